"""Secret scans: a trigram inverted index proposes rules per text, regexes decide.

From each rule's regex the driver derives which letter triples a match must
hold: alternatives of sets of trigrams. The trigrams that rules ask for are
looked up in every text, which gives posting lists (trigram, document).
Intersecting the lists of an alternative gives the documents that may match;
only there its regex runs. A rule without mandatory trigrams scans every text.
All of it is column expressions.

Trigrams are compared without regard to case, so they never miss a match.
Spans are code points, end exclusive. Cases: a null text is empty; rows of one
doc_id are told apart by their text, repeated rows get equal results; a row
without a doc_id is scanned like others; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedsift.llm.scratch import text_key
from feedsift.operators.columns import computed_once


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` count if group ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The first three kinds and their patterns.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 8,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hosting_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES
MASK = "[secret]"

# Alternatives kept per rule; beyond, a part of the pattern is not used.
_ALTERNATIVES = 64


def _parts(nodes) -> list[set[str]]:
    """Parts that follow one another; of each, a match holds one of the strings."""
    parts: list[set[str]] = []
    now = {""}

    def flush() -> None:
        nonlocal now
        parts.append(now)
        now = {""}

    def extend(more: set[str]) -> None:
        nonlocal now
        if len(now) * len(more) > _ALTERNATIVES:
            flush()
        now = {a + b for a, b in product(now, more)}

    for op, arg in nodes:
        name = str(op)
        if name == "LITERAL":
            extend({chr(arg)})
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            extend({chr(c) for _, c in arg})
        elif name in ("SUBPATTERN", "BRANCH"):
            branches = [arg[-1]] if name == "SUBPATTERN" else arg[1]
            inner = [_parts(b) for b in branches]
            if len(inner) == 1 and len(inner[0]) > 1:
                flush()
                parts.extend(inner[0])
            elif all(len(x) == 1 for x in inner):
                extend(set().union(*(x[0] for x in inner)))
            else:
                flush()
        elif name == "MAX_REPEAT" and arg[:2] == (0, 1) and len(inner := _parts(arg[2])) == 1:
            extend(inner[0] | {""})
        elif name == "MAX_REPEAT" and arg[0] == arg[1] and arg[0] <= 3 and len(inner := _parts(arg[2])) == 1:
            for _ in range(arg[0]):
                extend(inner[0])
        else:
            flush()
    flush()
    return parts


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of trigrams that a match holds, lower-cased; none: no condition."""
    alternatives = {frozenset()}
    for part in _parts(_parser.parse(pattern)):
        sets = {frozenset(s[i:i + 3].lower() for i in range(len(s) - 2)) for s in part}
        if frozenset() not in sets and len(alternatives) * len(sets) <= _ALTERNATIVES:
            alternatives = {a | b for a, b in product(alternatives, sets)}
    least = [a for a in alternatives if not any(b < a for b in alternatives)]
    return [] if frozenset() in alternatives else sorted(least, key=sorted)


# Elements put together at once: a list that grows is copied at each step, so long ones are made of short ones.
_TOGETHER = 256
_SPAN = "struct<start:bigint,rule:int,end:bigint>"


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _chunks(size: Column, part: Callable[[Column, Column], Column]) -> Column:
    """``part`` (first place from 1, count) of each stretch of a list of ``size`` elements."""
    starts = F.sequence(F.lit(0), size - 1, F.lit(_TOGETHER))
    return F.when(size > 0, F.transform(starts, lambda i: part(i + 1, F.least(size - i, F.lit(_TOGETHER)))))


def matches(text: Column, rule: Rule) -> Column:
    """Of each match of a rule: characters since the last one, characters in it, and whether it counts."""
    pattern = F.lit(rule.pattern)

    def sizes(texts: Column) -> Column:
        return F.transform(texts, lambda x: F.char_length(x))

    group = sizes(F.regexp_extract_all(text, pattern, F.lit(rule.group)))
    some = F.struct(
        sizes(F.split(text, rule.pattern, -1)).alias("between"),
        sizes(F.regexp_extract_all(text, pattern, F.lit(0))).alias("within"),
        F.transform(group, lambda n: n >= F.lit(rule.least)).alias("counts"),
    )
    return F.when(text.rlike(rule.pattern), some)


def spans(found: Column, rule: Rule) -> Column:
    """Spans of a rule, in order, from its ``matches`` (a stored column): start, number of the rule, end."""
    def part(at: Column, count: Column) -> Column:
        return F.arrays_zip(*(F.slice(found[c], at, count).alias(c) for c in ("between", "within", "counts")))

    def step(state: Column, m: Column) -> Column:
        start = state["at"] + m["between"]
        span = F.struct(
            start.cast("bigint").alias("start"), F.lit(RULES.index(rule)).alias("rule"),
            (start + m["within"]).cast("bigint").alias("end"),
        )
        out = F.when(m["counts"], F.array_append(state["out"], span)).otherwise(state["out"])
        return F.struct((start + m["within"]).alias("at"), out.alias("out"))

    def several(state: Column, chunk: Column) -> Column:
        start = F.struct(state["at"].alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
        return _bound(F.aggregate(chunk, start, step), lambda r: F.struct(
            r["at"].alias("at"), F.array_append(state["out"], r["out"]).alias("out")
        ))

    chunks = _chunks(F.size(found["within"]), part)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<array<{_SPAN}>>").alias("out"))
    walked = F.aggregate(chunks, start, several, lambda s: F.flatten(s["out"]))
    return F.coalesce(walked, F.array().cast(f"array<{_SPAN}>"))


def _with_spans(rows: DataFrame, text: Column, rules: dict[Rule, Column], name: str) -> DataFrame:
    """Spans of the rules whose condition holds, in place of the text; each regex runs once over a text."""
    made = {f"_matches_{RULES.index(r)}": F.when(holds, matches(text, r)) for r, holds in rules.items()}
    scanned = computed_once(rows, made)
    each = [spans(F.col(f"_matches_{RULES.index(r)}"), r) for r in rules]
    return scanned.select(*[c for c in rows.columns if c != "text"], F.concat(*each).alias(name))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """trigram, doc_id, text_key: the part of the inverted index that rules ask for."""
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    held = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("low"), t))
    return (
        docs.select("doc_id", text_key().alias("text_key"), low.alias("low"))
        .select(F.explode(held).alias("trigram"), "doc_id", "text_key")
    )


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id, text_key, rules: bits of the rules whose query the posting lists fulfil."""
    wanted = [(RULES.index(r), clause) for r in rules for clause in trigram_query(r.pattern)]
    uses: dict[str, list[Column]] = {}
    for number, (_, clause) in enumerate(wanted):
        for at, trigram in enumerate(sorted(clause)):
            uses.setdefault(trigram, []).append(
                F.struct(F.lit(number).alias("clause"), F.lit(1 << at).cast("bigint").alias("bit"))
            )
    by_trigram = F.create_map(*[x for t, u in uses.items() for x in (F.lit(t), F.array(*u))])
    full = F.array(*[F.lit((1 << len(clause)) - 1).cast("bigint") for _, clause in wanted])
    rule_bit = F.array(*[F.lit(1 << rule).cast("bigint") for rule, _ in wanted])
    met = (
        postings(docs, sorted(uses))
        .select("doc_id", "text_key", F.explode(by_trigram[F.col("trigram")]).alias("use"))
        .groupBy("doc_id", "text_key", F.col("use.clause").alias("clause"))
        .agg(F.bit_or("use.bit").alias("bits"))
        .filter(F.col("bits") == full[F.col("clause")])
    )
    return met.groupBy("doc_id", "text_key").agg(F.bit_or(rule_bit[F.col("clause")]).alias("rules"))


def indexed_spans(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id, text_key, spans of texts where a rule with trigrams matches."""
    found = candidates(docs, rules).withColumnsRenamed({"doc_id": "_doc_id", "text_key": "_text_key"})
    named = docs.select("doc_id", text_key().alias("text_key"), "text")
    tested = named.join(
        found, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_key") == F.col("_text_key"))
    )
    holds = {r: F.col("rules").bitwiseAND(F.lit(1 << RULES.index(r))) != 0 for r in rules}
    return (
        _with_spans(tested.select("doc_id", "text_key", "rules", "text"), F.col("text"), holds, "spans")
        .filter(F.size("spans") > 0)
        .groupBy("doc_id", "text_key").agg(F.first("spans").alias("spans"))
    )


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and sorted spans of each row; ``start``, ``rule``, ``end`` in a span."""
    indexed = tuple(r for r in RULES if trigram_query(r.pattern))
    scanned = tuple(r for r in RULES if r not in indexed)
    named = docs.select("doc_id", text_key().alias("text_key"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    everywhere = _with_spans(named, F.col("text"), {r: F.lit(True) for r in scanned}, "scanned")
    proposed = indexed_spans(docs, indexed).select(
        F.col("doc_id").alias("_doc_id"), F.col("text_key").alias("_text_key"), "spans"
    )
    joined = everywhere.join(
        proposed, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_key") == F.col("_text_key")), "left"
    )
    whole = F.when(F.col("spans").isNull(), F.col("scanned")).otherwise(F.concat("scanned", "spans"))
    return joined.select("doc_id", "text_key", F.array_sort(whole).alias("spans"))


def told(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in RULES])
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", kinds[s["rule"]], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Counts per base kind, digest of base spans and all spans of each document."""
    found = F.col("spans")

    def count(number: int) -> Column:
        return F.size(F.filter(found, lambda s: s["rule"] == number)).cast("bigint")

    base = F.filter(found, lambda s: s["rule"] < len(BASE_RULES))
    return secret_spans(docs).select(
        "doc_id",
        *[count(n).alias(f"n_{r.kind}") for n, r in enumerate(BASE_RULES)],
        F.sha2(told(base), 256).alias("base_sha256"),
        told(found).alias("spans"),
    )


def masked(text: Column, found: Column) -> Column:
    """The text with each stretch of spans replaced by MASK.

    The text is cut at every ``_TOGETHER``-th span first, so that a span is looked
    for in its stretch of the text and not from the text's start.
    """
    def step(part: Column, base: Column):
        def put(state: Column, s: Column) -> Column:
            before = F.substring(part, (state["at"] - base + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
            out = F.when(
                s["start"] >= state["at"], F.array_append(F.array_append(state["out"], before), F.lit(MASK))
            ).otherwise(state["out"])
            return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

        return put

    def several(state: Column, chunk: Column) -> Column:
        def cut(end: Column) -> Column:
            start = F.struct(state["at"].alias("at"), F.array().cast("array<string>").alias("out"))
            part = F.substring(state["rest"], F.lit(1), (end - state["at"]).cast("int"))
            done = _bound(part, lambda p: F.aggregate(chunk, start, step(p, state["at"]), lambda s: F.array_join(s["out"], "")))
            rest = F.substring(state["rest"], (end - state["at"] + 1).cast("int"), F.lit(2**31 - 1))
            return F.struct(end.alias("at"), rest.alias("rest"), F.array_append(state["out"], done).alias("out"))

        ends = F.array_max(F.transform(chunk, lambda s: s["end"]))
        return _bound(F.greatest(state["at"], ends), cut)

    start = F.struct(F.lit(0).cast("bigint").alias("at"), text.alias("rest"), F.array().cast("array<string>").alias("out"))
    chunks = _chunks(F.size(found), lambda at, count: F.slice(found, at, count))
    joined = F.aggregate(chunks, start, several, lambda s: F.concat(F.array_join(s["out"], ""), s["rest"]))
    return F.when(F.size(found) > 0, joined).otherwise(text)
