"""Matching against rule profiles that are tables: as many terms as there are rows.

A profile of a few hundred terms is one pattern per kind (``functions.predicates``).
Longer ones are joined instead. Every term is found by one key: terms looked for
as whole words by one of their words, terms looked for anywhere by bytes in
a row, of the longest of a few lengths (``SIZES``) that the term has: a long term is
found by a long key, so that few texts meet it that do not hold it. (The characters
before a place in a text need not be counted to find its bytes.) Of a term's
keys the one that the fewest texts hold is taken; a term with a key that no text
holds matches nothing and is dropped before the join. The whole term is verified on
each pair, so the result is that of the patterns, whichever key is taken.

A key is a number. A text has keys of the lengths that terms ask for; which of them
any term has is looked up in a bit field made of the terms' keys, and only those
are counted or moved. They are counted in buckets, so that a task hands on a bounded
number of counts, each with a few bits of the bucket's keys; keys of one bucket are taken
for equally common.

Keys that many texts hold are few. Terms found by one of them, ``BROADCAST_ROWS`` at
most, are sent to the texts, so no pair with them moves; all other terms meet the
texts that hold their key in a join. No rule is collected, and neither texts nor terms
are sent whole to every executor, which would pass them through the driver: the planner
takes a text's keys, made by a generator, for as small as the text. What is moved for
the join is dealt out over ``SALTS`` parts a key, so a key of many texts or terms that
stays in it makes no large task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedsift.functions import predicates, regex
from feedsift.functions.text import trim_spaces
from feedsift.rules import profiles, regions
from feedsift.session import BROADCAST_ROWS

RULE_SCHEMA = "profile STRING, kind STRING, ord INT, term STRING"
SIZES = (1, 2, 3, 4, 8, 16, 32)  # of the keys of terms that are looked for anywhere
SALTS = 16
BUCKETS_LOG2 = 20
CHUNK, FIELD_LOG2 = 1024, 20  # words of a bit field put together at once, and in a whole one at most
WORD, TITLE, PLACE = 0, 1, 2  # what a key is of: a title's words, a title's bytes, a place's bytes
_WORDS = "[a-z0-9_]+"


def profile_rows(name: str, profile: profiles.RuleProfile) -> list[tuple[str, str, int, str]]:
    """A profile as rows of a rule table."""
    kinds = {k: getattr(profile, k) for k in ("include", "exclude", "allow", "block")}
    return [(name, kind, n, term) for kind, terms in kinds.items() for n, term in enumerate(terms)]


def _grams(text: Column, size: Column) -> Column:
    """All runs of ``size`` bytes of a text."""
    n = F.octet_length(text) - size + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text.cast("binary"), i, size))).otherwise(
        F.array().cast("array<binary>")
    )


def _size(term: Column) -> Column:
    """The longest of SIZES that a term has; 0 for an empty one."""
    return F.array_max(F.filter(F.array(*(F.lit(n) for n in (0, *SIZES))), lambda n: n <= F.octet_length(term)))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORDS), F.lit(0))


def _key(field: Column, gram: Column) -> Column:
    """Number of a key; those of places are odd and those of titles even, so the two never meet."""
    return F.shiftleft(F.xxhash64(field, gram), 1).bitwiseOR(F.when(field == PLACE, 1).otherwise(0).cast("long"))


def _bits(key: Column, start: int, n: int) -> Column:
    return F.shiftrightunsigned(key, start).bitwiseAND(F.lit((1 << n) - 1).cast("long"))


def _mask(key: Column) -> Column:
    """Three bits of a word."""
    one = F.lit(1).cast("long")
    first, *more = (F.call_function("shiftleft", one, _bits(key, start, 6).cast("int")) for start in (1, 7, 13))
    return first.bitwiseOR(more[0]).bitwiseOR(more[1])


def _word(key: Column, n_words: Column) -> Column:
    """The word of a bit field that holds a key."""
    return _bits(key, 19, FIELD_LOG2).bitwiseAND(n_words - 1)


def _n_words(terms: DataFrame) -> Column:
    """Words of a bit field for the keys of so many terms, a power of two: one to two a term, up to the largest size."""
    log2 = F.least(F.ceil(F.log2(F.greatest(F.count(F.lit(1)), F.lit(CHUNK)))), F.lit(FIELD_LOG2)).cast("int")
    return terms.agg(F.call_function("shiftleft", F.lit(1).cast("long"), log2).alias("n")).scalar()


def _bit_field(keys: DataFrame, n_words: Column) -> Column:
    """All of ``key`` as one array of numbers, three bits a key."""
    none = F.explode(F.sequence(F.lit(0).cast("long"), n_words - 1))
    unset = keys.sparkSession.range(1).select(none.alias("word"), F.lit(0).cast("long").alias("bits"))
    held = keys.select(_word(F.col("key"), n_words).alias("word"), _mask(F.col("key")).alias("bits"))

    def joined(place: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct(place, "bits"))), lambda r: r["bits"])

    words = held.unionByName(unset).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    chunks = words.groupBy(F.floor(F.col("word") / CHUNK).alias("chunk")).agg(joined("word").alias("bits"))
    return chunks.agg(F.flatten(joined("chunk")).alias("bits")).scalar()


def _terms(rules: DataFrame, name: str) -> DataFrame:
    """Distinct terms of a profile with the keys each can be found by; ``field`` and ``size`` say of what kind these are."""
    low = F.lower("term")
    rows = rules.where((F.col("profile") == name) & F.col("term").isNotNull()).select("kind", low.alias("term")).distinct()
    term, words = F.col("term"), _words(F.col("term"))
    # A term of no word, looked for as a whole word, is found by its bytes like the others.
    field = (
        F.when((F.col("kind") == "exclude") & (F.size(words) > 0), WORD)
        .when(F.col("kind").isin("include", "exclude"), TITLE).otherwise(PLACE)
    )
    size = F.when(field == WORD, 0).otherwise(_size(term))
    rows = rows.select("kind", "term", field.alias("field"), size.alias("size"))

    def keys(grams: Column) -> Column:
        return F.transform(grams, lambda g: _key(F.col("field"), g))

    made = F.when(F.col("field") == WORD, keys(words)).when(term == "", keys(F.array(term))).otherwise(keys(_grams(term, F.col("size"))))
    return rows.withColumn("keys", F.array_distinct(made))


def _text_keys(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """Each text's keys of the kinds that terms have, with the text each is of; an empty term's is that of no byte."""
    asked = terms.agg(F.collect_set(F.struct("field", "size"))).scalar().alias("asked")
    words = F.transform(_words(F.col("title_low")), lambda w: _key(F.lit(WORD), w)).alias("words")
    # With ``row`` inside, no test on it is moved below the generator, which would make a second kind of texts to deal out.
    once = texts.select(F.inline(F.array(F.struct("row", "title_low", "location_low", words, asked))))
    made = once.select("row", "title_low", "location_low", "words", F.inline("asked"))
    text = F.when(F.col("field") == PLACE, F.col("location_low")).otherwise(F.col("title_low"))
    made = made.select("row", "words", "field", "size", text.alias("text"), text.cast("binary").alias("bytes"))
    one, n = F.lit(1).cast("long"), (F.octet_length("bytes") - F.col("size") + 1).cast("long")
    places = (
        F.when(F.col("field") == WORD, F.col("words")).when(F.col("size") == 0, F.array(one)).when(n > 0, F.sequence(one, n))
    )
    at = made.select("row", "field", "size", "text", "bytes", F.explode(places).alias("at"))
    gram = F.substring(F.col("bytes"), F.col("at").cast("int"), F.col("size"))
    key = F.when(F.col("field") == WORD, F.col("at")).otherwise(_key(F.col("field"), gram))
    return at.select("row", "text", F.explode(F.array(key)).alias("key"))  # made once, above what filters on it


def _probes(texts: DataFrame, terms: DataFrame, n_words: Column | None = None) -> DataFrame:
    """Each text's keys that one of the terms has, and a few others that share the bits of such."""
    n_words = _n_words(terms) if n_words is None else n_words
    field, key = _bit_field(terms.select(F.explode("keys").alias("key")), n_words), F.col("key")
    return _text_keys(texts, terms).where(F.get(field, _word(key, n_words).cast("int")).bitwiseAND(_mask(key)) == _mask(key))


def _rarest(terms: DataFrame, probes: DataFrame) -> DataFrame:
    """Each term with its rarest key, the least of equally rare ones; terms with a key that no text holds are gone.

    What is made of this is made more than once, so it must be the same each time.
    ``common``: the key is one that many texts hold. A bucket's terms are, if they are no more than its share of
    all counted keys times ``BROADCAST_ROWS``, so that there are no more than ``BROADCAST_ROWS`` of them in all.
    """
    bucket = _bits(F.col("key"), 64 - BUCKETS_LOG2, BUCKETS_LOG2)
    asked = terms.select("kind", "term", "field", "size", F.size("keys").alias("n_keys"), F.explode("keys").alias("key"))
    counts = probes.groupBy(bucket.alias("bucket")).agg(  # reduced per task before it moves
        F.count(F.lit(1)).alias("n"), F.bit_or(_mask(F.col("key"))).alias("bits")
    )
    shares = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
    held = asked.withColumn("bucket", bucket).hint("merge").join(shares, "bucket").where(F.col("bits").bitwiseAND(_mask(F.col("key"))) == _mask(F.col("key")))
    found = held.groupBy("kind", "term", "field", "size").agg(
        F.count(F.lit(1)).alias("held"), F.first("n_keys").alias("n_keys"), F.min(F.struct("share", "key")).alias("least")
    ).select("*", "least.*")
    n_terms = F.count(F.lit(1)).over(Window.partitionBy(bucket))
    return found.where(F.col("held") == F.col("n_keys")).select(
        "kind", "term", "field", "size", "key", F.array("key").alias("keys"), (n_terms <= F.col("share") * BROADCAST_ROWS).alias("common")
    )


def _hits(pairs: DataFrame) -> DataFrame:
    """What kinds of terms hold in each row, of its pairs of ``text`` and ``term`` that share a key."""
    quoted = F.replace("term", F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    whole = F.concat(F.lit(regex.BOUNDARY + "\\Q"), quoted, F.lit("\\E" + regex.BOUNDARY))
    holds = F.contains("text", F.col("term")) & ((F.col("kind") != "exclude") | F.regexp_like("text", whole))
    # A waived term counts only where the title is not exempt from it.
    counts = ~(F.col("term").isin(*profiles.EXEMPT_TERMS) & predicates.title_exempt("text"))
    return pairs.where(holds).groupBy("row").agg(
        F.bool_or(F.col("kind") == "include").alias("included"),
        F.bool_or((F.col("kind") == "exclude") & counts).alias("excluded"),
        F.bool_or(F.col("kind") == "allow").alias("allowed"),
        F.bool_or(F.col("kind") == "block").alias("blocked"),
    )


def _texts(listings: DataFrame, row: str) -> DataFrame:
    low = {f"{c}_low": F.lower(F.coalesce(c, F.lit(""))) for c in ("title", "location")}
    return listings.select(F.col(row).alias("row"), *(column.alias(n) for n, column in low.items()))


def with_rule_hits(listings: DataFrame, rules: DataFrame, name: str, row: str) -> DataFrame:
    """``listings`` with included, excluded, allowed, blocked: whether a term of that kind holds. ``row`` names a listing."""
    terms, n_words = _terms(rules, name), _n_words(rules.where(F.col("profile") == name))
    picked = _rarest(terms, _probes(_texts(listings, row), terms, n_words))
    common, rare = picked.where("common"), picked.where("NOT common")
    # Dealt by row once, for both kinds of terms and the join with what they hit.
    dealt = listings.repartition(F.col(row))
    texts = _texts(dealt, row)
    near = _text_keys(texts, common).join(F.broadcast(common.select("kind", "term", "key")), "key")
    salted = rare.select("kind", "term", "key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    moved = _probes(texts, rare, n_words).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    far = moved.hint("merge").join(salted, ["key", "salt"])
    kinds, found = ("included", "excluded", "allowed", "blocked"), dealt
    for n, pairs in enumerate((near, far)):
        hits = _hits(pairs).select(F.col("row").alias(f"_row{n}"), *(F.col(kind).alias(f"_{kind}{n}") for kind in kinds))
        found = found.join(hits, F.col(row) == F.col(f"_row{n}"), "left")
    held = {kind: F.coalesce(f"_{kind}0", F.lit(False)) | F.coalesce(f"_{kind}1", F.lit(False)) for kind in kinds}
    return found.select(*listings.columns, *(column.alias(kind) for kind, column in held.items()))


def matched_by_table(listings: DataFrame, rules: DataFrame, name: str, row: str = "seq") -> DataFrame:
    """Listings a profile kept as a table lets through; the same rows as ``predicates.matches_profile``."""
    n_allow = rules.where((F.col("profile") == name) & (F.col("kind") == "allow")).agg(F.count(F.lit(1)).alias("n"))
    trimmed = trim_spaces(F.lower(F.coalesce("location", F.lit(""))))
    unknown = (trimmed == "") | trimmed.rlike(regex.jvm(regions.OPAQUE_LOCATION_PATTERN))
    named = F.when(F.col("_n_allow") > 0, F.col("allowed")).otherwise(predicates.looks_us("location"))
    found = with_rule_hits(listings, rules, name, row).withColumn("_n_allow", n_allow.scalar())
    return found.where(F.col("included") & ~F.col("excluded") & ~F.col("blocked") & (unknown | named)).select(listings.columns)
