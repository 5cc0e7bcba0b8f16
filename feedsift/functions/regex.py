"""One pattern notation, two engines.

Rule patterns use ``\\b`` for an ASCII word boundary and ``\\s`` for any
whitespace including the Unicode spaces. The JVM's ``\\b`` counts accented
letters as word characters on older Java and its ``\\s`` is ASCII only, so both
are spelled out before a pattern reaches Spark.
"""

from __future__ import annotations

# Whitespace as a character-class body.
SPACE_BODY = (
    r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
SPACE = f"[{SPACE_BODY}]"
_WORD = "[A-Za-z0-9_]"
_NOT_AFTER = f"(?!{_WORD})"
BOUNDARY = f"(?:(?<={_WORD}){_NOT_AFTER}|(?<!{_WORD})(?={_WORD}))"


def _is_word(ch: str) -> bool:
    return ch.isascii() and (ch.isalnum() or ch == "_")


def _literal_run(pattern: str) -> str:
    """Plain characters the pattern starts with, if the first is a word character."""
    run = ""
    while pattern[len(run) : len(run) + 1] and (
        _is_word(pattern[len(run)]) or (run and pattern[len(run)] == " ")
    ):
        run += pattern[len(run)]
    return run[:-1] if pattern[len(run) : len(run) + 1] in ("?", "*", "{", "+") else run


def _boundary_before(rest: str) -> tuple[str, int]:
    """Spelling of a ``\\b`` that stands before ``rest``, and how much of ``rest`` it takes in.

    Before a literal the literal comes first and the look-behind after it: a
    search then skips from literal to literal instead of looking back at every
    character. Before a group whose branches start with literals each branch
    gets its own boundary.
    """
    run = _literal_run(rest)
    if run:
        return f"{run}(?<!{_WORD}{run})", len(run)
    end = _closing(rest) if rest.startswith("(") else 0
    if end and rest[end + 1 : end + 2] not in ("?", "*", "{", "+"):
        opening = "(?:" if rest.startswith("(?:") else "("
        branches = _split_alternatives(rest[len(opening) : end])
        if all(_literal_run(branch) for branch in branches):
            spelled = "|".join(jvm(r"\b" + branch) for branch in branches)
            return f"{opening}{spelled})", end + 1
    return BOUNDARY, 0


def jvm(pattern: str, ignore_case: bool = False) -> str:
    """``pattern`` for Spark's regex functions."""
    out, pos, in_class = [], 0, False
    while pos < len(pattern):
        two = pattern[pos : pos + 2]
        before = pattern[pos - 1 : pos]
        if two == r"\b" and before and _is_word(before) and pattern[pos - 2 : pos - 1] != "\\":
            out.append(_NOT_AFTER)
        elif two == r"\b":
            spelled, taken = _boundary_before(pattern[pos + 2 :])
            out.append(spelled)
            pos += taken
        elif two == r"\s":
            out.append(SPACE_BODY if in_class else SPACE)
        elif two[0] == "\\":
            out.append(two)
        else:
            in_class = two[0] == "[" or (in_class and two[0] != "]")
            out.append(two[0])
            pos -= 1
        pos += 2
    return ("(?i)" if ignore_case else "") + "".join(out)


def escape(term: str) -> str:
    """``term`` as a literal inside a pattern."""
    return "".join("\\" + ch if ch in r".*+?^${}()|[]\-/#&~" else ch for ch in term)


def whole_word(terms) -> str:
    """Pattern for any of ``terms`` as a whole word."""
    return r"\b(?:" + "|".join(escape(t.lower()) for t in terms) + r")\b"


def any_of(terms) -> str:
    """Pattern that finds any of ``terms`` as a substring.

    Terms that start alike share their prefix, so each position of the text is
    tried once per distinct next character instead of once per term. Only
    "is one of them there" is kept: a term that extends another is redundant.
    """
    by_first: dict[str, list[str]] = {}
    for term in terms:
        by_first.setdefault(term[:1], []).append(term[1:])
    if "" in by_first:
        return ""
    branches = [
        escape(first + rest[0]) if len(rest) == 1 else escape(first) + any_of(rest)
        for first, rest in by_first.items()
    ]
    return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"


def _split_alternatives(pattern: str) -> list[str]:
    parts, depth, start, pos = [], 0, 0, 0
    while pos < len(pattern):
        ch = pattern[pos]
        if ch == "\\":
            pos += 2
            continue
        depth += (ch in "([") - (ch in ")]")
        if ch == "|" and depth == 0:
            parts.append(pattern[start:pos])
            start = pos + 1
        pos += 1
    return parts + [pattern[start:]]


def required_literals(pattern: str) -> list[str] | None:
    """Lower-case literals, one of which every match starts with; None when a match may start otherwise."""
    found = []
    for alternative in _split_alternatives(pattern):
        body = alternative.removeprefix(r"\b")
        group = body.startswith("(") and _closing(body)
        if group and body[group + 1 : group + 2] not in ("?", "*", "{"):
            inner = required_literals(body[1:group].removeprefix("?:"))
            if inner is None:
                return None
            found += inner
            continue
        literal = ""
        while body and (body[0] not in r".*+?^${}()|[]\ ".strip() or _escaped_literal(body)):
            size = 2 if body[0] == "\\" else 1
            if body[size : size + 1] in ("?", "*", "{"):
                break
            literal += body[size - 1]
            body = body[size:]
        if not literal:
            return None
        found.append(literal.lower())
    return found


def _escaped_literal(body: str) -> bool:
    return len(body) > 1 and body[0] == "\\" and not body[1].isalnum()


def _closing(body: str) -> int:
    """Position of the bracket that closes the group ``body`` starts with."""
    depth = 0
    for pos, ch in enumerate(body):
        if pos and body[pos - 1] == "\\":
            continue
        depth += (ch == "(") - (ch == ")")
        if depth == 0:
            return pos
    return 0
