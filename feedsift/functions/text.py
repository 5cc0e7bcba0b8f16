"""Text cleaning and chunking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedsift.functions.regex import SPACE
from feedsift.rules.signals import MESSAGE_LIMIT


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def folded(text: Column | str) -> Column:
    """Lower-case text on which plain patterns find what case-blind ASCII patterns find on the original.

    Two letters turn into ASCII ones when lowered (the Kelvin sign and the
    dotted capital I); they are masked first.
    """
    masked = _column(text)
    for letter in ("\u212a", "\u0130"):
        masked = F.replace(masked, F.lit(letter), F.lit("\u00a4"))
    return F.lower(masked)


def squeeze(text: Column | str) -> Column:
    """Each run of whitespace becomes one space."""
    return F.regexp_replace(_column(text), f"{SPACE}+", " ")


def trim_spaces(text: Column | str) -> Column:
    """Trim every kind of whitespace (Spark's ``trim`` takes the plain space only)."""
    return F.regexp_replace(_column(text), rf"^{SPACE}+|{SPACE}+$", "")


def strip_tags(text: Column | str) -> Column:
    """Replace each non-empty tag by a space, squeeze whitespace, trim."""
    return F.trim(squeeze(F.regexp_replace(_column(text), "<[^>]+>", " ")))


def decode_entities(text: Column | str) -> Column:
    """Decode the handful of entities feeds use; the ampersand comes last so nothing is decoded twice."""
    out = _column(text)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(out, "&#(?:0?39|[xX]27);", "'")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def escape_html(text: Column | str) -> Column:
    out = _column(text)
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def join_parts(separator: str, *parts: Column) -> Column:
    """Join the parts that are neither null nor empty."""
    return F.concat_ws(separator, *(F.nullif(p, F.lit("")) for p in parts))


def chunk_text(text: Column | str, limit: int = MESSAGE_LIMIT) -> Column:
    """Cut ``text`` into pieces of at most ``limit`` code points, in order.

    Paragraphs are packed greedily; a paragraph over the limit is packed line
    by line; a line over the limit is cut into slices that stand alone. A text
    within the limit stays as it is. The fold carries (pieces so far, open
    piece) and runs inside one row, so no shuffle is involved.
    """
    text = _column(text)
    no_pieces = F.array().cast("array<string>")
    no_open = F.lit("")

    def state(pieces: Column, open_piece: Column) -> Column:
        return F.struct(pieces.alias("pieces"), open_piece.alias("open_piece"))

    def closed(st: Column) -> Column:
        return F.when(st["open_piece"] == "", st["pieces"]).otherwise(
            F.array_append(st["pieces"], st["open_piece"])
        )

    def appended(st: Column, glue: str, piece: Column) -> Column:
        return F.when(st["open_piece"] == "", piece).otherwise(
            F.concat(st["open_piece"], F.lit(glue), piece)
        )

    def fits(piece: Column) -> Column:
        return F.length(piece) <= limit

    def add_line(st: Column, line: Column) -> Column:
        slices = F.regexp_extract_all(line, F.lit(f"(?s).{{1,{limit}}}"), F.lit(0))
        joined = appended(st, "\n", line)
        return (
            F.when(~fits(line), state(F.concat(closed(st), slices), no_open))
            .when(fits(joined), state(st["pieces"], joined))
            .otherwise(state(closed(st), line))
        )

    def add_paragraph(st: Column, paragraph: Column) -> Column:
        joined = appended(st, "\n\n", paragraph)
        by_line = F.aggregate(
            F.split(paragraph, "\n", -1), state(closed(st), no_open), add_line
        )
        return (
            F.when(fits(joined), state(st["pieces"], joined))
            .when(fits(paragraph), state(closed(st), paragraph))
            .otherwise(by_line)
        )

    folded = F.aggregate(
        F.split(text, "\n\n", -1), state(no_pieces, no_open), add_paragraph, closed
    )
    return F.when(fits(text), F.array(text)).otherwise(folded)
