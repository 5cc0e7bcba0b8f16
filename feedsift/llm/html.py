"""Text of web pages as a reader sees it, laid out in lines.

A page becomes a tree: tags that a new tag or the end implies are closed, tags
that have no counterpart are ignored. What does not show (head, scripts,
comments, hidden elements) gives nothing. Blocks stand on lines of their own,
paragraphs and their like with a blank line around them; list items have marks
and indents; table cells stand in aligned columns, and what a table holds
outside of cells stands before it; blanks collapse except in preformatted text.

Cases: a null or empty page gives an empty text; broken markup never fails;
elements nested deeper than DEPTH are taken as siblings; texts are not cut.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from feedsift.llm.batches import arrow_map

DEPTH = 200
# Cells wider than this do not widen their column; their text is whole all the same.
COLUMN_WIDTH = 60

# Elements by how they behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset(
    "head title script style template noscript iframe object audio video canvas svg datalist select".split()
)
RAW = frozenset("script style textarea title noscript iframe".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure fieldset".split())
BLOCKS = SPACED | frozenset(
    "html body address article aside dd details dialog div dt figcaption footer form header hgroup hr legend li main "
    "nav section summary tr caption thead tbody tfoot td th".split()
)
# A start tag of the key closes open tags of the value, up to the nearest boundary.
CLOSES = {
    "li": "li", "dt": "dt dd", "dd": "dt dd", "option": "option", "tr": "tr td th", "td": "td th", "th": "td th",
    "thead": "tr td th thead tbody tfoot caption", "tbody": "tr td th thead tbody tfoot caption",
    "tfoot": "tr td th thead tbody tfoot caption", "body": "head",
}
CLOSES = {k: frozenset(v.split()) for k, v in CLOSES.items()}
BOUNDARY = frozenset("table html".split())
LISTS = frozenset("ul ol dl".split())
SECTIONS = frozenset("thead tbody tfoot".split())
CELLS = frozenset("td th".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*+)[^>]*+>?"
    r"|<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*+)([^>]*+)>|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_BLANKS = re.compile(r"[ \t\n\r\f]+")


@dataclass(slots=True)
class Node:
    tag: str
    attributes: str = ""
    parts: list = field(default_factory=list)  # nodes and texts

    def value(self, name: str) -> str | None:
        """An attribute's value, None without it."""
        for m in _ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return unescape(m[2] or m[3] or m[4] or "")
        return None

    def shows(self) -> bool:
        if self.tag in UNSEEN:
            return False
        if not self.attributes:
            return True
        if self.value("hidden") is not None or (self.tag == "input" and self.value("type") == "hidden"):
            return False
        return not _HIDDEN_STYLE.search(self.value("style") or "")


def tree(page: str) -> Node:
    """The page's elements, with implied ends put in."""
    root = Node("html")
    open_nodes = [root]
    at = 0

    def close(tags: frozenset[str], boundary: frozenset[str]) -> None:
        """Close up to and with the outermost open element of ``tags`` inside the boundary."""
        for k in range(len(open_nodes) - 1, 0, -1):
            tag = open_nodes[k].tag
            if tag in boundary and tag not in tags:
                break
            if tag in tags:
                del open_nodes[k:]

    def text(piece: str, raw: bool = False) -> None:
        if piece:
            open_nodes[-1].parts.append(piece if raw or "&" not in piece else unescape(piece))

    length = len(page)
    while at < length:
        found = _TOKEN.search(page, at)
        if not found:
            text(page[at:])
            break
        text(page[at:found.start()])
        at = found.end()
        if found[1]:
            tag = found[1].lower()
            if tag == "br":
                open_nodes[-1].parts.append(Node("br"))
                continue
            for k in range(len(open_nodes) - 1, 0, -1):
                if open_nodes[k].tag == tag:
                    del open_nodes[k:]
                    break
                if open_nodes[k].tag == "table" and tag not in BOUNDARY:
                    break
        elif name := found[2] or found[4]:  # the latter has a quote that is never closed
            tag, attributes = name.lower(), found[3] or found[5] or ""
            if tag == "html":
                continue
            if tag in CLOSES:
                close(CLOSES[tag], BOUNDARY | LISTS if tag in ("li", "dt", "dd") else BOUNDARY)
            if tag in BLOCKS:
                for k in range(len(open_nodes) - 1, 0, -1):  # a block ends an open paragraph
                    if open_nodes[k].tag == "p":
                        del open_nodes[k:]
                        break
                    if open_nodes[k].tag in BLOCKS:
                        break
                if tag != "head" and open_nodes[-1].tag == "head":
                    open_nodes.pop()
            if tag in CELLS and (open_nodes[-1].tag == "table" or open_nodes[-1].tag in SECTIONS) and len(open_nodes) < DEPTH:
                row = Node("tr")
                open_nodes[-1].parts.append(row)
                open_nodes.append(row)
            node = Node(tag, attributes)
            open_nodes[-1].parts.append(node)
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>?", re.I).search(page, at)
                inner = page[at:end.start() if end else length]
                node.parts.append(unescape(inner) if tag in ("title", "textarea") else inner)
                at = end.end() if end else length
            elif tag not in VOID and not attributes.endswith("/") and len(open_nodes) < DEPTH:
                open_nodes.append(node)
        elif found[0] == "<":
            text("<")
            if page.find(">", at) < 0:  # no tag can follow
                text(page[at:])
                break
    return root


class Page:
    """Lines under construction."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []  # of the line now
        self.blank = False  # a blank is due before the next word
        self.gap = False  # an empty line is due before the next line
        self.indent = ""
        self.mark = ""  # of the list item that begins

    def words(self, text: str) -> None:
        if not text.strip(" \t\n\r\f"):
            self.blank = self.blank or bool(text and self.parts)
            return
        shrunk = _BLANKS.sub(" ", text)
        if self.parts and (self.blank or shrunk[0] == " "):
            self.parts.append(" ")
        self.blank = shrunk[-1] == " "
        self.parts.append(shrunk.strip(" "))

    def raw(self, text: str) -> None:
        for n, line in enumerate(text.split("\n")):
            if n:
                self.end_line(empty=True)
            if line:
                self.parts.append(line)

    def end_line(self, empty: bool = False) -> None:
        """End the line now; without words there is one only if ``empty``."""
        if self.parts or empty:
            if self.gap and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = False
            lead = self.indent
            if self.mark:
                lead = lead[:len(lead) - len(self.mark)] + self.mark
                self.mark = ""
            self.lines.append((lead + "".join(self.parts)).rstrip())
        self.parts, self.blank = [], False

    def space(self) -> None:
        self.end_line()
        self.gap = True

    def block(self, lines: list[str]) -> None:
        for line in lines:
            self.parts = [line] if line else []
            self.end_line(empty=True)


def _span(node: Node) -> int:
    value = node.value("colspan") or ""
    return min(int(value), 1000) if value.isascii() and value.isdigit() and value != "0" else 1


def _wraps(node: Node) -> bool:
    """Whether an element holds rows or cells of the table around it."""
    return any(
        isinstance(part, Node) and part.shows()
        and (part.tag == "tr" or part.tag in CELLS or (part.tag != "table" and _wraps(part)))
        for part in node.parts
    )


def _laid(node: Node, rows: list[list[Node]], beside: list[list], row: list[Node] | None = None) -> None:
    """Add the rows of cells in a table or a part of it, and runs of what stands in no cell."""
    run: list = []
    for part in node.parts:
        if isinstance(part, Node) and not part.shows():
            continue
        tag = "" if isinstance(part, str) else part.tag
        if tag in CELLS:
            if row is None:
                row = []
                rows.append(row)
            row.append(part)
        elif tag == "tr":
            row = None
            rows.append([])
            _laid(part, rows, beside, rows[-1])
        elif tag in SECTIONS or (tag and _wraps(part)):
            _laid(part, rows, beside, row)
        elif node.tag == "table" or tag not in VOID:
            if not run:
                beside.append(run)
            run.append(part)
            continue
        run = []


def _table(rows: list[list[Node]]) -> list[str]:
    """Lines of a table: cells in columns, columns two blanks apart."""
    grid: list[list[tuple[int, list[str]]]] = []  # per row: first column and lines of each cell
    widths: dict[int, int] = {}
    for row in rows:
        column, cells = 0, []
        for cell in row:
            lines, span = text_lines(cell), _span(cell)
            cells.append((column, lines))
            if span == 1:
                wide = max((len(line) for line in lines if len(line) <= COLUMN_WIDTH), default=0)
                widths[column] = max(widths.get(column, 0), wide)
            column += span
        grid.append(cells)
    starts, at = {}, 0
    for column in range(max((c for cells in grid for c, _ in cells), default=-1) + 1):
        starts[column] = at
        at += widths.get(column, 0) + 2
    out = []
    for cells in grid:
        for n in range(max((len(lines) for _, lines in cells), default=0)):
            line = ""
            for column, lines in cells:
                if n < len(lines) and lines[n]:
                    line = line.ljust(starts[column] if len(line) + 2 <= starts[column] or not line else len(line) + 2)
                    line += lines[n]
            out.append(line)
    return out


def _render(node: Node, page: Page, pre: bool) -> None:
    number = 0
    for part in node.parts:
        if isinstance(part, str):
            (page.raw if pre else page.words)(part)
            continue
        tag = part.tag
        if tag == "br":
            page.end_line(empty=True)
        elif not part.shows():
            continue
        elif tag == "hr":
            page.space()
        elif tag == "table":
            page.space()
            rows, beside = [], []
            _laid(part, rows, beside)
            for run in beside:  # captions, and what stands in no cell
                for piece in run:
                    if isinstance(piece, str):
                        page.words(piece)
                    else:
                        _render(Node("div", "", [piece]), page, pre)
                page.end_line()
            page.block(_table(rows))
            page.space()
        elif tag in BLOCKS:
            spaced = tag in SPACED and not (tag in ("ul", "ol") and node.tag == "li")
            page.space() if spaced else page.end_line()
            indent = page.indent
            if tag == "li":
                number += 1
                mark = f"{number}. " if node.tag == "ol" else "- "
                page.indent += " " * len(mark)
                page.mark = mark
            elif tag in ("dd", "blockquote"):
                page.indent += "  "
            _render(part, page, pre or tag == "pre")
            page.end_line()
            page.indent, page.mark = indent, ""
            if spaced:
                page.gap = True
        else:
            _render(part, page, pre or tag in ("textarea",))


def text_lines(node: Node) -> list[str]:
    page = Page()
    _render(node, page, False)
    page.end_line()
    lines = page.lines
    while lines and not lines[-1]:
        lines.pop()
    return lines


def page_text(page: str | None) -> str:
    """All visible text of a page."""
    return "\n".join(text_lines(tree(page))) if page else ""


def _rendered(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = [page_text(p) for p in batch["html"].to_pylist()]
    return pa.RecordBatch.from_arrays(
        [batch["page_id"], pa.array([len(t) for t in texts], pa.int64()), pa.array(texts)],
        names=["page_id", "n_chars", "text"],
    )


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, n_chars and text of each page (page_id, html)."""
    kind = dict(pages.dtypes)["page_id"]
    return arrow_map(
        pages.select("page_id", "html"), _rendered, f"page_id {kind}, n_chars bigint, text string", text="html"
    )
