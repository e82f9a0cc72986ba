"""HTML extraction: layout-aware rendering of all visible text.

A tree is built from the tag stream with implied tags (a paragraph ends before a block, list items
and table parts end one another, stray end tags are ignored), then rendered by visibility and layout
rules: blocks on lines of their own, blank lines around paragraphs and headings, bullets and numbers
for lists, table columns padded to their widest cell, white space kept inside ``pre``.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element classes of the HTML standard that the rules need.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = set("head script style template noscript title meta link object iframe audio video canvas svg datalist textarea select".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure article section header footer nav aside main hr fieldset form".split())
BLOCK = SPACED | set("html body div li dt dd tr caption thead tbody tfoot address details summary figcaption center legend option".split())
CLOSES_P = BLOCK - {"li", "dt", "dd", "tr", "caption", "thead", "tbody", "tfoot", "html", "body", "option", "legend"}
#: A start tag ends these open elements, looked for up to the given containers.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
HEAD_ONLY = {"head", "meta", "title", "link", "script", "style", "base", "template", "noscript", "html"}

# Attributes as browsers read them: a quote opens a string only right after "=" and white space; elsewhere it is a character.
# The quantifiers are possessive, so a tag is read in one pass.
_NAME = r"[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[ \t\n\f\r/]++|" + _NAME
    + r"(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^ \t\n\f\r>\"'][^ \t\n\f\r>]*+)?+)?+)*+)(?:>|\Z)", re.S,
)
_ATTR = re.compile(rf"({_NAME})" + r"(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^ \t\n\f\r>\"'][^ \t\n\f\r>]*+))?+)?+")
_SPACE = re.compile(r"[ \t\n\f\r]+")
_NO_SHOW = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)


class Node:
    __slots__ = ("attrs", "kids", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids = tag, attrs, []

    def attributes(self) -> dict[str, str]:
        return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(self.attrs)}


def build(page: str) -> Node:
    """Tree of a page; every start and end tag finds its place, whatever is missing."""
    root = Node("#root")
    stack, at = [root], 0

    def end(tags: set[str], stop: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in stop:
                return

    def add_text(text: str) -> None:
        if text:
            if stack[-1].tag == "head" and not text.isspace():
                stack.pop()
            stack[-1].kids.append(html.unescape(text))

    while at < len(page):
        lt = page.find("<", at)
        m = _TOKEN.match(page, lt) if lt >= 0 else None
        if lt < 0:
            add_text(page[at:])
            break
        if m is None:  # a bare "<"
            nxt = page.find("<", lt + 1)
            nxt = len(page) if nxt < 0 else nxt
            add_text(page[at:nxt])
            at = nxt
            continue
        add_text(page[at:lt])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br" or (tag == "p" and not any(n.tag == "p" for n in stack)):
                stack[-1].kids.append(Node(tag))
            elif tag not in ("html", "body"):
                end({tag}, {"td", "th", "table"} if tag not in ("td", "th", "tr", "table", "thead", "tbody", "tfoot") else ({"table"} if tag != "table" else set()))
            continue
        if tag in CLOSES_P:
            end({"p"}, {"td", "th", "table", "button", "#root"})
        if tag in IMPLIED:
            end(*IMPLIED[tag])
        if tag not in HEAD_ONLY:
            end({"head"}, set())
        if tag in ("html", "body") and any(n.tag == tag for n in stack):
            continue
        node = Node(tag, m[3] or "")
        stack[-1].kids.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            text = page[at : close.start() if close else len(page)]
            node.kids.append(html.unescape(text) if tag in ("textarea", "title") else text)
            at = close.end() if close else len(page)
        elif tag not in VOID and not (m[3] or "").endswith("/") or tag not in VOID and tag in BLOCK:
            stack.append(node)
    return root


def visible(node: Node) -> bool:
    if node.tag in HIDDEN:
        return False
    if not node.attrs:
        return True
    a = node.attributes()
    return not ("hidden" in a or _NO_SHOW.search(a.get("style", "")) or (node.tag == "input" and a.get("type", "").lower() == "hidden"))


class _Lines:
    """Finished lines, and the line being filled."""

    def __init__(self):
        self.done: list[str] = []
        self.line: list[str] = []
        self.space = False  # collapsed space waiting for more text
        self.gap = False  # blank line waiting for more text

    def text(self, s: str) -> None:
        if _SPACE.match(s) and self.line:
            self.space = True
        body = _SPACE.sub(" ", s).strip(" ")
        if body:
            self.put((" " if self.space and self.line else "") + body)
            self.space = s[-1] in " \t\n\f\r"

    def put(self, s: str) -> None:
        if self.gap and not self.line and self.done:
            self.done.append("")
        self.gap = False
        self.line.append(s)
        self.space = False

    def end(self, blank: bool = False) -> None:
        if self.line:
            self.done.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False
        self.gap = self.gap or blank

    def lines(self) -> list[str]:
        self.end()
        return self.done


def _shown(kid: Node | str) -> bool:
    return visible(kid) if isinstance(kid, Node) else bool(kid.strip(" \t\n\f\r"))


def _rows(node: Node, inside: bool = False) -> Iterator[Node]:
    """Rows of a table; what stands between the rows of a table part is a row of one cell."""
    for kid in node.kids:
        if not _shown(kid):
            continue
        if isinstance(kid, Node) and kid.tag == "tr":
            yield kid
        elif isinstance(kid, Node) and kid.tag in ("thead", "tbody", "tfoot"):
            yield from _rows(kid, True)
        elif inside:
            row, cell = Node("tr"), Node("td")
            row.kids, cell.kids = [cell], [kid]
            yield row


def _block(node: Node) -> list[str]:
    out = _Lines()
    _render(node, out, False)
    return out.lines()


def _table(node: Node) -> list[str]:
    """Cells side by side, padded to the widest of their column; cells of several lines grow downwards."""
    grid = []
    for row in _rows(node):
        cells: list[list[str]] = []
        for cell in row.kids:
            if not _shown(cell):
                continue
            if not (isinstance(cell, Node) and cell.tag in ("td", "th")):  # stray content takes a cell
                holder = Node("td")
                holder.kids = [cell]
                cells.append(_block(holder) or [""])
            else:
                cells.append(_block(cell) or [""])
                span = cell.attributes().get("colspan", "1")
                cells += [[""]] * (min(int(span), 1000) - 1 if span.isdigit() else 0)
        if cells:
            grid.append(cells)
    widths: dict[int, int] = {}
    for cells in grid:
        for k, lines in enumerate(cells):
            widths[k] = max(widths.get(k, 0), *map(len, lines))
    out = []
    for cells in grid:
        for y in range(max(map(len, cells))):
            out.append("  ".join((c[y] if y < len(c) else "").ljust(widths[k]) for k, c in enumerate(cells)).rstrip(" "))
    return out


def _render(node: Node, out: _Lines, pre: bool) -> None:
    """Depth-first over an explicit stack: deep nesting needs no deep recursion (but for tables and lists)."""
    todo: list[tuple] = [("open", kid, pre) for kid in reversed(node.kids)]
    while todo:
        what, kid, keep = todo.pop()
        if what == "close":
            out.end(kid.tag in SPACED)
            continue
        if isinstance(kid, str):
            if keep:
                first, *rest = kid.split("\n")
                if first:
                    out.put(first)
                for line in rest:
                    out.done.append("".join(out.line))
                    out.line = []
                    if line:
                        out.put(line)
            else:
                out.text(kid)
            continue
        if not visible(kid):
            continue
        if kid.tag == "br":
            if out.line:
                out.end()
            else:
                out.done.append("")
        elif kid.tag == "hr":
            out.end(True)
        elif kid.tag == "img":
            alt = kid.attributes().get("alt", "")
            if alt.strip():
                out.text(alt)
        elif kid.tag == "input":
            value = kid.attributes()
            if value.get("type", "text").lower() in ("submit", "button", "reset", "text") and value.get("value", "").strip():
                out.text(value["value"])
        elif kid.tag == "table":
            out.end(True)
            nested = [k for k in kid.kids if not (isinstance(k, Node) and k.tag in ("tr", "thead", "tbody", "tfoot", "colgroup"))]
            shown = Node("caption")
            shown.kids = nested
            for line in [*_block(shown), *_table(kid)]:
                out.put(line)
                out.end()
            out.end(True)
        elif kid.tag in ("ul", "ol"):
            out.end(True)
            start = kid.attributes().get("start", "1") if kid.attrs else "1"
            n = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
            for item in kid.kids:
                if isinstance(item, Node) and item.tag == "li":
                    if not visible(item):
                        continue
                    mark = f"{n}. " if kid.tag == "ol" else "- "
                    n += 1
                    lines = _block(item)
                    for y, line in enumerate(lines):
                        out.put((mark if y == 0 else " " * len(mark)) + line if line else "")
                        out.end()
                elif isinstance(item, str) and item.strip() or isinstance(item, Node):
                    holder = Node("div")
                    holder.kids = [item]
                    for line in _block(holder):
                        out.put("  " + line if line else "")
                        out.end()
            out.end(True)
        elif kid.tag in BLOCK:
            out.end(kid.tag in SPACED)
            todo.append(("close", kid, keep))
            todo += [("open", k, keep or kid.tag == "pre") for k in reversed(kid.kids)]
        elif kid.tag in ("td", "th"):  # outside a table
            out.text(" ")
            todo += [("open", k, keep) for k in reversed(kid.kids)]
        else:
            todo += [("open", k, keep) for k in reversed(kid.kids)]


def render(page: str | None) -> str:
    """All visible text of a page; null and empty pages give an empty text.

    What form fields hold for editing or choice (``textarea``, ``select``, ``datalist``) is left out.
    """
    return "\n".join(_block(build(page or ""))).strip("\n")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of ``pages`` (page_id, url, html), row by row.

    Null html gives empty text; broken, deeply nested and very long pages are rendered whole; rows
    that repeat come out as often; other columns are ignored.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        import sys

        sys.setrecursionlimit(max(20_000, sys.getrecursionlimit()))
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [render(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(
        run, "page_id long, url string, text string"
    )
