"""Visible text of HTML pages, laid out.

A tree builder supplies the tags that authors leave out (ends of paragraphs, list items, table rows and
cells; the head's end; rows around stray cells) and a renderer walks the tree: hidden elements are skipped,
block elements stand on lines of their own with a blank line around paragraphs, headings, lists and tables,
list items get bullets or numbers, and table cells are aligned in columns.

Hidden are: head, script, style, template, noscript (scripts are taken to run), datalist, the ``hidden``
attribute, inline ``display:none`` and ``visibility:hidden`` (a ``visible`` inside shows again), dialogs and
details that are not open (a summary shows). Style sheets are not read.

Defined results: null html gives null text; empty html, and html without visible text, gives an empty text;
elements nested deeper than ``DEPTH`` are laid out as children of the element at that depth; whatever is
left open at the end is closed there; cells longer than ``CELL_WIDTH`` and columns beyond ``TABLE_WIDTH`` are shown whole
but not waited for by the cells below them; repeated rows are rows of their own; extra columns pass through.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH = 150
CELL_WIDTH, TABLE_WIDTH = 120, 600  # characters to which cells of a column, and columns of a table, are aligned
COLUMNS = 4096  # columns further right are not kept free below a cell that spans rows
TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|$))|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|$)|</[^>]*>",
    re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACE = re.compile(r"[ \t\n\r\f]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript datalist title iframe noembed noframes".split())
IN_HEAD = frozenset("base link meta noscript script style template title head html".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl menu pre table figure fieldset".split())
BLOCK = SPACED | frozenset(
    "address article aside body center dd details dialog dir div dt figcaption footer form header hgroup hr html legend li "
    "main nav optgroup option search section summary caption tr xmp".split())
ENDS_PARAGRAPH = BLOCK - frozenset("option optgroup caption tr legend body html".split())
PARTS = frozenset("caption colgroup thead tbody tfoot tr td th".split())
# For a start tag: the open elements that it ends, and those at which the search for them stops.
CELL = frozenset("table td th caption".split())
IMPLIED = {
    "li": (frozenset(["li"]), CELL | {"ul", "ol", "menu"}),
    "dt": (frozenset(["dt", "dd"]), CELL | {"dl"}), "dd": (frozenset(["dt", "dd"]), CELL | {"dl"}),
    "option": (frozenset(["option"]), CELL | {"select", "datalist", "optgroup"}),
    "optgroup": (frozenset(["optgroup"]), CELL | {"select"}),
}


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


class Node:
    __slots__ = ("tag", "raw", "children")

    def __init__(self, tag: str, raw: str = ""):
        self.tag, self.raw, self.children = tag, raw, []


def build(source: str) -> Node:
    """The tree of a page."""
    root = Node("html")
    open_ = [root]

    def end(wanted: frozenset, stops: frozenset) -> None:
        for i in range(len(open_) - 1, 0, -1):
            if open_[i].tag in wanted:
                del open_[i:]
                return
            if open_[i].tag in stops:
                return

    def start(tag: str, raw: str = "") -> None:
        node = Node(tag, raw)
        open_[-1].children.append(node)
        if tag not in VOID and len(open_) < DEPTH:
            open_.append(node)

    def innermost(tags: frozenset) -> int:
        return next((i for i in range(len(open_) - 1, 0, -1) if open_[i].tag in tags), 0)

    def begin(tag: str, raw: str) -> None:
        if tag in ("html", "body"):
            end(frozenset(["head"]), frozenset())
            if tag == "body" and raw and not any(n.tag == "body" for n in open_):
                start(tag, raw)
            return
        if open_[-1].tag == "head" and tag not in IN_HEAD:
            del open_[-1]
        if tag in IMPLIED:
            end(*IMPLIED[tag])
        if tag in ENDS_PARAGRAPH:
            end(frozenset(["p"]), CELL | {"button"})
        if tag in PARTS:
            table = innermost(frozenset(["table"]))
            if not table:
                return  # a stray part outside any table is ignored, its text stays
            if tag in ("td", "th"):
                row = innermost(frozenset(["tr"]))
                if row > table:
                    del open_[row + 1:]
                else:
                    group = innermost(frozenset(["thead", "tbody", "tfoot"]))
                    del open_[max(table, group) + 1:]
                    start("tr")
            elif tag == "tr":
                group = innermost(frozenset(["thead", "tbody", "tfoot"]))
                del open_[max(table, group) + 1:]
            else:
                del open_[table + 1:]
        start(tag, raw)

    at, n = 0, len(source)
    lower = None
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            text = source[at:lt]
            if open_[-1].tag == "head" and text.strip():
                del open_[-1]
            open_[-1].children.append(html.unescape(text) if "&" in text else text)
        if lt == n:
            break
        m = TOKEN.match(source, lt)
        if not m:
            open_[-1].children.append("<")
            at = lt + 1
            continue
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag == "br":
                start("br")
            elif tag == "body" or tag == "html":
                pass
            else:
                end(frozenset([tag]), frozenset() if tag in ("table", "select") else frozenset(["table"]) if tag in PARTS else CELL)
            continue
        raw = m[3] if m[2] else m[6]
        begin(tag, raw or "")
        if tag in RAW:
            if lower is None:
                lower = source.lower()
                if len(lower) != n:  # a letter that changes its length
                    lower = re.sub("[A-Z]", lambda c: c[0].lower(), source)
            close = lower.find("</" + tag, at)
            close = n if close < 0 else close
            body = source[at:close]
            if open_[-1].tag == tag:
                if tag in ("textarea", "xmp"):
                    open_[-1].children.append(html.unescape(body) if tag == "textarea" else body)
                del open_[-1]
            stop = source.find(">", close)
            at = n if stop < 0 else stop + 1
    return root


class Page:
    """Lines under construction."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = False  # a space is due before the next word
        self.blank = False  # a blank line is due before the next line
        self.indent = ""
        self.mark = ""  # bullet for the next line

    def text(self, s: str) -> None:
        words = SPACE.sub(" ", s)
        if words == " ":
            self.gap = bool(self.now)
            return
        if words[0] == " ":
            self.gap, words = bool(self.now), words[1:]
        if self.gap:
            self.now.append(" ")
        self.gap = words[-1] == " "
        self.now.append(words[:-1] if self.gap else words)

    def pre(self, s: str) -> None:
        lines = s.split("\n")
        for i, line in enumerate(lines):
            if i:
                self.line(keep=True)
            if line:
                self.now.append(line)

    def line(self, keep: bool = False) -> None:
        """End the current line; an empty one is only kept on request."""
        if self.now or (keep and self.lines):
            if self.blank and self.lines and self.lines[-1]:
                self.lines.append("")
            self.blank = False
            body = "".join(self.now)
            self.lines.append((self.indent + self.mark + body).rstrip(" ") if body else "")
            if self.mark and body:
                self.mark = ""
        self.now, self.gap = [], False

    def block(self, spaced: bool) -> None:
        self.line()
        self.blank |= spaced

    def done(self) -> list[str]:
        self.line()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        while lines and not lines[0]:
            lines.pop(0)
        return lines


def _style(raw: str) -> tuple[bool, bool | None]:
    """Whether an element is not displayed, and its own visibility if it states one."""
    low = raw.lower()
    if "hidden" not in low and "style" not in low:
        return False, None
    a = attributes(raw)
    css = re.sub(r"\s+", "", a.get("style", "").lower())
    rules = dict(r.split(":", 1) for r in css.split(";") if ":" in r)
    shown = rules.get("visibility", "").removesuffix("!important")
    off = "hidden" in a or rules.get("display", "").removesuffix("!important") == "none"
    return off, {"hidden": False, "collapse": False, "visible": True}.get(shown)


def _number(raw: str, name: str, default: int, low: int, high: int) -> int:
    if name not in raw.lower():
        return default
    m = re.match(r"\s*([+-]?\d{1,9})", attributes(raw).get(name, ""))
    return min(high, max(low, int(m[1]))) if m else default


def render(node: Node, page: Page, visible: bool = True, pre: bool = False, depth: int = 0, item: str = "") -> None:
    tag = node.tag
    if tag in HIDDEN:
        return
    off, own = _style(node.raw) if node.raw else (False, None)
    if off:
        return
    visible = visible if own is None else own
    if tag == "br":
        page.line(keep=True)
        return
    if tag == "dialog" and "open" not in attributes(node.raw):
        return
    spaced = tag in SPACED and not (tag in ("ul", "ol", "menu") and depth)
    block = tag in BLOCK
    if block:
        page.block(spaced)
    if tag == "table":
        for line in table(node, visible):
            page.now.append(line)
            page.line(keep=True)
        page.block(True)
        return
    pre = pre or tag in ("pre", "textarea", "xmp")
    counter, indent = 0, page.indent
    if tag == "ol":
        counter = _number(node.raw, "start", 1, -10**6, 10**6)
    if tag == "li":
        page.indent = "  " * max(depth - 1, 0)
        page.mark = item or "- "
    elif tag in ("blockquote", "dd"):
        page.indent = indent + "  "
    below = depth + 1 if tag in ("ul", "ol", "menu") else depth
    closed = tag == "details" and "open" not in attributes(node.raw)
    first = True
    for c in node.children:
        if isinstance(c, str):
            if visible and not closed:
                (page.pre if pre else page.text)(c[1:] if pre and first and c[:1] == "\n" else c)
        elif not closed or c.tag == "summary":
            mark = ""
            if c.tag == "li" and tag == "ol":
                counter = _number(c.raw, "value", counter, -10**6, 10**6)
                mark = f"{counter}. "
                counter += 1
            render(c, page, visible, pre, below, mark)
        first = False
    if block:
        page.block(spaced)
    if tag == "li":
        page.mark = ""
    page.indent = indent


def _covered(held: list[tuple[int, int, int]], spans: list[tuple[int, int, int]], row: int) -> list[tuple[int, int, int]]:
    """Sorted intervals of columns that cells above ``row`` cover, one for neighbours that end in the same row.

    A new span takes the columns it shares with an older one.
    """
    held = [h for h in held if h[2] > row]
    spans = [s for s in spans if s[2] > row]
    if spans:
        old, held = held, []
        k = 0
        for a, b, until in old:
            while k < len(spans) and spans[k][1] <= a:
                k += 1
            j = k
            while j < len(spans) and spans[j][0] < b:
                if a < spans[j][0]:
                    held.append((a, spans[j][0], until))
                a = max(a, spans[j][1])
                j += 1
            if a < b:
                held.append((a, b, until))
        held = sorted(held + spans)
    out: list[tuple[int, int, int]] = []
    for h in held:
        if out and out[-1][1] == h[0] and out[-1][2] == h[2]:
            out[-1] = (out[-1][0], h[1], h[2])
        else:
            out.append(h)
    return out


def table(node: Node, visible: bool) -> list[str]:
    """Caption and rows with cells padded to the width of their columns."""
    caption, rows = [], []

    def visit(n: Node, visible: bool) -> None:
        for c in n.children:
            if isinstance(c, str):
                if visible and c.strip():
                    caption.append(" ".join(c.split()))  # text outside cells is shown before the table
                continue
            off, own = _style(c.raw) if c.raw else (False, None)
            if off or c.tag in HIDDEN:
                continue
            seen = visible if own is None else own
            if c.tag in ("thead", "tbody", "tfoot", "colgroup"):
                visit(c, seen)
            elif c.tag == "tr":
                rows.append((c, seen))
            else:
                inner = Page()
                render(c, inner, visible)
                caption.extend(inner.done())

    visit(node, visible)
    grid: list[dict[int, list[str]]] = []
    width: dict[int, int] = {}
    held: list[tuple[int, int, int]] = []  # columns from, to, and the first row that the cell above does not cover
    for at, (tr, seen) in enumerate(rows):
        line: dict[int, list[str]] = {}
        col = passed = 0
        spans = []
        for cell in tr.children:
            if isinstance(cell, str):
                if cell.strip() and seen:
                    caption.append(" ".join(cell.split()))
                continue
            off, _ = _style(cell.raw) if cell.raw else (False, None)
            if off or cell.tag in HIDDEN:
                continue
            while passed < len(held) and held[passed][0] <= col:
                col = max(col, held[passed][1])
                passed += 1
            inner = Page()
            render(cell, inner, seen)
            text = inner.done()
            span = _number(cell.raw, "colspan", 1, 1, 1000) if cell.raw else 1
            down = _number(cell.raw, "rowspan", 1, 1, 65534) if cell.raw else 1
            line[col] = text
            if span == 1:
                width[col] = max(width.get(col, 0), min(max(map(len, text), default=0), CELL_WIDTH))
            if down > 1 and col < COLUMNS:
                spans.append((col, col + span, min(at + down, len(rows))))
            col += span
        held = _covered(held, spans, at + 1)
        grid.append(line)
    columns = sorted({c for line in grid for c in line})
    place, x = {}, 0
    for c in columns:
        place[c] = min(x, TABLE_WIDTH)
        x += width.get(c, 0) + 2 if width.get(c, 0) else 0
    out = list(caption)
    for line in grid:
        for i in range(max((len(t) for t in line.values()), default=0)):
            row = ""
            for c in sorted(line):
                part = line[c][i] if i < len(line[c]) else ""
                if part:
                    row = (row.ljust(place[c]) if len(row) <= place[c] else row + "  ") + part
            out.append(row.rstrip())
    return out


def visible_text(source: str | None) -> str | None:
    if source is None:
        return None
    page = Page()
    render(build(source.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "")), page)
    return "\n".join(page.done()).replace("\xa0", " ")


def extract(df: DataFrame, source: str = "html", name: str = "visible_text") -> DataFrame:
    """Add the visible text of each page."""
    rows = df.drop(name)
    keep = rows.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                text = pa.array([visible_text(x.as_py()) for x in b[source]], pa.string())
                yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], text], names=[*keep, name])

    return rows.mapInArrow(task, rows.select("*", F.lit(None).cast("string").alias(name)).schema)
