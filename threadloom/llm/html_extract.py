"""HTML extraction: a tree builder with implied tags, and a layout-aware rendering of all visible text.

Rules of the tree: void elements hold nothing; the text of script, style and the like is raw; an open head ends at body and at
any tag or text that can't stand in one, and a head after that is ignored; a block start tag ends an open p; li, dt/dd, option, table rows, cells and sections end their predecessors; a cell without a row and a row
without a table section get one; an end tag closes the nearest open element of its name within its table cell and is
ignored when there is none.

Rules of visibility: head, script, style, template, noscript, embedded media, elements with the hidden attribute,
aria-hidden=true or display:none, hidden inputs, closed dialogs, and closed details but for their summary emit nothing.
visibility is inherited: hidden or collapse hides text until a visible below it. All other text is emitted once.

Rules of layout: white space collapses outside pre and textarea; blocks start on lines of their own, paragraphs,
headings, outer lists and tables have an empty line around them; list items carry "- " or their number (from the start,
downwards in a reversed list) and are indented by depth, INDENT_CHARS at most; table cells are padded to the width of
their column with " | " between them, colspan and rowspan kept. Lines of a cell that another column stands beside are
wrapped at WRAP_CHARS; a word longer than that ends its line, and the cells to its right go on below, so columns stay
aligned whatever they hold. Beyond ALIGNED_COLUMNS columns the cells of a row follow each other without padding for
empty ones; tables nested deeper than NESTED_TABLES are read cell by cell.

Defined cases: null and empty pages give an empty text and title; unclosed comments, tags and quotes are read to the
end of the page as text or comment without failing; nesting of any depth is walked without recursion, and time and
output grow with the page's length; repeated rows are rendered one by one; an empty table gives an empty one; only
the named columns are read.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import read_table

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes object video audio canvas datalist title meta link base".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead tr caption ul".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl blockquote pre table figure hr fieldset".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
ENDS_P = BLOCK - frozenset("body html option optgroup tbody td tfoot th thead tr caption legend".split())
# A start tag closes the nearest open element of these names, unless one of the others lies between.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "td", "th", "table")),
    "dt": (("dt", "dd"), ("dl", "td", "th", "table")),
    "dd": (("dt", "dd"), ("dl", "td", "th", "table")),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("optgroup", "option"), ("select",)),
    "td": (("td", "th", "caption"), ("table", "tr")),
    "th": (("td", "th", "caption"), ("table", "tr")),
    "tr": (("tr", "caption"), ("table",)),
    "tbody": (("tbody", "thead", "tfoot", "caption"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "caption"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "caption"), ("table",)),
    "p": (("p",), ("td", "th", "table", "caption", "button")),
}
WRAP_CHARS = 60
INDENT_CHARS = 60
ALIGNED_COLUMNS = 64
NESTED_TABLES = 8

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?", re.S)
_START = re.compile(r"<([a-zA-Z][^\s/>]*)")
_SPECIAL = re.compile(r"""[>"']""")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
_SPACE = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw and not raw.isspace() else {}


class TagEnds:
    """Where tags end: at the first ">" outside quotes. A place from which the page's end is met inside quotes is remembered, so
    that time is linear however many tags leave a quote open."""

    def __init__(self, html: str):
        self.html, self.lost = html, set()

    def find(self, at: int) -> int:
        """The place of the ">" that ends a tag whose attributes begin at `at`, or -1."""
        html, passed = self.html, []
        while m := _SPECIAL.search(html, at):
            q = m.start()
            if html[q] == ">":
                return q
            if q in self.lost:
                break
            passed.append(q)
            at = html.find(html[q], q + 1) + 1
            if not at:
                break
        self.lost.update(passed)
        return -1


class Open:
    """The open elements of a page, with the places of each name, so that closing needs no search."""

    def __init__(self):
        self.root = Node("#root", {})
        self.stack = [self.root]
        self.places: dict[str, list[int]] = {}

    @property
    def top(self) -> Node:
        return self.stack[-1]

    def push(self, tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs)
        self.top.children.append(node)
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(node)

    def pop(self) -> None:
        self.places[self.stack.pop().tag].pop()

    def nearest(self, names) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def close(self, names, barriers) -> None:
        """Close the nearest element of these names, unless a barrier is open inside it."""
        k = self.nearest(names)
        if k >= 0 and k > self.nearest(barriers):
            while len(self.stack) > k:
                self.pop()


def build(html: str) -> Node:
    """The tree of a page; leaves are strings."""
    open_ = Open()
    pos, n, last = 0, len(html), html.rfind(">")
    ends, begun = TagEnds(html), False  # begun: something but html has been opened or written

    def leave_head() -> None:
        if open_.top.tag == "head":
            open_.pop()

    def tag_at(at: int):
        """(end, closing name, opening name, attributes) of the tag or comment at a "<", None for plain text."""
        m = _TOKEN.match(html, at)
        if m:
            return m.end(), m[1], None, ""
        m = _START.match(html, at) if at < last else None
        if not m:
            return None
        end = ends.find(m.end())
        if end < 0:  # a quote is open to the page's end: it holds nothing, and the tag ends at the next ">"
            end = html.find(">", m.end())
        return (end + 1, None, m[1], html[m.end() : end]) if end >= 0 else None

    while pos < n:
        at = html.find("<", pos)
        found = tag_at(at) if at >= 0 else None
        while at >= 0 and not found:  # a "<" that starts no tag is text
            at = html.find("<", at + 1)
            found = tag_at(at) if at >= 0 else None
        if at != pos:
            text = html[pos : at if found else n]
            if not text.isspace():
                leave_head()
                begun = True
            open_.top.children.append(unescape(text) if "&" in text else text)
        if not found:
            break
        pos, end, start, raw = found
        if end:
            end = end.lower()
            if end == "br":
                open_.top.children.append(Node("br", {}))
            else:
                open_.close((end,), () if end in ("table", "body", "html") else ("table",) if end in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else ("td", "th", "caption"))
        elif start:
            tag = start.lower()
            if tag == "head" and begun:
                continue
            if tag == "body":
                open_.close(("head",), ())
            elif tag != "html" and tag not in IN_HEAD:
                leave_head()
            begun = begun or tag != "html"
            attrs = attributes(raw)
            if tag in ENDS_P and tag != "p":
                open_.close(*CLOSES["p"])
            if tag in CLOSES:
                open_.close(*CLOSES[tag])
            if tag in ("td", "th") and open_.top.tag in ("table", "tbody", "thead", "tfoot"):
                if open_.top.tag == "table":
                    open_.push("tbody", {})
                open_.push("tr", {})
            elif tag == "tr" and open_.top.tag == "table":
                open_.push("tbody", {})
            open_.push(tag, attrs)
            if tag in VOID:
                open_.pop()
            elif tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, pos)
                stop_at = stop.start() if stop else n
                body = html[pos:stop_at]
                open_.top.children.append(unescape(body) if tag in ("title", "textarea") and "&" in body else body)
                open_.pop()
                close_end = html.find(">", stop_at) if stop else -1
                pos = close_end + 1 if close_end >= 0 else n
    return open_.root


def is_hidden(node: Node) -> bool:
    """Whether the element and all below it emit nothing."""
    a = node.attrs
    if node.tag in UNSEEN or (node.tag == "dialog" and "open" not in a):
        return True
    return bool(a) and ("hidden" in a or a.get("aria-hidden", "").lower() == "true" or (node.tag == "input" and a.get("type", "").lower() == "hidden") or declared(node).get("display") == "none")


def declared(node: Node) -> dict[str, str]:
    """The element's own display and visibility; the last declaration counts."""
    style = node.attrs.get("style")
    return {m[1].lower(): m[2].lower() for m in _STYLE.finditer(style)} if style else {}


class Lines:
    """Text of a page or cell, line by line: collapses white space and the space between blocks."""

    def __init__(self):
        self.done: list[str] = []
        self.parts: list[str] = []
        self.indent = 0
        self.markers: list[str] = []  # of the list items that have begun and have no text yet
        self.gap = 0
        self.space = False

    def text(self, s: str) -> None:
        s = _SPACE.sub(" ", s)
        body = s.strip(" ")
        if not body:
            self.space = self.space or (bool(s) and bool(self.parts))
            return
        if self.parts and (self.space or s[0] == " "):
            self.parts.append(" ")
        self.parts.append(body)
        self.space = s[-1] == " "

    def line(self) -> None:
        """End the line that is being written, if there is one."""
        if self.parts:
            if self.done and self.gap:
                self.done.extend([""] * self.gap)
            marker = "".join(self.markers)
            self.done.append(" " * min(INDENT_CHARS, self.indent - len(marker)) + marker + "".join(self.parts))
            self.parts, self.markers, self.gap = [], [], 0
        self.space = False

    def block(self, gap: int) -> None:
        self.line()
        self.gap = max(self.gap, gap)

    def forced(self) -> None:
        """A br: ends the line, or adds an empty one."""
        if self.parts:
            self.line()
        elif self.done:
            self.gap += 1

    def put(self, lines: list[str]) -> None:
        for x in lines:
            self.parts = [x] if x else []
            if x:
                self.line()
            elif self.done:
                self.gap += 1

    def result(self) -> list[str]:
        self.line()
        return self.done


def integer(value, default: int) -> int:
    try:
        return int(value)
    except (TypeError, ValueError):
        return default


def aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table; a row holds (lines, colspan, rowspan) for each cell."""
    grid: list[dict[int, list[str]]] = []
    down: dict[int, int] = {}
    for row in rows:
        placed, at = {}, 0
        below = {c: k - 1 for c, k in down.items() if k > 1}
        for lines, across, rows_down in row:
            while down.get(at, 0) > 0:
                at += 1
            placed[at] = lines
            if rows_down > 1:
                below |= {at + k: rows_down - 1 for k in range(across)}
            at += across
        down = below
        grid.append(placed)
    columns = sorted({c for row in grid for c, lines in row.items() if any(lines)})
    number = {c: k for k, c in enumerate(columns)}
    width = [0] * len(columns)
    for row in grid:
        for c in [c for c in row if c not in number]:
            del row[c]
        for c, lines in row.items():
            if c < columns[-1]:
                row[c] = [x for line in lines for x in wrapped(line)]
                width[number[c]] = max(width[number[c]], max((len(x) for x in row[c] if len(x) <= WRAP_CHARS), default=0))
    out = []
    for row in grid:
        left = {number[c]: lines[::-1] for c, lines in sorted(row.items()) if lines}
        while left:
            last, cells = max(left), []
            for k in [*range(min(last + 1, ALIGNED_COLUMNS)), *[k for k in left if k >= ALIGNED_COLUMNS]]:
                x = ""
                if k in left:
                    x = left[k].pop()
                    if not left[k]:
                        del left[k]
                cells.append((x, width[k]))
                if k < len(columns) - 1 and len(x) > width[k]:  # a long word: what stands to its right goes on below
                    break
            while cells and not cells[-1][0].strip():
                cells.pop()
            out.append(" | ".join([*(x.ljust(w) for x, w in cells[:-1]), *(x for x, _ in cells[-1:])]).rstrip())
    return out


def wrapped(line: str) -> list[str]:
    """A line of a cell in lines of WRAP_CHARS, cut at blanks; a longer word is a line of its own."""
    out, begin, n = [], 0, len(line)
    own = n - len(line.lstrip(" "))
    while n - begin > WRAP_CHARS:
        cut = line.rfind(" ", max(own, begin) + 1, begin + WRAP_CHARS + 1)
        if cut < 0:
            cut = line.find(" ", max(own, begin + WRAP_CHARS))
        if cut < 0:
            break
        out.append(line[begin:cut])
        begin = cut + 1
    return [*out, line[begin:]]


def render(root: Node) -> list[str]:
    out = Lines()
    outs: list[Lines] = [out]
    lists: list[list] = []
    tables: list[list] = []
    seen = [True]  # whether text shows, for each open element that says so
    pre = 0
    todo: list[tuple[object, bool]] = [(root, True)]
    while todo:
        item, enter = todo.pop()
        out = outs[-1]
        if isinstance(item, str):
            if not seen[-1]:
                continue
            if not pre:
                out.text(item)
            else:
                first, *more = item.split("\n")
                out.parts += [first] if first else []
                for x in more:
                    out.forced()
                    out.parts += [x] if x else []
            continue
        tag = item.tag
        if enter:
            if is_hidden(item):
                continue
            shown = {"visible": True, "hidden": False, "collapse": False}.get(declared(item).get("visibility"), seen[-1])
            if tag == "br":
                out.forced()
                continue
            if tag == "input":
                if shown and item.attrs.get("type", "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel", "number"):
                    out.text(item.attrs.get("value", ""))
                continue
            seen.append(shown)
            if tag in BLOCK and tag not in ("td", "th", "tr"):
                out.block(1 if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists) else 0)
            children = item.children
            if tag in ("ul", "ol", "menu"):
                down = tag == "ol" and "reversed" in item.attrs
                items = sum(1 for c in children if not isinstance(c, str) and c.tag == "li" and not is_hidden(c)) if down else 1
                lists.append([tag == "ol", integer(item.attrs.get("start"), items), -1 if down else 1])
            elif tag == "li":
                ordered, number, step = lists[-1] if lists else (False, 1, 1)
                if ordered:
                    number = integer(item.attrs.get("value"), number)
                    lists[-1][1] = number + step
                marker = f"{number}. " if ordered else "- "
                out.markers.append(marker)
                out.indent += len(marker)
                item.attrs["#marker"] = marker
            elif tag in ("blockquote", "dd"):
                out.indent += 2
            elif tag in ("pre", "textarea", "xmp"):
                pre += 1
            elif tag == "table":
                tables.append([] if len(tables) < NESTED_TABLES else None)
            elif tag == "tr" and tables and tables[-1] is not None:
                tables[-1].append([])
            elif tag in ("td", "th") and tables and tables[-1] is None:
                out.block(0)
            elif tag in ("td", "th") and tables:
                outs.append(Lines())
                lists.append([False, 1, 1])
            elif tag == "details" and "open" not in item.attrs:
                children = [c for c in children if not isinstance(c, str) and c.tag == "summary"]
            todo.append((item, False))
            todo.extend((c, True) for c in reversed(children))
        else:
            seen.pop()
            if tag in ("td", "th") and tables and tables[-1] is not None:
                cell = outs.pop().result()
                lists.pop()
                if not tables[-1]:
                    tables[-1].append([])
                tables[-1][-1].append((cell, max(1, min(1000, integer(item.attrs.get("colspan"), 1))), max(1, min(65534, integer(item.attrs.get("rowspan"), 1)))))
                continue
            if tag == "table" and tables:
                out.block(1)
                rows = tables.pop()
                if rows is not None:
                    out.put(aligned(rows))
            if tag in ("ul", "ol", "menu") and lists:
                lists.pop()
            if tag in BLOCK and tag not in ("tr", "td", "th"):
                out.block(1 if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists) else 0)
            if tag == "li":
                if out.markers:  # an item without text
                    out.markers.pop()
                out.indent -= len(item.attrs["#marker"])
            elif tag in ("blockquote", "dd"):
                out.indent -= 2
            elif tag in ("pre", "textarea", "xmp"):
                pre -= 1
    return outs[0].result()


def title_of(root: Node) -> str:
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag == "title":
            return _SPACE.sub(" ", "".join(c for c in node.children if isinstance(c, str))).strip()
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return ""


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, title, text (all visible text), n_lines."""

    def run(batches):
        for batch in batches:
            trees = [build(h or "") for h in batch.column(1).to_pylist()]
            lines = [render(t) for t in trees]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([title_of(t) for t in trees], pa.string()), pa.array(["\n".join(x) for x in lines], pa.string()), pa.array([len(x) for x in lines], pa.int64())],
                ["page_id", "title", "text", "n_lines"],
            )

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, title string, text string, n_lines long")


def op1_html_extraction(spark, sf_dir):
    return extract(read_table(spark, sf_dir, "pages"))
