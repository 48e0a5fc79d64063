"""Layout-aware rendering of HTML to text.

A tokenizer and a tree builder with implied start and end tags make a tree; visibility rules drop what a browser would not show;
rendering keeps block spacing, list markers with nesting, preformatted text and aligned table cells.

Defined results: null or empty pages give an empty text; unclosed tags end with their parent; unmatched end tags are ignored;
elements nest without limit; what a table, row group or row may not hold comes before the table, a form there stays empty and a table there ends the one before; comments, declarations and processing instructions vanish.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Generator, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard: groups of element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas datalist title meta link param rp area source track map".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre figure table fieldset menu dir listing hr".split())
BLOCKS = SPACED | frozenset("html body address article aside center details dialog dd div dt figcaption footer form header hgroup legend li main nav optgroup option search section summary caption thead tbody tfoot tr".split())
CLOSES_P = (SPACED | frozenset("address article aside center details dialog div dd dt figcaption footer form header hgroup li main nav search section summary".split())) - {"table"} | {"table"}
PART_OF_TABLE = frozenset("thead tbody tfoot".split())
HOLDS_NO_TEXT = PART_OF_TABLE | frozenset("table tr colgroup".split())
IN_TABLE = PART_OF_TABLE | frozenset("caption colgroup col tr td th script style template".split())
#: A part of a table named by the key goes into the nearest open element named by a value.
HOLDERS = {"tr": PART_OF_TABLE | {"table"}} | dict.fromkeys(("td", "th"), PART_OF_TABLE | {"table", "tr"}) | dict.fromkeys((*PART_OF_TABLE, "caption", "colgroup"), frozenset({"table"})) | {"col": frozenset({"table", "colgroup"})}
#: An element named by the key ends an open element named by a value, unless one of the barriers lies between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}), "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"})} | {x: ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}) for x in PART_OF_TABLE} | {f"h{i}": ({f"h{j}" for j in range(1, 7)}, {"div", "section", "article", "td", "th", "li", "body"}) for i in range(1, 7)}

_NAME_END, _TAG_MARK, _COMMENT_END = re.compile(r"[\s/>]"), re.compile(r"[>\"']"), re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HIDE = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(\w+)", re.I)
_PRE = re.compile(r"(?:^|;)\s*white-space\s*:\s*(?:pre\b|pre-wrap|break-spaces)", re.I)
_WHITE = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return found


class _Tags:
    """Finds a page's tags one after the other, in time linear in the page however many stay open."""

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.name_start, self.name_end = 0, -1
        self.dead: set[int] = set()  # marks outside quotes from which no tag ends

    def _end_of_name(self, at: int) -> int:
        if not self.name_start <= at < self.name_end:
            m = _NAME_END.search(self.html, at)
            self.name_start, self.name_end = at, m.start() if m else len(self.html)
        return self.name_end

    def _end_of_tag(self, at: int) -> int:
        """The place of the > that ends a tag, outside quotes; -1 if there is none."""
        met = []
        while True:
            m = _TAG_MARK.search(self.html, at) if at <= self.last else None
            mark = m.start() if m else -1
            if m and m[0] == ">":
                return mark
            close = self.html.find(m[0], mark + 1) if m and mark not in self.dead else -1
            met.append(mark)
            if close < 0:
                self.dead.update(met)
                return -1
            at = close + 1

    def tag(self, at: int) -> tuple[int, str, str] | None:
        """Of the markup that begins at a <: where it ends, its name (empty for comments and declarations) and its attributes."""
        html = self.html
        if html.startswith("<!--", at):
            if html.startswith(("<!-->", "<!--->"), at):
                return html.index(">", at) + 1, "", ""
            m = _COMMENT_END.search(html, at + 4)
            return m.end() if m else len(html), "", ""
        if html.startswith(("<!", "<?"), at):
            return (html.find(">", at) + 1) or len(html), "", ""
        name = at + 1 + html.startswith("</", at)
        if at >= self.last or not (html[name : name + 1].isascii() and html[name : name + 1].isalpha()):
            return None
        end_of_name = self._end_of_name(name)
        end = self._end_of_tag(end_of_name)
        return (end + 1, html[name:end_of_name].lower(), html[end_of_name:end]) if end >= 0 else None


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) with kind text, start or end; the content of raw elements is one text."""
    at, seek, n, tags = 0, 0, len(html), _Tags(html)
    while at < n:
        begin = html.find("<", seek)
        if begin < 0:
            yield "text", html[at:], ""
            return
        found = tags.tag(begin)
        if found is None:
            seek = begin + 1
            continue
        if begin > at:
            yield "text", html[at:begin], ""
        at, name, attributes = found
        seek = at
        if not name:
            continue
        if html[begin + 1] == "/":
            yield "end", name, ""
            continue
        yield "start", name, attributes
        if name in RAW and not attributes.endswith("/"):
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
            end = html.find(">", close.start()) if close else -1
            yield "raw", html[at : close.start() if end >= 0 else n], ""
            yield "end", name, ""
            at = seek = end + 1 if end >= 0 else n


class Builder:
    """The stack of open elements, and each name's places in it; implied tags are put in as elements come."""

    def __init__(self):
        self.root = Node("html")
        self.open = [self.root]
        self.places: defaultdict[str, list[int]] = defaultdict(list)

    def _nearest(self, names: set[str] | frozenset[str]) -> int:
        """The place of the innermost open element of `names`; 0, the root's, if there is none."""
        return max((p[-1] for x in names if (p := self.places.get(x))), default=0)

    def _cut(self, place: int) -> None:
        """Ends the open elements from a place on."""
        for node in self.open[place:]:
            self.places[node.tag].pop()
        del self.open[place:]

    def _close(self, names: set[str] | frozenset[str], barriers: set[str] | frozenset[str]) -> None:
        """Ends the outermost open element of `names` above the nearest barrier."""
        if not any(self.places.get(x) for x in names):
            return
        barrier = self._nearest(barriers)
        above = [p[i] for x in names if (p := self.places.get(x)) and (i := bisect_right(p, barrier)) < len(p)]
        if above:
            self._cut(min(above))

    def _insert(self, child: Node | str) -> None:
        """Adds to the innermost open element; what a table's parts may not hold goes before the table (foster parenting)."""
        if self.open[-1].tag in HOLDS_NO_TEXT and (isinstance(child, str) or child.tag not in IN_TABLE | {"form"}):
            i = self._nearest({"table"})
            if i:
                home = self.open[i - 1].children
                home.insert(len(home) - 1, child)  # the open table is its parent's last child
                return
        self.open[-1].children.append(child)

    def _push(self, node: Node) -> None:
        self._insert(node)
        self.places[node.tag].append(len(self.open))
        self.open.append(node)

    def start(self, name: str, attributes: str) -> None:
        if name in ("html", "body"):
            self.open[0].attrs |= _attributes(attributes) if attributes.strip(" /") else {}
            if name == "body":
                self._close({"head"}, frozenset())
            return
        if name in BLOCKS and self.places["head"]:
            self._close({"head"}, frozenset())
        if name in CLOSES_P:
            self._close({"p"}, {"td", "th", "table", "button", "caption"})
        if name in ENDS:
            self._close(*ENDS[name])
        if name in HOLDERS:
            i = self._nearest(HOLDERS[name])
            if i:
                self._cut(i + 1)
        elif name == "table" and self.open[-1].tag in HOLDS_NO_TEXT:
            self.end("table")
        top = self.open[-1].tag
        if name in ("td", "th"):
            if top == "table":
                self._push(Node("tbody"))
            if self.open[-1].tag in PART_OF_TABLE:
                self._push(Node("tr"))
        elif name == "tr" and top == "table":
            self._push(Node("tbody"))
        node = Node(name, _attributes(attributes) if attributes.strip(" /") else None)
        if name in VOID or (name == "form" and top in HOLDS_NO_TEXT):  # a form among a table's parts stays empty
            self._insert(node)
        else:
            self._push(node)

    def end(self, name: str) -> None:
        if name == "br":
            self._insert(Node("br"))
            return
        if name in ("html", "body", *VOID):
            return
        barriers = {"table", "td", "th", "caption"} if name not in PART_OF_TABLE | {"table", "tr", "td", "th", "caption"} else {"table"}
        i = self._nearest({name})
        if i and i >= self._nearest(barriers):
            self._cut(i)
        elif name == "p":
            self.start("p", "")
            self._cut(len(self.open) - 1)

    def text(self, value: str) -> None:
        if value.strip() or self.open[-1].tag not in HOLDS_NO_TEXT:
            self._insert(value)


def parse(html: str) -> Node:
    b = Builder()
    for kind, value, attributes in tokens(html):
        if kind == "start":
            b.start(value, attributes)
        elif kind == "end":
            b.end(value)
        elif kind == "raw":
            b.open[-1].children.append(value if b.open[-1].tag not in ("textarea", "title") else unescape(value))
        else:
            b.text(unescape(value) if "&" in value else value)
    return b.root


class Lines:
    """Text lines in the making: white space collapses, and block edges ask for line ends and blank lines."""

    def __init__(self):
        self.done: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.gap = 0

    def edge(self, blank: bool) -> None:
        if self.now:
            self.done.append("".join(self.now).rstrip(" "))
            self.now = []
        self.space, self.gap = False, max(self.gap, int(blank))

    def _begin(self) -> None:
        if not self.now:
            if self.gap and self.done:
                self.done.append("")
            self.gap = 0

    def add(self, text: str, pre: bool) -> None:
        if pre:
            first, *rest = text.split("\n")
            if first:
                self._begin()
                self.now.append(first)
            for line in rest:
                self._begin()
                self.done.append("".join(self.now).rstrip("\r"))
                self.now = [line] if line else []
            self.space = False
            return
        words = _WHITE.sub(" ", text)
        if words[:1] == " ":
            self.space, words = True, words[1:]
        if not words:
            return
        self._begin()
        if self.space and self.now:
            self.now.append(" ")
        self.space = words[-1] == " "
        self.now.append(words.rstrip(" ") if self.space else words)

    def line_break(self) -> None:
        self._begin()
        self.done.append("".join(self.now).rstrip(" "))
        self.now, self.space = [], False

    def block(self, lines: list[str], blank: bool) -> None:
        self.edge(blank)
        if lines:
            self._begin()
            self.done += lines
        self.edge(blank)

    def result(self) -> list[str]:
        self.edge(False)
        while self.done and not self.done[-1].strip():
            self.done.pop()
        while self.done and not self.done[0].strip():
            self.done.pop(0)
        return self.done


def shown(node: Node, visible: bool) -> tuple[bool, bool]:
    """Whether the element has a box, and whether text in it is visible."""
    a = node.attrs
    if node.tag in UNSEEN or "hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden") or (node.tag == "dialog" and "open" not in a):
        return False, False
    style = a.get("style")
    if style:
        if _HIDE.search(style):
            return False, False
        if m := _VISIBILITY.search(style):
            visible = m[1].lower() not in ("hidden", "collapse")
    return True, visible


def _number(value: str, default: int, most: int = 1000) -> int:
    digits = value.strip()
    return min(most, int(digits)) if re.fullmatch(r"-?[0-9]{1,9}", digits) else default


#: Rendering keeps its own stack: a task yields the tasks whose result it needs.
Task = Generator["Task", list[str], list[str]]


def _run(task: Task) -> list[str]:
    stack, result = [task], None
    while stack:
        try:
            stack.append(stack[-1].send(result))
            result = None
        except StopIteration as done:
            stack.pop()
            result = done.value
    return result


def _table(node: Node, visible: bool, pre: bool) -> Task:
    caption, rows, groups, left = [], [], [], []
    for child in node.children:
        if isinstance(child, str):
            left.append((child, visible))
            continue
        has, sees = shown(child, visible)
        if not has:
            continue
        if child.tag == "caption":
            caption += yield _rendered(child, sees, pre)
        elif child.tag == "tr":
            groups.append((1, child, sees))
        elif child.tag in PART_OF_TABLE:
            place = {"thead": 0, "tbody": 1, "tfoot": 2}[child.tag]
            for x in child.children:
                if isinstance(x, str) or x.tag != "tr":
                    left.append((x, sees))
                elif (below := shown(x, sees))[0]:
                    groups.append((place, x, below[1]))
        else:
            left.append((child, visible))
    covered: dict[int, int] = {}  # the row before which a column is taken
    for r, (_, row, sees) in enumerate(sorted(groups, key=lambda g: g[0])):
        cells, column = [], 0
        for cell in row.children:
            if isinstance(cell, str) or cell.tag not in ("td", "th"):
                left.append((cell, sees))
                continue
            has, s = shown(cell, sees)
            if not has:
                continue
            while covered.get(column, 0) > r:
                column += 1
            across, down = max(1, _number(cell.attrs.get("colspan", ""), 1)), max(1, _number(cell.attrs.get("rowspan", ""), 1, 65534))  # the standard's bound
            if down > 1:
                for x in range(column, column + across):
                    covered[x] = max(covered.get(x, 0), r + down)
            cells.append((column, across, (yield _rendered(cell, s, pre))))
            column += across
        rows.append(cells)
    widths: dict[int, int] = {}
    for cells in rows:
        for column, across, lines in cells:
            if across == 1:
                widths[column] = max(widths.get(column, 0), *(len(x) for x in lines), 0)
    for cells in rows:  # what a cell over several columns needs more goes to its last one
        for column, across, lines in cells:
            if across > 1:
                need = max((len(x) for x in lines), default=0) - sum(widths.get(c, 0) for c in range(column, column + across)) - 2 * (across - 1)
                if need > 0:
                    widths[column + across - 1] = widths.get(column + across - 1, 0) + need
    starts, at = {}, 0
    for c in range(max(widths, default=-1) + 1):
        starts[c] = at
        at += widths[c] + 2 if widths.get(c) else 0
    for child, sees in left:  # what no cell holds
        holder = Node("div")
        holder.children.append(child)
        caption += yield _rendered(holder, sees, pre)
    out = list(caption)
    for cells in rows:
        for i in range(max((len(lines) for _, _, lines in cells), default=0)):
            line = ""
            for column, _, lines in cells:
                if i < len(lines) and lines[i]:
                    line = line.ljust(starts.get(column, at)) + lines[i]
            out.append(line.rstrip(" "))
    return out


def _into(node: Node, out: Lines, visible: bool, pre: bool) -> Task:
    numbering = None
    if node.tag == "ol":
        numbering = _number(node.attrs.get("start", ""), 1, 10**9)
    closed = node.tag == "details" and "open" not in node.attrs
    for child in node.children:
        if isinstance(child, str):
            if visible and not closed:
                out.add(child, pre)
            continue
        tag = child.tag
        has, sees = shown(child, visible)
        if not has or (closed and tag != "summary"):
            continue
        inner_pre = pre or tag in ("pre", "listing", "xmp", "textarea") or ("style" in child.attrs and bool(_PRE.search(child.attrs["style"])))
        if tag == "br":
            out.line_break()
        elif tag == "hr":
            out.block(["---"] if sees else [], True)
        elif tag == "wbr" or tag == "img":
            continue
        elif tag == "input":
            if sees and child.attrs.get("type", "").lower() in ("submit", "button", "reset"):
                out.add(child.attrs.get("value", ""), False)
        elif tag in ("pre", "listing", "textarea") and child.children and isinstance(child.children[0], str) and child.children[0].startswith("\n"):
            child.children[0] = child.children[0][1:]  # the line end after the start tag is not content
            blank = tag in SPACED
            if blank:
                out.edge(True)
            yield _into(child, out, sees, True)
            if blank:
                out.edge(True)
        elif tag == "table":
            out.block((yield _table(child, sees, inner_pre)), True)
        elif tag == "li":
            if numbering is not None:
                numbering = _number(child.attrs.get("value", ""), numbering, 10**9)
                marker, numbering = f"{numbering}. ", numbering + 1
            else:
                marker = "- "
            lines = yield _rendered(child, sees, inner_pre)
            out.block([(marker if not i else " " * len(marker)) + x if x else "" for i, x in enumerate(lines)], False)
        elif tag in ("dd", "blockquote"):
            lines = yield _rendered(child, sees, inner_pre)
            out.block(["  " + x if x else "" for x in lines], tag == "blockquote")
        elif tag in BLOCKS:
            blank = tag in SPACED and not (tag in ("ul", "ol") and node.tag == "li")
            out.edge(blank)
            yield _into(child, out, sees, inner_pre)
            out.edge(blank)
        else:
            yield _into(child, out, sees, inner_pre)


def _rendered(node: Node, visible: bool, pre: bool) -> Task:
    out = Lines()
    yield _into(node, out, visible, pre)
    return out.result()


def rendered(node: Node, visible: bool = True, pre: bool = False) -> list[str]:
    return _run(_rendered(node, visible, pre))


def html_to_text(html: str | None) -> str:
    """The visible text of a page."""
    if not html:
        return ""
    root = parse(html)
    has, sees = shown(root, True)
    return "\n".join(rendered(root, sees)) if has else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [html_to_text(x.as_py()) for x in batch.column(1)]
        lines = [t.count("\n") + 1 if t else 0 for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int64())], ["page_id", "text", "n_lines"])


def extract_text(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, n_lines): the whole visible text of every page. Rows are independent, so nothing is shuffled."""
    return pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{html_col}`").cast("string").alias("html")).mapInArrow(_extract, "page_id long, text string, n_lines long")
