"""HTML to text by layout-aware rendering.

A tolerant tree builder reads tags in one pass, closes what HTML closes by implication (p before a
block, li before li, cells, rows, options, definitions), adds the rows and cells that a table lacks
and ignores end tags without a start.  A renderer walks the tree: what is not displayed gives no
text (head, scripts, styles, templates, ``hidden``, ``display:none`` in a style attribute or in a plain
rule of a style sheet, closed dialogs, closed details but for their summary), nor does what is not
``visibility:visible``, a property that children inherit and may set again; blocks stand on lines of their own, paragraphs and headings
with a blank line around them; list items have a marker and an indent; table cells are aligned in
columns; blanks collapse, but not in pre and textarea.  All visible text is kept, navigation and
footers included.

Any text is a page: none raises, elements may nest to any depth (neither pass recurses), and time and
memory are linear in the page.  Defined results: null or empty HTML gives an empty text; text outside of
all tags is text; an unclosed comment or tag runs to the end of the page, as a browser reads it; a
numeric reference to no character is U+FFFD.  Lists, quotations and tables that lie in more than
``LEVELS`` others are rendered as plain blocks.  Columns of a table are aligned up to ``WIDTH``
characters and ``COLUMNS`` columns; longer cells, and those further right, are kept unpadded.  Each row is
rendered, repeated or not; other columns pass through, whatever their names; one that is named like
the result raises ValueError.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Generator, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orisite.llm.common import bounded_batches

LEVELS, WIDTH, COLUMNS = 30, 80, 200
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
                  "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
                  "summary table tbody td tfoot th thead tr ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
UNSEEN = frozenset("head script style template title noscript noembed noframes iframe object audio video canvas datalist".split())
#: A start tag closes the open elements of its set, up to the nearest of its fence.
CLOSES = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select datalist optgroup"),
    "optgroup": ("option optgroup", "select"), "tr": ("tr td th caption colgroup", "table"), "td": ("td th", "tr table"),
    "th": ("td th", "tr table"), "thead": ("thead tbody tfoot tr td th caption colgroup", "table"),
    "tbody": ("thead tbody tfoot tr td th caption colgroup", "table"), "tfoot": ("thead tbody tfoot tr td th caption colgroup", "table"),
    "caption": ("colgroup", "table"), "body": ("head", "html"),
}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
CLOSES_P = (BLOCK - frozenset("td th tr tbody thead tfoot body html option optgroup caption legend summary".split()), frozenset("p".split()),
            frozenset("td th table li dd button caption".split()))
#: End tags that reach through a fence.
THROUGH = frozenset("table tr td th tbody thead tfoot caption template".split())
FENCE = frozenset("td th table caption template".split())
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NO_DISPLAY = re.compile(r"(?:^|[;\s])display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?:^|[;\s])visibility\s*:\s*(visible|hidden|collapse)", re.I)
COMMENT_END = re.compile(r"--!?>")
NUMBER = re.compile(r"\s*([+-]?[0-9]{1,9})(?![0-9])")
PLAIN = re.compile(r"[.#]?[\w-]+")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|$)", re.I) for tag in RAW}
BLANKS = re.compile(r"[ \t\n\f\r]+")


def characters(s: str) -> str:
    """``s`` with its character references replaced."""
    if "&#" in s:
        s = re.sub(r"&#(x?)0+(?=[0-9a-f])", r"&#\1", s, flags=re.I)
        s = re.sub(r"&#(?:[0-9]{8,}|x[0-9a-f]{7,});?", "\ufffd", s, flags=re.I)  # beyond the last character
    return unescape(s)


def number(s: str | None, least: int, most: int, default: int) -> int:
    """The integer that an attribute begins with, brought between ``least`` and ``most``."""
    m = NUMBER.match(s or "")
    return min(max(int(m[1]), least), most) if m else default


def styled(style: str) -> str | None:
    """none, hidden or visible: what declarations say of being seen."""
    if NO_DISPLAY.search(style):
        return "none"
    said = VISIBILITY.findall(style)
    return None if not said else "visible" if said[-1].lower() == "visible" else "hidden"


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []

    def get(self, name: str) -> str | None:
        """The attribute's value, or None."""
        if self.attrs:
            for m in ATTRIBUTE.finditer(self.attrs):
                if m[1].lower() == name:
                    return characters(m[2] or m[3] or m[4] or "")
        return None


def tag_end(html: str, at: int) -> int:
    """Where the tag ends whose name ends at ``at``: the next > outside of quotes."""
    while m := STOP.search(html, at):
        if m[0] == ">":
            return m.start()
        close = html.find(m[0], m.end())
        if close < 0:  # a quote that is never closed is an ordinary character
            return html.find(">", m.end())
        at = close + 1
    return -1


class Open:
    """The open elements, and for each tag their places, so that no search walks the stack."""

    def __init__(self):
        self.stack, self.places = [Node("#root")], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def top(self, tags: frozenset) -> int:
        """The place of the innermost open element of these tags, or 0."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def cut(self, at: int) -> None:
        """Close the element at the place ``at`` and all inside it."""
        for n in self.stack[at:]:
            self.places[n.tag].pop()
        del self.stack[at:]

    def close(self, tags: frozenset, fence: frozenset) -> None:
        """Close the open elements of ``tags`` down to the nearest element of ``fence``."""
        stop = self.top(fence)
        if self.top(tags) > stop:
            self.cut(min(p[k] for t in tags if (p := self.places.get(t)) and (k := bisect_right(p, stop)) < len(p)))


def build(html: str) -> Node:
    open_, at, size = Open(), 0, len(html)
    root = open_.stack[0]

    def text(s: str) -> None:
        if s:
            open_.stack[-1].children.append(s)

    def push(tag: str, attrs: str = "") -> None:
        node = Node(tag, attrs)
        open_.stack[-1].children.append(node)
        if tag not in VOID:
            open_.push(node)

    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            text(characters(html[at:]))
            break
        if lt > at:
            text(characters(html[at:lt]))
        nxt = html[lt + 1: lt + 2]
        if nxt in "!?" and nxt:
            if html.startswith("<!--", lt):
                if html.startswith((">", "->"), lt + 4):
                    at = html.index(">", lt + 4) + 1
                else:
                    m = COMMENT_END.search(html, lt + 4)
                    at = m.end() if m else size
            else:
                end = html.find(">", lt)
                at = size if end < 0 else end + 1
            continue
        ending = nxt == "/"
        m = NAME.match(html, lt + 1 + ending)
        if not m:
            if ending:  # a bogus comment
                end = html.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                text("<")
                at = lt + 1
            continue
        tag, end = m[0].lower(), tag_end(html, m.end())
        attrs = html[m.end(): end if end >= 0 else size]
        at = size if end < 0 else end + 1
        if ending:
            if tag == "br":
                push("br")
            elif tag == "p" and not open_.places.get("p"):
                open_.stack[-1].children.append(Node("p"))
            elif open_.places.get(tag) and (tag in THROUGH or open_.places[tag][-1] >= open_.top(FENCE)):
                open_.cut(open_.places[tag][-1])
            continue
        if tag in CLOSES_P[0]:
            open_.close(CLOSES_P[1], CLOSES_P[2])
        if tag in CLOSES:
            open_.close(*CLOSES[tag])
        if tag in ("td", "th") and open_.stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            push("tr")
        push(tag, attrs.rstrip("/"))
        if tag in RAW:
            stop = RAW_END[tag].search(html, at)
            body = html[at: stop.start() if stop else size]
            open_.stack[-1].children.append(characters(body) if tag in ("textarea", "title") else body)
            open_.cut(len(open_.stack) - 1)
            end = html.find(">", stop.end()) if stop else -1
            at = size if end < 0 else end + 1
    return root


Rules = dict[str, str]  # a plain selector (tag, .class or #id) -> none, hidden or visible


def hiding_rules(root: Node) -> Rules:
    """What style sheets say of plain selectors."""
    found, todo = {}, [root]
    while todo:
        n = todo.pop()
        for c in n.children:
            if isinstance(c, Node):
                if c.tag == "style":
                    for part in "".join(x for x in c.children if isinstance(x, str)).split("}"):
                        selectors, _, body = part.rpartition("{")
                        said = styled(body) if selectors else None
                        for sel in selectors.rpartition("{")[2].split(",") if said else ():
                            sel = sel.strip()
                            if PLAIN.fullmatch(sel):
                                found[sel if sel[0] in ".#" else sel.lower()] = said
                else:
                    todo.append(c)
    return found


def run(task: Generator):
    """The result of a task, which yields the tasks that it waits for: recursion on a list."""
    waiting, value = [task], None
    while waiting:
        try:
            waiting.append(waiting[-1].send(value))
            value = None
        except StopIteration as done:
            waiting.pop()
            value = done.value
    return value


class Renderer:
    """Collects lines: ``out`` are done, ``line`` holds the parts of the open one, ``gap`` is the number of
    line ends owed.  Methods that walk the tree are tasks for ``run``."""

    def __init__(self, rules: Rules, level: int = 0, visible: bool = True):
        self.rules, self.level, self.visible = rules, level, visible
        self.out: list[str] = []
        self.line: list[str] = []
        self.gap, self.blank = 0, False

    def seen(self, n: Node) -> str | None:
        """none: not displayed; hidden or visible: as set here; None: as around it."""
        if n.tag in UNSEEN or n.tag == "input":
            return "none"
        said = self.rules.get(n.tag) if self.rules else None
        if not n.attrs:
            return "none" if n.tag == "dialog" else said
        if n.get("hidden") is not None or n.tag == "dialog" and n.get("open") is None:
            return "none"
        if self.rules:
            names = ["." + c for c in (n.get("class") or "").split()] + ["#" + (n.get("id") or "")]
            all_said = [said, *(self.rules.get(c) for c in names)]
            said = "none" if "none" in all_said else next((x for x in reversed(all_said) if x), None)
        return said if said == "none" else styled(n.get("style") or "") or said

    def owe(self, ends: int) -> None:
        """What follows begins a line of its own, after ``ends - 1`` blank ones."""
        self.flush()
        self.gap = max(self.gap, ends)

    def flush(self) -> None:
        line = "".join(self.line)
        if line.strip():
            self.put(line.rstrip())
        self.line, self.blank = [], False

    def put(self, line: str) -> None:
        if self.out:
            self.out.extend([""] * (max(self.gap, 1) - 1))
        self.out.append(line)
        self.gap = 1

    def write(self, s: str) -> None:
        if not self.visible:
            return
        s = BLANKS.sub(" ", s)
        if not s:
            return
        if s[0] == " ":
            self.blank, s = True, s[1:]
        if s:
            if self.blank and self.line and not self.line[-1].endswith(" "):
                self.line.append(" ")
            self.blank = s[-1] == " "
            if kept := s.rstrip(" "):
                self.line.append(kept)

    def inner(self, n: Node) -> Generator:
        """The lines of a subtree on its own."""
        r = Renderer(self.rules, self.level + 1, self.visible)
        yield r.children(n)
        r.flush()
        return r.out

    def within(self, n: Node, task: Callable[[Node], Generator]) -> Generator:
        """``task(n)`` under the visibility of ``n``, if it is displayed."""
        said = self.seen(n)
        if said == "none":
            return None
        before, self.visible = self.visible, self.visible if said is None else said == "visible"
        value = yield task(n)
        self.visible = before
        return value

    def children(self, n: Node) -> Generator:
        closed = n.tag == "details" and n.get("open") is None
        for c in n.children:
            if closed and (isinstance(c, str) or c.tag != "summary"):
                continue
            if isinstance(c, str):
                self.write(c)
            else:
                yield self.within(c, self.node)
            if closed:
                return

    def node(self, n: Node) -> Generator:
        tag = n.tag
        if tag == "br":
            if any(x.strip() for x in self.line):
                self.flush()
            elif self.out:
                self.gap = min(self.gap + 1, 2)
        elif tag == "hr":
            self.owe(1)
        elif tag in ("pre", "textarea", "xmp"):
            self.owe(2 if tag == "pre" else 1)
            body = "".join(self.raw(n)).replace("\r\n", "\n")
            for i, line in enumerate(body.removeprefix("\n").rstrip().split("\n")):
                if line or i:
                    self.put(line.rstrip())
            self.gap = 2 if tag == "pre" else 1
        elif tag in ("ul", "ol", "menu", "dir"):
            yield self.list(n)
        elif tag == "table" and self.level < LEVELS:
            yield self.table(n)
        elif tag in BLOCK:
            ends = 2 if tag in SPACED else 1
            self.owe(ends)
            if tag in ("blockquote", "dd") and self.level < LEVELS:
                self.indented((yield self.inner(n)), "  ", "  ")
            else:
                yield self.children(n)
            self.owe(ends)
        else:
            yield self.children(n)

    def raw(self, n: Node) -> Iterator[str]:
        """The text of a subtree as it stands."""
        todo = [(c, self.visible) for c in reversed(n.children)]
        while todo:
            c, visible = todo.pop()
            if isinstance(c, str):
                if visible:
                    yield c
            elif (said := self.seen(c)) != "none":
                if c.tag == "br":
                    yield "\n"
                todo += [(x, visible if said is None else said == "visible") for x in reversed(c.children)]

    def indented(self, lines: list[str], first: str, rest: str) -> None:
        for i, line in enumerate(lines):
            self.put(((first if i == 0 else rest) + line).rstrip())

    def list(self, n: Node) -> Generator:
        self.owe(1)
        at = number(n.get("start"), -10 ** 9, 10 ** 9, 1)
        for c in n.children:
            if isinstance(c, str):
                self.write(c)
            elif c.tag != "li":
                yield self.within(c, self.node)
            elif self.seen(c) != "none":
                self.owe(1)
                mark = f"{at}. " if n.tag == "ol" else "- "
                at += 1
                if self.level < LEVELS:
                    self.indented((yield self.within(c, self.inner)), mark, " " * len(mark))
                else:
                    self.write(mark)
                    yield self.within(c, self.children)
        self.owe(1)

    def table(self, n: Node) -> Generator:
        self.owe(2)
        rows, loose, todo = [], [], list(reversed(n.children))
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                if c.strip():
                    loose.append(c)
            elif c.tag in ("tbody", "thead", "tfoot") and self.seen(c) is None:
                todo += reversed(c.children)
            elif c.tag in ("tbody", "thead", "tfoot", "tr"):
                rows += (yield self.within(c, self.rows)) or []
            else:  # captions, and content that a browser would move before the table
                yield self.within(c, self.node)
                self.owe(1)
        if loose:
            self.write(" ".join(loose))
            self.owe(1)
        for line in aligned(rows):
            if line:
                self.put(line)
        self.gap = 2

    def rows(self, n: Node) -> Generator:
        """The rows, lists of (text, colspan, rowspan), of a tr or of a group of them."""
        if n.tag != "tr":
            found = []
            for c in n.children:
                if isinstance(c, Node):
                    found += (yield self.within(c, self.rows)) or []
            return found
        row = []
        for d in n.children:
            if isinstance(d, str):
                if d.strip() and self.visible:
                    row.append((" ".join(d.split()), 1, 1))
            elif self.seen(d) != "none":
                cell = d.tag in ("td", "th")
                lines = (yield self.within(d, self.inner)) if cell else (yield self.wrapped(d))
                text = " ".join(x for x in (y.strip() for y in lines) if x)
                row.append((text, number(d.get("colspan"), 1, 1000, 1) if cell else 1, number(d.get("rowspan"), 0, 65534, 1) if cell else 1))
        return [row]

    def wrapped(self, n: Node) -> Generator:
        outer = Node("#cell")
        outer.children.append(n)
        return self.inner(outer)


def aligned(rows: list[list[tuple[str, int, int]]]) -> Iterator[str]:
    """A line for each row, its cells in columns."""
    most = min(max((len(r) for r in rows), default=0), COLUMNS)  # spans over more columns than cells only add empty ones
    placed, taken = [], {}  # taken: column -> rows that a cell from above still takes
    for row in rows:
        at, cells = 0, []
        for text, across, down in row:
            while at < COLUMNS and taken.get(at, 0) > 0:
                at += 1
            end = min(at + min(across, most), max(COLUMNS, at + 1))
            cells.append((text, at, end))
            if down != 1:
                for k in range(at, min(end, COLUMNS)):
                    taken[k] = down if down else len(rows) + 1
            at = end
        placed.append(cells)
        taken = {k: v - 1 for k, v in taken.items() if v > 1}
    widths = [0] * (COLUMNS + 1)
    for cells in placed:
        for text, at, end in cells:
            if end == at + 1 <= COLUMNS and len(text) <= WIDTH:
                widths[at] = max(widths[at], len(text))
    starts = [0]
    for w in widths:
        starts.append(starts[-1] + (w + 2 if w else 0))
    for cells in placed:
        line, size = [], 0
        for text, at, _ in cells:
            if not text:
                continue
            gap = max(starts[min(at, COLUMNS)] - size, 2 if line else 0)
            line += [" " * gap, text]
            size += gap + len(text)
        yield "".join(line).rstrip()


def render(html: str | None) -> str:
    """The visible text of one page."""
    if not html:
        return ""
    root = build(html)
    r = Renderer(hiding_rules(root) if "<style" in html.lower() else {})
    run(r.children(root))
    r.flush()
    return "\n".join(r.out).strip("\n")


def extract_text(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``pages`` (all but the HTML, if None) and ``page_text``."""
    keep = [c for c in pages.columns if c != html_col] if keep is None else keep
    if "page_text" in keep:
        raise ValueError("a kept column is named page_text, like the result: rename it first")
    slim = pages.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("__row"), F.col(f"`{html_col}`").alias("html"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({"__row": b.column("__row"), "page_text": pa.array(map(render, b.column("html").to_pylist()), pa.string())})

    return bounded_batches(slim).mapInArrow(scan, StructType([slim.schema["__row"]]).add("page_text", "string")).select("__row.*", "page_text")
