"""Operator 5, layout-aware text of HTML pages.

A tree builder with implied tags reads each page; a renderer walks the tree and writes all visible text the way it is laid
out: block elements on lines of their own with blank lines between paragraphs, list items behind their markers, table cells
in aligned columns. Content of svg, math and object is left out, though browsers show text of theirs. Every page is a row's own work inside Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysweep.llm.common import read, small_batches

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|"
                    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.S)
_SPACES = re.compile(r"[ \t\n\r\f]+")
_GONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title iframe noembed noframes object svg canvas audio video datalist "
                   "math map area param rp".split())
#: Blank lines around a block; blocks of 0 only stand on lines of their own.
MARGIN = {**dict.fromkeys("address article aside body center dd details dialog dir div dt fieldset footer form header hgroup "
                          "html li main menu nav section summary legend figcaption option optgroup tr tbody thead tfoot "
                          "caption td th".split(), 0),
          **dict.fromkeys("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul".split(), 1)}
#: Start tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: For a start tag: the open elements it ends, and those behind which it doesn't look.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir", "td", "th", "table"}),
          "dt": ({"dt", "dd"}, {"dl", "td", "th", "table"}), "dd": ({"dt", "dd"}, {"dl", "td", "th", "table"}),
          "option": ({"option"}, {"select", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
          "td": ({"td", "th", "caption"}, {"tr", "table"}), "th": ({"td", "th", "caption"}, {"tr", "table"}),
          "tr": ({"tr", "caption"}, {"table", "tbody", "thead", "tfoot"}),
          "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
          "thead": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
          "tfoot": ({"tbody", "thead", "tfoot", "caption"}, {"table"})}
#: An end tag doesn't reach out of these, but for the tags of the table itself.
WALLS = frozenset("td th caption table button".split())
TABLE_TAGS = frozenset("table tbody thead tfoot tr td th caption".split())
#: Elements deeper than this join their parent: layout is lost there, text is not.
DEEPEST = 150
#: The most columns that one cell may span.
SPAN = 1000


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def hidden(self) -> bool:
        a = self.attrs
        return (self.tag in HIDDEN or "hidden" in a or self.tag == "dialog" and "open" not in a
                or "style" in a and _GONE.search(a["style"]) is not None)


def attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html.unescape(value.strip("\"'")))
    return found


def parse(page: str) -> Node:
    """The page's tree; unclosed, misnested and unknown tags are no errors."""
    root = Node("#root", {})
    stack = [root]

    def close(tags: set | frozenset, walls: set | frozenset) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in walls:
                return

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if at < (m.start() if m else len(page)):
            stack[-1].children.append(html.unescape(page[at:m.start() if m else len(page)]))
        if m is None:
            return root
        at = m.end()
        if m[0].startswith("<![CDATA["):
            stack[-1].children.append(m[0][9:].removesuffix("]]>"))
            continue
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in HEADINGS:
                close(HEADINGS, WALLS)
            elif tag == "br":
                stack[-1].children.append(Node("br", {}))
            else:
                close({tag}, {"table"} - {tag} if tag in TABLE_TAGS else WALLS - {tag})
            continue
        if tag in ENDS_P:
            close({"p"}, WALLS)
        if tag in CLOSES:
            while True:
                depth = len(stack)
                close(*CLOSES[tag])
                if len(stack) == depth:
                    break
        node = Node(tag, attributes(m[3]) if m[3] else {})
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            stop = end.start() if end else len(page)
            text = page[at:stop]
            node.children.append(html.unescape(text) if tag in ("textarea", "title") else text)
            at = page.find(">", stop) + 1 or len(page)
        elif tag not in VOID and len(stack) < DEEPEST:
            stack.append(node)


class Flow:
    """Lines of one block context."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap = 0

    def put(self, lines: list[str]) -> None:
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        self.lines += lines

    def text(self, text: str) -> None:
        text = _SPACES.sub(" ", text)
        if not self.parts or self.parts[-1].endswith(" "):
            text = text.removeprefix(" ")
        if text:
            self.parts.append(text)

    def end_line(self) -> bool:
        line = "".join(self.parts).rstrip(" ")
        self.parts = []
        if line:
            self.put([line])
        return bool(line)

    def block(self, margin: int) -> None:
        self.end_line()
        self.gap = max(self.gap, margin)

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


def render(node: Node, flow: Flow, pre: bool = False) -> None:
    for child in node.children:
        if isinstance(child, str):
            if pre:
                first, *others = child.split("\n")
                flow.parts.append(first)
                for line in others:
                    flow.put(["".join(flow.parts).rstrip()])
                    flow.parts = [line]
            else:
                flow.text(child)
            continue
        tag = child.tag
        if child.hidden():
            continue
        if tag == "br":
            if not flow.end_line() and flow.lines:
                flow.gap = max(flow.gap, 1)
        elif tag == "hr":
            flow.block(1)
            flow.put(["---"])
            flow.gap = 1
        elif tag == "table":
            flow.block(1)
            flow.put(table(child))
            flow.gap = 1
        elif tag in ("ul", "ol", "menu", "dir"):
            listing(child, flow)
        elif tag in ("blockquote", "dd"):
            inset(child, flow, MARGIN[tag], "  ", "  ")
        elif tag == "details" and "open" not in child.attrs:
            flow.block(0)
            for x in child.children:
                if isinstance(x, Node) and x.tag == "summary":
                    render(x, flow)
            flow.block(0)
        elif tag in MARGIN:
            flow.block(MARGIN[tag])
            if tag == "pre" and child.children and isinstance(child.children[0], str):
                child.children[0] = child.children[0].removeprefix("\n")
            render(child, flow, pre or tag == "pre")
            flow.block(MARGIN[tag])
        else:
            render(child, flow, pre)


def inset(node: Node, flow: Flow, margin: int, first: str, later: str) -> None:
    """A block whose lines stand behind a marker."""
    inner = Flow()
    render(node, inner)
    flow.block(margin)
    if lines := inner.done():
        flow.put([(first if k == 0 else later) + line if line else "" for k, line in enumerate(lines)])
    flow.gap = max(flow.gap, margin)


def listing(node: Node, flow: Flow) -> None:
    margin = 0 if node.attrs.get("#nested") else 1
    flow.block(margin)
    start = node.attrs.get("start", "1")
    number = int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1
    loose = Node("li", {})
    for child in node.children:
        if isinstance(child, Node) and child.tag == "li":
            if child.hidden():
                continue
            for x in child.children:
                if isinstance(x, Node) and x.tag in ("ul", "ol"):
                    x.attrs["#nested"] = "1"
            marker = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            inset(child, flow, 0, marker, " " * len(marker))
        else:
            loose.children = [child]
            render(loose, flow)
    flow.block(margin)


def table(node: Node) -> list[str]:
    """Rows of cells, each column as wide as its widest cell that spans no other."""
    captions, rows = [], []

    def collect(parent: Node) -> None:
        loose = None
        for child in parent.children:
            if isinstance(child, str):
                if child.strip():
                    captions.append(Node("div", {}))
                    captions[-1].children.append(child)
            elif child.hidden():
                continue
            elif child.tag in ("tbody", "thead", "tfoot"):
                collect(child)
            elif child.tag == "tr":
                loose = None
                rows.append([x for x in child.children if isinstance(x, Node) and x.tag in ("td", "th") and not x.hidden()])
                others = Node("div", {})
                others.children = [x for x in child.children if not (isinstance(x, Node) and x.tag in ("td", "th"))]
                captions.append(others)
            elif child.tag in ("td", "th"):
                if loose is None:
                    loose = []
                    rows.append(loose)
                loose.append(child)
            else:
                captions.append(child)

    collect(node)
    above = Flow()
    for x in captions:
        box = Node("div", {})
        box.children = [x]
        render(box, above)
        above.block(0)
    grid, taken = [], {}
    for r, cells in enumerate(rows):
        at, line = 0, []
        for cell in cells:
            while taken.get(at, 0) > r:
                at += 1
            inner = Flow()
            render(cell, inner)
            wide, tall = (int(x) if (x := cell.attrs.get(n, "1")).isascii() and x.isdigit() and len(x) < 5 else 1
                          for n in ("colspan", "rowspan"))
            wide = max(1, min(wide, SPAN))
            line.append((at, wide, inner.done()))
            for k in range(at, at + wide if tall > 1 else at):
                taken[k] = r + min(tall, SPAN)
            at += wide
        grid.append(line)
    widths: dict[int, int] = {}
    for line in grid:
        for at, wide, lines in line:
            if wide == 1:
                widths[at] = max([widths.get(at, 0), *map(len, lines)])
    out = above.done()
    columns = sorted({at for line in grid for at, _, _ in line})
    left, where = 0, {}
    for at in columns:
        where[at] = left
        left += widths.get(at, 0) + 2
    for line in grid:
        for k in range(max((len(lines) for _, _, lines in line), default=0)):
            text = ""
            for at, _, lines in line:
                if k < len(lines) and lines[k]:
                    text = (text + "  " if len(text) > where[at] - 2 and text else text.ljust(where[at])) + lines[k]
            out.append(text.rstrip())
    return out


def text_of(page: str) -> str:
    """All visible text of a page as laid out."""
    flow = Flow()
    render(parse(page), flow)
    lines = [line.replace("\xa0", " ").rstrip() for line in flow.done()]
    return "\n".join(lines).strip("\n")


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text and n_chars of every page.

    Hidden are the elements that browsers don't show (head, script, style, template and so on), those with the attribute
    ``hidden`` or an inline style that hides them, and what a closed ``details`` or ``dialog`` holds.

    Edge cases: a null or empty page, or one without visible text, has an empty text; text without any tag is a page too; of
    elements nested deeper than 150 only the layout is lost; very long pages are read whole; repeated rows stay repeated;
    an empty table gives no rows; other columns are ignored.
    """
    small_batches(pages.sparkSession)
    table_ = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"),
                          F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_of(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["page_id", "text"])

    return table_.mapInArrow(run, "page_id long, text string").withColumn("n_chars", F.length("text").cast("long"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return extract(read(spark, sf_dir, "pages"))


QUERIES = {"op5_html_text": op5_html_text}
ORACLE: dict[str, str] = {}
