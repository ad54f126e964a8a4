"""HTML to text as it is laid out: a tree with implied tags, visibility rules, then blocks, lists and table cells.

Every visible text comes out, in document order. White space is collapsed outside preformatted text; blocks start on a
line of their own, paragraphs and headings with an empty line around them; list items carry their mark and are indented
by level; the cells of a table are aligned by column (columns wider than WIDEST are not padded). Nothing is taken from
what a browser doesn't show: head, scripts, styles, templates, comments, hidden elements; and not form values (input,
textarea, select). Formulas and the labels of inline drawings come out, their annotations, descriptions and definitions
don't; labels, cells and the parts of a fraction are set apart by a space.

Null and empty pages give an empty text; broken markup never fails: unknown closing tags are ignored, what is open at the
end is closed. The work is linear and without recursion, so deep nesting is safe. Rows come out as they came in; other
columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from helmline.llm.common import small_batches

WIDEST = 80

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template title noscript noembed noframes iframe object audio video canvas "
                   "datalist select option optgroup textarea meta link base".split())
#: Elements that are not shown inside svg and math, and those that stand apart there.
FOREIGN = {"svg": frozenset("title desc defs metadata symbol clippath mask pattern marker".split()),
           "math": frozenset("annotation annotation-xml".split())}
APART = frozenset("text mtd mfrac".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
                   "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section "
                   "summary table ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure hr menu dir".split())
#: What an opening tag closes when it is open, and the elements the search stops at.
IMPLIED = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select datalist optgroup"),
    "optgroup": ("option optgroup", "select"), "tr": ("tr td th caption colgroup", "table"), "td": ("td th", "tr table"),
    "th": ("td th", "tr table"), "thead": ("thead tbody tfoot tr td th caption colgroup", "table"),
    "tbody": ("thead tbody tfoot tr td th caption colgroup", "table"), "tfoot": ("thead tbody tfoot tr td th caption colgroup", "table"),
    "body": ("head", "html"),
}
IMPLIED_SETS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED.items()}
#: Elements that an open p ends at.
CLOSES_P = BLOCKS - frozenset("body html li dd dt legend caption frameset".split())
P_SCOPE = frozenset("button td th caption table html".split())
SCOPE = frozenset("table td th html".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HIDING = re.compile(r"(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))")
GAP = re.compile(r"[ \t\n\r\f]+")


@dataclass
class Node:
    tag: str
    attributes: str = ""
    children: list = field(default_factory=list)
    foreign: bool = False
    unseen: bool = False
    apart: bool = False

    def get(self, name: str) -> str | None:
        if name not in self.attributes.lower():
            return None
        for m in ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return html.unescape(m[2] or m[3] or m[4] or "")
        return None


def tree(page: str) -> Node:
    """The elements of a page; texts are strings with their character references resolved."""
    root = Node("#root")
    stack, names = [root], {"#root": 1}

    def close(to: int) -> None:
        while len(stack) > to:
            names[stack.pop().tag] -= 1

    def close_one(tags: frozenset[str], stop: frozenset[str]) -> None:
        """Close the outermost open element of tags above the nearest element of stop."""
        if not any(names.get(t) for t in tags):
            return
        found = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in stop:
                break
            if stack[i].tag in tags:
                found = i
        if found:
            close(found)

    at = 0
    lowered = page.lower()
    for m in iter(lambda: TOKEN.search(page, at), None):
        if m.start() > at:
            stack[-1].children.append(html.unescape(page[at:m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag == "p" and not names.get("p"):
                stack[-1].children.append(Node("p"))
            elif names.get(tag):
                stop = SCOPE if tag not in SCOPE else frozenset(["table"]) if tag in ("td", "th") else frozenset()
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
                    if stack[i].tag in stop:
                        break
            continue
        if tag in CLOSES_P and names.get("p"):
            close_one(frozenset(["p"]), P_SCOPE)
        if tag in IMPLIED_SETS:
            close_one(*IMPLIED_SETS[tag])
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            stack[-1].children.append(row := Node("tr"))
            stack.append(row)
            names["tr"] = names.get("tr", 0) + 1
        node = Node(tag, m[3])
        if names.get("svg") or names.get("math"):
            node.foreign = True
            node.unseen = any(names.get(k) and tag in unseen for k, unseen in FOREIGN.items())
            node.apart = tag in APART or stack[-1].tag == "mfrac"
        stack[-1].children.append(node)
        if tag in VOID or (node.foreign or tag in FOREIGN) and m[3].endswith("/"):
            continue
        if tag in RAW:
            end = lowered.find(f"</{tag}", at)
            end = len(page) if end < 0 else end
            node.children.append(page[at:end])
            at = page.find(">", end) + 1 or len(page)
            continue
        stack.append(node)
        names[tag] = names.get(tag, 0) + 1
    if at < len(page):
        stack[-1].children.append(html.unescape(page[at:]))
    return root


def visible(node: Node) -> bool:
    if node.tag in UNSEEN or node.unseen:
        return False
    if node.foreign and (node.get("display") == "none" or node.get("visibility") in ("hidden", "collapse")):
        return False
    if node.tag == "input" or not node.attributes:
        return node.tag != "input"
    if node.get("hidden") is not None:
        return False
    style = node.get("style")
    return not (style and HIDING.search(style.lower()))


class Flow:
    """Text that is being laid out in one column."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.breaks = 0
        self.gap = False
        self.line_open = False

    def add(self, text: str) -> None:
        if self.breaks and self.parts:
            self.parts.append("\n" * self.breaks)
        elif self.gap and self.line_open:
            self.parts.append(" ")
        self.parts.append(text)
        self.breaks, self.gap, self.line_open = 0, False, True

    def text(self, text: str) -> None:
        words = GAP.sub(" ", text)
        if words.startswith(" "):
            self.gap = True
        if bare := words.strip(" "):
            self.add(bare)
            self.gap = words.endswith(" ")

    def block(self, lines: int) -> None:
        """What follows starts after at least so many line ends."""
        self.breaks, self.gap, self.line_open = max(self.breaks, lines), False, False

    def line_end(self) -> None:
        self.breaks, self.gap, self.line_open = self.breaks + 1, False, False

    def result(self) -> str:
        return "".join(self.parts).strip("\n")


def _table(rows: list[list[tuple[str, int]]]) -> str:
    """Rows of (text, columns it spans), aligned."""
    lines_of, widths = [], []
    for row in rows:
        cells = []
        for text, span in row:
            cells.append(text.split("\n"))
            cells += [[""]] * (min(span, 100) - 1)
        lines_of.append(cells)
        for i, cell in enumerate(cells):
            width = max(map(len, cell))
            if i == len(widths):
                widths.append(0)
            widths[i] = max(widths[i], min(width, WIDEST))
    out = []
    for cells in lines_of:
        for k in range(max(map(len, cells), default=0)):
            out.append("  ".join((c[k] if k < len(c) else "").ljust(widths[i]) for i, c in enumerate(cells)).rstrip())
    return "\n".join(out)


def _number(text: str | None, default: int) -> int:
    text = (text or "").strip()
    return int(text) if re.fullmatch(r"-?[0-9]{1,9}", text) else default


def render(root: Node) -> str:
    """The visible text of a tree."""
    flows, rows, lists = [Flow()], [], []
    pre = 0
    work: list[tuple[Node | str, bool]] = [(root, False)]
    while work:
        node, leaving = work.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if rows and rows[-1][1] is None and not node.strip():
                continue
            if pre:
                for i, line in enumerate(node.split("\n")):
                    if i:
                        flow.line_end()
                    if line:
                        flow.add(line)
            else:
                flow.text(node)
            continue
        tag = node.tag
        if not leaving:
            if not visible(node):
                continue
            if node.apart:
                flow.gap = True
            if tag == "br":
                flow.line_end()
                continue
            if tag in BLOCKS:
                flow.block(2 if tag in SPACED and not (lists and tag in ("ul", "ol", "menu", "dir")) else 1)
            if tag == "hr":
                continue
            if tag == "table":
                rows.append(([], None))
            elif tag == "tr" and rows:
                rows[-1] = (rows[-1][0], True)
                rows[-1][0].append([])
            elif tag in ("td", "th") and rows and rows[-1][0]:
                flows.append(Flow())
            elif tag in ("ul", "ol", "menu", "dir"):
                lists.append([tag, _number(node.get("start"), 1)])
            elif tag == "li":
                flows.append(Flow())
            elif tag == "pre":
                pre += 1
            work.append((node, True))
            work.extend((c, False) for c in reversed(node.children))
            continue
        if node.apart:
            flow.gap = True
        if tag == "table":
            done = rows.pop()[0]
            if text := _table([r for r in done if any(t for t, _ in r)]):
                flow.block(2)
                flow.add(text)
            flow.block(2)
        elif tag == "tr" and rows:
            rows[-1] = (rows[-1][0], None)
        elif tag in ("td", "th") and rows and rows[-1][0]:
            rows[-1][0][-1].append((flows.pop().result(), max(_number(node.get("colspan"), 1), 1)))
        elif tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
        elif tag == "li":
            text = flows.pop().result()
            flow = flows[-1]
            mark = "- "
            if lists and lists[-1][0] == "ol":
                lists[-1][1] = _number(node.get("value"), lists[-1][1])
                mark = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            if text:
                flow.block(1)
                flow.add(mark + text.replace("\n", "\n" + " " * len(mark)))
                flow.block(1)
        elif tag == "pre":
            pre -= 1
        if tag in BLOCKS and tag != "table":
            flows[-1].block(2 if tag in SPACED and not (lists and tag in ("ul", "ol", "menu", "dir")) else 1)
    return flows[0].result()


def text_of(page: str | None) -> str:
    return render(tree(page)) if page else ""


def extract(df: DataFrame, page_id: str = "page_id", page: str = "html") -> DataFrame:
    """(page_id, text) of every row. Row by row, no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "held", 4 << 20):
            found = pa.array([text_of(x) for x in batch.column("held").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("own_id"), found], ["own_id", "text"])

    rows = df.select(F.col(f"`{page_id}`").alias("own_id"), F.col(f"`{page}`").cast("string").alias("held"))
    kind = rows.schema["own_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"own_id {kind}, text string").withColumnRenamed("own_id", page_id)
