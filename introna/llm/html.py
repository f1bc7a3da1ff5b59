"""Text of HTML pages, laid out as a browser shows it.

A small tree builder reads tags, supplies the end tags HTML leaves out and drops what is not shown
(scripts, styles, hidden elements, closed details, fallbacks, what svg and math only describe or define); the renderer walks the tree without
recursion. Blocks are kept apart by line breaks or blank lines, list items carry marks and indents,
table cells stand in aligned columns, preformatted text keeps its spaces. A cell is a block of lines of its
own, with the lists, paragraphs and tables it holds; inner tables are laid out before outer ones. Cells that
span rows keep their columns. What is hidden by visibility shows again where an inner element says so.

Defined results: null or empty pages give the empty text; broken markup never fails: unclosed elements
end with their parent or the page, stray end tags are dropped; pages of any length are read whole;
repeated rows give equal results; all columns but the page pass through, whatever their names, except
``text``, which is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import html
import itertools
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed values of HTML: element names by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSHOWN = frozenset(
    "head title script style template noscript iframe noembed noframes object video audio canvas datalist base link meta param source track area map dialog".split()
)
FOREIGN = frozenset(("svg", "math"))
FOREIGN_UNSHOWN = frozenset("title desc defs metadata symbol clippath mask pattern marker annotation annotation-xml mphantom".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())  # what does not end an open head
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure fieldset hr menu dir".split())  # blank line around
BLOCK = SPACED | frozenset(
    "html body div section article aside nav header footer main address form li dt dd tr td th thead tbody tfoot caption colgroup figcaption details summary legend center hgroup search option optgroup text".split()
)
CLOSES_P = BLOCK - frozenset("html body li dt dd tr td th thead tbody tfoot caption colgroup summary legend option optgroup text".split())
#: an opening tag ends open elements of these names, up to the nearest of the borders
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    **{x: ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}) for x in ("thead", "tbody", "tfoot")},
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
SCOPES = frozenset("table td th caption html template".split())  # what an end tag or an implied end of p does not cross

WS = r"[ \t\n\f\r]"
#: a quote begins a value right after the equals sign only, and only where it is closed
VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^ \t\n\f\r>]++)"""
ATTRIBUTE = re.compile(rf"([^ \t\n\f\r/>][^ \t\n\f\r/>=]*+)(?:{WS}*+={WS}*+({VALUE})?+)?+")
TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^ \t\n\f\r/>]*+)((?:(?:{WS}|/)++|{ATTRIBUTE.pattern.replace('(', '(?:', 1).replace(f'({VALUE})', VALUE)})*+)>|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL,
)
UNENDED = re.compile(r"<[!?/]")
SPACES = re.compile(r"[ \t\n\f\r]+")
HIDING = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)


class Node:
    __slots__ = ("name", "attributes", "children", "hidden", "unseen", "lines")

    def __init__(self, name: str, attributes: str = ""):
        self.name, self.attributes, self.children = name, attributes, []
        self.hidden = self.unseen = False  # with all below it; its own text only
        self.lines: list[str] = []  # of a table

    def get(self, key: str) -> str | None:
        for m in ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == key:
                value = m[2] or ""
                return html.unescape(value[1:-1] if len(value) > 1 and value[0] in "\"'" and value[0] == value[-1] else value)
        return None


def is_hidden(node: Node) -> bool:
    if node.name in UNSHOWN:
        return not (node.name == "dialog" and node.get("open") is not None)
    if not node.attributes:
        return False
    low = node.attributes.lower()
    if "hidden" in low and (node.get("hidden") is not None or (node.name == "input" and (node.get("type") or "").lower() == "hidden")):
        return True
    return "style" in low and bool(HIDING.search(node.get("style") or ""))


def is_unseen(node: Node, parent: Node) -> bool:
    """Whether an element's own text is invisible: as its style says, else like its parent's."""
    if "visibility" in node.attributes.lower():
        told = VISIBILITY.findall(node.get("style") or "")
        if told:
            return told[-1].lower() != "visible"
    return parent.unseen


def whole_number(text: str | None, default: int) -> int:
    return int(text) if text and re.fullmatch(r"-?[0-9]{1,9}", text.strip()) else default


def parse(page: str) -> Node:
    """The tree of a page, with the end tags that HTML implies."""
    root = Node("html")
    open_, at = [root], 0
    counts: Counter[str] = Counter()  # open elements by name
    borders: list[int] = []  # places of the open elements that begin or end foreign content

    def text(a: int, b: int) -> None:
        if a < b:
            piece = page[a:b]
            if open_[-1].name == "head" and piece.strip(" \t\n\f\r"):
                drop(len(open_) - 1)
            if open_[-1].unseen:
                return
            open_[-1].children.append(html.unescape(piece) if "&" in piece else piece)

    def drop(i: int) -> None:
        for node in open_[i:]:
            counts[node.name] -= 1
        while borders and borders[-1] >= i:
            borders.pop()
        del open_[i:]

    def close(names, limits) -> None:
        """End the outermost open element of these names inside the nearest limit, with all it holds."""
        if not any(counts[n] for n in names):
            return
        found = 0
        for i in range(len(open_) - 1, 0, -1):
            if open_[i].name in names:
                found = i
            elif open_[i].name in limits:
                break
        if found:
            drop(found)

    def in_foreign() -> bool:
        """Whether the innermost element is one of svg or math, not HTML inside them."""
        return bool(borders) and open_[borders[-1]].name in FOREIGN

    size, last = len(page), page.rfind(">")
    while at < size:
        if at > last:  # no tag ends here any more
            m = UNENDED.search(page, at)
            text(at, m.start() if m else size)
            break
        m = TOKEN.search(page, at)
        if not m:
            text(at, size)
            break
        text(at, m.start())
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "br":
                if open_[-1].name == "head":
                    drop(len(open_) - 1)
                open_[-1].children.append(Node("br"))
            elif name == "p" and not counts["p"]:
                open_[-1].children.append(Node("p"))
            elif counts[name]:
                for i in range(len(open_) - 1, 0, -1):
                    if open_[i].name == name:
                        drop(i)
                        break
                    if open_[i].name in SCOPES and name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                        break
            continue
        if name == "html" or name == "head" and (len(open_) > 1 or any(not isinstance(c, str) or c.strip(" \t\n\f\r") for c in root.children)):
            continue  # a page has one of each, at its beginning
        if open_[-1].name == "head" and name not in IN_HEAD:
            drop(len(open_) - 1)
        if name in ENDS:
            close(*ENDS[name])
        if name in CLOSES_P:
            close({"p"}, SCOPES | {"button", "li"})
        node = Node(name, m[3])
        foreign = counts["svg"] or counts["math"]
        node.hidden = is_hidden(node) or bool(foreign and name in FOREIGN_UNSHOWN)
        node.unseen = is_unseen(node, open_[-1])
        open_[-1].children.append(node)
        if m[3].endswith("/") and (name in FOREIGN or foreign and in_foreign()):
            continue  # a slash closes nothing but void and foreign elements
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            stop = end.start() if end else size
            if not node.unseen:
                node.children.append(html.unescape(page[at:stop]) if name in ("textarea", "title") else page[at:stop])
            at = end.end() if end else size
        elif name not in VOID:
            if name in FOREIGN or name == "foreignobject":
                borders.append(len(open_))
            open_.append(node)
            counts[name] += 1
    return root


class Lines:
    """Text under way: finished lines, the current one, and the blank lines due before the next."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.blank = False
        self.indent = ""
        self.first = ""  # mark for the next line, e.g. of a list item

    def write(self, piece: str) -> None:
        words = SPACES.split(piece)
        for i, word in enumerate(words):
            if i:
                self.space = True
            if word:
                if self.line and self.space:
                    self.line.append(" ")
                self.line.append(word)
                self.space = False

    def verbatim(self, piece: str) -> None:
        first, *rest = piece.replace("\r\n", "\n").split("\n")
        if first:
            self.line.append(first)
        for line in rest:
            self.end(force=True)
            if line:
                self.line.append(line)

    def end(self, force: bool = False) -> None:
        """Finish the current line."""
        if self.line or force:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.lines.append((self.indent + self.first + "".join(self.line)).rstrip())
            if self.first:
                self.indent += " " * len(self.first)
                self.first = ""
        self.line, self.space = [], False

    def gap(self) -> None:
        self.end()
        self.blank = True

    def text(self) -> str:
        self.end()
        return "\n".join(self.lines).strip("\n")


def _inline(node: Node) -> str:
    """Everything shown below a node, in one line."""
    out = Lines()
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.write(x)
        elif not x.hidden:
            if x.name in BLOCK or x.name == "br":
                out.space = True
                stack.append(" ")
            stack.extend(reversed(_shown(x)))
    return "".join(out.line)


def _shown(node: Node) -> list:
    if node.name == "details" and node.get("open") is None:
        return [c for c in node.children if isinstance(c, Node) and c.name == "summary"]
    return node.children


def _rows(node: Node) -> tuple[list[str], list[Node]]:
    """Captions and other text of a table outside its rows, and the rows."""
    captions, rows = [], []
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                captions.append(" ".join(child.split()))
        elif child.hidden:
            continue
        elif child.name == "tr":
            rows.append(child)
        elif child.name in ("thead", "tbody", "tfoot"):
            rows += [c for c in child.children if isinstance(c, Node) and c.name == "tr" and not c.hidden]
            captions += [" ".join((c if isinstance(c, str) else _inline(c)).split()) for c in child.children if isinstance(c, str) or c.name != "tr"]
        elif child.name not in ("colgroup", "col"):
            captions.append(_inline(child))
    return [c for c in captions if c], rows


def _cells(row: Node) -> list[tuple[list[str], int, int]]:
    """Lines, columns and rows of every cell; what stands loose in a row comes first, as cells."""
    made, loose = [], []
    for c in row.children:
        if isinstance(c, str):
            if c.strip():
                loose.append(([" ".join(c.split())], 1, 1))
        elif c.hidden:
            continue
        elif c.name in ("td", "th"):
            down = whole_number(c.get("rowspan"), 1)
            made.append((_render(c).split("\n"), min(max(whole_number(c.get("colspan"), 1), 1), 1000), 1 << 16 if down == 0 else min(max(down, 1), 1 << 16)))
        elif value := _inline(c):
            loose.append(([value], 1, 1))
    return loose + made


def _table(node: Node) -> list[str]:
    """Captions, and the rows with their cells as blocks of lines in aligned columns."""
    captions, rows = _rows(node)
    taken: dict[int, int] = {}  # columns that a cell above still fills, and the first row below it
    placed: list[list[tuple[int, list[str]]]] = []
    widths: dict[int, int] = {}
    for number, row in enumerate(rows):
        at, out = 0, []
        for lines, across, down in _cells(row):
            while taken.get(at, 0) > number:
                at += 1
            out.append((at, lines))
            if across == 1:
                widths[at] = max(widths.get(at, 0), *map(len, lines))
            if down > 1:
                taken.update(dict.fromkeys(range(at, at + across), number + down))
            at += across
        placed.append(out)
    columns = sorted(widths)
    upto = [0, *itertools.accumulate(widths[c] for c in columns)]
    lines = []
    for out in placed:
        made = []
        for i in range(max((len(x) for _, x in out), default=0)):
            line = ""
            for at, cell in out:
                if i < len(cell) and cell[i]:
                    start = 2 * at + upto[bisect.bisect_left(columns, at)]
                    line = line.ljust(start) if len(line) + 2 <= start or not line else line + "  "
                    line += cell[i]
            made.append(line.rstrip())
        if any(made):
            lines += made
    return captions + lines


def _lay_out_tables(root: Node) -> None:
    """Set the lines of every table, inner ones first."""
    found, stack = [], [root]
    while stack:
        x = stack.pop()
        if x.name == "table":
            found.append(x)
        stack.extend(c for c in x.children if isinstance(c, Node) and not c.hidden)
    for table in reversed(found):
        table.lines = _table(table)


def text_of(page: str | None) -> str:
    """All visible text of a page."""
    if not page:
        return ""
    root = parse(page)
    _lay_out_tables(root)
    return _render(root)


def _render(root: Node) -> str:
    """The text below a node, tables as they are laid out."""
    out = Lines()
    lists: list[list] = []  # open lists: kind, next number and step
    stack: list = [(root, 0)]
    pre = 0
    while stack:
        x, leaving = stack.pop()
        if isinstance(x, str):
            out.verbatim(x) if pre else out.write(x)
            continue
        name = x.name
        if leaving:
            if name in ("ul", "ol", "menu", "dir"):
                lists.pop()
                out.end()
                out.indent = leaving
                out.blank = not lists or out.blank
                out.indent = out.indent[1:]
            elif name in ("li", "dd"):
                out.end()
                out.indent, out.first = leaving[1:], ""
            elif name in ("pre", "textarea"):
                pre -= 1
                out.gap()
            elif name == "blockquote":
                out.gap()
                out.indent = leaving[1:]
            elif name in SPACED:
                out.gap()
            elif name in BLOCK:
                out.end()
            elif name == "q":
                out.line.append('"')
            continue
        if x.hidden:
            continue
        if name == "br":
            out.end(force=True)
            continue
        if name == "hr":
            out.gap()
            continue
        if name == "table":
            out.gap()
            for line in x.lines:
                out.line = [line]
                out.end(force=True)
            out.gap()
            continue
        mark: object = 1
        if name in ("ul", "ol", "menu", "dir"):
            out.gap() if not lists else out.end()
            backward = name == "ol" and x.get("reversed") is not None
            items = sum(isinstance(c, Node) and c.name == "li" and not c.hidden for c in x.children) if backward else 1
            lists.append([name, whole_number(x.get("start"), items), -1 if backward else 1])
            mark = "#" + out.indent
        elif name == "li":
            out.end()
            mark = "#" + out.indent
            if lists and lists[-1][0] == "ol":
                number = whole_number(x.get("value"), lists[-1][1])
                out.first = f"{number}. "
                lists[-1][1] = number + lists[-1][2]
            else:
                out.first = "- "
        elif name == "dd":
            out.end()
            mark = "#" + out.indent
            out.indent += "  "
        elif name in ("pre", "textarea"):
            out.gap()
            pre += 1
        elif name == "blockquote":
            out.gap()
            mark = "#" + out.indent
            out.indent += "  "
        elif name in SPACED:
            # the first paragraph of a list item stays on the item's line
            out.end() if out.first else out.gap()
        elif name in BLOCK:
            out.end()
        elif name == "q":
            out.write('"') if not out.space else out.write(' "')
        stack.append((x, mark))
        stack.extend((c, 0) for c in reversed(_shown(x)))
    return out.text()


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """Replace the page by its ``text``."""
    fields = [f for f in pages.schema.fields if f.name not in (column, "text")]
    kept = [f.name for f in fields]

    def run(batches):
        for batch in batches:
            texts = pa.array((text_of(x.as_py()) for x in batch.column(column)), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), texts], [*kept, "text"])

    return pages.mapInArrow(run, T.StructType([*fields, T.StructField("text", T.StringType())]))
