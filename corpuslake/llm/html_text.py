"""Layout-aware HTML rendering: all visible text, with block spacing, lists and aligned tables.

A small tree builder closes what HTML implies (list items, paragraphs, table rows and cells,
options, definition terms), ignores stray end tags and closes what is open at the end. Elements
that are never shown, or are not displayed by attribute or inline style, are left out with all they
hold; text of an invisible element is left out, but not that of visible elements inside it. Cells
outside a row get one, forms between rows and cells are passed over, and what may not stand between
them moves out before the table. Of SVG the text elements are shown, MathML as inline text.

What a button or a field shows is text too: the value, else the placeholder, of an input (but a
password's), and the labels of groups of options. White space collapses, except in preformatted
text (by element or by style). Blocks start on lines of their own, paragraphs and headings with a blank line around
them; list items carry a bullet, or their number as start, value, reversed and type have it, indented by depth
(INDENTS levels at most, so that a deep page stays as long as its text). Of style declarations the
last valid one counts, unless one before it is important. Layout rules of tables:

- A table that holds another table is for layout: its cells are blocks, one under the other.
- Any other table is a grid. Columns are padded to the widest line of their cells as long as a row
  stays within WIDTH characters; columns beyond are separated, not padded. Further lines of a cell
  begin at its column. A cell that spans columns or rows leaves their places blank.

Cases: null or empty markup gives an empty text; broken markup is rendered as far as it goes;
repeated rows are rendered each; deeply nested and very long pages are rendered whole, in time
linear in their markup (nothing recurses or looks back over what is open); extra columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places to which the columns of a grid are padded, and levels to which lists are indented.
WIDTH, INDENTS = 120, 20

#: Fixed element sets of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript noembed noframes title meta link iframe object canvas audio video datalist".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre xmp listing plaintext figure".split())
BLOCK = SPACED | frozenset("html body div section article header footer nav main aside address form fieldset li dt dd tr caption hr figcaption details dialog summary option optgroup legend thead tbody tfoot select".split())
PREFORMATTED = frozenset("pre textarea xmp listing plaintext".split())
#: Inputs that show no value of theirs as text.
NO_TEXT = frozenset("hidden password checkbox radio file image color range".split())
#: Values that the declarations read here may take.
STYLES = {
    "display": frozenset(
        "none block inline inline-block flex inline-flex grid inline-grid flow-root contents list-item run-in ruby table inline-table table-row table-cell table-caption table-column"
        " table-column-group table-row-group table-header-group table-footer-group initial inherit unset revert".split()
    ),
    "visibility": frozenset("visible hidden collapse initial inherit unset revert".split()),
    "white-space": frozenset("normal nowrap pre pre-wrap pre-line break-spaces initial inherit unset revert".split()),
}
#: What an opening tag closes, and what bounds the search for it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
CLOSES_P = BLOCK - {"li", "dt", "dd", "tr", "caption", "option", "html", "body", "thead", "tbody", "tfoot", "select", "legend"}
P_BOUNDS = frozenset({"td", "th", "table", "button", "caption"})
#: Elements that hold rows and cells, the ones that belong in them, and what bounds the search for the table.
STRUCTURE = frozenset({"table", "thead", "tbody", "tfoot", "tr"})
IN_TABLE = STRUCTURE | {"td", "th", "caption"}
TABLE_BOUNDS = frozenset({"td", "th", "caption"}) | UNSEEN
#: End tags that reach beyond an open cell or table.
LEAVES_CELL = IN_TABLE - {"caption"} | {"body", "html"} | UNSEEN
#: Foreign content: where HTML begins again, what is not shown, and the HTML tags that end it.
HTML_AGAIN = {"svg": frozenset({"foreignobject"}), "text": frozenset({"foreignobject"}), "math": frozenset("mi mo mn ms mtext".split())}
FOREIGN_UNSEEN = {"svg": frozenset("defs desc metadata symbol clippath mask pattern marker".split()), "math": frozenset({"annotation", "annotation-xml"})}
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
#: Comments, declarations and tags. A quote matters after an equals sign only; one that is not closed is a character.
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?>[^>=]++|=\s*+(?>\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"([^\s=/>]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++))?+")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW - {"plaintext"}} | {"plaintext": re.compile(r"(?!)")}
STYLE_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
WHOLE = re.compile(r"\s*([+-]?[0-9]{1,9})")
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attributes", "children", "foreign", "layout", "tag")

    def __init__(self, tag: str, attributes: dict[str, str], foreign: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []
        self.foreign = foreign  # what the content is: "" (HTML), "svg", "text" (of SVG) or "math"
        self.layout = False  # of a table: it holds another table

    def styled(self, name: str) -> str:
        """The value that the style attribute gives a property; empty without a valid one."""
        style, found, weight = self.attributes.get("style", ""), "", False
        if name not in style.lower():
            return ""
        for declaration in STYLE_COMMENT.sub("", style).split(";"):
            key, _, value = declaration.partition(":")
            value, mark, rest = value.strip().lower().partition("!")
            important = rest.strip() == "important"
            if key.strip().lower() == name and value.strip() in STYLES[name] and (important or not mark) and (important or not weight):
                found, weight = value.strip(), important
        return found

    def hidden(self) -> bool:
        a = self.attributes
        shown = self.styled("display")
        if self.tag in UNSEEN or shown == "none" or (self.tag == "input" and a.get("type", "").lower() == "hidden"):
            return True
        return ("hidden" in a or (self.tag == "dialog" and "open" not in a)) and shown in ("", "initial", "inherit", "unset", "revert")

    def visible(self, inherited: bool) -> bool:
        found = self.styled("visibility")
        return inherited if found in ("", "inherit", "unset", "revert") else found in ("visible", "initial")

    def preformatted(self, inherited: str) -> str:
        """How white space is kept: "" (collapsed), "pre" or "lines" (line ends only)."""
        found = self.styled("white-space")
        if found in ("", "inherit", "unset"):
            return "pre" if self.tag in PREFORMATTED and not found else inherited
        return {"pre": "pre", "pre-wrap": "pre", "break-spaces": "pre", "pre-line": "lines"}.get(found, "")

    def whole(self, name: str) -> int | None:
        m = WHOLE.match(self.attributes.get(name, ""))
        return int(m[1]) if m else None

    def control(self) -> str:
        """The text that an input shows."""
        a, kind = self.attributes, self.attributes.get("type", "").strip().lower()
        return a.get("alt", "") if kind == "image" else "" if kind in NO_TEXT else a.get("value", "") or a.get("placeholder", "")

    def first(self) -> int:
        """The number of a list's first item."""
        given = self.whole("start")
        if given is None:
            given = sum(isinstance(c, Node) and c.tag == "li" and not c.hidden() for c in self.children) if "reversed" in self.attributes else 1
        return given

    def span(self, name: str) -> int:
        """How many columns or rows a cell takes; those beyond WIDTH could not be told apart."""
        value = self.attributes.get(name, "").strip()
        return min(max(int(value), 1), WIDTH) if value.isascii() and value.isdigit() and len(value) < 10 else 1


def attributes_of(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text):
        if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1:
            value = value[1:-1]
        found.setdefault(name.lower(), unescape(value))
    return found


class Open:
    """The stack of open elements, with the places of each tag, so that no search walks the stack."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        """Close the element at a place and all inside it."""
        while len(self.nodes) > at:
            self.places[self.nodes.pop().tag].pop()

    def last(self, tags: set[str] | frozenset[str] | tuple[str, ...]) -> int:
        """Place of the innermost open element of these tags; 0 without one."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def close(self, tags: set[str] | frozenset[str], bounds: set[str] | frozenset[str]) -> None:
        """Close the outermost of the elements of these tags that follow on one another inside the bound."""
        i = self.last(tags)
        if i and i > self.last(bounds):
            while i > 1 and self.nodes[i - 1].tag in tags:
                i -= 1
            self.cut(i)

    def table(self) -> int:
        """Place of the open table whose rows or cells may come next; 0 in a cell, or without a table."""
        i = self.last(("table",))
        return i if i and i > self.last(TABLE_BOUNDS) else 0

    def add(self, child: Node | str) -> None:
        """Append to the open node; what may not stand between rows and cells goes before their table."""
        top = self.nodes[-1]
        if top.tag in STRUCTURE and (i := self.table()):
            if isinstance(child, str) and not child.strip():
                return
            if isinstance(child, str) or child.tag not in IN_TABLE:
                self.nodes[i - 1].children.insert(-1, child)  # an open table is its parent's last child
                return
        top.children.append(child)

    def add_text(self, text: str) -> None:
        if self.nodes[-1].foreign != "svg":
            self.add(text)


def end_tag(tag: str, stack: Open) -> None:
    i = stack.last((tag,))
    if i and (tag in LEAVES_CELL or i >= stack.last(("td", "th", "table"))):
        stack.cut(i)


def tree(markup: str) -> Node:
    """The element tree; text children are strings with entities resolved."""
    root = Node("html", {})
    stack, at = Open(root), 0
    while m := TOKEN.search(markup, at):
        if m.start() > at:
            stack.add_text(unescape(markup[at : m.start()]))
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                if stack.nodes[-1].foreign:
                    stack.add_text(m[0][9:].removesuffix("]]>"))
                else:  # in HTML a comment, up to the first >
                    at = markup.find(">", m.start()) + 1 or len(markup)
            continue
        tag = m[2].lower()
        if m[1]:
            end_tag(tag, stack)
            continue
        if stack.nodes[-1].foreign and tag in BREAKOUT:
            while stack.nodes[-1].foreign:
                stack.cut(len(stack.nodes) - 1)
        if tag in IN_TABLE and (i := stack.table()):
            # Whatever was moved out before the table ends here.
            if tag in ("table", "caption"):
                stack.cut(i + (tag == "caption"))
            else:
                while stack.nodes[-1].tag not in STRUCTURE:
                    stack.cut(len(stack.nodes) - 1)
        elif stack.nodes[-1].tag in STRUCTURE and tag in ("form", "colgroup", "col") and stack.table():
            continue
        if tag in CLOSES_P:
            stack.close({"p"}, P_BOUNDS)
        if tag in CLOSES:
            stack.close(*CLOSES[tag])
        if tag == "html":
            continue
        if tag in ("td", "th") and stack.nodes[-1].tag in STRUCTURE - {"tr"}:
            row = Node("tr", {})
            stack.add(row)
            stack.push(row)
        outer = stack.nodes[-1].foreign
        node = Node(tag, attributes_of(m[3]), outer)
        if tag in ("svg", "math"):
            node.foreign = tag
        elif outer == "svg" and tag == "text":
            node.foreign = "text"
            stack.nodes[-1].children.append(" ")
        elif outer and tag in HTML_AGAIN[outer]:
            node.foreign = ""
        elif outer and tag in FOREIGN_UNSEEN.get(outer, ()):
            node.attributes["hidden"] = ""
        elif tag == "table" and (i := stack.last(("table",))):
            stack.nodes[i].layout = True
        stack.add(node)
        if m[3].endswith("/") and (outer or node.foreign):
            continue
        if tag in RAW:
            end = RAW_END[tag].search(markup, at)
            body = markup[at : end.start() if end else len(markup)]
            node.children.append(unescape(body) if tag == "textarea" else body)
            at = end.end() if end else len(markup)
        elif tag not in VOID:
            stack.push(node)
    if at < len(markup):
        stack.add_text(unescape(markup[at:]))
    return root


class Page:
    """Lines of text as they are laid out. The open line is a list of pieces."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.mark = 0  # pieces of the open line, if it is a list item's mark alone
        self.gap = False

    def marked(self, mark: str, indent: str) -> None:
        """Open a list item: blocks inside it begin on the mark's line."""
        self._put(mark, indent)
        self.mark = len(self.line)

    def words(self, text: str, preformatted: str, indent: str) -> None:
        if preformatted:
            if preformatted == "lines":
                text = re.sub(r"[ \t]*\n[ \t]*", "\n", re.sub(r"[ \t]+", " ", text))
            for i, piece in enumerate(text.split("\n")):
                if i:
                    self.end_line(keep=True)
                self._put(piece, indent)
            return
        text = SPACE.sub(" ", text)
        if not self.line or self.line[-1].endswith(" ") or not (self.line[-1].strip() or any(map(str.strip, self.line))):
            text = text.lstrip(" ")
        self._put(text, indent)

    def _put(self, text: str, indent: str) -> None:
        if not text:
            return
        if not self.line:
            if self.lines and self.gap and self.lines[-1]:
                self.lines.append("")
            self.gap = False
            if indent:
                self.line.append(indent)
        self.line.append(text)

    def end_line(self, keep: bool = False, close: bool = False) -> None:
        if self.mark and len(self.line) == self.mark and not close:
            return
        self.mark = 0
        line = "".join(self.line).rstrip()
        if line or (keep and self.lines):
            self.lines.append(line)
        self.line = []

    def blank(self) -> None:
        self.end_line()
        self.gap = not self.mark

    def text(self) -> str:
        self.end_line(close=True)
        return "\n".join(self.lines).strip("\n")


def lettered(n: int) -> str:
    """a to z, then aa and on."""
    out = ""
    while n > 0:
        n, digit = divmod(n - 1, 26)
        out = chr(97 + digit) + out
    return out


def roman(n: int) -> str:
    out = ""
    for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += sign * (n // value)
        n %= value
    return out


def numeral(n: int, kind: str) -> str:
    """A list's number as its type has it; numbers that it can not write are decimal."""
    small = lettered(n) if kind in ("a", "A") and n > 0 else roman(n) if kind in ("i", "I") and 0 < n < 4000 else str(n)
    return small.upper() if kind in ("A", "I") else small


#: A cell of a grid: its column, the columns it takes, and its lines.
Cell = tuple[int, int, list[str]]


def grid(table: Node, visible: bool) -> list[list[Cell]]:
    """Rows of displayed cells at their columns; places that cells of earlier rows span are passed over."""
    rows, todo, taken = [], [(iter(table.children), visible)], {}
    while todo:
        children, seen = todo[-1]
        child = next(children, None)
        if child is None:
            todo.pop()
        elif isinstance(child, Node) and not child.hidden():
            if child.tag in ("thead", "tbody", "tfoot"):
                todo.append((iter(child.children), child.visible(seen)))
            elif child.tag == "tr":
                row, column, until = [], 0, len(rows)
                for cell in child.children:
                    if not isinstance(cell, Node) or cell.tag not in ("td", "th") or cell.hidden():
                        continue
                    while taken.get(column, 0) > until:
                        column += 1
                    wide = cell.span("colspan") if column < WIDTH else 1
                    high = cell.span("rowspan")
                    row.append((column, wide, render(cell, cell.visible(child.visible(seen))).split("\n")))
                    if high > 1:
                        taken.update({c: until + high for c in range(column, min(column + wide, WIDTH))})
                    column += wide
                rows.append(row)
    return rows


def aligned(rows: list[list[Cell]]) -> list[str]:
    """The lines of a grid. Every line is at most WIDTH characters of padding longer than its text and separators."""
    widths: dict[int, int] = {}
    for row in rows:
        for column, wide, lines in row:
            widths[column] = max(widths.get(column, 0), max(map(len, lines)) if wide == 1 else 0)
    for row in rows:
        for column, wide, lines in row:
            if wide > 1:
                inside = sum(widths.get(c, 0) + 3 for c in range(column, column + wide)) - 3
                widths[column + wide - 1] = widths.get(column + wide - 1, 0) + max(max(map(len, lines)) - inside, 0)
    starts, at = {}, 0
    for column in range(max(widths, default=-1) + 1):
        if at > WIDTH:
            break
        starts[column] = at
        at += widths.get(column, 0) + 3
    edge = max(starts, default=0)
    out = []
    for row in rows:
        for k in range(max((len(lines) for _, _, lines in row), default=0)):
            pieces, length = [], 0
            for column, _, lines in row if k == 0 else [c for c in row if k < len(c[2]) and c[2][k]]:
                start = starts[min(column, edge)]
                if column:
                    gap = max(start - 3 - length, 0) if column <= edge else 0
                    separator = " | " if pieces or k == 0 or column == 0 else "   "
                    pieces.append(" " * gap + separator)
                    length += gap + 3
                pieces.append(lines[k])
                length += len(lines[k])
            out.append("".join(pieces).rstrip())
    return out


def render(root: Node, visible: bool = True, preformatted: str = "") -> str:
    """The visible text under a node. Only cells of grids, which hold no table, are rendered apart."""
    page = Page()
    # [node, next child, list depth, next item's number, preformatted, indent, visible]
    stack: list[list] = [[root, 0, 0, None, root.preformatted(preformatted), "", visible]]
    while stack:
        frame = stack[-1]
        node, i, lists, _, pre, indent, seen = frame
        if i >= len(node.children):
            stack.pop()
            if node.tag in SPACED and not (node.tag in ("ul", "ol") and lists > 1):
                page.blank()
            elif node.tag in BLOCK or node.tag in ("td", "th"):
                page.end_line(close=node.tag == "li")
            continue
        frame[1] += 1
        child = node.children[i]
        if isinstance(child, str):
            if seen:
                page.words(child, pre, indent)
            continue
        if child.hidden():
            continue
        tag, shown = child.tag, child.visible(seen)
        if tag == "br":
            page.end_line(keep=True)
        elif tag == "hr":
            page.blank()
        elif tag in ("img", "input"):
            if shown and (alt := child.attributes.get("alt", "").strip() if tag == "img" else child.control().strip()):
                page.words(alt, "", indent)
        elif tag == "table" and not child.layout:
            page.blank()
            around = Node("div", {})
            around.children = [c for c in child.children if not (isinstance(c, Node) and c.tag in ("tr", "thead", "tbody", "tfoot"))]
            for line in [*render(around, shown).split("\n"), *aligned(grid(child, shown))]:
                page.words(line, "pre", indent)
                page.end_line()
            page.blank()
        else:
            inner_lists, inner_indent = lists, indent
            if tag in SPACED and not (tag in ("ul", "ol") and lists):
                page.blank()
            elif tag in BLOCK or tag in ("td", "th"):
                page.end_line()
            if tag in ("ul", "ol"):
                inner_lists += 1
            if tag == "li":
                mark = "- "
                if node.tag == "ol":
                    given = child.whole("value")
                    number = given if given is not None else node.first() if frame[3] is None else frame[3]
                    frame[3] = number + (-1 if "reversed" in node.attributes else 1)
                    mark = f"{numeral(number, child.attributes.get('type', node.attributes.get('type', '')).strip())}. "
                page.end_line(close=True)
                if shown:
                    page.marked(mark, "  " * min(max(lists - 1, 0), INDENTS))
                inner_indent = "  " * min(lists, INDENTS)
            elif tag == "dd":
                inner_indent = indent + "  " if len(indent) < 2 * INDENTS else indent
            elif tag == "optgroup" and shown and (label := child.attributes.get("label", "").strip()):
                page.words(label, "", indent)
                page.end_line()
            stack.append([child, 0, inner_lists, None, child.preformatted(pre), inner_indent, shown])
    return page.text()


def visible_text(markup: str | None) -> str:
    return render(tree(markup or ""))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars for every page; no shuffle."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [visible_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string())], ["page_id", "text"])

    rows = pages.select(F.col("page_id").cast("long"), "html").mapInArrow(extract, "page_id long, text string")
    return rows.select("page_id", "text", F.length("text").cast("long").alias("n_chars"))
