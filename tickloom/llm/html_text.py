"""Visible text of HTML pages by layout-aware rendering.

A tokenizer reads tags, comments and raw text in one pass over the page, as browsers do: what is cut off by the end of
the page inside a tag or comment is no text.  A tree builder closes elements whose end tags HTML lets authors leave out.  Rendering works from the leaves up:
inline text is collapsed as browsers do, blocks stand on lines of their own (with a blank line around paragraphs,
headings, lists and tables), list items keep markers and indentation, preformatted text keeps its spacing, and table
cells are padded to their column's width (cells over several rows keep their columns free below).  Text in a table outside
its cells comes before it.  Controls show their text (a select its chosen option).  Hidden elements emit nothing, but for
visible elements inside ones with visibility: hidden; a page's own style rules for a class, an id or an element hide too (the
last such rule counts, other selectors and media rules are not applied), and a closed details element shows its summary.
Indents and padding are bounded.  The tree is MOST_DEEP elements deep at most, as in browsers: deeper elements stand beside
each other in it, and tables deeper than DEEPEST elements are laid out cell below cell.  So time and text are at most a
constant times the length of the page.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without content, elements never shown, and elements laid out as blocks (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title script style template noscript noframes iframe object audio video canvas datalist area base link meta defs symbol desc metadata annotation annotation-xml".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr menu".split())
BLOCKS = SPACED | frozenset("html body div section article aside header footer nav main address details summary dialog fieldset form li dt dd figcaption legend center caption hgroup search".split())
#: Elements that may stand in head (any other, and text, ends it), and kinds of input elements whose value is shown.
IN_HEAD = frozenset("html head base link meta title script style template noscript noframes".split())
SHOWN_INPUTS = frozenset(("", "text", "search", "email", "url", "tel", "number", "submit", "reset", "button"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS, ROWS, PARTS = frozenset(("td", "th")), frozenset(("tr",)), frozenset(("thead", "tbody", "tfoot"))
#: For a start tag: the open elements that it ends, and those that bound the search.
ENDS: dict[str, tuple[frozenset, frozenset]] = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    **dict.fromkeys(("dt", "dd"), (frozenset(("dt", "dd")), frozenset(("dl",)))),
    **dict.fromkeys(CELLS, (CELLS, frozenset(("tr", "table")))),
    "tr": (CELLS | ROWS, frozenset(("table",))),
    **dict.fromkeys(("thead", "tbody", "tfoot", "caption"), (CELLS | ROWS | PARTS | {"caption"}, frozenset(("table",)))),
    **dict.fromkeys(("option", "optgroup"), (frozenset(("option",)), frozenset(("select",)))),
    **dict.fromkeys(("input", "textarea"), (frozenset(("select",)), frozenset())),
    "body": (frozenset(("head",)), frozenset()),
}
_WALLS = frozenset(("td", "th", "caption", "table", "button", "html"))
#: Elements of drawings whose text stands on a line of its own.
LABELS = frozenset(("text", "foreignobject"))
_SPACE = re.compile(r"[ \t\n\r\f]+")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\s*(?:!important\s*)?(?:;|$)", re.IGNORECASE)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)\s*(?:!important\s*)?(?=;|$)", re.IGNORECASE)
BREAK = "\x00"
#: Elements whose content is text up to their end tag; in the last ones character references count.
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
REFERENCES_IN_RAW = frozenset(("textarea", "title"))
_NAME = re.compile(r"[^\t\n\r\f />]+")
_ATTRIBUTE = re.compile(r"[\t\n\r\f /]*+(?:([^\t\n\r\f />][^\t\n\r\f />=]*+)(?:[\t\n\r\f ]*+=[\t\n\r\f ]*+(?:\"([^\"]*+)(\"?)|'([^']*+)('?)|([^\t\n\r\f >]*+)))?+)?+")
#: Columns of text to which cells are padded at most, and columns of a table that are kept apart.
WIDEST, MOST_COLUMNS = 120, 1000
#: Elements inside each other within which lists and quotes are indented and tables have columns, and depth of the tree.
DEEPEST, MOST_DEEP = 100, 512
_BRACES = re.compile(r"[^{}]*+[{}]|/\*.*?\*/", re.DOTALL)
_SELECTOR = re.compile(r"\s*([.#]?)(-?[A-Za-z_][\w-]*)\s*")


def style_rules(css: str) -> Iterator[tuple[str, str]]:
    """(selector, declarations) of the rules for one class, id or element, outside of any block."""
    head, depth = "", 0
    for part in _BRACES.findall(re.sub(r"/\*.*?(?:\*/|$)", " ", css, flags=re.DOTALL)):
        if part[-1] == "{":
            head, depth = part[:-1], depth + 1
        else:
            if depth == 1:
                for one in head.split(","):
                    m = _SELECTOR.fullmatch(one.rpartition(";")[2])
                    if m:
                        yield m[1] + (m[2] if m[1] else m[2].lower()), part[:-1]
            head, depth = "@", max(depth - 1, 0)  # the end of a nested block leaves a head that is no selector
            if depth == 0:
                head = ""


def tokens(html: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(kind, name or text, attributes) of a page: kinds are start, end and text; every character is looked at once or twice."""
    at, n = 0, len(html)
    while at < n:
        open_ = html.find("<", at)
        if open_ < 0 or open_ + 1 == n:
            yield "text", unescape(html[at:]), {}
            return
        after = html[open_ + 1]
        named = after == "/" and html[open_ + 2 : open_ + 3].isalpha() or after.isalpha()
        if not (named or after in "!?/"):
            follow = html.find("<", open_ + 1)
            follow = n if follow < 0 else follow
            yield "text", unescape(html[at:follow]), {}
            at = follow
            continue
        if open_ > at:
            yield "text", unescape(html[at:open_]), {}
        if not named:
            at = _after_comment(html, open_)
            continue
        end, name, attrs = _tag(html, open_ + (2 if after == "/" else 1))
        if end < 0:
            return
        at = end
        if after == "/":
            yield "end", name, {}
            continue
        yield "start", name, attrs
        if name == "plaintext":
            yield "text", html[at:], {}
            return
        if name in RAW:
            close = re.compile(f"</{name}(?=[\\t\\n\\r\\f />])", re.IGNORECASE).search(html, at)
            stop = close.start() if close else n
            yield "text", unescape(html[at:stop]) if name in REFERENCES_IN_RAW else html[at:stop], {}
            at = stop


def _after_comment(html: str, at: int) -> int:
    """Place after a comment, a declaration or the like that begins at `at`; the end of the page ends it too."""
    if not html.startswith("<!--", at):
        end = html.find(">", at)
        return end + 1 if end >= 0 else len(html)
    for short in (">", "->"):
        if html.startswith(short, at + 4):
            return at + 4 + len(short)
    end = html.find("-->", at + 4)
    return end + 3 if end >= 0 else len(html)


def _tag(html: str, at: int) -> tuple[int, str, dict[str, str]]:
    """(place after the tag or -1 where the page ends in it, name, attributes) of a tag whose name begins at `at`."""
    name, attrs = _NAME.match(html, at), {}
    at = name.end()
    while True:
        m = _ATTRIBUTE.match(html, at)
        key, at = m[1], m.end()
        if m[3] == "" or m[5] == "":  # an open quote
            return -1, "", {}
        if key is not None:
            value = m[2] if m[2] is not None else m[4] if m[4] is not None else m[6]
            attrs.setdefault(key.lower(), unescape(value) if value else "")
        if at >= len(html):
            return -1, "", {}
        if html[at] == ">":
            return at + 1, name[0].lower(), attrs


class Node:
    __slots__ = ("attrs", "children", "seen", "shown", "tag")

    def __init__(self, tag: str, attrs: dict, seen: bool, shown: bool) -> None:
        self.tag, self.attrs, self.children, self.seen, self.shown = tag, attrs, [], seen, shown


class TreeBuilder:
    """Nodes with implied end tags; text of unseen elements is not kept, except the first title."""

    def __init__(self) -> None:
        self.root = Node("body", {}, True, True)
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}  # where in `open` the elements of each tag are, rising
        self.rules: dict[str, tuple[bool, str]] = {}  # (not displayed, visibility) by selector
        self.title: str | None = None

    def read(self, html: str) -> None:
        for kind, what, attrs in tokens(html):
            if kind == "text":
                self.text(what)
            elif kind == "start":
                self.start(what, attrs)
            else:
                self.end(what)

    def _pop(self, upto: int) -> None:
        for node in self.open[upto:]:
            self.places[node.tag].pop()
        del self.open[upto:]

    def _innermost(self, tags: frozenset) -> int:
        """Place of the innermost open element of `tags`, 0 without one."""
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=0)

    def _end(self, tags: frozenset, walls: frozenset, last: bool) -> None:
        """Close the innermost open element of `tags` (the outermost before a wall with `last`)."""
        found = self._innermost(tags)
        wall = self._innermost(walls - tags) if found else 0
        if found <= wall:
            return
        if last:
            found = min(at[k] for t in tags if (at := self.places.get(t)) and (k := bisect_right(at, wall)) < len(at))
        self._pop(found)

    def _end_head(self) -> None:
        while self.open[-1].tag == "head":
            self._pop(len(self.open) - 1)

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag not in IN_HEAD:
            self._end_head()
        if tag in ENDS:
            self._end(*ENDS[tag], last=True)
        if tag in BLOCKS:
            self._end(frozenset(("p",)), _WALLS, last=False)
        if tag in HEADINGS:
            self._end(HEADINGS, _WALLS | {"div", "section", "article"}, last=False)
        if tag in CELLS and (self.open[-1].tag == "table" or self.open[-1].tag in PARTS):
            self.start("tr", {})
        if tag in ("html", "body") or (tag == "form" and self.open[-1].tag in ("table", "tr", *PARTS)):
            return  # a form between the parts of a table holds none of them
        top, style = self.open[-1], attrs.get("style", "")
        gone, said = self._styled(tag, attrs) if self.rules else (False, "")
        if style:
            gone = bool(_NO_DISPLAY.search(style)) or (gone and "display" not in style.lower())
            said = (_VISIBILITY.findall(style) or [said])[-1]
        folded = top.tag == "details" and "open" not in top.attrs and (tag != "summary" or any(not isinstance(x, str) and x.tag == "summary" for x in top.children))
        seen = top.seen and tag not in UNSEEN and "hidden" not in attrs and not gone and not folded
        node = Node(tag, attrs, seen, said.lower() == "visible" if said else top.shown)
        if seen:
            self.open[min(len(self.open), MOST_DEEP) - 1].children.append(node)
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def _styled(self, tag: str, attrs: dict[str, str]) -> tuple[bool, str]:
        """(not displayed, visibility) by the page's rules; those for an id count before those for classes, then elements."""
        found = [self.rules.get(tag), *(self.rules.get(f".{c}") for c in attrs.get("class", "").split()), self.rules.get(f"#{attrs.get('id', '')}")]
        found = [x for x in found if x]
        return (found[-1][0], next((x[1] for x in reversed(found) if x[1]), "")) if found else (False, "")

    def _style(self, css: str) -> None:
        for selector, said in style_rules(css):
            if "display" in said.lower() or "visibility" in said.lower():
                was = self.rules.get(selector, (False, ""))
                self.rules[selector] = (bool(_NO_DISPLAY.search(said)) if "display" in said.lower() else was[0], (_VISIBILITY.findall(said) or [was[1]])[-1])

    def end(self, tag: str) -> None:
        if tag in ("br", "p") and not self.places.get(tag):
            self.start(tag, {})  # as browsers do
        if tag in ("html", "body", "br"):
            return
        walls = frozenset() if tag in ("table", *PARTS) else frozenset(("table", "ul", "ol")) if tag == "li" else frozenset(("table",))
        self._end(frozenset((tag,)), walls, last=False)

    def text(self, data: str) -> None:
        if data.strip(" \t\n\r\f"):
            self._end_head()
        top = self.open[-1]
        if top.tag == "style":
            self._style(data)
        elif top.seen:
            if top.shown and (top.tag != "details" or "open" in top.attrs):
                self._keep(top, data.replace(BREAK, "�"))
        elif top.tag == "title" and self.title is None and not self.places.get("svg"):
            self.title = _SPACE.sub(" ", data).strip()

    def _keep(self, top: Node, data: str) -> None:
        """Text into its element; where that is too deep and others came after it, into one like it beside them."""
        if len(self.open) > MOST_DEEP:
            beside = self.open[MOST_DEEP - 1].children
            if not beside or beside[-1] is not top:
                beside.append(top := Node("div" if top.tag in BLOCKS or top.tag in CELLS else "span", {}, True, True))
        top.children.append(data)


def _width(text: str) -> int:
    """Columns of a line: wide characters take two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _marked(lines: list[str], mark: str, depth: int = 0) -> list[str]:
    """A list item's lines, further ones indented below the text."""
    return [mark + lines[0], *_indented(lines[1:], len(mark), depth)] if lines else []


def _indented(lines: list[str], n: int, depth: int) -> list[str]:
    """Lines moved n columns to the right, but for elements deeper than DEEPEST."""
    return [" " * n + x if x else x for x in lines] if depth <= DEEPEST else lines


def _plain(items: list) -> list:
    """List items, cells and rows that are outside of their list or table as blocks; rows below each other are a table."""
    if all(isinstance(x, str) or len(x) < 3 for x in items):
        return items
    out, rows = [], []
    for item in items:
        kind = item[2] if not isinstance(item, str) and len(item) > 2 else None
        if kind == "row":
            rows.append(item[3])
        elif not rows or not isinstance(item, str) or item.strip(" \t\n\r\f"):
            if rows:
                out.append((_table(rows), False))
                rows = []
            out.append(item if kind is None else (_marked(item[0], "- ") if kind == "li" else item[0], False))
    return [*out, (_table(rows), False)] if rows else out


def _stack(items: list) -> list[str]:
    """Lines of a block's content: inline runs collapsed and cut at breaks, blocks below each other."""
    lines: list[str] = []
    run: list[str] = []
    gap = False  # a blank line is due before the next line

    def put(more: list[str], spaced: bool) -> None:
        nonlocal gap
        if more:
            if (spaced or gap) and lines:
                lines.append("")
            lines.extend(more)
            gap = spaced

    def flush() -> None:
        if run:
            text = "".join(run)
            run.clear()
            if text.strip(" \t\n\r\f"):
                parts = [_SPACE.sub(" ", t).strip(" ") for t in text.split(BREAK)]
                if parts[-1] == "":
                    parts.pop()
                put(parts, False)

    for item in _plain(items):
        if isinstance(item, str):
            run.append(item)
        else:
            flush()
            put(*item)
    flush()
    return lines


def _number(text: str, other: int) -> int:
    return int(text) if re.fullmatch(r"-?[0-9]{1,6}", text.strip()) else other


def _list(node: Node, items: list, depth: int) -> list[str]:
    """Items with a bullet or their number; their further lines are indented below the text."""
    at, out = _number(node.attrs.get("start", ""), 1), []
    for item in items:
        if isinstance(item, str):
            if item.strip(" \t\n\r\f" + BREAK):
                out.append(_SPACE.sub(" ", item.replace(BREAK, " ")).strip())
            continue
        lines, kind = item[0], item[2] if len(item) > 2 else None
        if kind != "li":
            out.extend(lines if kind is None else _stack([item]))
            continue
        mark = f"{at}. " if node.tag == "ol" else "- "
        at += 1
        out.extend(_marked(lines, mark, depth))
    return out


def _options(select: Node) -> list[str]:
    """Texts that a select element shows: all of a list box with the labels of its groups, else the chosen or first option that can be chosen."""
    box = "multiple" in select.attrs or _number(select.attrs.get("size", ""), 1) > 1
    found, stack = [], [(x, None) for x in reversed(select.children)]
    while stack:
        node, option = stack.pop()
        if isinstance(node, str):
            if option is not None:
                option[1].append(node)
            continue
        if node.tag == "option":
            found.append(option := (node, []))
        elif node.tag == "optgroup" and box and node.attrs.get("label"):
            found.append((node, [node.attrs["label"].replace(BREAK, "�")]))
        stack.extend((x, option) for x in reversed(node.children))
    if not box:
        found = [x for x in found if "selected" in x[0].attrs][-1:] or [x for x in found if "disabled" not in x[0].attrs][:1]
    return [_SPACE.sub(" ", "".join(texts)).strip() for _, texts in found]


def _grid(rows: list[list[tuple]]) -> list[list[tuple[int, list[str], int]]]:
    """(column, lines, columns) of the cells (lines, columns, rows) of each row; columns that a cell above covers are left free."""
    out, busy = [], {}  # busy: the first row that is free again, by column
    for r, row in enumerate(rows):
        placed, at = [], 0
        for lines, span, down in row:
            while busy.get(at, 0) > r:
                at += 1
            if at + span > MOST_COLUMNS:
                span = 1
            placed.append((at, lines, span))
            for c in range(at, at + span if down > 1 else at):
                busy[c] = r + down
            at += span
        out.append(placed)
    return out


def _table(rows: list[list[tuple]], depth: int = 0) -> list[str]:
    """Cells padded to the width of their column, two spaces apart; cells over several columns or wider than WIDEST widen none.

    A table of one column, and one too deep in the page, is its cells below each other.
    """
    if depth > DEEPEST or all(len(row) <= 1 and all(down == 1 for _, _, down in row) for row in rows):
        return [line for row in rows for lines, *_ in row for line in lines]
    widths: dict[int, int] = {}
    grid = _grid(rows)
    for row in grid:
        for at, lines, span in row:
            if span == 1:
                widths[at] = max([widths.get(at, 0), *(w for w in map(_width, lines) if w <= WIDEST)])
    begin = [0]
    for c in range(max((at + span for row in grid for at, _, span in row), default=0)):
        begin.append(begin[-1] + widths.get(c, 0) + 2)
    out = []
    for row in grid:
        for k in range(max((len(lines) for _, lines, _ in row), default=0)):
            line, wide = "", 0
            for at, lines, _ in row:
                if k < len(lines) and lines[k]:
                    gap = max(begin[at] - wide, 2 if line else 0)
                    line, wide = line + " " * min(gap, 2 * WIDEST) + lines[k], wide + gap + _width(lines[k])
            out.append(line)
    return out


def _loose(items: list) -> list:
    """Content of a row besides its cells, which stands before the table."""
    return [x for x in items if (x.strip(" \t\n\r\f") if isinstance(x, str) else len(x) < 4 or x[2] != "cell")]


def _layout(node: Node, items: list, pre: bool, depth: int) -> list:
    """What an element adds to its parent: inline strings, or (lines, spaced[, kind[, more]])."""
    tag = node.tag
    if tag == "br":
        return [BREAK]
    if tag == "hr":
        return [(["---"], True)] if node.shown else []
    if tag in CELLS:
        span = lambda name, most: min(max(_number(node.attrs.get(name, ""), 1), 1), most)
        return [(_stack(items), False, "cell", span("colspan", 1000), span("rowspan", 65534))]
    if tag == "tr":
        cells = [(x[0], x[3], x[4]) for x in items if not isinstance(x, str) and len(x) > 3 and x[2] == "cell"]
        return [*_loose(items), ([], False, "row", cells)]
    if tag in PARTS:
        return [x for x in items if not isinstance(x, str) or x.strip(" \t\n\r\f")]
    if tag == "table":
        rows, bare = [], False
        for x in items:
            if not isinstance(x, str) and len(x) > 3:
                if x[2] == "row" or not bare:
                    rows.append([])
                rows[-1].extend(x[3] if x[2] == "row" else [(x[0], x[3], x[4])])
                bare = x[2] == "cell"
        return [(_stack([x for x in items if isinstance(x, str) or len(x) < 4]) + _table(rows, depth), True)]
    if tag == "input":
        return [node.attrs["value"].replace(BREAK, "�")] if node.attrs.get("value") and node.attrs.get("type", "").lower() in SHOWN_INPUTS and node.shown else []
    if tag == "textarea":
        return ["".join(x for x in items if isinstance(x, str)).removeprefix("\n").rstrip("\n").replace("\n", BREAK)]
    if tag == "select":
        return [BREAK.join(_options(node))] if node.shown else []
    if tag in ("ul", "ol", "menu"):
        return [(_list(node, items, depth), True)]
    if tag == "pre":
        text = "".join(x if isinstance(x, str) else "\n".join(x[0]) for x in _plain(items)).replace(BREAK, "\n")
        return [([x.rstrip() for x in text.removeprefix("\n").rstrip("\n").split("\n")] if text.strip() else [], True)]
    if tag in ("dd", "blockquote") and not pre:
        return [(_indented(_stack(items), 2, depth), tag == "blockquote")]
    if tag in BLOCKS and not pre:
        return [(_stack(items), tag in SPACED, *(["li"] if tag == "li" else []))]
    if tag in LABELS and not pre:
        return [(_stack(items), False)]
    if tag == "q":
        return ['"', *items, '"']
    return items


def render(root: Node) -> list[str]:
    """Lines of a tree, from the leaves up and without recursion (so nesting may be of any depth)."""
    stack: list[tuple[Node, int, list, bool]] = [(root, 0, [], False)]
    while True:
        node, at, items, pre = stack.pop()
        if at < len(node.children):
            stack.append((node, at + 1, items, pre))
            child = node.children[at]
            if isinstance(child, str):
                items.append(child)
            else:
                stack.append((child, 0, [], pre or child.tag == "pre"))
        elif stack:
            stack[-1][2].extend(_layout(node, items, pre and node.tag != "pre", len(stack)))
        else:
            return _stack(items)


def page_text(html: str | None) -> tuple[str | None, str]:
    """(title, visible text) of a page; null and empty pages have neither."""
    builder = TreeBuilder()
    builder.read(html or "")
    return builder.title, "\n".join(render(builder.root)).replace(BREAK, "\n")


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, title, text, n_chars.

    Null and empty pages have empty text and a null title; broken markup never fails; equal pages have equal texts;
    other columns are not read.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{html_col}`").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [page_text(h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in found], pa.string()), pa.array([x for _, x in found], pa.string()), pa.array([len(x) for _, x in found], pa.int64())], ["page_id", "title", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, title string, text string, n_chars long")
