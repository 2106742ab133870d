"""Visible text of HTML pages by layout-aware rendering.

A tokenizer feeds a tree builder that supplies implied tags (an open paragraph ends at the next block, a list item at the
next item, a table cell at the next cell or row, the document elements where they are left out); a renderer then walks the
tree under visibility rules and lays the text out: blank lines between blocks, list markers with indents, and table
cells in aligned columns.

Visible is all text except in head, script, style, template, noscript, title, iframe, noembed, noframes, datalist, below svg and
math in annotation, desc, metadata, defs, symbol and mphantom, under the hidden attribute, under display:none,
and where visibility is hidden or collapse (which descendants can undo). Declarations are read from style attributes and,
for selectors of one tag, class or id, from style sheets of the page; the more specific selector wins, then the later.

Defined cases: null or empty markup gives an empty text. Unknown and stray end tags are ignored, unclosed elements end
with their parents, an unfinished tag is text. Depth is bounded by DEPTH: deeper elements become siblings, so
that no page can exhaust the stack; tags are found in time proportional to the markup. Repeated rows and null ids are rendered like any other; empty tables give empty results.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH = 200
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset("head script style template noscript title iframe noembed noframes datalist".split())
#: Below svg and math: not rendered, and on lines of their own.
FOREIGN_NEVER = frozenset("annotation annotation-xml desc metadata defs symbol mphantom".split())
FOREIGN_BLOCK = frozenset("text mtr".split())
BLOCK = frozenset(
    "html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main "
    "menu nav ol p pre section summary table ul caption tr thead tbody tfoot legend optgroup option".split()
)
#: Blocks with a blank line before and after.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr form fieldset".split())
#: A start tag of the key ends open elements of the set, up to the nearest element of SCOPE.
ENDS = {
    **{t: frozenset(["p"]) for t in "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul".split()},
    "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]),
    "option": frozenset(["option"]), "optgroup": frozenset(["option", "optgroup"]),
    "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "tr": frozenset(["tr", "td", "th", "p", "caption"]),
    **{t: frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "p", "caption"]) for t in ("thead", "tbody", "tfoot")},
    "body": frozenset(["head"]),
}
SCOPE = {
    "li": frozenset(["ul", "ol", "menu", "table", "td", "th"]), "dt": frozenset(["dl", "table"]), "dd": frozenset(["dl", "table"]),
    "option": frozenset(["select", "datalist"]), "optgroup": frozenset(["select"]),
    **{t: frozenset(["table"]) for t in ("td", "th", "tr", "thead", "tbody", "tfoot")}, "body": frozenset(["html"]),
}
#: An open paragraph is out of reach behind these.
P_SCOPE = frozenset("table td th caption html button object li".split())
HEAD_ONLY = frozenset("title meta link base style script template noscript".split())

_SPECIAL, _NAME_END = re.compile(r"[>\"']"), re.compile(r"[\s/>]")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_RULE = re.compile(r"(?<![^{}])([^{}]++)\{([^{}]*+)\}")
_SIMPLE = re.compile(r"([.#]?)([a-zA-Z_][\w-]*)\Z")
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.kids = tag, attrs or {}, []


def _attrs(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(raw):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


class Tags:
    """Finds tags, comments and declarations in time proportional to the markup, whatever it holds.

    A tag ends at the first > outside quotes. Where there is none, the < is text; the quotes and ends that such a search
    came by lead nowhere for later searches either and are remembered.
    """

    def __init__(self, markup: str):
        self.markup, self.dead = markup, set()
        self.last = markup.rfind(">") + 1
        #: (pattern: a place, and the first match from there on), as later searches mostly start between the two.
        self.seen = {_SPECIAL: (0, -1), _NAME_END: (0, -1)}

    def _first(self, pattern: re.Pattern, at: int) -> int:
        lo, found = self.seen[pattern]
        if not lo <= at <= found:
            m = pattern.search(self.markup, at)
            found = m.start() if m else len(self.markup)
            self.seen[pattern] = at, found
        return found

    def _close(self, at: int) -> int:
        """The place of the > that ends a tag whose name ends at `at`, or -1."""
        came_by, n = [], len(self.markup)
        while True:
            k = self._first(_SPECIAL, at)
            if k == n or k in self.dead:
                break
            if self.markup[k] == ">":
                return k
            came_by.append(k)
            at = self.markup.find(self.markup[k], k + 1) + 1
            if not at:
                break
        self.dead.update(came_by)
        return -1

    def next(self, at: int) -> tuple[int, int, bool, str, str]:
        """(start, end, whether an end tag, name, attributes) from `at` on; the name is empty for all that isn't a tag."""
        text, n = self.markup, len(self.markup)
        look = at
        while (start := text.find("<", look)) >= 0:
            if text.startswith("<!--", start):
                end = text.find("-->", start + 4)
                return start, end + 3 if end >= 0 else n, False, "", ""
            if text.startswith(("<!", "<?"), start):
                end = text.find(">", start + 2)
                return start, end + 1 if end >= 0 else n, False, "", ""
            name = start + 1 + text.startswith("/", start + 1)
            if name < n and text[name].isascii() and text[name].isalpha() and start < self.last:
                ends = self._first(_NAME_END, name)
                if (close := self._close(ends)) >= 0:
                    return start, close + 1, name > start + 1, text[name:ends], text[ends:close]
            look = start + 1
        return n, n, False, "", ""


class Tree:
    """Builds the element tree; `sheets` collects the text of style elements."""

    def __init__(self, markup: str):
        self.root = Node("html")
        self.stack, self.sheets, self.body = [self.root], [], None
        at, n, tags = 0, len(markup), Tags(markup)
        while at < n:
            start, after, end_tag, tag, attrs = tags.next(at)
            if start > at:
                self._text(markup[at:start])
            at = after
            if not tag:
                continue
            tag = tag.lower()
            if end_tag:
                self._end(tag)
                continue
            node = self._start(tag, _attrs(attrs) if attrs.strip(" /\t\n\r") else {})
            if attrs.endswith("/") and self._foreign():
                if self.stack[-1] is node:
                    self.stack.pop()
                continue
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(markup, at, tags.last)
                inner = markup[at : close.start() if close else n]
                at = close.end() if close else n
                if tag == "style":
                    self.sheets.append(inner)
                elif inner:
                    node.kids.append(html.unescape(inner) if tag in ("textarea", "title") else inner)
                if self.stack[-1] is node:
                    self.stack.pop()

    def _foreign(self) -> bool:
        return any(n.tag in ("svg", "math") for n in self.stack)

    def _ensure_body(self) -> None:
        if self.body is None:
            del self.stack[1:]
            self.body = Node("body")
            self.root.kids.append(self.body)
            self.stack.append(self.body)

    def _text(self, raw: str) -> None:
        if self.body is None:
            if not raw.strip():
                return
            self._ensure_body()
        self.stack[-1].kids.append(html.unescape(raw) if "&" in raw else raw)

    def _start(self, tag: str, attrs: dict[str, str]) -> Node:
        if tag == "html":
            self.root.attrs = attrs | self.root.attrs
            return self.root
        if tag == "body":
            self._ensure_body()
            self.body.attrs = attrs | self.body.attrs
            return self.body
        if tag == "head" and self.body is None and len(self.stack) == 1:
            pass
        elif tag == "head":
            return Node("head")
        elif self.body is None and tag not in HEAD_ONLY:
            self._ensure_body()
        if tag in ENDS:
            self._imply(tag)
        top = self.stack[-1]
        if tag in ("td", "th") and top.tag in ("table", "thead", "tbody", "tfoot"):
            top = self._push("tr", {})
        node = Node(tag, attrs)
        top.kids.append(node)
        if tag not in VOID:
            if len(self.stack) < DEPTH or tag in RAW:
                self.stack.append(node)
        return node

    def _push(self, tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs)
        self.stack[-1].kids.append(node)
        self.stack.append(node)
        return node

    def _imply(self, tag: str) -> None:
        closes, scope = ENDS[tag], SCOPE.get(tag, P_SCOPE)
        for k in range(len(self.stack) - 1, 0, -1):
            t = self.stack[k].tag
            if t in scope:
                return
            if t in closes:
                # A closed element takes all that it holds along; look on above it, as a cell and its row end together.
                del self.stack[k:]

    def _end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "br":
            self._start("br", {})
            return
        barrier = frozenset(["table"]) if tag not in ("table",) else frozenset()
        for k in range(len(self.stack) - 1, 0, -1):
            t = self.stack[k].tag
            if t == tag:
                del self.stack[k:]
                return
            if t in barrier or t == "body":
                break
        if tag == "p":
            self._start("p", {})
            self.stack.pop()


def _declared(css: str) -> dict[str, str]:
    found = {}
    for part in css.split(";"):
        name, colon, value = part.partition(":")
        if colon and (name := name.strip().lower()) in ("display", "visibility", "white-space"):
            found[name] = value.replace("!important", "").strip().lower()
    return found


class Styles:
    """Declarations by simple selectors, in order of weight: tags, classes, ids, then the style attribute."""

    def __init__(self, sheets: list[str]):
        self.by: dict[str, dict[str, dict[str, str]]] = {"": {}, ".": {}, "#": {}}
        for sheet in sheets:
            for selectors, css in _RULE.findall(re.sub(r"/\*.*?(?:\*/|\Z)", "", sheet, flags=re.S)):
                if found := _declared(css):
                    for one in selectors.split(","):
                        if m := _SIMPLE.match(one.strip()):
                            key = m[2] if m[1] else m[2].lower()
                            self.by[m[1]].setdefault(key, {}).update(found)
        self.plain = not any(self.by.values())

    def of(self, node: Node) -> dict[str, str]:
        attrs = node.attrs
        if self.plain and "style" not in attrs:
            return {}
        found = dict(self.by[""].get(node.tag, ()))
        for name in attrs.get("class", "").split():
            found.update(self.by["."].get(name, ()))
        if "id" in attrs:
            found.update(self.by["#"].get(attrs["id"], ()))
        if "style" in attrs:
            found.update(_declared(attrs["style"]))
        return found


class Lines:
    """Output under construction: finished lines, the open line, and the blank lines due before the next text."""

    def __init__(self):
        self.done: list[str] = []
        self.open: list[str] = []
        self.gap = 0
        self.prefix: list[str] = []
        self.marker = ""

    def text(self, s: str, pre: bool) -> None:
        if pre:
            for k, part in enumerate(s.split("\n")):
                if k:
                    self.newline(force=True)
                if part:
                    self._put(part)
            return
        s = _SPACE.sub(" ", s)
        if not self.open:
            s = s.lstrip(" ")
        elif self.open[-1].endswith(" "):
            s = s.lstrip(" ") if s.startswith(" ") else s
        if s:
            self._put(s)

    def _put(self, s: str) -> None:
        if not self.open:
            if self.done and self.gap:
                self.done += [""] * (self.gap - 1)
            self.gap = 0
            lead = "".join(self.prefix)
            if self.marker:
                lead = lead[: len(lead) - len(self.marker)] + self.marker
                self.marker = ""
            self.open.append(lead)
            if lead and not lead.endswith(" "):
                self.open.append(" ")
        self.open.append(s)

    def newline(self, force: bool = False) -> None:
        if self.open:
            self.done.append("".join(self.open).rstrip(" "))
            self.open = []
        elif force and self.done:
            self.done.append("")

    def block(self, blank: bool) -> None:
        self.newline()
        self.gap = max(self.gap, 2 if blank else 1)


def _span(attrs: dict[str, str], name: str) -> int:
    value = attrs.get(name, "1")
    return min(max(int(value), 1), 100) if value.isascii() and value.isdigit() and len(value) < 4 else 1


class Renderer:
    def __init__(self, styles: Styles):
        self.styles, self.foreign = styles, 0

    def render(self, node: Node) -> str:
        out = Lines()
        self._walk(node, out, True, False, [])
        out.newline()
        return "\n".join(out.done).strip("\n")

    def _walk(self, node: Node, out: Lines, seen: bool, pre: bool, lists: list) -> None:
        tag = node.tag
        if tag in NEVER or "hidden" in node.attrs or (tag == "input" and node.attrs.get("type", "").lower() == "hidden"):
            return
        if self.foreign and tag in FOREIGN_NEVER:
            return
        style = self.styles.of(node)
        display = style.get("display", "")
        if display == "none":
            return
        visibility = style.get("visibility", "")
        seen = visibility == "visible" if visibility in ("visible", "hidden", "collapse") else seen
        space = style.get("white-space", "")
        pre = space.startswith(("pre", "break")) if space else pre or tag in ("pre", "textarea")
        if tag == "br":
            if seen:
                out.newline(force=True)
            return
        if tag == "hr":
            out.block(True)
            if seen:
                out.text("---", False)
            out.block(True)
            return
        if tag == "table":
            out.block(True)
            self._table(node, out, seen, pre)
            out.block(True)
            return
        block = display in ("block", "flex", "grid", "list-item", "table") or ((tag in BLOCK or (self.foreign and tag in FOREIGN_BLOCK)) and not display.startswith("inline"))
        spaced = tag in SPACED and not (tag in ("ul", "ol") and lists)
        if block:
            out.block(spaced)
        indent = 0
        if tag in ("ul", "ol", "menu"):
            start = node.attrs.get("start", "1")
            lists = [*lists, [tag, int(start) if start.isascii() and start.isdigit() and len(start) < 9 else 1]]
        elif tag == "li":
            marker = "- "
            if lists and lists[-1][0] == "ol":
                value = node.attrs.get("value", "")
                if value.isascii() and value.isdigit() and len(value) < 9:
                    lists[-1][1] = int(value)
                marker = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            if seen:
                out.prefix.append(" " * len(marker))
                out.marker, indent = marker, 1
        elif tag in ("blockquote", "dd") and seen:
            out.prefix.append("  ")
            indent = 1
        if tag == "mtd" and seen and out.open:
            out.text(" ", False)
        self.foreign += tag in ("svg", "math")
        closed = tag == "details" and "open" not in node.attrs
        for kid in node.kids:
            if isinstance(kid, str):
                if seen and not closed:
                    out.text(kid, pre)
            elif not closed or kid.tag == "summary":
                self._walk(kid, out, seen, pre, lists)
        self.foreign -= tag in ("svg", "math")
        if block:
            out.block(spaced)
        if indent:
            out.prefix.pop()
            if tag == "li":
                out.marker = ""

    def _rows(self, node: Node, seen: bool) -> Iterator[tuple[Node, bool]]:
        """The rows of a table in order, with their visibility; a caption counts as a row of its own."""
        for kid in node.kids:
            if isinstance(kid, str) or kid.tag in NEVER or "hidden" in kid.attrs:
                continue
            style = self.styles.of(kid)
            if style.get("display") == "none":
                continue
            own = style.get("visibility", "")
            shown = own == "visible" if own in ("visible", "hidden", "collapse") else seen
            if kid.tag in ("thead", "tbody", "tfoot"):
                yield from self._rows(kid, shown)
            elif kid.tag not in ("col", "colgroup"):
                yield kid, shown

    def _cell(self, node: Node, seen: bool, pre: bool) -> list[str]:
        own = Lines()
        self._walk(node, own, seen, pre, [])
        own.newline()
        lines = own.done
        while lines and not lines[-1]:
            lines.pop()
        return lines

    def _table(self, table: Node, out: Lines, seen: bool, pre: bool) -> None:
        grid: list[list[list[str]]] = []
        free: list[tuple[int, list[str]]] = []
        held: dict[int, int] = {}
        loose = [k for k in table.kids if isinstance(k, str) and k.strip()]
        for row, shown in self._rows(table, seen):
            if row.tag != "tr":
                free.append((len(grid), self._cell(row, shown, pre)))
                continue
            cells: list[list[str]] = []
            for cell in row.kids:
                if isinstance(cell, str):
                    if cell.strip() and shown:
                        free.append((len(grid), [_SPACE.sub(" ", cell).strip()]))
                    continue
                while held.get(len(cells), 0):
                    held[len(cells)] -= 1
                    cells.append([])
                if cell.tag in NEVER or "hidden" in cell.attrs or self.styles.of(cell).get("display") == "none":
                    continue
                wide = _span(cell.attrs, "colspan")
                for k in range(wide):
                    held[len(cells) + k] = _span(cell.attrs, "rowspan") - 1
                cells += [self._cell(cell, shown, pre), *([[]] * (wide - 1))]
            grid.append(cells)
        columns = max((len(r) for r in grid), default=0)
        widths = [max((len(line) for r in grid if k < len(r) for line in r[k]), default=0) for k in range(columns)]
        if seen:
            for text in loose:
                out.text(text, False)
                out.block(False)
        for k in range(len(grid) + 1):
            for at, lines in free:
                if at == k:
                    for line in lines:
                        out.text(line, True)
                        out.newline()
            if k < len(grid):
                for j in range(max((len(c) for c in grid[k]), default=0)):
                    parts = [(c[j] if j < len(c) else "").ljust(widths[i]) for i, c in enumerate(grid[k])]
                    if line := "  ".join(parts).rstrip():
                        out.text(line, True)
                        out.newline()


def visible_text(markup: str | None) -> str:
    if not markup:
        return ""
    tree = Tree(markup)
    return Renderer(Styles(tree.sheets)).render(tree.root)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [visible_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], ["page_id", "url", "text"])


def page_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) for each row of pages."""
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return pages.mapInArrow(_texts, "page_id long, url string, text string")
