"""Text of HTML pages by layout-aware rendering.

A page is cut into tags and text, a tree builder keeps the stack of open
elements (closing what a tag implies, opening rows and cells that a table
lacks), and a renderer writes what a reader would see: blocks on lines of
their own with blank lines around paragraphs, headings, lists and tables; list
items with a mark and an indent; table cells in aligned columns; preformatted
text as it is.  Not visible: the head, scripts, styles and other elements that
never show, comments, dialogs that are not open, and elements with ``hidden``
or with ``display:none`` or ``visibility:hidden`` in their style; elements
with ``visibility:visible`` inside the latter show.  Rules from style sheets
are not applied.

A cell longer than ``WIDEST`` does not widen its column: what follows it in
its row goes on below, in its own columns.

The page is read once from left to right without recursion, so the work is
linear in its length, also for broken or very deep markup; a table takes its
rows times its columns.

Cases with a defined result: null pages and pages without visible text give an
empty text; unclosed and stray tags never fail; rows that share an id are
rendered each; empty tables give empty results; only the named columns are
read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy

MARKUP = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))""", re.S)
SPACE = re.compile(r"[ \t\n\r\f]+")
MAY_HIDE = re.compile("hidden|style", re.I)
ATTRIBUTE = re.compile(r"""([^ \t\n\r\f/][^ \t\n\r\f/=]*+)(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:"([^"]*+)"?+|'([^']*+)'?+|([^ \t\n\r\f]*+)))?+""")
STYLE_OPAQUE = re.compile(r"""/\*.*?(?:\*/|\Z)|"(?:[^"\\]++|\\.?)*+"?+|'(?:[^'\\]++|\\.?)*+'?+|\([^)]*+\)?+""", re.S)
IMPORTANT = re.compile(r"!\s*important$")
NUMBER = {k: re.compile(rf"""(?:^|[\s"']){k}\s*=\s*["']?\s*(\d{{1,4}})""", re.I) for k in ("colspan", "rowspan", "start", "value")}

# Groups of element names of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {n: re.compile(rf"</{n}(?=[\s/>]|\Z)", re.I) for n in "script style iframe noembed noframes xmp title textarea noscript".split()}
UNSEEN = set("head script style template iframe noembed noframes noscript title object audio video canvas svg datalist".split())
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
             "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary "
             "table ul xmp".split())
SPACED = set("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul xmp".split())
ENDS_P = BLOCKS - set("body html legend option".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = set("base link meta noscript script style template title".split())
LISTS = set("ul ol menu dir".split())
CELLS, GROUPS = {"td", "th"}, {"thead", "tbody", "tfoot"}
# For a start tag: open elements that it closes, and those beyond which it closes none.
IMPLIED = {
    "li": ({"li"}, LISTS | CELLS | {"table"}), "dt": ({"dt", "dd"}, {"dl", "table"} | CELLS), "dd": ({"dt", "dd"}, {"dl", "table"} | CELLS),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th", "caption"}, {"table", "tr"}), "th": ({"td", "th", "caption"}, {"table", "tr"}),
    **{g: (GROUPS | CELLS | {"tr", "caption"}, {"table"}) for g in GROUPS},
}
WIDEST = 60  # characters up to which a column's cells are aligned
DEEPEST = 12  # list levels that are indented
NESTED = 512  # elements nested deeper than this are only matched with their end tags
MOST_COLUMNS = 1000  # fixed value: the widest colspan of the HTML standard


def style_shows(style: str) -> tuple[bool, bool | None]:
    """Whether declarations have display none, and whether they set the visibility to visible (None: not set); of
    several for a property the last ``!important`` one holds, else the last."""
    plain = STYLE_OPAQUE.sub(lambda m: " " if m[0][0] == "/" else '"', style)  # no sign in these cuts or names anything
    held: dict[str, tuple[bool, str]] = {}
    for declaration in plain.lower().split(";"):
        prop, colon, value = declaration.partition(":")
        prop, bare = prop.strip(), IMPORTANT.sub("", value.strip())
        if colon and (now := (bare != value.strip(), bare.strip()))[0] >= held.get(prop, now)[0]:
            held[prop] = now
    seen = {"visible": True, "initial": True, "hidden": False, "collapse": False}
    return held.get("display", (False, ""))[1] == "none", seen.get(held.get("visibility", (False, ""))[1])


def shows(attrs: str) -> tuple[bool, bool | None]:
    """Whether a tag takes its element away (an attribute named hidden, display none), and the visibility that its
    style sets; of equal names the first counts."""
    if not MAY_HIDE.search(attrs):
        return False, None
    style = None
    for m in ATTRIBUTE.finditer(attrs):
        name = m[1].lower()
        if name == "hidden":
            return True, None
        if name == "style" and style is None:
            style = html.unescape(m[2] or m[3] or m[4] or "")
    return style_shows(style) if style else (False, None)


def has(attrs: str, name: str) -> bool:
    return any(m[1].lower() == name for m in ATTRIBUTE.finditer(attrs))


class Lines:
    """Text written line by line: single spaces within lines, at most one blank line in between."""

    def __init__(self):
        self.parts: list[str] = []
        self.breaks = self.gap = 0  # line breaks to write before the next text
        self.space = False
        self.marks: list[str | None] = []  # of the open list items; None once written
        self.lists: list[int | None] = []  # the next number of each open list; None: not numbered

    def line(self, n: int) -> None:
        self.breaks, self.space = max(self.breaks, n), False

    def state(self) -> tuple:
        return len(self.parts), self.breaks, self.gap, self.space

    def back_to(self, state: tuple) -> None:
        """Forget the breaks since ``state`` if nothing was written since."""
        if len(self.parts) == state[0]:
            _, self.breaks, self.gap, self.space = state

    def force(self) -> None:
        """A line break that stays even after another one."""
        self.gap, self.space = self.gap + 1, False

    def _begin(self) -> None:
        n = max(self.breaks, min(self.gap, 2)) if self.parts else 0
        if n or not self.parts:
            self.parts.append("\n" * n)
            levels = min(max(len(self.lists) - 1, 0), DEEPEST)
            mark = self.marks[-1] if self.marks else None
            if mark:
                self.parts.append("  " * levels + mark)
                self.marks[-1] = None
            elif self.lists:
                self.parts.append("  " * (levels + 1))
        elif self.space:
            self.parts.append(" ")
        self.breaks, self.gap, self.space = 0, 0, False

    def text(self, s: str) -> None:
        words = SPACE.sub(" ", s)
        bare = words.strip(" ")
        if not bare:
            self.space = self.space or bool(words)
            return
        self.space = self.space or words[0] == " "
        self._begin()
        self.parts.append(bare)
        self.space = words[-1] == " "

    def raw(self, s: str) -> None:
        for i, row in enumerate(s.split("\n")):
            if i:
                self.force()
            if row.strip():
                lines = self.gap
                self._begin()
                self.parts.append("\n" * max(0, lines - 2) + row.rstrip("\r"))

    def result(self) -> str:
        return "".join(self.parts).strip("\n")


class Table:
    def __init__(self):
        self.rows: list[list[tuple[list[str], int, int]]] = []  # cells: lines, columns, rows
        self.span = self.down = 1

    def places(self) -> list[list[tuple[int, list[str], int]]]:
        """Each row's cells with their first columns; columns of a cell from above that reaches down are left free."""
        until: dict[int, tuple[int, int]] = {}  # of a column: the first free row, the next column
        out = []
        for r, row in enumerate(self.rows):
            at, placed = 0, []
            for lines, span, down in row:
                while until.get(at, (0, 0))[0] > r:
                    at = until[at][1]
                placed.append((at, lines, span))
                if down > 1:
                    until.update(dict.fromkeys(range(at, at + span), (r + down, at + span)))
                at += span
            out.append(placed)
        return out

    def text(self) -> str:
        placed = self.places()
        widths: dict[int, int] = {}
        for row in placed:
            for at, lines, span in row:
                if span == 1:
                    widths[at] = max([widths.get(at, 0), *(len(x) for x in lines if len(x) <= WIDEST)])
        starts, end = {}, 0  # only columns in which a cell begins take room
        for c in sorted({at for row in placed for at, _, _ in row}):
            starts[c] = end
            end += widths.get(c, 0) + 2
        out = []
        for row in placed:
            for i in range(max((len(lines) for _, lines, _ in row), default=0)):
                line, long = "", False
                for at, lines, _ in row:
                    if i >= len(lines) or not lines[i]:
                        continue
                    if line and len(line) + 2 > starts[at]:  # the cell before reaches into this column
                        if long:
                            out.append(line)
                        line = "" if long else line + "  "
                    line = line.ljust(starts[at]) + lines[i]
                    long = len(lines[i]) > WIDEST
                out.append(line.rstrip())
        return "\n".join(x for x in out if x)


class Renderer:
    """Tree builder and renderer of one page."""

    def __init__(self):
        self.open: list[str] = []
        self.n: Counter[str] = Counter()  # open elements by name
        self.deep: list[str] = []  # open elements beyond NESTED
        self.deep_n: Counter[str] = Counter()
        self.unseen = 0  # depth from which nothing shows; 0: all shows
        # of the visibilities set by open elements: depth, value, the writer and its state before
        self.visible: list[tuple[int, bool, Lines, tuple]] = []
        self.pre = 0
        self.writers: list[Lines] = [Lines()]
        self.tables: list[Table] = []

    def in_cell(self) -> bool:
        return len(self.writers) > len(self.tables)

    def text(self, s: str) -> None:
        if self.unseen or not s:
            return
        s = html.unescape(s) if "&" in s else s
        if self.open and self.open[-1] == "head" and s.strip():
            self.pop_to("head")
        w = self.writers[-1]
        if self.visible and not self.visible[-1][1]:
            w.space = w.space or s[:1].isspace() or s[-1:].isspace()
            return
        if self.pre:
            w.raw(s)
        else:
            w.text(s)

    def _find(self, names: set[str], beyond: set[str]) -> int:
        if not any(self.n[x] for x in names):
            return -1
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i] in names:
                return i
            if self.open[i] in beyond:
                return -1
        return -1

    def start(self, name: str, attrs: str) -> None:
        if not self.unseen and self.open and self.open[-1] == "head" and name not in IN_HEAD:
            self.pop_to("head")
        if name in IMPLIED:
            names, beyond = IMPLIED[name]
            while (i := self._find(names, beyond)) >= 0:
                self.close(i)
        if name in ENDS_P and (i := self._find({"p"}, CELLS | {"table", "caption", "button"})) >= 0:
            self.close(i)
        if name in HEADINGS and self.open and self.open[-1] in HEADINGS:
            self.close(len(self.open) - 1)
        if name in ("html", "body") and name in self.open[:2]:
            return
        if name in CELLS and "table" in self.open and self._find({"tr"}, {"table"}) < 0:
            self.start("tr", "")
        gone, visible = shows(attrs) if attrs and not self.unseen else (False, None)
        if not self.unseen and (gone or name in UNSEEN or name == "dialog" and not has(attrs, "open")):
            if name in VOID:
                return
            self.unseen = len(self.open) + 1
        if name in VOID:
            if not self.unseen:
                if name == "br":
                    self.writers[-1].force()
                elif name == "hr":
                    self.writers[-1].line(2)
                elif name == "wbr":
                    pass
            return
        if len(self.open) >= NESTED and self.unseen <= NESTED and visible is None:
            self.deep.append(name)
            self.deep_n[name] += 1
            return
        self.open.append(name)
        self.n[name] += 1
        if visible is not None:
            self.visible.append((len(self.open), visible, self.writers[-1], self.writers[-1].state()))
        if not self.unseen:
            self.enter(name, attrs)

    def enter(self, name: str, attrs: str) -> None:
        w = self.writers[-1]
        if name in CELLS or name == "caption":
            if not self.tables:
                w.text(" ")
                return
            if self.in_cell():
                return
            span, down = (NUMBER[k].search(attrs) if attrs and name in CELLS else None for k in ("colspan", "rowspan"))
            self.tables[-1].span = min(max(1, int(span[1])), MOST_COLUMNS) if span else 1
            self.tables[-1].down = (int(down[1]) or 1 << 30) if down else 1  # 0: all rows that follow
            self.writers.append(Lines())
        elif name == "tr":
            if self.tables and not self.in_cell():
                self.tables[-1].rows.append([])
            else:
                w.line(1)
        elif name in BLOCKS:
            nested = bool(w.lists) and name in LISTS
            w.line(1 if nested else 2 if name in SPACED else 1)
            if name == "table":
                self.tables.append(Table())
                self.writers[-1:] = [w]
            elif name in LISTS:
                m = NUMBER["start"].search(attrs) if attrs and name == "ol" else None
                w.lists.append(int(m[1]) if m else 1 if name == "ol" else None)
            elif name == "li":
                n = w.lists[-1] if w.lists else None
                if n is not None:
                    m = NUMBER["value"].search(attrs) if attrs else None
                    n = int(m[1]) if m else n
                    w.lists[-1] = n + 1
                w.marks.append("- " if n is None else f"{n}. ")
            elif name in ("pre", "xmp"):
                self.pre += 1

    def leave(self, name: str) -> None:
        w = self.writers[-1]
        if name in CELLS or name == "caption":
            if not self.tables or not self.in_cell():
                return
            table, cell = self.tables[-1], self.writers.pop().result().split("\n")
            if name == "caption":
                self.writers[-1].text("\n".join(cell))
                self.writers[-1].line(1)
            else:
                if not table.rows:
                    table.rows.append([])
                table.rows[-1].append((cell, table.span, table.down))
        elif name == "table":
            if not self.tables:
                return
            if self.in_cell():  # a cell that was never closed
                self.leave("td")
            w = self.writers[-1]
            w.line(1 if w.breaks == 1 else 2)
            w.raw(self.tables.pop().text())
            w.line(2)
        elif name in BLOCKS:
            if name == "li":
                if w.marks:
                    w.marks.pop()
            elif name in LISTS and w.lists:
                w.lists.pop()
            elif name in ("pre", "xmp"):
                self.pre -= 1
            nested = bool(w.lists) and name in LISTS
            w.line(1 if nested else 2 if name in SPACED else 1)

    def close(self, i: int) -> None:
        """Close the open elements from the i-th on."""
        while len(self.open) > i:
            name = self.open.pop()
            self.n[name] -= 1
            if self.unseen:
                if len(self.open) < self.unseen:
                    self.unseen = 0
            else:
                self.leave(name)
            if self.visible and len(self.open) < self.visible[-1][0]:
                _, shown, w, before = self.visible.pop()
                if not shown and not self.unseen and w is self.writers[-1]:
                    w.back_to(before)
        if self.deep and len(self.open) < NESTED:
            self.deep.clear()
            self.deep_n.clear()

    def pop_to(self, name: str) -> None:
        beyond = set() if name in ("table", "body", "html") else {"table"} if name in CELLS | GROUPS | {"tr", "caption"} else CELLS | {"table"}
        i = self._find({name}, beyond)
        if self.deep_n[name] and i < NESTED:
            self.close(NESTED)
            while self.deep_n[name]:
                last = self.deep.pop()
                self.deep_n[last] -= 1
                if last == name:
                    break
        elif i >= 0:
            self.close(i)
        elif name == "p" and not self.unseen:
            self.writers[-1].line(2)
        elif name == "br" and not self.unseen:
            self.writers[-1].force()

    def render(self, page: str) -> str:
        at, end = 0, len(page)
        while at < end:
            lt = page.find("<", at)
            if lt < 0:
                self.text(page[at:])
                break
            m = MARKUP.match(page, lt)
            if m is None:  # a lone sign
                self.text(page[at:lt + 1])
                at = lt + 1
                continue
            if lt > at:
                self.text(page[at:lt])
            at, name = m.end(), m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                self.pop_to(name)
                continue
            self.start(name, m[3])
            if name in RAW:
                stop = RAW[name].search(page, at)
                inner = page[at:stop.start() if stop else end]
                self.text(inner if name in ("textarea", "xmp") else "")
                at = stop.start() if stop else end
            elif m[3].endswith("/") and name in ("svg", "math"):
                self.close(len(self.open) - 1)
        self.close(0)
        return self.writers[0].result()


def page_text(page: str | None) -> str:
    return Renderer().render(page.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "")) if page else ""


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = 0
        for pages in slices(b.column("html"), 4 << 20, 1024):
            rest = [b.column(n).slice(at, len(pages)) for n in b.schema.names if n != "html"]
            at += len(pages)
            yield pa.RecordBatch.from_arrays([*rest, pa.array(list(map(page_text, pages)), pa.string())],
                                             names=[*(n for n in b.schema.names if n != "html"), "text"])


def extract(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """The columns ``keep`` and ``text`` of every page."""
    rows = pages.select(*[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)], F.col(html_col).cast("string").alias("html"))
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"kept_{i} {kinds[f'kept_{i}']}" for i in range(len(keep))), "text string"])
    out = rows.mapInArrow(tidy(_render), schema)
    return out.select(*[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)], "text")
