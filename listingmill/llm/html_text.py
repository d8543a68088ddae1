"""Layout-aware text of HTML pages.

A tree builder closes what tags imply closed (paragraphs, list items, table parts, options),
visibility rules leave out what a browser would not show, and a renderer lays out the rest:
blocks on lines of their own, blank lines where blocks have margins, lists with bullets or
numbers and indents, tables with their columns aligned, preformatted text as it stands. A cell
that has others beside it is laid out as a page of its own, so blocks, lists and tables inside it keep their lines.
Elements may be nested to any depth: nothing here recurses. What padding and deep indents may take is in
proportion to the page, and cells are passed on through few tables at most, so output and time are too.

Pages are independent, so the work is one pass over the rows without a shuffle.
"""

from __future__ import annotations

import html as entities
import re
import textwrap

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("rp head script style title template noscript datalist iframe canvas audio video noembed noframes area param source track meta link base".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset hr menu".split())
BLOCK = SPACED | frozenset("html body div section article header footer nav aside main address li dt dd tr thead tbody tfoot caption form details summary dialog legend figcaption center hgroup search option optgroup text".split())
#: A start tag closes an open element of the second set, unless one of the third is met first.
_IMPLIED = (
    (frozenset(["li"]), frozenset(["li"]), frozenset("ul ol menu table td th".split())),
    (frozenset(["dt", "dd"]), frozenset(["dt", "dd"]), frozenset("dl table td th".split())),
    (frozenset(["option"]), frozenset(["option"]), frozenset(["select", "datalist", "optgroup"])),
    (frozenset(["optgroup"]), frozenset(["option", "optgroup"]), frozenset(["select"])),
    (frozenset(["td", "th"]), frozenset(["td", "th", "caption"]), frozenset(["tr", "table"])),
    (frozenset(["tr"]), frozenset(["tr", "caption", "colgroup"]), frozenset(["table"])),
    (frozenset(["thead", "tbody", "tfoot"]), frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    (frozenset(["body"]), frozenset(["head"]), frozenset()),
)
_CLOSES_P = BLOCK - frozenset("html body li dt dd tr thead tbody tfoot caption option optgroup legend figcaption summary text".split())
_CLOSES = {tag: (of, stop) for tags, of, stop in _IMPLIED for tag in tags}
_P_STOP = frozenset("table td th caption button li dd div section article body blockquote".split())
_SCOPE = frozenset("table td th caption".split())
#: Where a part of a table may stand: a start tag leaves what is open inside the nearest of these.
_PARENTS = {
    **dict.fromkeys(("caption", "colgroup", "thead", "tbody", "tfoot"), frozenset(["table"])),
    "col": frozenset(["table", "colgroup"]),
    "tr": frozenset("table thead tbody tfoot".split()),
    **dict.fromkeys(("td", "th"), frozenset("table thead tbody tfoot tr".split())),
}
#: Open elements that take only parts of tables; anything else goes before the table, as in browsers.
_TABLE_ONLY = frozenset("table thead tbody tfoot tr colgroup".split())
_TABLE_KEEPS = frozenset(_PARENTS) | frozenset("script style template".split())
#: What drawings and formulas hold but don't show.
_UNDRAWN = frozenset("desc metadata defs symbol clippath mask pattern marker annotation annotation-xml".split())
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_GONE = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)", re.I)
#: Spans that browsers allow at most, by the HTML standard.
_SPANS = {"colspan": 1000, "rowspan": 65_534}
#: Tables inside each other whose columns are aligned; deeper ones are laid out a cell after the other.
ALIGNED = 16
#: Indents that every line may have; what deeper ones and columns may take together, for each character of the page, and on any page.
INDENT, PADDING, SOME = 24, 3, 4096
#: Characters after which a line of a cell that has others to its right is wrapped.
WRAP = 60


class Node:
    __slots__ = ("attrs", "children", "rules", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, rules: dict | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []
        self.rules = rules if rules is not None else {}  # of the page, which all its elements share


def _value(v: str) -> str:
    v = v[1:-1] if v[:1] in ("'", '"') else v
    return entities.unescape(v) if "&" in v else v


#: A rule of a style sheet whose selectors name a tag, a class or an id, alone or with the tag before it.
_COMMENT, _RULE = re.compile(r"/\*.*?(?:\*/|\Z)", re.S), re.compile(r"([^{}]*)([{}])")
_SIMPLE = re.compile(r"([a-zA-Z][\w-]*|\*)?([.#][\w-]+)?")
_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]+)", re.I)


def sheet_rules(css: str) -> dict[tuple[str, str], bool]:
    """Whether a style sheet displays what a simple selector (tag or '', mark with its class or id or '') names; rules inside others, as of media, are left out."""
    rules: dict[tuple[str, str], bool] = {}
    depth, selectors = 0, ""
    for before, brace in _RULE.findall(_COMMENT.sub("", css)):
        if brace == "{":
            depth += 1
            selectors = before if depth == 1 else ""
            continue
        found = _DISPLAY.findall(before) if depth == 1 and selectors else ()
        for one in selectors.rpartition(";")[2].split(",") if found else ():
            m = _SIMPLE.fullmatch(one.strip())
            if m and m[0]:
                rules[(m[1] or "").lower().replace("*", ""), m[2] or ""] = found[-1].lower() != "none"
        depth, selectors = max(0, depth - 1), ""
    return rules


def parse(page: str) -> Node:
    """The tree of a page; strings among the children are text."""
    rules: dict[tuple[str, str], bool] = {}
    root = Node("#root", rules=rules)
    stack = [root]
    opened: dict[str, int] = {}  # open elements by tag: what isn't open needs no look through the stack
    at, size = 0, len(page)

    def push(node: Node) -> None:
        stack.append(node)
        opened[node.tag] = opened.get(node.tag, 0) + 1

    def leave(i: int) -> None:
        for node in stack[i:]:
            opened[node.tag] -= 1
        del stack[i:]

    def add(child: Node | str, keep: bool) -> None:
        i = 0 if keep or stack[-1].tag not in _TABLE_ONLY else nearest(("table",))
        if not i:  # nothing to leave, or a part of a table outside any
            stack[-1].children.append(child)
            return
        above = stack[i - 1].children
        above.insert(len(above) - 1, child)  # an open table is the last child of its parent

    def nearest(of) -> int:
        if not any(map(opened.get, of)):
            return 0
        return next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in of), 0)

    def text(s: str) -> None:
        if s:
            add(entities.unescape(s) if "&" in s else s, _SPACE.fullmatch(s) is not None)

    def close(of, stop) -> None:
        if not any(map(opened.get, of)):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in of:
                leave(i)
                return
            if stack[i].tag in stop:
                return

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        follows = page[lt + 1 : lt + 2]
        if follows == "!" or follows == "?":
            text(page[at:lt])
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = size if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt) or _PLAIN_TAG.match(page, lt)
        if not m:
            if follows == "/":  # a stray end tag that isn't one
                text(page[at:lt])
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                text(page[at : lt + 1])
                at = lt + 1
            continue
        text(page[at:lt])
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                add(Node("br", rules=rules), False)
                continue
            for i in range(len(stack) - 1 if opened.get(tag) else 0, 0, -1):
                if stack[i].tag == tag:
                    leave(i)
                    break
                if stack[i].tag in _SCOPE and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                    break
            continue
        if tag in _CLOSES_P:
            close(("p",), _P_STOP)
        if tag in _CLOSES:
            close(*_CLOSES[tag])
        if tag in _PARENTS and nearest(("table",)):
            leave(nearest(_PARENTS[tag]) + 1)
        elif stack[-1].tag in _TABLE_ONLY and (i := nearest(("table",))):
            if tag == "form":  # its fields follow, but it holds no part of the table
                continue
            if tag == "table":
                leave(i)
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            row = Node("tr", rules=rules)
            stack[-1].children.append(row)
            push(row)
        attrs = {k.lower(): _value(v) for k, v in _ATTR.findall(m[3])} if m[3].strip(" \t\n\r\f/") else None
        node = Node(tag, attrs, rules)
        add(node, tag in _TABLE_KEEPS)
        if (tag in _UNDRAWN or m[3].endswith("/")) and nearest(("svg", "math")):
            if m[3].endswith("/"):
                continue
            node.attrs["hidden"] = ""
        elif tag in ("svg", "math") and m[3].endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            inner = page[at : end.start() if end else size]
            if tag == "textarea":
                node.children.append(entities.unescape(inner))
            if tag == "style" and node.attrs.get("media", "all").strip().lower() in ("all", "screen", ""):
                root.rules.update(sheet_rules(inner))
            after = page.find(">", end.end()) if end else -1
            at = size if after < 0 else after + 1
        elif tag not in VOID:
            push(node)
    return root


def displayed(node: Node) -> bool:
    """Whether an element takes part in the page at all."""
    a = node.attrs
    if node.tag in UNSEEN:
        return False
    if node.rules and not ("style" in a and _DISPLAY.search(a["style"])) and not _ruled(node):
        return False
    if not a:
        return node.tag != "dialog"
    if node.tag == "input" or "hidden" in a or (node.tag == "dialog" and "open" not in a) or (node.tag == "object" and "data" in a):
        return False
    return not ("style" in a and _GONE.search(a["style"]))


def _ruled(node: Node) -> bool:
    """What the page's style rules say: those of the id, then of classes, then of the tag; of classes at odds the last named."""
    marks = ["#" + node.attrs["id"]] if "id" in node.attrs else []
    for group in (marks, ["." + c for c in reversed(node.attrs.get("class", "").split())], [""]):
        for mark in group:
            for tag in (node.tag, ""):
                found = node.rules.get((tag, mark))
                if found is not None:
                    return found
    return True


def _seen(node: Node, inherited: bool) -> bool:
    """Whether text right inside an element is visible; unlike ``display``, children may take it back."""
    found = _VISIBILITY.findall(node.attrs["style"]) if "style" in node.attrs else ()
    return found[-1].lower() == "visible" if found else inherited


class _Page:
    """Lines of output, with white space between inline text collapsed and margins of blocks merged."""

    def __init__(self, room: list[int], aligned: int = 0):
        self.room = room  # what deep indents and columns may still take, a number that all parts of a page share
        self.aligned = aligned  # tables whose columns are aligned around this
        self.lines: list[str] = []
        self.base, self.owed, self.lead = 0, False, ""  # first line of the cell, a blank line before it, marks before its indent
        self.now: list[str] = []
        self.gap = False  # white space waits before the next word
        self.blank = False  # a blank line waits before the next line
        self.indent = ""
        self.mark = ""  # a bullet waits for its line

    def words(self, s: str) -> None:
        if not s:
            return
        lead, trail = s[0] in " \t\n\r\f", s[-1] in " \t\n\r\f"
        s = _SPACE.sub(" ", s).strip(" ")
        if not s:
            self.gap = self.gap or bool(self.now)
            return
        if (self.gap or lead) and self.now:
            self.now.append(" ")
        self.now.append(s)
        self.gap = trail

    def line(self) -> None:
        if self.now:
            self.put("".join(self.now))
            self.now = []
        self.gap = False

    def put(self, s: str) -> None:
        if (self.blank if len(self.lines) > self.base else self.owed or self.blank and not self.base) and self.lines:
            self.lines.append("")
        self.blank = False
        pad = self._pad()
        self.lead = self.mark = ""
        if len(pad) > INDENT and not self.take(len(pad)):
            pad = pad[-INDENT:]
        self.lines.append((pad + s).rstrip(" "))

    def _pad(self) -> str:
        pad = self.lead + self.indent[len(self.lead) :]
        return pad[: max(0, len(pad) - len(self.mark))] + self.mark

    def take(self, n: int) -> bool:
        if n > self.room[0]:
            return False
        self.room[0] -= n
        return True

    def enter(self) -> tuple:
        """Lines from here on are those of a cell: white space at its edges is none of the page's."""
        held = (self.base, self.owed, self.blank, self.lead, self.mark, len(self.lines))
        self.owed = self.owed if self.lines and len(self.lines) == self.base else self.blank
        self.lead = self._pad() if self.lead or self.mark else ""
        self.base, self.blank, self.mark = len(self.lines), False, ""
        return held

    def leave(self, held: tuple) -> None:
        self.line()
        if len(self.lines) == held[-1]:
            self.base, self.owed, self.blank, self.lead, self.mark, _ = held
        else:
            self.base, self.owed, self.blank, self.lead, self.mark = held[0], held[1], False, "", ""

    def margin(self) -> None:
        self.line()
        self.blank = True


def _table_rows(node: Node):
    """Row groups of a table in display order: head, bodies and loose rows, foot."""
    parts: dict[str, list[list[Node]]] = {"thead": [], "": [], "tfoot": []}
    loose: list[Node] | None = None
    for c in node.children:
        if not isinstance(c, Node) or not displayed(c):
            continue
        if c.tag == "tr":
            if loose is None:
                loose = []
                parts[""].append(loose)
            loose.append(c)
        elif c.tag in ("thead", "tbody", "tfoot"):
            loose = None
            parts[c.tag if c.tag != "tbody" else ""].append([r for r in c.children if isinstance(r, Node) and r.tag == "tr" and displayed(r)])
    return parts["thead"] + parts[""] + parts["tfoot"]


def _is_cell(c) -> bool:
    return isinstance(c, Node) and c.tag in ("td", "th") and displayed(c)


def _one_column(groups) -> bool:
    """Whether no cell has another beside it, so there is nothing to align."""
    for group in groups:
        for row in group:
            cells = [c for c in row.children if _is_cell(c)]
            if len(cells) > 1 or any("colspan" in c.attrs or "rowspan" in c.attrs for c in cells):
                return False
    return True


def _span(node: Node, key: str) -> int:
    v = node.attrs.get(key, "")
    if not (v.isascii() and v.isdigit()):
        return 1
    return min(int(v[:9]), _SPANS[key]) if int(v[:9]) else _SPANS[key] if key == "rowspan" else 1


def _table(page: _Page, node: Node, seen: bool):
    for c in node.children:
        if isinstance(c, Node) and c.tag == "caption" and displayed(c):
            page.line()
            yield _flow(page, c, _seen(c, seen))
            page.line()
    groups = _table_rows(node)
    if page.aligned >= ALIGNED or _one_column(groups):
        page.line()
        for group in groups:
            for row in group:
                for c in row.children:
                    if _is_cell(c):
                        held = page.enter()
                        yield _flow(page, c, _seen(c, _seen(row, seen)))
                        page.leave(held)
        return
    rows: list[list[tuple[int, int, list[str]]]] = []  # (column, columns, lines) of the cells that hold something
    for group in groups:
        held: list[list[int]] = []  # (from column, to column, rows left) of cells above that reach down, by column
        for row in group:
            at, free, out = 0, iter(held), []
            block = next(free, None)
            reach = []
            for c in row.children:
                if not _is_cell(c):
                    continue
                while block and block[0] <= at:
                    at, block = max(at, block[1]), next(free, None)
                wide, tall = _span(c, "colspan"), _span(c, "rowspan")
                inner = _Page(page.room, page.aligned + 1)
                yield _flow(inner, c, _seen(c, _seen(row, seen)))
                inner.line()
                if inner.lines:
                    out.append((at, wide, inner.lines))
                if tall > 1:
                    reach.append([at, at + wide, tall])
                at += wide
            held = sorted([a, z, left - 1] for a, z, left in held + reach if left > 1)
            rows.append(out)
    page.line()
    _grid(page, rows)


def _grid(page: _Page, rows) -> None:
    """Rows of cells side by side, each column from one place on.

    A row is laid out so only if its padding stays in proportion to what it holds; else its
    cells follow one another, so the output never outgrows the page.
    """
    wrapped = [[(at, wide, _wrapped(lines) if i < len(row) - 1 else lines) for i, (at, wide, lines) in enumerate(row)] for row in rows]
    widths: dict[int, int] = {}  # one word may be longer than a column; it pushes what is right of it
    for row in wrapped:
        for at, wide, lines in row:
            widths[at] = max(widths.get(at, 0), min(WRAP, max(map(len, lines))) if wide == 1 else 0)
    starts, place = {}, 0
    for at in sorted(widths):
        starts[at] = place
        place += widths[at] + 2 if widths[at] else 0
    for row, own in zip(wrapped, rows, strict=True):
        if not row:
            continue
        size = sum(map(len, (s for _, _, lines in own for s in lines)))
        tall = max(len(lines) for _, _, lines in row)
        padding = starts[row[-1][0]] * tall
        if (len(row) > 1 and padding > 4 * size + 160 * len(row)) or not page.take(padding):
            for _, _, lines in own:
                for s in lines:
                    page.put(s)
            continue
        for i in range(tall):
            line = ""
            for at, _, lines in row:
                if i < len(lines) and lines[i]:
                    line = line.ljust(starts[at]) if len(line) < starts[at] - 1 or not line else line + "  "
                    line += lines[i]
            page.put(line)


def _wrapped(lines: list[str]) -> list[str]:
    out = []
    for s in lines:
        pad = s[: len(s) - len(s.lstrip(" "))]
        out += [s] if len(s) <= WRAP else textwrap.wrap(s, WRAP, subsequent_indent=pad, expand_tabs=False, replace_whitespace=False, break_long_words=False, break_on_hyphens=False)
    return out


def _ordinals(node: Node):
    """The mark of each item of an ordered list, in turn; the item may state its own number."""
    items = [c for c in node.children if isinstance(c, Node) and c.tag == "li" and displayed(c)]
    step = -1 if "reversed" in node.attrs else 1
    number = _whole(node.attrs.get("start"), len(items) if step < 0 else 1)
    for item in items:
        number = _whole(item.attrs.get("value"), number)
        yield f"{_ordinal(number, node.attrs.get('type', '1'))}. "
        number += step


def _whole(v: str | None, otherwise: int) -> int:
    return int(v) if v and v.isascii() and v.removeprefix("-").isdigit() and len(v) < 10 else otherwise


def _ordinal(n: int, kind: str) -> str:
    if kind in ("a", "A") and n > 0:
        s = ""
        while n:
            n, r = divmod(n - 1, 26)
            s = chr(97 + r) + s
        return s if kind == "a" else s.upper()
    if kind in ("i", "I") and 0 < n < 4000:
        s = ""
        for value, mark in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "m cm d cd c xc l xl x ix v iv i".split(), strict=True):
            s += mark * (n // value)
            n %= value
        return s if kind == "i" else s.upper()
    return str(n)


def _flow(page: _Page, node: Node, seen: bool, depth: int = 0):
    """Lays out what an element holds. Yields such calls for its elements, which ``_run`` makes in turn."""
    marks = _ordinals(node) if node.tag == "ol" else None
    for c in node.children:
        if isinstance(c, str):
            if seen:
                page.words(c)
            continue
        if not displayed(c):
            continue
        tag = c.tag
        if tag == "br":
            if page.now:
                page.line()
            else:
                page.blank = True
            continue
        if node.tag == "details" and "open" not in node.attrs and tag != "summary":
            continue
        own = _seen(c, seen)
        if tag not in BLOCK:
            yield _flow(page, c, own, depth)
            continue
        edge = page.margin if tag in SPACED and not (tag in ("ul", "ol", "menu") and depth) else page.line
        edge()
        if tag == "table":
            yield _table(page, c, own)
        elif tag == "pre":
            parts: list[str] = []
            yield _plain(parts, c, own)
            for s in "".join(parts).strip("\n").split("\n"):
                page.put(s)
        elif tag == "li":
            mark = next(marks, "- ") if marks else "- "
            held = page.indent
            page.indent, page.mark = page.indent + " " * len(mark), mark
            yield _flow(page, c, own, depth + 1)
            page.line()
            page.indent, page.mark = held, ""
        elif tag in ("dd", "blockquote"):
            held = page.indent
            page.indent = held + "  "
            yield _flow(page, c, own, depth)
            page.line()
            page.indent = held
        else:
            yield _flow(page, c, own, depth)
        edge()
    if node.tag == "details" and "open" not in node.attrs:
        page.line()


def _plain(parts: list[str], node: Node, seen: bool):
    for c in node.children:
        if isinstance(c, str):
            if seen:
                parts.append(c)
        elif c.tag == "br":
            parts.append("\n")
        elif displayed(c):
            yield _plain(parts, c, _seen(c, seen))


def _run(call) -> None:
    """Makes a call and those it yields, each to its end before the one that yielded it goes on."""
    calls = [call]
    while calls:
        inner = next(calls[-1], None)
        if inner is None:
            calls.pop()
        else:
            calls.append(inner)


def render(node: Node, room: int) -> str:
    page = _Page([room])
    _run(_flow(page, node, True))
    page.line()
    return "\n".join(page.lines)


def page_text(page: str) -> str:
    """All visible text of a page, laid out in lines."""
    return render(parse(page), PADDING * len(page) + SOME)


def _texts(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([page_text(h) for h in part.column(1).to_pylist()], pa.string())], names=["page_id", "text"])


def html_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id and text of every row.

    Defined cases: a null or empty page has the empty text; markup without an end is read as far
    as it goes; elements may be nested to any depth; values of form fields are not text; of style sheets, rules
    of ``display`` for a tag, a class or an id of the page's own are read, other selectors and files are not; a table
    whose padding would outgrow its content, or that lies in ``ALIGNED`` others, is laid out a cell after the other, and very
    deep indents are cut, both without loss of text; repeated rows and null
    ids each get a result; other columns, of any name, are not read; an empty table gives an empty result.
    """
    own = pages.select(pages[id_col].cast("long").alias("page_id"), F.coalesce(pages[html_col], F.lit("")).alias("html"))
    return own.mapInArrow(_texts, "page_id long, text string")
