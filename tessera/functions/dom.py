"""Pages as node tables: every element with its interval in preorder, its text, and for table cells their place in the grid.

With intervals, "inside", "next after" and "nearest before" are joins and windows over rows; no tree is walked afterwards.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An element that opens ends these ones, up to a border that it does not cross.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
_BLOCKS = frozenset("address article aside blockquote center dd div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
_CELLS = {"td", "th", "table", "caption"}
_P = {"p"}
_CLOSED = {"script", "style"}  # their content is no text of the page
#: Elements in which a parser may not read tags.
_SPECIAL = frozenset("script style title textarea xmp iframe noembed noframes noscript plaintext".split())
NODE = "pre int, last int, parent int, level int, start int, tag string, attrs map<string,string>, text string, grid_row int, grid_col int, row_span int, col_span int"


_FLAT = ("pre", "last", "parent", "level", "start", "tag", "text", "grid_row", "grid_col", "row_span", "col_span")
_NO_GRID = (None,) * 4


class Node:
    """An element: its interval (pre to last), the one that it stands in (parent, else -1), and the place of its text (first to end)."""

    __slots__ = ("tag", "attrs", "hidden", "pre", "last", "parent", "level", "first", "end")


class _Events(HTMLParser):
    """What the parser reports of a text, one step after the other: data as it is, tags as _step says."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.said = []

    def handle_starttag(self, tag, attrs):
        self.said.append(_step("start", tag, attrs))

    def handle_startendtag(self, tag, attrs):
        self.said.append(_step("startend", tag, attrs))

    def handle_endtag(self, tag):
        self.said.append(_step("end", tag))

    def handle_data(self, data):
        self.said.append(data)


class _Tag(_Events):
    """What the parser makes of one tag alone."""

    def handle_comment(self, data):
        self.said.append(_step("nothing", ""))

    def handle_decl(self, decl):
        self.said.append(_step("nothing", ""))


def _step(kind: str, tag: str, attrs=()) -> tuple:
    """(kind, tag, attributes, what an opening tag ends, whether it is a block, whether it has no content)."""
    return kind, tag, {k: v or "" for k, v in attrs}, ENDS.get(tag), tag in _BLOCKS, kind == "startend" or tag in VOID


@functools.lru_cache(maxsize=4096)
def _tag(inside: str) -> tuple | None:
    """The step of a tag by what stands between < and >, which pages repeat; None where the parser does not take it as one."""
    one = _Tag()
    one.feed(f"<{inside}>")
    return one.said[0] if len(one.said) == 1 and isinstance(one.said[0], tuple) and not one.rawdata else None


def _steps(html: str) -> list[tuple | str] | None:
    """What the parser would report for a page, by its tags one by one; None if it depends on more than these."""
    pieces = html.split("<")
    if "&" in pieces[0]:
        return None
    out, raw, closes = pieces[:1] if pieces[0] else [], "", ""  # an element whose content has to be text up to its end, the end of a script
    add = out.append
    for i in range(1, len(pieces)):
        piece = pieces[i]
        if closes:  # its content is no text of the page
            if not piece.startswith(closes):
                if piece.startswith("!--") or re.match(rf"(?i)/\s*{closes[1:-1]}", piece):
                    return None
                continue
            add(_step("end", closes[1:-1]))
            data, closes = piece[len(closes) :], ""
        else:
            head, sign, data = piece.partition(">")
            step = _tag(head) if sign else None  # a < that opens no tag, or tags inside comments
            if step is None:
                return None
            tag = step[1]
            if raw and (step[0] != "end" or tag != raw):
                return None
            raw = ""
            add(step)
            if tag in _SPECIAL and step[0] != "end":
                if tag in _CLOSED:
                    if step[0] != "start" or not piece.startswith(tag):
                        return None
                    closes = f"/{tag}>"
                    continue
                raw = tag if step[0] == "start" else ""
        if data:
            if "&" in data:
                return None
            add(data)
    return None if raw or closes else out


class Page:
    """A page, read: nodes in preorder and its whole text. An element without its end tag ends with what it stands in, an end without a start is nothing."""

    def __init__(self, html: str | None, without: frozenset[str] = frozenset()):
        steps = _steps(html or "")
        if steps is None:
            parser = _Events()
            parser.feed(html)
            parser.close()
            steps = parser.said
        self.nodes: list[Node] = []
        self.tags: defaultdict[str, list[Node]] = defaultdict(list)
        self.given: list[Node] = []  # those that have attributes
        self.whole = self._read(steps, without)

    def text(self, node: Node) -> str:
        """The pieces of text in an element, joined by a space."""
        return self.whole[node.first : node.end]

    def having(self, name: str, part: str) -> list[Node]:
        """The elements with an attribute that contains part."""
        return [n for n in self.given if part in n.attrs.get(name, "")]

    def _read(self, steps, without) -> str:
        nodes, tags, given, stack, pieces, size = self.nodes, self.tags, self.given, [], [], 0
        count: defaultdict[str, int] = defaultdict(int)  # open elements of each tag

        def close(left: int):
            """Ends the innermost open elements down to a number."""
            last = len(nodes) - 1
            while len(stack) > left:
                node = stack.pop()
                count[node.tag] -= 1
                node.end, node.last = size, last
                if node.first < 0:
                    node.first = size

        def end(tag: str):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    return close(i)
                if stack[i].tag in _CELLS and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                    return None

        def end_up_to(what, border):
            deepest, i, left = None, len(stack), 0
            for t in what:
                left += count[t]
            while left and (i := i - 1) >= 0 and stack[i].tag not in border:
                if stack[i].tag in what:
                    deepest, left = i, left - 1
            if deepest is not None:
                close(deepest)

        for step in steps:
            if step.__class__ is str:
                words = " ".join(step.split())
                if words and not (stack and (stack[-1].hidden or stack[-1].tag in _CLOSED)):
                    start = size + 1 if size else 0
                    pieces.append(words)
                    size = start + len(words)
                    for node in reversed(stack):  # those around one that has a text have one themselves
                        if node.first >= 0:
                            break
                        node.first = start
                continue
            kind, tag, attrs, ends, block, empty = step
            if kind == "end":
                if stack and (node := stack[-1]).tag == tag:
                    del stack[-1]
                    count[tag] -= 1
                    node.end, node.last = size, len(nodes) - 1
                    if node.first < 0:
                        node.first = size
                elif count[tag]:
                    end(tag)
                continue
            if kind == "nothing":
                continue
            if ends:
                for t in ends[0]:
                    if count[t]:
                        end_up_to(*ends)
                        break
            if block and count["p"]:
                end_up_to(_P, _CELLS)
            node = Node()
            node.tag, node.attrs, node.first, node.hidden = tag, attrs, -1, False
            if without:
                node.hidden = bool(stack and stack[-1].hidden) or ("class" in attrs and not without.isdisjoint(attrs["class"].split()))
            if not node.hidden:
                node.pre, node.parent, node.level = len(nodes), stack[-1].pre if stack else -1, len(stack)
                nodes.append(node)
                tags[tag].append(node)
                if attrs:
                    given.append(node)
            if empty:
                node.first = node.end = size
                node.last = len(nodes) - 1
            else:
                stack.append(node)
                count[tag] += 1
        close(0)
        return " ".join(pieces)


def _span(node: Node, name: str) -> int:
    value = node.attrs.get(name, "")
    return min(max(int(value), 1), 1000) if value.isdecimal() else 1


def grids(page: Page) -> dict[int, tuple[int, int, int, int, int]]:
    """Row, column, spans and table (its pre) of each cell: it takes the first column of its row that no cell from above reaches into."""
    if not (page.tags["td"] or page.tags["th"]):
        return {}
    nodes, tables, rows, out, near = page.nodes, {}, {}, {}, []  # near: the table or row that a node is or lies in
    for n in nodes:
        above = near[n.parent] if n.parent >= 0 else -1
        near.append(n.pre if n.tag in ("table", "tr") else above)
        if n.tag == "tr" and above >= 0 and nodes[above].tag == "table":
            t = tables.setdefault(above, {"rows": 0, "taken": {}, "pre": above})
            rows[n.pre] = (t, t["rows"])
            t["rows"] += 1
        elif n.tag in ("td", "th") and above in rows:
            t, r = rows[above]
            taken, c, high, wide = t["taken"], 0, _span(n, "rowspan"), _span(n, "colspan")
            while taken.get(c, -1) >= r:
                c += 1
            for k in range(c, c + wide):
                taken[k] = r + high - 1
            out[n.pre] = (r, c, high, wide, t)
    return {pre: (r, c, min(high, t["rows"] - r), wide, t["pre"]) for pre, (r, c, high, wide, t) in out.items()}  # no cell reaches below its table


def page_nodes(html: str | None, texts: frozenset[str], without: frozenset[str] = frozenset()) -> list[dict]:
    """The elements of a page in preorder: last is the last node inside, start the place of its text in the page's.

    Those whose tag is among texts have their text, its pieces joined by a space.
    """
    page, out = Page(html, without), []
    cells = grids(page)
    for n in page.nodes:
        row = {"pre": n.pre, "last": n.last, "parent": n.parent, "level": n.level, "start": n.first, "tag": n.tag, "attrs": n.attrs}
        row["text"] = page.text(n) if n.tag in texts else None
        row |= dict(zip(("grid_row", "grid_col", "row_span", "col_span"), cells.get(n.pre, _NO_GRID)[:4], strict=True))
        out.append(row)
    return out


def nodes_of(pages: DataFrame, html: str, texts: tuple[str, ...], without: tuple[str, ...] = ()) -> DataFrame:
    """One row for each element of each page; all columns of pages but html stay. Elements with a class of without are left out with all in them."""
    wanted, dropped = frozenset(texts), frozenset(without)
    own = [c for c in pages.columns if c != html]

    def flat(given: pa.RecordBatch, at: list[int], rows: list[tuple], attrs: list[dict]) -> pa.RecordBatch:
        places = [0]
        for a in attrs:
            places.append(places[-1] + len(a))
        keys, values = [k for a in attrs for k in a], [v for a in attrs for v in a.values()]
        columns = dict(zip(_FLAT, zip(*rows, strict=True), strict=True))
        arrays = {c: pa.array(v, pa.string() if c in ("tag", "text") else pa.int32()) for c, v in columns.items()}
        arrays["attrs"] = pa.MapArray.from_arrays(pa.array(places, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string()))
        mine = [given.column(c).take(pa.array(at, pa.int64())) for c in own]
        return pa.RecordBatch.from_arrays([*mine, *(arrays[f.split()[0]] for f in NODE.split(", "))], [*own, *(f.split()[0] for f in NODE.split(", "))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, attrs, size = [], [], [], 0
            for i in range(batch.num_rows):
                page = Page(batch.column(html)[i].as_py(), dropped)
                cells = grids(page)
                for n in page.nodes:
                    text = page.text(n) if n.tag in wanted else None
                    size += len(text or "") + 100
                    rows.append((n.pre, n.last, n.parent, n.level, n.first, n.tag, text, *cells.get(n.pre, _NO_GRID)[:4]))
                    attrs.append(n.attrs)
                at += [i] * len(page.nodes)
                if size > 4_000_000:  # a page at least, however many pages a batch has
                    yield flat(batch, at, rows, attrs)
                    at, rows, attrs, size = [], [], [], 0
            if rows:
                yield flat(batch, at, rows, attrs)

    # one order of columns for what goes in and out
    given = pages.select(*own, html)
    schema = StructType([*given.select(*own).schema.fields, *StructType.fromDDL(NODE).fields])
    return given.mapInArrow(parse, schema)


#: Rows and letters of pages after which what was found goes on; a page at least is read before.
TOGETHER = (20_000, 4_000_000)


def found_in(pages: DataFrame, html: str, fields: str, find: Callable[[Page], Iterator[tuple]], without: tuple[str, ...] = ()) -> DataFrame:
    """The rows (fields) that find gives for each page, in the task that has the page; all columns of pages but html stay."""
    dropped, own = frozenset(without), [c for c in pages.columns if c != html]
    given = pages.select(*own, html)
    schema = StructType([*given.select(*own).schema.fields, *StructType.fromDDL(fields).fields])
    types = list(to_arrow_schema(StructType.fromDDL(fields)))

    def flat(batch: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        mine = [batch.column(c).take(pa.array(at, pa.int64())) for c in own]
        return pa.RecordBatch.from_arrays([*mine, *(pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), types, strict=True))], [*own, *(t.name for t in types)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, letters = TOGETHER
        for batch in batches:
            at, rows, size = [], [], 0
            for i in range(batch.num_rows):
                text = batch.column(html)[i].as_py()
                size += len(text or "")
                for row in find(Page(text, dropped)):
                    at.append(i)
                    rows.append(row)
                    if len(rows) >= most:  # a page may have any number of rows
                        yield flat(batch, at, rows)
                        at, rows, size = [], [], 0
                if size > letters and rows:
                    yield flat(batch, at, rows)
                    at, rows, size = [], [], 0
            if rows:
                yield flat(batch, at, rows)

    return given.mapInArrow(read, schema)


def attr(name: str, of: str | Column = "attrs") -> Column:
    return F.coalesce(F.element_at(of, name), F.lit(""))
