"""Layouts of one page, read in memory: what layout.py says of node tables, said of a page's own nodes.

A page lies in one row, so nothing about it needs a join: intervals are slices of its nodes, and what stands next is found by halving.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from operator import attrgetter

from tessera.functions.dom import Node, Page, grids
from tessera.functions.layout import HEADS

_PRE = attrgetter("pre")
_STAT = re.compile(r"stat-(\w+)", re.A)
_TIMES = re.compile(r"×\s*([\d.]+)", re.A)


def attr(node: Node, name: str) -> str:
    return node.attrs.get(name, "")


def inside(found: list[Node], outer: Node) -> list[Node]:
    """Those of found, in the order of the page, that stand in an element."""
    return found[bisect_right(found, outer.pre, key=_PRE) : bisect_right(found, outer.last, key=_PRE)]


def next_of(found: list[Node], node: Node) -> Node | None:
    """The first of found that opens behind a node."""
    i = bisect_right(found, node.pre, key=_PRE)
    return found[i] if i < len(found) else None


def sections(page: Page, through: str | None = None) -> list[tuple[Node, int]]:
    """Headings with the node before which their section ends: the next heading of the same parent, or the parent's end.

    Headings whose text contains through do not end one.
    """
    after, out = {}, []
    for h in sorted((n for tag in HEADS for n in page.tags[tag]), key=_PRE, reverse=True):
        end = page.nodes[h.parent].last + 1 if h.parent >= 0 else len(page.nodes)
        out.append((h, after.get(h.parent, end)))
        if through is None or through not in page.text(h):
            after[h.parent] = h.pre
    return out[::-1]


def next_in_section(page: Page, targets: list[Node], marks: list[Node]) -> Iterator[tuple[Node, Node]]:
    """Headings with the first target of their section that has a mark inside.

    Of each element that stands beside the heading only its first target counts (the element itself, if it is one).
    """
    nodes, starts, marked = page.nodes, [t.pre for t in targets], [m.pre for m in marks]
    for head, until in sections(page):
        at = head.last + 1
        while at < until:
            last = nodes[at].last
            i = bisect_left(starts, at)
            if i < len(starts) and starts[i] <= last:
                j = bisect_right(marked, starts[i])
                if j < len(marked) and marked[j] <= targets[i].last:
                    yield head, targets[i]
                    break
            at = last + 1


def following(page: Page, targets: list[Node], through: str) -> Iterator[tuple[Node, list[Node]]]:
    """Headings with the targets beside them up to the next heading of their parent that does not contain through."""
    beside: dict[int, list[Node]] = {}
    for t in targets:
        beside.setdefault(t.parent, []).append(t)
    starts = {parent: [t.pre for t in found] for parent, found in beside.items()}
    for head, until in sections(page, through):
        if found := beside.get(head.parent):
            of = starts[head.parent]
            yield head, found[bisect_right(of, head.last) : bisect_left(of, until)]


# --- units -------------------------------------------------------------------------------------------------------


def units(page: Page, friends: str, foes: str, no_units: tuple[str, ...], through: str) -> Iterator[tuple]:
    """(unit, lives, speed, defence, threshold, n_blocks) of the headings that have a table with a life icon; values as texts."""
    side, mine = False, set()
    for n in sorted((n for tag in HEADS for n in page.tags[tag]), key=_PRE):
        text = page.text(n)
        if not side and text not in no_units:
            mine.add(n.pre)
        if n.tag == "h2":
            side = True if friends in text else False if text == foes else side
    blocks = {h.pre: len(b) for h, b in following(page, [n for n in page.having("class", "mw-collapsible") if n.tag == "div"], through)}
    icons = page.having("alt", "stat-")
    for head, table in next_in_section(page, page.tags["table"], [n for n in icons if "stat-life" in attr(n, "alt")]):
        if head.pre not in mine:
            continue
        values, threshold = {}, None
        for n in inside(icons, table):
            if (icon := _STAT.search(attr(n, "alt"))) and (bold := next_of(page.tags["b"], n)):
                values.setdefault(icon[1], []).append(page.text(bold))
        until = -1
        for row in inside(page.tags["tr"], table):
            if row.last > until and "threshold" in page.text(row) and (big := inside(page.tags["big"], row)):  # rows in rows are seen already
                threshold, until = page.text(big[-1]), row.last
        most = lambda name: max(values[name]) if name in values else None  # noqa: B023, E731
        yield page.text(head), values.get("life", []), most("speed"), most("defence"), threshold, blocks.get(head.pre, 0)


# --- grids -------------------------------------------------------------------------------------------------------


def grid_rows(page: Page, names: tuple[str, ...]) -> Iterator[tuple]:
    """(t_pre, row, values) of the rows of every table that have a cell under a header: the text below each of names.

    A cell counts in all slots that it reaches into; its label is the last header above in its column, and of equal labels the leftmost counts.
    """
    tables: dict[int, dict[int, list]] = {}
    for pre, (row, col, high, wide, table) in grids(page).items():
        tables.setdefault(table, {}).setdefault(row, []).append((page.nodes[pre], col, high, wide))
    for table in sorted(tables):
        starts, open_, labels, row = tables[table], [], {}, 0
        while starts or open_:
            open_ += [(node, col, row + high, wide) for node, col, high, wide in starts.pop(row, ())]
            found, heads = {}, []
            for node, col, _, wide in open_:
                if node.tag == "th":
                    heads.append((node, col, wide))
                    continue
                for c in range(col, col + wide):
                    if (label := labels.get(c)) is not None and (label not in found or c < found[label][0]):
                        found[label] = c, node
            for node, col, wide in heads:
                labels |= dict.fromkeys(range(col, col + wide), page.text(node))
            if found:
                yield table, row, *(page.text(found[n][1]) if n in found else None for n in names)
            row += 1
            open_ = [c for c in open_ if c[2] > row]


def icon_counts(page: Page, icon: re.Pattern, count: re.Pattern) -> Iterator[tuple]:
    """(pos, names, counts) of the rows that have icons: by name, of equal ones the last, each with its count as a text.

    The k-th icon has the k-th count of the row's text; where they differ in number, the one in the text of its parent, else 1.
    """
    pos = 0
    named = {n.pre: m[1] for n in page.tags["img"] if (m := icon.search(attr(n, "alt"))) and m[1]}
    images = [n for n in page.tags["img"] if n.pre in named]
    for row in page.tags["tr"]:
        if icons := inside(images, row):
            pos += 1
            counts = count.findall(page.text(row))
            if len(counts) != len(icons):
                near = [page.nodes[n.parent] for n in icons]
                counts = [m[1] if (m := count.search(page.text(p))) else "1" for p in near]
            values = sorted({named[n.pre]: c for n, c in zip(icons, counts, strict=True)}.items())
            yield pos, [k for k, _ in values], [v for _, v in values]


# --- tables of many parts ----------------------------------------------------------------------------------------


def times(found: list[str], text: str, n: int) -> list[float]:
    """The first n ×numbers of found, one a text; where that has none, those of the text."""

    def value(s: str) -> float | None:
        try:
            return float(s)
        except ValueError:
            return None

    own = [v for m in map(_TIMES.search, found) if m and (v := value(m[1])) is not None]
    return own[:n] if own else [value(s) for s in _TIMES.findall(text)[:n]]


class _Row:
    """What stands in a row of a table, in order; colored are bold texts in coloured spans, those in a cell with a sin's image apart (sins)."""

    __slots__ = ("text", "icon", "bold", "big", "color", "sin", "head")

    def __init__(self, text: str, facts: list[tuple[int, str, str]]):
        self.text, self.icon, self.bold, self.big, self.color, self.sin, self.head = text, [], [], [], [], [], []
        for _, kind, what in facts:
            getattr(self, kind).append(what)


def row_facts(page: Page) -> list[tuple[int, str, str]]:
    """(place, kind, what) of images (icon), bold and big texts, bold texts in coloured spans (color; sin beside an image whose alt has
    "sin-", in one cell with it) and black cells over the whole width that have a body icon (head)."""
    tags, sin_until, coming = page.tags, -1, 0
    images, bolds = tags["img"], tags["b"]
    out = [(n.pre, kind, page.text(n)) for kind, tag in (("bold", "b"), ("big", "big")) for n in tags[tag]]
    out += [(n.pre, "icon", attr(n, "alt")) for n in images]
    sins = [n for n in images if "sin-" in attr(n, "alt")]
    sin_cells = sorted((c for tag in ("td", "th") for c in tags[tag] if (n := next_of(sins, c)) and n.pre <= c.last), key=_PRE)
    for cell in page.having("style", "background:#000000"):
        if cell.tag in ("td", "th") and attr(cell, "colspan") == "7" and any("body-" in attr(n, "alt") for n in inside(images, cell)):
            out.append((cell.pre, "head", ""))
    for span in page.having("style", "color"):
        if span.tag == "span" and (bold := next_of(bolds, span)) and bold.pre <= span.last:
            while coming < len(sin_cells) and sin_cells[coming].pre < span.pre:
                sin_until, coming = max(sin_until, sin_cells[coming].last), coming + 1
            out.append((span.pre, "sin" if span.pre <= sin_until else "color", page.text(bold)))
    return sorted(out)


def part_rows(page: Page, table: Node, facts: list[tuple[int, str, str]]) -> Iterator[tuple[int, str, _Row]]:
    """(part, phase, row) of the rows of a table: part is the number of part heads so far, phase what a row is in its part.

    head opens a part and ends the one before; icons (life and speed) announce values, which are the next row; sin_icons
    with values are sin_values themselves, those without announce them: the next row without an image. Heads and icons
    take back what was announced. All else is other.
    """
    part, before, opened = 0, None, None
    for tr in inside(page.tags["tr"], table):
        row, phase = _Row(page.text(tr), facts[bisect_left(facts, (tr.pre + 1,)) : bisect_left(facts, (tr.last + 1,))]), "other"
        has = lambda name: any(name in alt for alt in row.icon)  # noqa: B023, E731
        if row.head:
            part, phase, opened = part + 1, "head", None
        elif has("stat-life") and has("stat-speed"):
            phase, opened = "icons", None
        elif before == "icons":
            phase = "values"
        elif has("sin-"):
            phase, opened = ("sin_values", None) if row.sin else ("sin_icons", "sins")
        elif not row.icon and opened:
            phase, opened = "sin_values", None
        before = phase
        yield part, phase, row


def parts(page: Page, n_blows: int, n_sins: int, through: str) -> Iterator[tuple]:
    """(name, hp, defence, speed, threshold, blows, sins, passives) of the parts with life points of the tables below third headings.

    Speed is a text, blows and sins are numbers in their order. Passives are those of the table, repeated ones once.
    Parts that equal an earlier one in name, blows and sins go where a third heading has blocks.
    """
    tables = {t.pre: t for h, t in next_in_section(page, page.tags["table"], page.having("alt", "stat-life")) if h.tag == "h3"}
    if not tables:
        return
    skilled = any(b for h, b in following(page, [n for n in page.having("class", "mw-collapsible") if n.tag == "div"], through) if h.tag == "h3")
    folds = [n for n in page.having("class", "mw-collapsible-content") if attr(n, "class") == "mw-collapsible-content"]
    facts, seen = row_facts(page), set()
    for table in sorted(tables.values(), key=_PRE):
        gifts = {}
        for item in inside(page.tags["li"], table):
            if any(f.pre < item.pre <= f.last for f in inside(folds, table)):
                paragraph = next_of(page.tags["p"], item)
                gifts[page.text(item) if paragraph is None else f"{page.text(item)}: {page.text(paragraph)}"] = True
        records: dict[int, dict] = {}
        for part, phase, row in part_rows(page, table, facts):
            if part == 0:
                continue
            r = records.setdefault(part, {"name": None, "bigs": None, "blows": None, "sins": None})
            if phase == "head":
                r["name"] = row.bold[0] if row.bold else None
            elif phase == "values":
                r["blows"] = times(row.color, row.text, n_blows)
                if len(row.big) >= 3:
                    r["bigs"] = row.big
            elif phase == "sin_values":
                r["sins"] = times(row.sin, "" if row.sin else row.text, n_sins)
        for r in records.values():
            if r["bigs"] is None or not (hp := number(r["bigs"][0])):
                continue
            mine = (r["name"], *(tuple((i, v) for i, v in enumerate(found or ()) if v is not None) for found in (r["blows"], r["sins"])))
            if not (skilled and mine in seen):
                threshold = r["bigs"][3] if len(r["bigs"]) > 3 else ""
                yield r["name"], hp, number(r["bigs"][1]), r["bigs"][2], threshold or None, r["blows"], r["sins"], "; ".join(gifts)
            seen.add(mine)


def number(text: str) -> int | None:
    """The first digits of a text as an int; null where an int does not hold them."""
    m = re.search(r"\d+", text, re.A)
    return int(m[0]) if m and len(m[0].lstrip("0")) <= 10 and int(m[0]) < 2**31 else None
