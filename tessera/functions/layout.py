"""Queries over node tables: sections, what stands next or before, grids of tables, and a fold of ordered rows into records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.dom import attr

HEADS = ("h2", "h3", "h4", "h5")


def within(outer: DataFrame, inner: DataFrame, key: str) -> DataFrame:
    """Pairs of an outer element (key, o_pre, o_last and more) and the elements of the same page inside it."""
    return outer.join(inner, key).filter((F.col("pre") > F.col("o_pre")) & (F.col("pre") <= F.col("o_last")))


def headings(nodes: DataFrame, key: str, through: str | None = None) -> DataFrame:
    """(key, head, level, name, from, until): each heading with the range of nodes of its section.

    A section ends at the next heading of the same parent, or with the parent; headings whose text contains through do
    not end it.
    """
    heads = nodes.filter(F.col("tag").isin(*HEADS))
    ends = heads.filter(~F.col("text").contains(through)) if through else heads
    marks = heads.select(key, "parent", "pre", "tag", "last", F.col("text").alias("name"))
    stops = ends.groupBy(key, "parent").agg(F.array_sort(F.collect_list("pre")).alias("stops"))  # the headings of one parent
    top = nodes.select(key, F.col("pre").alias("parent"), F.col("last").alias("top_last"))
    out = marks.join(stops, [key, "parent"], "left").join(top, [key, "parent"], "left")
    after = F.try_element_at(F.filter("stops", lambda s: s > F.col("pre")), F.lit(1))
    return out.select(key, F.col("pre").alias("head"), "parent", F.col("tag").alias("rank"), "name", (F.col("last") + 1).alias("from"), F.coalesce(after, F.col("top_last") + 1, F.lit(2**31 - 1)).alias("until"))


def next_in_section(nodes: DataFrame, key: str, target: Column, mark: Column) -> DataFrame:
    """(key, head, o_pre, o_last): for each heading the first target of its section that has a mark inside.

    Of each element that stands beside the heading only its first target counts (the element itself, if it is one).
    """
    heads = headings(nodes, key).select(key, "head", "parent", "from", "until")
    beside = heads.join(nodes.select(key, "parent", F.col("pre").alias("b_pre"), F.col("last").alias("b_last")), [key, "parent"]).filter("b_pre >= from and b_pre < until")
    targets = nodes.filter(target).select(key, F.col("pre").alias("o_pre"), F.col("last").alias("o_last"))
    first = beside.join(targets, key).filter("o_pre >= b_pre and o_pre <= b_last").groupBy(key, "head", "b_pre").agg(F.min(F.struct("o_pre", "o_last")).alias("t")).select(key, "head", "t.*")
    marked = within(first.select(key, "o_pre", "o_last").distinct(), nodes.filter(mark), key).select(key, "o_pre").distinct()
    return first.join(marked, [key, "o_pre"], "leftsemi").groupBy(key, "head").agg(F.min(F.struct("o_pre", "o_last")).alias("t")).select(key, "head", "t.*")


def following(nodes: DataFrame, key: str, target: Column, through: str) -> DataFrame:
    """(key, head, pre, last): the targets beside each heading up to the next one of its parent that does not contain through."""
    heads = headings(nodes, key, through).select(key, "head", "parent", "from", "until")
    return heads.join(nodes.filter(target).select(key, "parent", "pre", "last"), [key, "parent"]).filter("pre >= from and pre < until").select(key, "head", "pre", "last")


def last_before(nodes: DataFrame, key: str, value: Column) -> DataFrame:
    """nodes with before: the last value that is not null among the nodes before, in the order of the page."""
    return nodes.withColumn("before", F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)))


def next_after(nodes: DataFrame, key: str, value: Column) -> DataFrame:
    """nodes with after: the first value that is not null among the nodes behind, in the order of the page."""
    return nodes.withColumn("after", F.first(value, ignorenulls=True).over(Window.partitionBy(key).orderBy("pre").rowsBetween(1, Window.unboundedFollowing)))


def grid(nodes: DataFrame, key: str) -> DataFrame:
    """(key, t_pre, row, col, cell, head, text): the slots of every table, each with the cell that reaches into it."""
    cells = nodes.filter("grid_row is not null")
    tables = nodes.filter("tag = 'table'").select(key, F.col("pre").alias("t_pre"), F.col("last").alias("t_last"), F.col("level").alias("t_level"))
    inner = cells.join(tables, key).filter("pre > t_pre and pre <= t_last")
    inner = inner.groupBy(key, "pre").agg(F.max_by(F.struct("t_pre", "grid_row", "grid_col", "row_span", "col_span", "tag", "text"), "t_level").alias("c"))  # the innermost table
    slots = inner.select(key, F.col("pre").alias("cell"), "c.*", F.explode(F.expr("sequence(c.grid_row, c.grid_row + c.row_span - 1)")).alias("row"))
    return slots.select(key, "t_pre", "row", F.explode(F.expr("sequence(grid_col, grid_col + col_span - 1)")).alias("col"), "cell", (F.col("tag") == "th").alias("head"), "text")


def labelled(slots: DataFrame, key: str) -> DataFrame:
    """The data slots of a grid with label: the text of the last header slot above in the column."""
    down = Window.partitionBy(key, "t_pre", "col").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return slots.withColumn("label", F.last(F.when(F.col("head"), F.col("text")), ignorenulls=True).over(down)).filter(~F.col("head"))


def as_maps(cells: DataFrame, key: str) -> DataFrame:
    """(key, t_pre, row, values): a MAP from label to text for each row of a table; of equal labels the leftmost counts."""
    first = cells.filter("label is not null").groupBy(key, "t_pre", "row", "label").agg(F.min_by("text", "col").alias("text"))
    return first.groupBy(key, "t_pre", "row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "text")))).alias("values"))


def icon_values(rows: DataFrame, nodes: DataFrame, key: str, icon: str, pattern: str) -> DataFrame:
    """(key, o_pre, values): of each row element (o_pre, o_last, text) its icons, named by group 1 of icon in alt, with the k-th match of pattern.

    Where counts and icons differ in number, an icon takes the match in the text of its parent, else 1.
    """
    name = F.regexp_extract(attr("alt"), icon, 1)
    up = nodes.select(key, F.col("pre").alias("parent"), F.col("text").alias("p_text"))
    icons = within(rows.select(key, "o_pre", "o_last", F.col("text").alias("o_text")), nodes.filter((F.col("tag") == "img") & (name != "")).select(key, "pre", "parent", name.alias("name")), key)
    icons = icons.join(up, [key, "parent"], "left").withColumn("near", F.regexp_extract(F.coalesce("p_text", F.lit("")), pattern, 1))
    each = icons.groupBy(key, "o_pre", "o_text").agg(F.array_sort(F.collect_list(F.struct("pre", "name", "near"))).alias("icons"))
    found = F.regexp_extract_all("o_text", F.lit(pattern), F.lit(1))
    number = lambda s: F.when(s == "", F.lit("1")).otherwise(s).cast("double")
    paired = F.when(F.size(found) == F.size("icons"), F.zip_with("icons", found, lambda i, v: F.struct(i["name"].alias("key"), v.cast("double").alias("value"))))
    alone = F.transform("icons", lambda i: F.struct(i["name"].alias("key"), number(i["near"]).alias("value")))
    # of equal names the last one counts
    entries = F.coalesce(paired, alone)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return each.select(key, "o_pre", F.map_from_entries(last).alias("values"))


def row_facts(tables: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """(key, t_pre, row, r_last, text, icons, bolds, bigs, colored, sin_colored, head): the rows of tables (key, o_pre, o_last) and what stands in them, in order.

    icons are the alt texts of images; colored are bold texts in coloured spans, those beside an image whose alt has
    "sin-" (in one cell with it) apart in sin_colored; head tells a black cell over the whole width that has a body icon.
    """
    rows = within(tables.select(key, "o_pre", "o_last"), nodes.filter("tag = 'tr'"), key).select(key, F.col("o_pre").alias("t_pre"), F.col("pre").alias("o_pre"), F.col("last").alias("o_last"), F.col("text").alias("r_text"))
    cells = nodes.filter("tag in ('td', 'th')").select(key, F.col("pre").alias("o_pre"), F.col("last").alias("o_last"), (attr("style").contains("background:#000000") & (attr("colspan") == "7")).alias("black"))
    images = nodes.filter("tag = 'img'").select(key, "pre", attr("alt").alias("alt"))
    by_cell = within(cells, images, key).groupBy(key, F.col("o_pre").alias("c_pre"), F.col("o_last").alias("c_last"), "black").agg(F.bool_or(F.col("alt").contains("sin-")).alias("sin"), F.bool_or(F.col("alt").contains("body-")).alias("body"))
    sin_cells = by_cell.filter("sin").select(key, F.col("c_pre").alias("o_pre"), F.col("c_last").alias("o_last"))
    spans = nodes.filter((F.col("tag") == "span") & attr("style").contains("color")).select(key, F.col("pre").alias("o_pre"), F.col("last").alias("o_last"))
    bolds = nodes.filter("tag = 'b'").select(key, "pre", "text")
    colored = within(spans, bolds, key).groupBy(key, "o_pre").agg(F.min_by("text", "pre").alias("text")).select(key, F.col("o_pre").alias("pre"), "text")
    in_sin = within(sin_cells, colored, key).select(key, "pre").distinct().withColumn("sin", F.lit(True))
    facts = [
        images.select(key, "pre", F.lit("icon").alias("kind"), F.col("alt").alias("what")), bolds.select(key, "pre", F.lit("bold").alias("kind"), F.col("text").alias("what")), nodes.filter("tag = 'big'").select(key, "pre", F.lit("big").alias("kind"), F.col("text").alias("what")),
        colored.join(in_sin, [key, "pre"], "left").select(key, "pre", F.when(F.col("sin"), "sin").otherwise("color").alias("kind"), F.col("text").alias("what")),
        by_cell.filter("black and body").select(key, F.col("c_pre").alias("pre"), F.lit("head").alias("kind"), F.lit("").alias("what")),
    ]
    every = facts[0]
    for f in facts[1:]:
        every = every.unionByName(f)
    of = lambda kind: F.transform(F.filter("found", lambda f: f["kind"] == kind), lambda f: f["what"])
    found = within(rows.select(key, "o_pre", "o_last"), every, key).groupBy(key, "o_pre").agg(F.array_sort(F.collect_list(F.struct("pre", "kind", "what"))).alias("found"))
    out = rows.join(found, [key, "o_pre"], "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<pre:int,kind:string,what:string>>")))
    return out.select(key, "t_pre", F.col("o_pre").alias("row"), F.col("o_last").alias("r_last"), F.col("r_text").alias("text"), of("icon").alias("icons"), of("bold").alias("bolds"), of("big").alias("bigs"), of("color").alias("colored"), of("sin").alias("sin_colored"), (F.size(of("head")) > 0).alias("head"))


def part_rows(rows: DataFrame, key: str) -> DataFrame:
    """row_facts with part (number of part heads so far) and phase: what a row is in its part.

    A fold over the rows as windows. head opens a part and ends the one before; icons (life and speed) announce values,
    which are the next row; sin_icons with values are sin_values themselves, those without announce them: the next row
    without an image. Heads and icons take back what was announced. All else is other.
    """
    order = Window.partitionBy(key, "t_pre").orderBy("row")
    has = lambda name: F.exists("icons", lambda i: i.contains(name))
    kind = F.when(F.col("head"), "head").when(has("stat-life") & has("stat-speed"), "icons")
    rows = rows.withColumn("part", F.count_if("head").over(order)).withColumn("kind", kind)
    rows = rows.withColumn("kind", F.coalesce("kind", F.when(F.lag("kind").over(order) == "icons", "values"), F.when(has("sin-"), F.when(F.size("sin_colored") > 0, "sin_values").otherwise("sin_icons")), F.when(F.size("icons") == 0, "bare")))
    event = F.col("kind").isin("head", "icons", "sin_icons", "sin_values")
    rows = rows.withColumn("event", F.count_if(event).over(order)).withColumn("opened", F.last(F.when(event, F.col("kind")), ignorenulls=True).over(order))
    first = F.row_number().over(Window.partitionBy(key, "t_pre", "event", "kind").orderBy("row"))
    bare = F.when((F.col("opened") == "sin_icons") & (first == 1), "sin_values").otherwise("other")
    return rows.withColumn("phase", F.when(F.col("kind") == "bare", bare).otherwise(F.coalesce("kind", F.lit("other")))).drop("kind", "event", "opened")


def by_position(found: Column, text: Column, names: tuple[str, ...], skip: Column | None = None) -> Column:
    """A map from names, in order, to the ×numbers of found; where that has none, to those of the text (from place skip on)."""
    number = lambda a: F.filter(F.transform(a, lambda s: F.nullif(F.regexp_extract(s, r"×\s*([\d.]+)", 1), F.lit("")).try_cast("double")), lambda v: v.isNotNull())
    spare = F.transform(F.regexp_extract_all(text, F.lit(r"×\s*([\d.]+)"), F.lit(1)), lambda s: s.try_cast("double"))
    spare = F.slice(spare, skip + 1, F.greatest(F.size(spare), F.lit(1))) if skip is not None else spare
    keys = F.array(*map(F.lit, names))
    chosen = F.when(F.size(number(found)) > 0, number(found)).otherwise(spare)
    pairs = F.filter(F.zip_with(keys, chosen, lambda k, v: F.struct(k.alias("key"), v.alias("value"))), lambda e: e["key"].isNotNull() & e["value"].isNotNull())
    return F.map_from_entries(pairs)
