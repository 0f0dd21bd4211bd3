"""Mixing of sources to target weights: certain whole copies, then Pareto order sampling for the fraction that is left.

The targets of the sources, and inside a source the expected copies of each length class, are shares by weight that stop
at a cap (the excess goes on to the others). A document with e expected copies gets floor(e) of them for certain; the
fraction p is its chance of one more. For these the documents of a source are ordered by their random odds over their
inclusion odds, u / (1 - u) * (1 - p) / p, and taken in this order until the words that the source still needs are full;
the document at that border is taken in part. The border is found by radix selection: counts of words by 12 bits of the
order at a time, so that no source has to be sorted by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: What mix() adds to the columns that it keeps.
ADDED = ("size", "source_size", "target", "expected_copies", "taken")


def words(text: str | Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _capped_shares(rows: DataFrame, total: Column, within: list[str]) -> Column:
    """The share of each row (cap, weight) in total: by weight, at most cap, the excess to the others.

    In the order of cap / weight the capped rows come first. With all before a row at their caps, the rest by weight is
    (total - caps before) / (weights left); this level is highest at the first row that is not capped.
    """
    every = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    before = every.orderBy(F.col("cap") / F.col("weight"), "cap", "weight").rowsBetween(Window.unboundedPreceding, -1)
    spent, used = F.coalesce(F.sum("cap").over(before), F.lit(0)), F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (total - spent.cast("double")) / (F.sum("weight").over(every) - used).cast("double")
    return rows.withColumn("level", level).withColumn("level", F.max("level").over(every))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most_copies: int = 3) -> DataFrame:
    """(source, source_size, target) of (source, source_size): one row a source; these rows meet in one task.

    Sources take the weights in turn, by code point, null last. A target stops at most_copies times the source.
    """
    turn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod("turn", F.lit(len(weights))) + 1).cast("long")
    rows = sizes.withColumn("turn", turn).select("source", "source_size", "turn", weight.alias("weight"), (F.col("source_size") * most_copies).alias("cap"))
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0))).cast("double")
    return _capped_shares(rows, total, []).select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _copies(classes: DataFrame, most_copies: int) -> DataFrame:
    """Expected copies, certain copies and chance of one more, by (source, class); need: the words that chance has to bring.

    A class is the bit length of the size. Its documents get copies in proportion to it (scraps are repeated least), most_copies at most.
    """
    rows = classes.select("*", (F.col("class_size") * most_copies).alias("cap"), (F.col("class_size") * F.col("class")).alias("weight"))
    shared = _capped_shares(rows, F.col("target"), ["source"])
    expected = F.least(F.lit(float(most_copies)), F.col("level") * F.col("class"))
    out = shared.withColumn("expected_copies", expected).withColumn("whole", F.floor("expected_copies"))
    need = F.floor(F.col("target") + 0.5) - F.sum(F.col("whole") * F.col("class_size")).over(Window.partitionBy("source"))
    return out.select("source", "class", "source_size", "target", "expected_copies", "whole", (F.col("expected_copies") - F.col("whole")).alias("p"), F.greatest(need, F.lit(0)).alias("need"))


def _digit(level: int) -> Column:
    """12 bits of the order (48 bits of the Pareto rank, then 48 of chance), from the highest, as hex digits."""
    name, at = ("rank", level) if level < 4 else ("chance", level - 4)
    return F.lpad(F.hex(F.shiftright(name, 48 - 12 * (at + 1)).bitwiseAND(0xFFF)), 3, "0")


def _border(rows: DataFrame, cell_rows: int) -> tuple[DataFrame, int]:
    """Of each source the leading digits of the order at which its need is full, and the words before them.

    Every level counts the words of those rows only that share the digits found so far, until no source has more than
    cell_rows rows there; a level has 4,096 counts a source at most. (source, digits, before) and the number of levels.
    """
    rows, levels = rows.filter("p > 0"), 0
    here = rows.withColumns({"digits": F.lit(""), "before": F.lit(0).cast("long")})
    while True:
        cells = here.groupBy("source", "digits", _digit(levels).alias("code"), "need").agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.max("before").alias("start"))
        until = F.col("start") + F.sum("words").over(Window.partitionBy("source").orderBy("code"))
        found = cells.withColumn("until", until).filter(F.col("until") - F.col("words") < F.col("need")).groupBy("source", "digits", "need").agg(F.max(F.struct("code", "until", "words", "n")).alias("c"))
        state = materialize(found.select("source", F.concat("digits", "c.code").alias("digits"), (F.col("c.until") - F.col("c.words")).alias("before"), F.col("c.n").alias("n")))
        levels += 1
        if levels == 8 or (state.agg(F.max("n")).first()[0] or 0) <= cell_rows:
            return state.drop("n"), levels
        here = rows.withColumn("digits", _leading(levels)).join(state.drop("n"), ["source", "digits"])


def _leading(levels: int) -> Column:
    return F.concat(*map(_digit, range(levels)))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most_copies: int = 3, seed: int = 13, keep: list[str] | None = None, cell_rows: int = 20_000) -> DataFrame:
    """The rows of docs (doc_id, text, source and more) with size, source_size, target, expected_copies and taken (words, repeats counted).

    Null texts have no words and are never taken; a null source is a source of its own; a null doc_id is an id like
    another. Chance comes from doc_id and size, so reruns agree; rows equal in both take any order among themselves. An
    empty table gives no rows, a table without words targets of 0. Input columns named like an added one are replaced;
    keep names the columns to carry (all, if not given). The words that a source takes are its target, rounded; no
    document is taken more than most_copies times. Rows are written once; after that only counts by length class and by
    12 bits of the order are shuffled, and the rows at the border of a source.
    """
    own = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    size = words(F.col("text").cast("string"))
    u = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")).cast("binary"), 256)
    base = docs.select(F.struct(*own).alias("own"), F.col("source").cast("string").alias("name"), F.col("doc_id"), size.alias("size"))
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), 16)
    base = base.select("own", F.struct(F.col("name").isNull().alias("no"), "name").alias("source"), "size", ((F.conv(F.substring(u, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)).alias("u"), chance.alias("chance"))
    bits = F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0)
    base = materialize(base.withColumn("class", bits.cast("long")))
    by_class = materialize(base.groupBy("source", "class").agg(F.sum("size").alias("class_size")))
    per_source = by_class.groupBy("source").agg(F.sum("class_size").alias("source_size"))
    aims = targets(per_source.select(F.col("source.name").alias("source"), "source_size"), weights, most_copies)
    aims = aims.select(F.struct(F.col("source").isNull().alias("no"), F.col("source").alias("name")).alias("source"), "source_size", "target")
    aims = materialize(aims)
    classes = by_class.filter("class > 0").join(aims, "source")
    plan = materialize(_copies(classes, most_copies).unionByName(by_class.filter("class = 0").join(aims, "source").select("source", "class", "source_size", "target", F.lit(0.0).alias("expected_copies"), F.lit(0).cast("long").alias("whole"), F.lit(0.0).alias("p"), F.lit(0).cast("long").alias("need"))))
    u, p = F.col("u"), F.col("p")
    rank = F.floor(u * (1 - p) / (u * (1 - p) + (1 - u) * p) * float(1 << 48))  # q / (1 + q) of the Pareto rank q
    rows = base.join(plan, ["source", "class"]).withColumn("rank", F.when(p > 0, F.least(rank, F.lit((1 << 48) - 1))).otherwise(0))
    border, levels = _border(rows.select("source", "size", "p", "need", "rank", "chance"), cell_rows)
    placed = rows.withColumn("digits", _leading(levels)).join(border.select("source", F.col("digits").alias("border"), "before"), "source", "left")
    sampled = F.col("p") > 0
    clear = placed.filter(~sampled | F.col("border").isNull() | (F.col("digits") != F.col("border"))).withColumn("more", F.when(sampled & (F.col("digits") < F.col("border")), F.col("size")).otherwise(0))
    at = placed.filter(sampled & (F.col("digits") == F.col("border")))
    until = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("rank", "chance").rowsBetween(Window.unboundedPreceding, 0))
    border_rows = at.withColumn("until", until).withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("need") - F.col("until") + F.col("size")))).drop("until")
    done = clear.unionByName(border_rows)
    return done.select(*(F.col("own")[c].alias(c) for c in own), "size", "source_size", "target", "expected_copies", (F.col("whole") * F.col("size") + F.col("more")).cast("long").alias("taken"))


def copies(mixed: DataFrame) -> DataFrame:
    """The mixture itself: a row for each copy (copy, from 0), its text as words joined by spaces where only a part is taken."""
    whole = F.expr("taken div size")
    each = mixed.filter("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.expr("(taken - 1) div size").cast("int"))))
    part = F.slice(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.greatest(F.lit(1), F.expr("taken % size")).cast("int"))
    return each.withColumn("text", F.when(F.col("copy") < whole, F.col("text")).otherwise(F.array_join(part, " ")))
