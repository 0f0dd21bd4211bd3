"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix.

Every partition of the input permutes its rows. The matrix of counts partition -> shard is drawn without replacement (so
its row and column sums are exact), every partition deals its rows out by its row of the matrix, and every shard permutes
what it got: by a random key of each row, whose upper part names a cell, so that no task holds a whole shard.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many good ones are among so many draws without replacement: inversion outward from the mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    up = down = mode
    p = q = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    u = rng.random() - p
    while u > 0 and (up < high or down > low):
        p = p * (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1)) if up < high else 0.0
        q = q * down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1)) if down > low else 0.0
        if up < high:
            up += 1
            u -= p
            if u <= 0:
                return up
        if down > low:
            down -= 1
            u -= q
            if u <= 0:
                return down
    return mode


def communication_matrix(sources: list[int], targets: list[int], seed: int) -> list[list[int]]:
    """Counts source -> target with exactly these sums, distributed as in a uniform shuffle."""
    rng, left, out = random.Random(seed), list(targets), []
    for n in sources:
        rest, row = sum(left), []
        for k, room in enumerate(left):
            rest -= room
            x = hypergeometric(rng, room, rest, n)
            row.append(x)
            left[k] -= x
            n -= x
        out.append(row)
    return out


def near_equal(n: int, parts: int) -> list[int]:
    """n in parts that are at most one apart."""
    return [n // parts + (k < n % parts) for k in range(parts)]


ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def shard(docs: DataFrame, n_shards: int = 24, seed: int = 20, cell_rows: int = 20_000, most_blocks: int = 65_536) -> DataFrame:
    """The rows of docs with all their columns, and size, text_crc32, law, shard, slot, grown_shard.

    A null text counts 8 bytes and has the checksum of no bytes; a null doc_id is an id like another; rows of equal
    doc_id and text go their own ways and take any order among themselves; an empty table gives no rows. Input columns
    named like an added one are replaced. Rows are sorted by chance inside their partitions (of which there are
    most_blocks at most: more are put together, without a shuffle), written once with their place, and shuffled into the
    cells, of about cell_rows rows each. The driver holds the sizes of the partitions and most_blocks x n_shards counts
    at most, which are broadcast; the cells' sizes are joined as rows.
    """
    own = [c for c in docs.columns if c not in ADDED]
    digests = {"size": lambda t: F.octet_length(t).cast("long") + 8, "text_crc32": lambda t: F.crc32(t.cast("binary"))}
    spark = docs.sparkSession
    # the row's own columns stand apart, so that no name clashes; the running number tells equal rows apart
    rows = docs.coalesce(most_blocks).select(F.struct(*own).alias("own"), F.xxhash64(F.lit(seed), "doc_id", "text", F.monotonically_increasing_id()).alias("chance"))
    sorted_rows = rows.sortWithinPartitions("chance").select("own", F.spark_partition_id().alias("block"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("r"))
    local = materialize(sorted_rows.withColumn("key", F.xxhash64(F.lit(seed + 1), "block", "r")))
    # of the rows as written: the matrix fits them even if docs comes out otherwise the next time
    counts = sorted(local.groupBy("block").count().collect())
    shards = near_equal(sum(c["count"] for c in counts), n_shards)
    matrix = communication_matrix([c["count"] for c in counts], shards, seed)
    plan = [(c["block"], [sum(row[: k + 1]) for k in range(n_shards)]) for c, row in zip(counts, matrix, strict=True)]
    dealt = spark.createDataFrame(plan, "block int, ends array<long>")
    cells = max(1, math.ceil(shards[0] / cell_rows))
    cell = F.pmod(F.shiftrightunsigned("key", 1), F.lit(cells)).cast("int")
    placed = local.join(F.broadcast(dealt), "block").select("own", F.size(F.filter("ends", lambda e: e <= F.col("r"))).alias("shard"), cell.alias("cell"), "key", "block", "r")
    sizes = placed.groupBy("shard", "cell").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("cell")) - F.col("count")
    starts = materialize(sizes.select("shard", "cell", before.alias("start")))
    inside = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("key", "block", "r")) - 1
    slots = placed.withColumn("inside", inside).join(starts.hint("merge"), ["shard", "cell"])
    text = F.coalesce(F.col("own")["text"].cast("string"), F.lit(""))
    return slots.select(*(F.col("own")[c].alias(c) for c in own), *(f(text).alias(c) for c, f in digests.items()), F.lit("rows").alias("law"), "shard", (F.col("start") + F.col("inside")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
