"""Candidates for the most similar vectors of many queries: blocks of vectors meet by matrix products, ties and rounding stay in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.staged import staged

#: Rows of a block of vectors and of queries, blocks that meet in a task, and more than what sums in another order may differ by.
ROWS, QUERIES, TOGETHER, MARGIN = 1024, 256, (32, 2), 1e-9


def _blocks(vectors: DataFrame, row: str, v: str, size: int) -> DataFrame:
    """(rows, dim, data): vectors of one length in blocks; those that are null or have a null are of length 0."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim):
            rows, data = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            return pa.RecordBatch.from_pydict({"rows": [rows.tobytes()], "dim": pa.array([dim], pa.int32()), "data": [data.tobytes()]})

        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                rows, col = part.column(row).to_numpy(zero_copy_only=False), part.column(v)
                lengths = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = col.flatten()
                values, owner = flat.to_numpy(zero_copy_only=False).astype(np.float64), np.repeat(np.arange(len(rows)), lengths)
                dims = lengths.copy()
                dims[owner[flat.is_null().to_numpy(zero_copy_only=False)]] = 0
                for dim in np.unique(dims):
                    mine = dims == dim
                    data = values[mine[owner]].reshape(-1, dim) if dim else np.zeros((mine.sum(), 0))
                    held.setdefault(int(dim), []).append((rows[mine], data))
                    if sum(len(r) for r, _ in held[int(dim)]) >= size:
                        yield block(int(dim))
        for dim in list(held):
            yield block(dim)

    return staged(vectors.select(row, v).mapInArrow(pack, "rows binary, dim int, data binary"))


def _best(q: np.ndarray, of: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which of the scored pairs may be among the k best of their query."""
    order = np.lexsort((-score, q))
    q, score = q[order], score[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    last = np.minimum(first + k - 1, np.r_[first[1:], len(q)] - 1)
    least = np.repeat(score[last], np.diff(np.r_[first, len(q)]))
    return order[score >= least - MARGIN]


def close_pairs(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(q_row, row) of queries (q_row, q) and vectors (row, v): all that can be among the k of largest cosine, ties with the last included.

    A task holds at most some blocks of either side and leaves about k rows a query. The cosine of vectors of different
    lengths, without length, null or with a null is 0; one that is no number is the largest.
    """
    v, q = _blocks(vectors, "row", "v", ROWS), _blocks(queries, "q_row", "q", QUERIES)
    v, q = (b.repartition(-(-max(b.count(), 1) // n)) for b, n in zip((v, q), TOGETHER, strict=True))
    q = q.select(F.col("rows").alias("q_rows"), F.col("dim").alias("q_dim"), F.col("data").alias("q_data"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                of, mine = np.frombuffer(row["rows"], np.int64), np.frombuffer(row["q_rows"], np.int64)
                score = np.zeros((len(mine), len(of)))
                if row["dim"] and row["dim"] == row["q_dim"]:
                    a, b = (np.frombuffer(row[d], np.float64).reshape(-1, row["dim"]) for d in ("q_data", "data"))
                    with np.errstate(all="ignore"):
                        norm = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :]
                        score = np.where(norm == 0, 0.0, (a @ b.T) / norm)
                    score[np.isnan(score)] = np.inf
                least = np.partition(score, -min(k, len(of)), axis=1)[:, -min(k, len(of))]
                at, to = np.nonzero(score >= least[:, None] - MARGIN)
                kept.append((mine[at], of[to], score[at, to]))
        if kept:
            q_row, to, score = (np.concatenate(x) for x in zip(*kept, strict=True))
            few = _best(q_row, to, score, k)
            yield pa.RecordBatch.from_arrays([pa.array(x[few]) for x in (q_row, to, score)], ["q_row", "row", "score"])

    pairs = v.hint("shuffle_replicate_nl").crossJoin(q).mapInArrow(meet, "q_row long, row long, score double")
    own = Window.partitionBy("q_row")
    ranked = pairs.withColumn("r", F.row_number().over(own.orderBy(F.desc("score"))))
    return ranked.withColumn("least", F.min(F.when(F.col("r") <= k, F.col("score"))).over(own)).filter(F.col("score") >= F.col("least") - MARGIN).select("q_row", "row")
