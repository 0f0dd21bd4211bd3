"""Texts against texts by the sets of their characters: blocks of sets meet by matrix products, the counts are exact."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.staged import staged

#: Rows and characters of a block, of either side; blocks that meet in a task; cells of a matrix.
ROWS, QUERIES, CODES, TOGETHER, CELLS = 4096, 1024, 1 << 18, (8, 2), 1 << 21
#: What stands for the one part of an empty text.
_EMPTY = np.array([0xFFFFFFFF], "<u4").tobytes()


def _codes(text: str | None) -> bytes:
    """The distinct characters of a text, four bytes each; a null text has none."""
    return b"" if text is None else "".join(set(text)).encode("utf-32-le", "surrogatepass") or _EMPTY


def _blocks(rows: DataFrame, keys: list[str], text: str, most: int) -> DataFrame:
    """(a, b, sizes, codes): rows of two keys with the characters of their texts, in order of the keys, nulls last."""

    def block(held) -> pa.RecordBatch:
        held.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0))
        a, b, codes = zip(*held, strict=True)
        ints = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([a], ints), pa.array([b], ints), pa.array([[len(c) // 4 for c in codes]], ints), pa.array([b"".join(codes)], pa.binary())], ["a", "b", "sizes", "codes"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for a, b, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((a, b, _codes(t)))
                size += len(held[-1][2]) // 4
                if len(held) >= most or size >= CODES:
                    yield block(held)
                    held, size = [], 0
        if held:
            yield block(held)

    kept = rows.select(*(F.col(k).cast("long") for k in keys), text)
    return staged(kept.mapInArrow(pack, "a array<long>, b array<long>, sizes array<long>, codes binary"))


def _matrix(sizes: np.ndarray, codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """A row of 0 and 1 for each set: which of the known characters it has."""
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    mine = known[at] == codes
    out = np.zeros((len(sizes), len(known)), np.float32)
    out[np.repeat(np.arange(len(sizes)), sizes)[mine], at[mine]] = 1
    return out


def _best(queries: tuple, rows: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The largest similarity of each query in a block of rows and the first row that has it; -1 where no row counts."""
    (a, a_none, b, b_none, sizes, codes), (of_a, of_a_none, of_b, of_b_none, of_sizes, of_codes) = queries, rows
    score, at = np.full(len(a), -1.0), np.zeros(len(a), np.int64)
    known = np.unique(codes) if len(codes) else np.zeros(1, np.uint32)  # what no query has is in no intersection
    mine, edges, few = _matrix(sizes, codes, known), np.append(0, np.cumsum(of_sizes)), max(1, CELLS // max(len(known), len(a)))
    for i in range(0, len(of_a), few):
        part = slice(i, i + few)
        common = (mine @ _matrix(of_sizes[part], of_codes[edges[i] : edges[min(i + few, len(of_a))]], known).T).astype(np.float64)
        s = common / np.maximum(sizes[:, None] + of_sizes[None, part] - common, 1)
        q, k = np.nonzero((a[:, None] == of_a[None, part]) | a_none[:, None] | of_a_none[None, part])
        own = (b[q] == of_b[part][k]) | b_none[q] | of_b_none[part][k]
        s[q[own], k[own]] = -1
        first = s.argmax(1)
        top = s[np.arange(len(a)), first]
        better = top > score
        score[better], at[better] = top[better], first[better] + i
    return score, at


def closest(rows: DataFrame, queries: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(q_a, q_b, score, a, b) for rows and queries of two keys each: the most similar row of each block of rows, of equal ones the first by its keys.

    The similarity is common characters over all characters of both; it is 0 with a null text. A row does not meet
    itself: both keys the same or unknown. A task holds a few blocks of either side and leaves a row a query and block.
    """
    v, q = _blocks(rows, keys, text, ROWS), _blocks(queries, keys, text, QUERIES)
    v, q = (b.repartition(-(-max(b.count(), 1) // n)) for b, n in zip((v, q), TOGETHER, strict=True))
    q = q.select(*(F.col(c).alias(f"q_{c}") for c in q.columns))

    def read(batch, i, prefix=""):
        a, b, sizes = (batch.column(prefix + c)[i].values for c in ("a", "b", "sizes"))
        ids = [x for k in (a, b) for x in (k.fill_null(0).to_numpy(), k.is_null().to_numpy(zero_copy_only=False))]
        return (*ids, sizes.to_numpy(), np.frombuffer(batch.column(prefix + "codes")[i].as_py(), "<u4"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asked, of = read(batch, i, "q_"), read(batch, i)
                score, at = _best(asked, of)
                some = np.flatnonzero(score >= 0)
                ids = [pa.array(x[k], mask=none[k]) for x, none, k in ((asked[0], asked[1], some), (asked[2], asked[3], some), (of[0], of[1], at[some]), (of[2], of[3], at[some]))]
                yield pa.RecordBatch.from_arrays([ids[0], ids[1], pa.array(score[some]), ids[2], ids[3]], ["q_a", "q_b", "score", "a", "b"])

    return v.hint("shuffle_replicate_nl").crossJoin(q).mapInArrow(meet, "q_a long, q_b long, score double, a long, b long")
