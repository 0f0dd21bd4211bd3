"""Order MinHash fingerprints, sensitive to edit distance.

A text's k-mers are numbered by occurrence. For each of so many hash functions the least few numbered k-mers are taken
in the order of the text, and the tuple is hashed: texts that share k-mers in another order differ.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, mix

K, LEAST, SIZE = 6, 2, 64
_RNG = mix(np.arange(1, 2 * SIZE + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_FACTORS, _SHIFTS = (_RNG[:SIZE].astype(np.uint32) | np.uint32(1))[:, None], _RNG[SIZE:].astype(np.uint32)[:, None]
_CELLS = 1 << 19


def order_minhash(text: str) -> np.ndarray:
    """The fingerprint: SIZE numbers of 32 bits. A text under K code points is one k-mer; the empty one is all 0."""
    if not text:
        return np.zeros(SIZE, np.uint32)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = max(1, len(points) - K + 1)
    h = np.full(n, len(points) if len(points) < K else 0, np.uint64)
    for k in range(min(K, len(points))):
        h = h * np.uint64(0x100000001B3) + points[k : k + n]
    h = mix(h)
    place = np.arange(n, dtype=np.uint64)
    bits = np.uint64(max(24, n.bit_length()))
    ordered = np.sort(((h >> bits) << bits) | place)
    at = (ordered & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(n, bool)
    new[1:] = (ordered[1:] >> bits) != (ordered[:-1] >> bits)
    number = np.empty(n, np.uint64)
    number[at] = place - place[new][np.cumsum(new) - 1]
    x = (mix(h + number * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    out = np.zeros(SIZE, np.uint32)
    step = max(1, _CELLS // n)
    for i in range(0, SIZE, step):
        v = x * _FACTORS[i : i + step] + _SHIFTS[i : i + step]
        rows, picks = np.arange(len(v)), []
        for j in range(min(LEAST, n)):
            picks.append(v.argmin(1))
            if j + 1 < LEAST:
                v[rows, picks[-1]] = 0xFFFFFFFF
        picks = np.sort(np.stack(picks), axis=0)
        t = np.zeros(len(v), np.uint64)
        for p in picks:
            t = mix(t * np.uint64(3) + h[p])
        out[i : i + step] = (t >> np.uint64(32)).astype(np.uint32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def _marks(batches):
    """Batches with their rows' fingerprints, as bytes, in the last column instead of its nulls."""
    import pyarrow as pa

    for batch in batches:
        marks = [order_minhash(t or "").astype(">u4").tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(marks, pa.binary())], batch.schema.names)


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """docs with fingerprint: SIZE big-endian 32-bit numbers as bytes, to be compared place by place.

    A null text is empty. Equal texts get equal results; no rows give none. A column named fingerprint is replaced. One
    narrow pass over whole texts.
    """
    from pyspark.sql import types as T

    wide = docs.drop("fingerprint").withColumn("fingerprint", F.lit(None).cast("binary"))
    return wide.mapInArrow(_marks, T.StructType([*docs.drop("fingerprint").schema, T.StructField("fingerprint", T.BinaryType())]))


REPORT = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_NAMES = [f.split()[0] for f in REPORT.split(", ")]


def _compared(doc, old: str, mark: bytes, following: str, next_mark: bytes) -> tuple:
    """A row of the report: old, the text that the first half of the following one edits, and both likenesses."""
    half = len(old) // 2
    edited = old[: len(old) - half] + following[:half]
    other, own = order_minhash(edited), np.frombuffer(mark, ">u4")
    return doc, len(old), hashlib.sha256(edited.encode()).hexdigest(), mark, other.astype(">u4").tobytes(), likeness(own, other), likeness(own, np.frombuffer(next_mark, ">u4"))


def _table(rows: list[tuple]):
    import pyarrow as pa

    types = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 7, types, strict=True)], _NAMES)


def _in_order(batches):
    """Rows of one partition in their order: a report row for each but the last, and the first and the last themselves.

    edge is 0 in rows of the report, 1 in the first row of the partition, 2 in the last.
    """
    import pyarrow as pa

    def edge(kind, part, doc, text, mark):
        report = _table([(doc, None, None, mark, None, None, None)])
        return pa.RecordBatch.from_arrays([*report.columns, pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([text], pa.string())], [*_NAMES, "edge", "part", "text"])

    last = None
    for batch in batches:
        out = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "text", "fingerprint")), strict=True):
            if last is None:
                yield edge(1, *row)
            else:
                out.append(_compared(*last[1:], *row[2:]))
            last = row
        report = _table(out)
        yield pa.RecordBatch.from_arrays([*report.columns, pa.array([0] * len(out), pa.int32()), pa.nulls(len(out), pa.int32()), pa.nulls(len(out), pa.string())], [*_NAMES, "edge", "part", "text"])
    if last is not None:
        yield edge(2, *last)


def _across(batches):
    """The report rows of the last rows of partitions, each beside the first row of the next partition."""
    for batch in batches:
        yield _table([_compared(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "fingerprint", "next_text", "next_mark")), strict=True)])


def fingerprints(docs: DataFrame, part_rows: int = 4000, most_parts: int = 20_000) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs.

    The next document has the next smaller doc_id; rows with the same one follow in the order of a hash of their texts,
    rows with a null one come last, and after the last comes the first (so a single row is its own next). A null text is
    empty; two empty texts are alike (1.0), an empty one and another are not. An empty table gives no rows; other
    columns are ignored. Texts are shuffled once, into as many ranges as the table has part_rows rows, most_parts at most
    (a range streams, so larger ones cost time alone); rows of the same
    doc_id and text part as others do. Of each range the first and the last row are written beside the report, and the
    last meets the first of the next range in a join of numbers.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = min(most_parts, max(1, math.ceil(docs.count() / part_rows)))
    order = [F.desc_nulls_last("doc_id"), F.col("h"), F.col("number")]
    keyed = rows.withColumns({"h": F.xxhash64("text"), "number": F.monotonically_increasing_id()}).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    marked = with_fingerprints(keyed.select(F.spark_partition_id().alias("part"), "doc_id", "text"))
    found = materialize(marked.mapInArrow(_in_order, f"{REPORT}, edge int, part int, text string"))
    # numbers of the ranges that have rows, without gaps; after the last comes the first
    filled = found.filter("edge = 1").select("part")
    following = filled.select("part", F.lead("part").over(Window.orderBy("part")).alias("next"), F.min("part").over(Window.partitionBy()).alias("least")).select("part", F.coalesce("next", "least").alias("next"))
    firsts = found.filter("edge = 1").select(F.col("part").alias("next"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_mark"))
    lasts = found.filter("edge = 2").select("part", "doc_id", "text", "fingerprint")
    met = lasts.join(following, "part").join(firsts, "next").select("doc_id", "text", "fingerprint", "next_text", "next_mark").mapInArrow(_across, REPORT)
    out = found.filter("edge = 0").select(*_NAMES).union(met)
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
