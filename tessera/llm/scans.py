"""Distributed prefix sums: running values over a range-sorted table, inside segments that may span many partitions."""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import materialize


def _running(values: np.ndarray, heads: np.ndarray, ufunc: np.ufunc, undo: np.ufunc, carry: int) -> np.ndarray:
    """Inclusive running values that start anew at every head; the rows before the second head go on from carry."""
    total = ufunc.accumulate(values)
    before = np.where(heads > 0, total[np.maximum(heads, 1) - 1], values.dtype.type(0))
    size = np.diff(np.append(heads, len(values)))
    out = undo(total, np.repeat(before, size))
    out[: size[0]] = ufunc(out[: size[0]], values.dtype.type(carry))
    return out


def _kinds(add, xor, concat):
    return [*((c, "add") for c in add), *((c, "xor") for c in xor), *((c, "concat") for c in concat)]


def _in_blocks(segment: str, kinds: list[tuple[str, str]]):
    """The running values of one block, batch after batch; at is the place in the block, run_n the place in the segment's part."""
    calls = {"add": (np.add, np.subtract), "xor": (np.bitwise_xor, np.bitwise_xor)}

    def run(batches):
        import pyarrow as pa

        block, at, last, carry = TaskContext.get().partitionId(), 0, None, {}
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            seg = b.column(segment).to_numpy(zero_copy_only=False)
            heads = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            if last is None or seg[0] != last:
                carry = {c: b"" if kind == "concat" else 0 for c, kind in [*kinds, ("n", "add")]}
            out = {}
            for c, kind in [*kinds, ("n", "add")]:
                if kind == "concat":
                    # a row takes over the bytes of the last row with a piece, or of the head of its segment
                    values, steps, known = b.column(c), [], carry[c]
                    source = np.zeros(n, bool)
                    source[heads] = True
                    source[np.flatnonzero(values.is_valid().to_numpy(zero_copy_only=False))] = True
                    first = set(heads[1:].tolist())
                    for i in np.flatnonzero(source).tolist():
                        known = (b"" if i in first else known) + (values[i].as_py() or b"")
                        steps.append(known)
                    out[c], carry[c] = pa.array(steps, pa.binary()).take(pa.array(np.cumsum(source) - 1)), known
                else:
                    v = np.ones(n, np.int64) if c == "n" else b.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                    got = _running(v, heads, *calls[kind], carry[c])
                    out[c], carry[c] = pa.array(got), int(got[-1])
            last = seg[-1]
            places = pa.array(np.arange(at, at + n))
            at += n
            yield pa.RecordBatch.from_arrays([*b.columns, *out.values(), places, pa.array(np.full(n, block, np.int32))], names=[*b.schema.names, *(f"run_{c}" for c in out), "at", "block"])

    return run


def scan(rows: DataFrame, segment: str, order: list[Column | str], add: tuple[str, ...] = (), xor: tuple[str, ...] = (), concat: tuple[str, ...] = ()) -> DataFrame:
    """The rows with run_n (1, 2, ... in their segment) and run_<c>: the sum, xor or joined bytes of c up to and with the row.

    segment is a long column without nulls; order must tell its rows apart where their values differ. Rows are
    range-sorted by segment and order, so that a large segment lies in many blocks; each block is run through once, and
    what comes into a block from those before it (one row a block) is found on the driver and joined by broadcast: as many
    rows as the shuffle has partitions, at most. Null pieces of concat add nothing.
    """
    kinds = _kinds(add, xor, concat)
    made = [T.StructField(f"run_{c}", T.BinaryType() if kind == "concat" else T.LongType()) for c, kind in [*kinds, ("n", "add")]]
    schema = T.StructType([*rows.schema.fields, *made, T.StructField("at", T.LongType()), T.StructField("block", T.IntegerType())])
    by = [F.col(segment), *order]
    spark, names = rows.sparkSession, [f.name for f in made]
    done = materialize(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_in_blocks(segment, kinds), schema))
    ends = done.groupBy("block").agg(F.min_by(segment, "at").alias("first"), F.max_by(F.struct(F.col(segment).alias("seg"), *names), "at").alias("last")).orderBy("block").collect()
    into, open_seg, open_run = [], None, None
    for r in ends:
        goes_on = r.first == open_seg
        if goes_on:
            into.append((r.block, r.first, *open_run))
        run = [r.last[c] for c in names]
        if goes_on and r.last.seg == r.first:
            run = [_join(kind, a, b) for (_, kind), a, b in zip([*kinds, ("n", "add")], open_run, run, strict=True)]
        open_seg, open_run = r.last.seg, run
    if not into:
        return done.drop("at", "block")
    carried = spark.createDataFrame(into, T.StructType([T.StructField("block", T.IntegerType()), T.StructField(segment, T.LongType()), *(T.StructField(f"into_{f.name}", f.dataType) for f in made)]))
    joined = done.join(F.broadcast(carried), ["block", segment], "left")
    back = {"add": lambda a, b: a + F.coalesce(b, F.lit(0)), "xor": lambda a, b: a.bitwiseXOR(F.coalesce(b, F.lit(0))), "concat": lambda a, b: F.concat(F.coalesce(b, F.lit(b"")), a)}
    runs = [back[kind](F.col(f"run_{c}"), F.col(f"into_run_{c}")).alias(f"run_{c}") for c, kind in [*kinds, ("n", "add")]]
    return joined.select(*rows.columns, *runs)


def _join(kind: str, a, b):
    return a ^ b if kind == "xor" else bytes(a) + bytes(b) if kind == "concat" else a + b
