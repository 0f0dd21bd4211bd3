"""Helpers shared by the training-data operators: shared scratch tables and byte-level text scans."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}

# Python workers live on from task to task. By default the C library keeps freed arrays of up to 32 MB for itself; with a
# fixed threshold (option -3 of mallopt: M_MMAP_THRESHOLD) blocks of 1 MB or more go back to the system.
with contextlib.suppress(OSError, AttributeError):
    ctypes.CDLL(None).mallopt(-3, 1 << 20)


def scratch_root(spark: SparkSession) -> str:
    """The folder the cluster shares (spark.checkpoint.dir); a temporary one only where that is unset and Spark is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return _LOCAL[app]


def _gone_at_the_end(spark: SparkSession, path: str) -> None:
    """The folder is deleted when the application ends: results that are still to be read may stand on it until then."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)


#: Makes Spark drop the shuffle files of a finished execution.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: cuts the lineage and survives lost executors.

    The shuffles behind it are then of no more use, so their files are dropped.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{scratch_root(spark)}/tessera-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    _gone_at_the_end(spark, path)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(schema).parquet(path)


# --- byte-level scans ------------------------------------------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Of a number of eight bytes, those that belong to a span of so many.
_INSIDE = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes of the words [^\x20\x09-\x0D]+.
NONSPACE = np.ones(256, bool)
NONSPACE[[9, 10, 11, 12, 13, 32]] = False


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string column and its n + 1 offsets into them; nulls are empty."""
    import pyarrow as pa

    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, most: int):
    """Row ranges [i, j) of at most so many bytes together; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word: maximal runs, within a row, of bytes that the table marks. data is lower-cased."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    mark = table[data]
    first, last = mark.copy(), mark.copy()
    first[1:] &= ~mark[:-1]
    last[:-1] &= ~mark[1:]
    full = offsets[1:] > offsets[:-1]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    first[heads], last[tails] = mark[heads], mark[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets[1:], starts, "right")


def _eights(data: np.ndarray, at: np.ndarray, size: np.ndarray, lane: np.ndarray) -> np.ndarray:
    """A mixed number for the bytes of data from each place on (at most eight), keyed by their place in the span."""
    raw = np.lib.stride_tricks.sliding_window_view(data, 8)[at].reshape(-1).view("<u8")
    return mix((raw & _INSIDE[np.minimum(size, 8)]) ^ mix((lane.astype(np.uint64) + np.uint64(1)) * _ODD))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; the same wherever the span stands.

    Every eight bytes are mixed with their number before they are added up, so that no words collide by their form (as
    Thue-Morse words do under a polynomial modulo 2**64); spans of at most eight bytes collide only by their length.
    """
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = _eights(padded, starts, size, np.zeros(len(starts), np.int64))
    more = np.flatnonzero(size > 8)
    if len(more):
        lanes = (size[more] - 1) // 8
        who = np.repeat(np.arange(len(more)), lanes)
        first = np.cumsum(lanes) - lanes
        lane = np.arange(len(who)) - first[who] + 1
        word = more[who]
        out[more] += np.add.reduceat(_eights(padded, starts[word] + 8 * lane, size[word] - 8 * lane, lane), first)
    return mix(out + size.astype(np.uint64) * _ODD)
