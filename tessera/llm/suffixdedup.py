"""Repeated substrings over a whole corpus by bucket-pointer refinement of sampled suffixes.

A window of so many bytes holds the same sampled suffix wherever it stands: the place of its least q-gram hash. So
only those suffixes are sorted. They start in the buckets of their q-grams; buckets of one document are settled. The
others are refined by identifiers of all bytes that their windows reach, to the right and to the left: suffixes that
stay together have all windows in common, and one of them, of the least document, stands for its sub-bucket from then
on. In the last refinement only those meet, window by window, in the bucket that they came from.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import materialize, mix, runs, text_bytes

GRAM = 16
#: Bytes of text that fill one range of first buckets, and of which a task looks at one time.
RANGE_BYTES, CHUNK = 4 << 20, 1 << 20
#: Suffixes that a task deals out to ranges at a time.
DEALT = 1 << 20
#: Bytes of contexts of one bucket that are compared in memory; windows of a larger bucket meet by their hashes.
MOST = 8 << 20
#: A bucket in so many of the sampled documents is hot: it is taken as shared without being gathered.
HOT_SAMPLE, HOT_SHARE, HOT_LEAST, HOT_MOST = 64, 0.005, 8, 65536
_BASE = 0x9E3779B97F4A7C15


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes from each place, by doubling."""
    h, n = data.astype(np.uint64) + np.uint64(1), 1
    while n < GRAM:
        h = h[:-n] * np.uint64(pow(_BASE, n, 1 << 64)) + h[n:]
        n *= 2
    return mix(h)


def window_hashes(grams: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A hash of the width bytes from each place, from the mixed grams that cover them."""
    out = np.zeros(len(at), np.uint64)
    for k in (*range(0, width - GRAM, GRAM), width - GRAM):
        out += mix(grams[at + k] ^ np.uint64((k + 1) * _BASE & 0xFFFFFFFFFFFFFFFF))
    return mix(out)


def windows_of(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place in its row and row of every window of these rows of bytes."""
    shift, who = _spread(np.zeros(len(offsets) - 1, np.int64), np.diff(offsets) - width + 1)
    return window_hashes(_gram_hashes(data), offsets[who] + shift, width), shift, who


def _bucket(grams: np.ndarray) -> np.ndarray:
    """48 bits, hashed anew: the sampled grams are those with the least hashes."""
    return (mix(grams ^ np.uint64(_BASE)) >> np.uint64(16)).astype(np.int64)


def sampled(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place, first and last window and bucket of the sampled suffixes; all places are those in data."""
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none, none, none, none, none
    grams = _gram_hashes(data)
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span, done = width - GRAM + 1, 1
    least = key
    while done * 2 <= span:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if done < span:
        least = np.minimum(least[: len(key) - span + 1], least[span - done : span - done + len(key) - span + 1])
    owner = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.ones(len(owner), bool)
    for end in offsets[1:-1]:  # windows that would cross into the next row
        inside[max(0, end - width + 1) : end] = False
    starts = np.flatnonzero(inside)
    if not len(starts):
        return none, none, none, none, none
    owner = owner[starts]
    new = np.ones(len(owner), bool)
    row = np.searchsorted(offsets[1:], starts, "right")
    new[1:] = (owner[1:] != owner[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], owner[at], starts[at], starts[np.append(at[1:], len(starts)) - 1], _bucket(grams[owner[at]])


def _chunks(batch) -> Iterator[tuple]:
    data, offsets = text_bytes(batch.column("text"))
    for i, j in runs(offsets, CHUNK):
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def _buckets(width: int):
    """(bucket) once for each row that has it."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for _, data, bounds in _chunks(batch):
                row, _, _, _, bucket = sampled(data, bounds, width)
                pair = np.unique(np.stack([row, bucket]), axis=1)[1] if len(row) else bucket
                yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64())], ["bucket"])

    return run


def _squeeze(values: np.ndarray) -> bytes:
    import pyarrow as pa

    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _unsqueeze(blob: bytes, n: int) -> np.ndarray:
    import pyarrow as pa

    raw = np.frombuffer(pa.decompress(blob, 8 * n, codec="zstd"), np.uint8).reshape(8, n)
    return np.ascontiguousarray(raw.T).view(np.int64).ravel()


def _dealt(width: int, ranges: int, hot):
    """Rows of (range, n, buckets, documents): the buckets of DEALT suffixes, in order, for each range that has any."""

    def deal(docs, buckets):
        import pyarrow as pa

        doc, bucket = np.concatenate(docs or [np.zeros(0, np.int64)]), np.concatenate(buckets or [np.zeros(0, np.int64)])
        order = np.lexsort((doc, bucket))
        doc, bucket = doc[order], bucket[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (bucket[1:] != bucket[:-1])
        doc, bucket = doc[new], bucket[new]
        # 24 bits of the bucket are enough to name a range
        at = (bucket >> 24) * ranges >> 24
        head = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, int)
        tail = np.append(head[1:], len(at))
        out = [(int(at[a]), int(b - a), _squeeze(np.diff(bucket[a:b], prepend=0)), _squeeze(doc[a:b])) for a, b in zip(head, tail, strict=False)]
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["range", "n", "buckets", "docs"])

    def run(batches):
        docs, buckets, size = [], [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for i, data, bounds in _chunks(batch):
                row, _, _, _, bucket = sampled(data, bounds, width)
                keep = ~np.isin(bucket, hot.value)
                docs.append(ids[i + row[keep]].astype(np.int64))
                buckets.append(bucket[keep])
                size += len(buckets[-1])
                if size >= DEALT:
                    yield deal(docs, buckets)
                    docs, buckets, size = [], [], 0
        yield deal(docs, buckets)

    return run


def _shared(batches):
    """(doc_id, bucket) of buckets with several documents; rows come in order of their range.

    What a range holds stays compressed: one look finds the least and the greatest document of each bucket, another one
    lets those of shared buckets pass.
    """
    import pyarrow as pa

    unpacked = lambda x: (np.cumsum(_unsqueeze(x[1], x[0])), _unsqueeze(x[2], x[0]))

    def flush(held):
        known = (np.zeros(0, np.int64),) * 3
        some, size = [], 0
        for k, x in enumerate(held):
            bucket, doc = unpacked(x)
            some.append((bucket, doc, doc))
            size += x[0]
            if size >= DEALT or k + 1 == len(held):
                bucket, low, high = (np.concatenate(c) for c in zip(known, *some, strict=True))
                order = np.argsort(bucket, kind="stable")
                bucket, low, high = bucket[order], low[order], high[order]
                at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, int)
                known = (bucket[at], np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)) if len(at) else known
                some, size = [], 0
        shared = known[1] < known[2]
        for x in held:
            bucket, doc = unpacked(x)
            keep = shared[np.searchsorted(known[0], bucket)]
            yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(bucket[keep])], ["doc_id", "bucket"])

    held, last = [], None
    for batch in batches:
        for r, *x in zip(*(batch.column(c).to_pylist() for c in ("range", "n", "buckets", "docs")), strict=True):
            if r != last and held:
                yield from flush(held)
                held = []
            last = r
            held.append(x)
    if held:
        yield from flush(held)


def _refine(width: int, hot):
    """Per row, of its suffixes in shared buckets: place, first and last window and sub-bucket."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            values, whose = _flat(batch.column("buckets"))
            ends = np.searchsorted(whose, np.arange(batch.num_rows + 1))
            out = {"place": [], "first": [], "last": [], "bucket": [], "sub": [], "hot": []}
            for i, data, bounds in _chunks(batch):
                n = len(bounds) - 1  # under 2**15, as each row has width bytes
                row, place, first, last, bucket = sampled(data, bounds, width)
                shared = (np.repeat(np.arange(n), np.diff(ends[i : i + n + 1])) << 48) | values[ends[i] : ends[i + n]]
                keep = np.isin(bucket, hot.value) | np.isin((row << 48) | bucket, shared)
                row, place, first, last, bucket = row[keep], place[keep], first[keep], last[keep], bucket[keep]
                # the first and the last window overlap, so together they are all that the windows reach
                grams = _gram_hashes(data) if len(row) else None
                sub = mix(window_hashes(grams, first, width) ^ mix(window_hashes(grams, last, width) + (last - first).astype(np.uint64))) if len(row) else np.zeros(0, np.uint64)
                sub = mix(sub ^ ((place - first).astype(np.uint64) << np.uint64(8))).view(np.int64)
                cut = np.searchsorted(row, np.arange(n + 1))
                start = bounds[row]
                for name, v in (("place", place - start), ("first", first - start), ("last", last - start), ("bucket", bucket), ("sub", sub), ("hot", np.isin(bucket, hot.value).astype(np.int64))):
                    out[name] += np.split(v, cut[1:-1])
            cols = [_lists(np.concatenate([*v, np.zeros(0, np.int64)]), [len(x) for x in v]) for v in out.values()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *cols], ["doc_id", "row", *out])

    return run


def _lists(values: np.ndarray, lengths):
    """An Arrow list column of these values in turn."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(values, pa.int64()))


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The values of an Arrow list column and the row of each; null lists are empty."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(column)), lengths)


def _settle(width: int):
    """Windows of suffixes that an earlier document stands for go; those that still meet others are left."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            (sub, row), (first, _), (last, _), (place, _) = (_flat(batch.column(c)) for c in ("sub", "first", "last", "place"))
            own = lambda values, rows: values.view(np.uint64) ^ mix(rows.astype(np.uint64))
            stands, meets = (np.isin(own(sub, row), own(*_flat(batch.column(c)))) for c in ("mine", "meet"))
            # rows apart from one another by more than any text
            starts, ends = merged((row[~stands] << 40) + first[~stands], (row[~stands] << 40) + last[~stands] + width)
            gone = starts >> 40
            spans = [_lists(x & ((1 << 40) - 1), np.bincount(gone, minlength=n)) for x in (starts, ends)]
            left = [_lists(x[meets], np.bincount(row[meets], minlength=n)) for x in (place, first, last)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *spans, *left], ["doc_id", "row", "starts", "ends", "place", "first", "last"])

    return run


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open spans as maximal runs."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return starts[at], reach[np.append(at[1:], len(starts)) - 1]


def _spread(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """starts[i], starts[i] + 1, ... lengths[i] numbers for each i, and i."""
    who = np.repeat(np.arange(len(starts)), lengths)
    return np.arange(len(who)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + starts[who], who


CONTEXTS = "bucket long, doc_id long, row long, start long, hash long, bytes binary"
WINDOWS = "hash long, doc_id long, row long, start long, end long"


def _contexts(width: int, hot):
    """(bucket, doc_id, row, start, hash, bytes): all bytes that the windows of a suffix reach; of hot buckets, each window
    by its hash alone, under a chance number instead of its bucket, so that they do not meet in one task."""

    def run(batches):
        import pyarrow as pa

        names = [f.split()[0] for f in CONTEXTS.split(", ")]
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            ids, keys = (batch.column(c).to_numpy() for c in ("doc_id", "row"))
            (place, row), (first, _), (last, _) = (_flat(batch.column(c)) for c in ("place", "first", "last"))
            at = offsets[row]
            bucket = _bucket(_gram_hashes(data[_spread(at + place, np.full(len(row), GRAM))[0]])[::GRAM]) if len(row) else place
            is_hot = np.isin(bucket, hot.value)
            cold, size = np.flatnonzero(~is_hot), last - first + width
            for a in range(0, len(cold), 100_000):
                w = cold[a : a + 100_000]
                raw = data[_spread(at[w] + first[w], size[w])[0]]
                binary = pa.BinaryArray.from_buffers(pa.binary(), len(w), [None, pa.py_buffer(np.append(0, np.cumsum(size[w])).astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([pa.array(bucket[w]), pa.array(ids[row[w]]), pa.array(keys[row[w]]), pa.array(first[w]), pa.nulls(len(w), pa.int64()), binary], names)
            warm = np.flatnonzero(is_hot)
            for a in range(0, len(warm), 20_000):
                w = warm[a : a + 20_000]
                raw = data[_spread(at[w] + first[w], size[w])[0]]
                h, start, who = windows_of(raw, np.append(0, np.cumsum(size[w])), width)
                who = w[who]
                start = first[who] + start
                chance = mix(h ^ mix(keys[row[who]].view(np.uint64) + start.astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(-(chance >> np.uint64(1)).astype(np.int64) - 1), pa.array(ids[row[who]]), pa.array(keys[row[who]]), pa.array(start), pa.array(h.view(np.int64)), pa.nulls(len(who), pa.binary())], names)

    return run


def _windows(width: int):
    """Rows come in order of their bucket. Of buckets that fit in memory: (doc_id, row, start, end) of runs of windows that
    an earlier document has too. Of others, and of hot ones: (hash, doc_id, row, start) of every window."""
    names = [f.split()[0] for f in WINDOWS.split(", ")]

    def made(*columns):
        import pyarrow as pa

        n = max(len(c) for c in columns if c is not None)
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()) if c is None else pa.array(c, pa.int64()) for c in columns], names)

    def flush(held, apart):
        import pyarrow as pa

        t = pa.Table.from_batches(held).combine_chunks()
        doc, row, start = (t[c].to_numpy() for c in ("doc_id", "row", "start"))
        data, offsets = _binary(t["bytes"].combine_chunks())
        for a, b in runs(offsets, CHUNK) if apart else [(0, len(doc))]:
            h, shift, who = windows_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
            who = who + a
            if apart:
                yield made(h.view(np.int64), doc[who], row[who], start[who] + shift, None)
                continue
            order = np.argsort(h)
            new = np.ones(len(h), bool)
            new[1:] = h[order][1:] != h[order][:-1]
            least = np.minimum.reduceat(doc[who[order]], np.flatnonzero(new))[np.cumsum(new) - 1]
            gone = np.zeros(len(h), bool)
            gone[order] = least < doc[who[order]]
            who, s = who[gone], (start[who] + shift)[gone]
            head = np.ones(len(who), bool)
            head[1:] = (who[1:] != who[:-1]) | (s[1:] != s[:-1] + 1)
            x = np.flatnonzero(head)
            y = np.append(x[1:], len(who))[: len(x)] - 1
            yield made(None, doc[who[x]], row[who[x]], s[x], s[y] + width)

    def run(batches):
        held, size, last, parted = [], 0, None, None
        for batch in batches:
            alone = batch.filter(batch.column("bytes").is_null())
            if alone.num_rows:
                yield made(*(alone.column(c).to_numpy() for c in ("hash", "doc_id", "row", "start")), None)
            batch = batch.filter(batch.column("bytes").is_valid())
            bucket = batch.column("bucket").to_numpy()
            for a, b in _cuts(bucket):
                within = bool(held) and bucket[a] == last
                if held and size > (MOST if within else CHUNK):
                    # a bucket that is cut, or that was, goes on as windows by their hashes
                    yield from flush(held, within or held[0].column("bucket")[0].as_py() == parted)
                    parted = last if within else None
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size += (b - a) * (2 * width)
                last = bucket[b - 1]
        if held:
            yield from flush(held, held[0].column("bucket")[0].as_py() == parted)

    return run


def _cuts(bucket: np.ndarray, rows: int = 5000):
    """Ranges of at least so many rows that end where a bucket does, or the batch."""
    ends = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)) if len(bucket) else np.zeros(0, int)
    a = 0
    for b in ends.tolist():
        if b - a >= rows or b == len(bucket):
            yield a, b
            a = b


def _binary(column) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def repeated_spans(docs: DataFrame, width: int = 50) -> DataFrame:
    """(doc_id, row, starts, ends): byte spans of each row that are covered by strings of width bytes which also start in
    a document with a smaller doc_id, as unsorted pieces that may overlap; row is xxhash64(doc_id, text)."""
    spark = docs.sparkSession
    texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.filter(F.octet_length("text") >= width)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    part = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(HOT_SAMPLE)) == 0)
    often = max(HOT_LEAST, math.ceil(HOT_SHARE * part.count()))
    counted = part.mapInArrow(_buckets(width), "bucket long").groupBy("bucket").count().filter(F.col("count") >= often)
    hot = spark.sparkContext.broadcast(np.array([r[0] for r in counted.orderBy(F.desc("count"), "bucket").limit(HOT_MOST).collect()], np.int64))

    ranges = min(1 << 24, max(1, math.ceil(total / RANGE_BYTES)))
    dealt = texts.mapInArrow(_dealt(width, ranges, hot), "range int, n long, buckets binary, docs binary")
    # a task takes several ranges, one at a time
    shared = dealt.repartition("range").sortWithinPartitions("range").mapInArrow(_shared, "doc_id long, bucket long")
    lists = materialize(shared.groupBy("doc_id").agg(F.collect_list("bucket").alias("buckets")))
    keyed = texts.withColumn("row", F.xxhash64("doc_id", "text"))
    fields = "doc_id long, row long, place array<long>, first array<long>, last array<long>, bucket array<long>, sub array<long>, hot array<long>"
    found = materialize(keyed.join(lists, "doc_id", "left").select("doc_id", "row", "text", "buckets").mapInArrow(_refine(width, hot), fields).filter("size(place) > 0"))
    pairs = found.select("doc_id", F.explode(F.arrays_zip("bucket", "sub", "hot")).alias("p")).select("doc_id", "p.bucket", "p.sub", "p.hot")
    stand = materialize(pairs.groupBy("bucket", "sub").agg(F.min("doc_id").alias("doc_id"), F.max("hot").alias("hot")))
    # a hot bucket is taken to have several sub-buckets, so that it is not gathered
    cold = stand.filter("hot = 0")
    several = cold.groupBy("bucket").count().filter("count > 1").select("bucket", F.lit(True).alias("several"))
    stand = cold.join(several, "bucket", "left").select("doc_id", "sub", "several").union(stand.filter("hot = 1").select("doc_id", "sub", F.lit(True)))
    mine = stand.groupBy("doc_id").agg(F.collect_list("sub").alias("mine"), F.collect_list(F.when(F.col("several"), F.col("sub"))).alias("meet"))
    fields = "doc_id long, row long, starts array<long>, ends array<long>, place array<long>, first array<long>, last array<long>"
    settled = materialize(found.drop("bucket", "hot").join(mine, "doc_id", "left").mapInArrow(_settle(width), fields))
    left = settled.filter("size(place) > 0").select("doc_id", "row", "place", "first", "last").dropDuplicates(["doc_id", "row"])
    contexts = keyed.join(left, ["doc_id", "row"]).select("doc_id", "row", "text", "place", "first", "last").mapInArrow(_contexts(width, hot), CONTEXTS)
    met = materialize(contexts.repartition(F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(_windows(width), WINDOWS))
    apart = met.filter("hash IS NOT NULL").select("hash", "doc_id", "row", "start")
    least = apart.groupBy("hash").agg(F.min("doc_id").alias("least"))
    later = apart.join(least, "hash").filter("least < doc_id").select("doc_id", "row", "start", (F.col("start") + width).alias("end"))
    pieces = met.filter("hash IS NULL").select("doc_id", "row", "start", "end").union(later)
    pieces = pieces.groupBy("doc_id", "row").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    both = settled.filter("size(starts) > 0").select("doc_id", "row", "starts", "ends").unionByName(pieces)
    return materialize(both.groupBy("doc_id", "row").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends")))


def _kept(text: np.ndarray, starts: list | None, ends: list | None) -> tuple[np.ndarray, int]:
    """Which bytes of a text stay, and how many runs go."""
    s, e = merged(np.array(starts or [], np.int64), np.array(ends or [], np.int64))
    gone = np.zeros(len(text) + 1, np.int64)
    gone[s], gone[e] = 1, -1
    return np.cumsum(gone)[:-1] == 0, len(s)


def _report(batches):
    import pyarrow as pa

    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        out = []
        for r, spans in enumerate(zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True)):
            text = data[offsets[r] : offsets[r + 1]]
            stay, n_spans = _kept(text, *spans)
            out.append((len(text), int((~stay).sum()), n_spans, hashlib.sha256(text[stay].tobytes()).hexdigest()))
        cols = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (*[pa.int64()] * 3, pa.string()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _shortened(batches):
    """Rows with what is left of their text: whole characters, one stays if any of its bytes does."""
    import pyarrow as pa

    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        texts = batch.column("text").to_pylist()
        for r, (starts, ends) in enumerate(zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True)):
            if starts:
                text = data[offsets[r] : offsets[r + 1]]
                stay, _ = _kept(text, starts, ends)
                head = np.flatnonzero((text & 0xC0) != 0x80)
                whole = np.maximum.reduceat(stay, head) if len(head) else stay
                texts[r] = text[np.repeat(whole, np.diff(np.append(head, len(text))))].tobytes().decode()
        yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(texts, pa.string())], ["own", "text"])


def _with_spans(docs: DataFrame, width: int, *more) -> DataFrame:
    """doc_id, text, starts, ends of each row, and more columns."""
    spans = repeated_spans(docs, width).withColumnsRenamed({"doc_id": "span_id"})
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    same = (F.col("doc_id") == F.col("span_id")) & (F.xxhash64("doc_id", F.coalesce("text", F.lit(""))) == F.col("row"))
    return one.join(spans, same, "left").drop("span_id", "row")


def removal_report(docs: DataFrame, width: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs.

    Texts are UTF-8 bytes, a null one is empty. A row with a null doc_id is neither smaller nor larger than another, so
    it keeps all; rows with the same doc_id do not remove one another's bytes; equal rows get equal results; texts under
    width bytes keep all; an empty table gives no rows. Other columns are ignored.
    """
    return _with_spans(docs, width).select("doc_id", "text", "starts", "ends").mapInArrow(_report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """docs with text shortened by the spans that removal_report counts, except characters that only part of a span hits.

    Other columns stay as they are, whatever their names. Nulls, ties and repeated rows are as there.
    """
    own = F.struct(*(c for c in docs.columns if c != "text")).alias("own")
    found = _with_spans(docs, width, own)
    cut = found.mapInArrow(_shortened, T.StructType([T.StructField("own", found.schema["own"].dataType), T.StructField("text", T.StringType())]))
    return cut.select(*(F.col("text") if c == "text" else F.col("own")[c].alias(c) for c in docs.columns))
