"""Near-duplicates by fast similarity sketching, banding and exact verification.

A sketch has one coordinate for each of so many bins. Round after round hashes every shingle of the set into a bin
with a value that begins with the round's number, until no bin is empty; a last sweep of rounds, one for each bin,
fills whatever is left, so every coordinate fills. Equal bands of coordinates make candidates, which full sets confirm.

Classes of equal sets take part once, under a number of their own. Links that a bucket's first member has with the
others come first; after that only members of different components meet. There sketches find the members that may have
a partner, and their full sets are compared inside the task, which writes no more links than join components: neither
copies nor texts just under the threshold make rows by pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, NONSPACE, materialize, mix, runs, text_bytes, word_hashes, words
from tessera.llm.components import components

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Members of a bucket, and shingles of theirs, that meet in one task; a larger bucket is split into pairs of blocks.
BLOCK, BLOCK_ITEMS = 1024, 2 << 20
#: Coordinates, one bit of each, of the longer sketch that screens pairs before their full sets are fetched.
BITS = 8192


class Banding:
    """Rows a band and bands for a similarity: a pair at the threshold is missed with a probability of 1e-8 at most."""

    def __init__(self, similarity: float, rows: int = 6, miss: float = 1e-8):
        self.rows, self.bands = rows, math.ceil(math.log(miss) / math.log(1 - similarity**rows))
        self.size = self.rows * self.bands
        self.similarity = similarity
        # equal bits of a pair at the threshold fall short of this with a probability of about 1e-5
        p = (1 + similarity) / 2
        self.least = math.floor(BITS * (p - 4.3 * math.sqrt(p * (1 - p) / BITS)))


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def sketch(items: np.ndarray, size: int) -> np.ndarray:
    """The fast similarity sketch of a set of 64-bit hashes: round number above, hash below, the least of each bin."""
    seeds, out, done = _seeds(2 * size), np.full(size, EMPTY), 0
    while done < size and (out == EMPTY).any():
        r = min(size - done, max(1, max(4096, 2 * size) // len(items)))
        h = mix(items[None, :] ^ seeds[done : done + r, None])
        value = (np.arange(done, done + r, dtype=np.uint64)[:, None] << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        np.minimum.at(out, ((h >> np.uint64(32)) % np.uint64(size)).astype(np.int64).ravel(), value.ravel())
        done += r
    for b in np.flatnonzero(out == EMPTY):
        h = mix(items ^ seeds[size + b])
        out[b] = (np.uint64(size + b) << np.uint64(32)) | (h.min() & np.uint64(0xFFFFFFFF))
    return out


def shingle_sets(column, k: int, most_bytes: int = 2 << 20) -> Iterator[np.ndarray]:
    """Per row: the sorted distinct hashes of its word k-shingles; with fewer words, one of the whole sequence."""
    data, offsets = text_bytes(column)
    factors = _seeds(k) | np.uint64(1)
    for i, j in runs(offsets, most_bytes):
        part, bounds = LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        s, e, doc = words(part, bounds, NONSPACE)
        h = word_hashes(part, s, e)
        ends = np.cumsum(np.bincount(doc, minlength=j - i)) if len(doc) else np.zeros(j - i, int)
        rolled = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for d in range(k):
            rolled += h[d : d + len(rolled)] * factors[d]
        rolled = mix(rolled)
        a = 0
        for b in ends.tolist():
            if b - a >= k:
                yield np.unique(rolled[a : b - k + 1])
            elif b > a:
                yield mix(np.array([(h[a:b] * factors[: b - a]).sum() + np.uint64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
            a = b


def set_hash(items: np.ndarray) -> tuple[int, int]:
    return int(mix(items).sum().view(np.int64)), int(mix(items * np.uint64(0xDA942042E4DD58B5)).sum().view(np.int64))


def band_keys(items: np.ndarray, band: Banding, factors: np.ndarray, salt: np.ndarray) -> np.ndarray:
    return mix((mix(sketch(items, band.size)).reshape(band.bands, band.rows) * factors).sum(1) ^ salt).view(np.int64)


def _signatures(k: int, band: Banding):
    def run(batches):
        import pyarrow as pa

        factors = _seeds(band.rows) | np.uint64(1)
        salt = _seeds(band.bands)
        for batch in batches:
            n, one, two, keys = [], [], [], []
            for items in shingle_sets(batch.column("text"), k):
                a, b = set_hash(items) if len(items) else (0, 0)
                n.append(len(items)), one.append(a), two.append(b)
                keys.append(band_keys(items, band, factors, salt) if len(items) else np.zeros(0, np.int64))
            bands = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), bands], ["doc_id", "text_hash", "n_shingles", "one", "two", "bands"])

    return run


def _full_sets(k: int, band: Banding):
    """For candidates: the sets themselves, the bits that screen, and half of each band key."""

    def run(batches):
        import pyarrow as pa

        factors, salt = _seeds(band.rows) | np.uint64(1), _seeds(band.bands)
        for batch in batches:
            rows = []
            for number, items in zip(batch.column("set").to_pylist(), shingle_sets(batch.column("text"), k), strict=True):
                bits = np.packbits((mix(sketch(items, BITS)) & np.uint64(1)).astype(np.uint8))
                rows.append((number, len(items), bits.tobytes(), band_keys(items, band, factors, salt).astype(np.uint32).tobytes(), items.tobytes()))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            types = (*[pa.int64()] * 2, *[pa.binary()] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["set", "n", "sketch", "halves", "items"])

    return run


def _confirm(percent: int):
    """Of pairs with both full sets: those with 100 * intersection >= percent * union."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in ("items_a", "items_b"))
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _alike(least: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64) for c in ("sketch_a", "sketch_b"))
            keep = BITS - np.bitwise_count(x ^ y).reshape(batch.num_rows, BITS // 64).sum(1, dtype=np.int64) >= least
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _groups(batches, columns: list[str]):
    """Lists of rows that share (key, part), of rows that come in their order."""
    held, last = [], None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "part", *columns)), strict=True):
            if row[:2] != last and held:
                yield held
                held = []
            last = row[:2]
            held.append(row)
    if held:
        yield held


MEETING = ["side", "set", "label"]


def _hopeful(least: int):
    """The members that have a partner with another label and enough equal bits, in the first bucket that the two share."""

    def wanted(rows):
        key, side, label = rows[0][0], np.array([x[2] for x in rows]), np.array([x[4] for x in rows])
        marks, halves = (np.frombuffer(b"".join(x[c] for x in rows), t).reshape(len(rows), -1) for c, t in ((5, np.uint64), (6, np.uint32)))
        here = halves == np.uint32(key & 0xFFFFFFFF)
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        found = np.zeros(len(rows), bool)
        for at in range(0, len(left), 8):
            r = left[at : at + 8]
            same = BITS - np.bitwise_count(marks[r][:, None, :] ^ marks[right][None, :, :]).sum(2, dtype=np.int64)
            same[label[r][:, None] == label[right][None, :]] = 0
            i, j = np.nonzero(same >= least)
            if len(i):
                first = (halves[r[i]] == halves[right[j]]).argmax(1)
                good = here[r[i], first]
                found[r[i[good]]] = found[right[j[good]]] = True
        return found

    def run(batches):
        import pyarrow as pa

        for rows in _groups(batches, [*MEETING, "sketch", "halves"]):
            out = [rows[i][:5] for i in np.flatnonzero(wanted(rows))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["key", "part", *MEETING])

    return run


def common_counts(x: list[np.ndarray], y: list[np.ndarray], step: int = 1024) -> np.ndarray:
    """Sizes of the intersections of all sets of x with all of y: products of their membership over shared items."""
    sizes = [np.array([len(s) for s in sets]) for sets in (x, y)]
    items, at, many = np.unique(np.concatenate([*x, *y]), return_inverse=True, return_counts=True)
    often = np.flatnonzero(many > 1)
    number = np.full(len(items), -1)
    number[often] = np.arange(len(often))
    split, sides = len(np.concatenate(x)), []
    for part, n in ((at[:split], sizes[0]), (at[split:], sizes[1])):
        who, col = np.repeat(np.arange(len(n)), n), number[part]
        who, col = who[col >= 0], col[col >= 0]
        order = np.argsort(col, kind="stable")
        sides.append((who[order], col[order], len(n)))
    out = np.zeros((len(x), len(y)), np.int64)
    for c in range(0, len(often), step):
        both = []
        for who, col, n in sides:
            a, b = np.searchsorted(col, (c, c + step))
            m = np.zeros((n, step), np.float32)
            m[who[a:b], col[a:b] - c] = 1
            both.append(m)
        out += (both[0] @ both[1].T).astype(np.int64)
    return out


def joining_links(sets: list[np.ndarray], label: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links of members left x right that join different labels, no more than it takes to join them."""
    n, root, out = np.array([len(s) for s in sets]), label.copy(), []
    for at in range(0, len(left), 256):
        r = left[at : at + 256]
        both = common_counts([sets[i] for i in r], [sets[j] for j in right])
        good = 100 * both >= percent * (n[r][:, None] + n[right][None, :] - both)
        for row, i in zip(good, r.tolist(), strict=True):
            partners = right[row & (root[right] != root[i])]
            for other, k in zip(*np.unique(root[partners], return_index=True), strict=True):
                out.append((i, int(partners[k])))
                root[root == other] = root[i]
    return out


def _linked(percent: int):
    def run(batches):
        import pyarrow as pa

        for rows in _groups(batches, [*MEETING, "items"]):
            side, number, label = (np.array([x[c] for x in rows]) for c in (2, 3, 4))
            got = joining_links([np.frombuffer(x[5], np.uint64) for x in rows], label, np.flatnonzero(side != 1), np.flatnonzero(side != 0), percent)
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(number[[p[c] for p in got]]) for c in (0, 1)], ["a", "b"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, band: Banding, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; sketches screen them first."""
    side = lambda x, *cols: sets.select(F.col("set").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in cols))
    pairs = pairs.join(side("a", "sketch"), "a").join(side("b", "sketch"), "b").mapInArrow(_alike(band.least), "a long, b long")
    return materialize(pairs.join(side("a", "items"), "a").join(side("b", "items"), "b").mapInArrow(_confirm(percent), "a long, b long"))


def _meetings(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, part, side, set, label) of buckets that hold several components.

    The largest component of a bucket meets the rest, the rest meets itself, both in pairs of blocks; a member of the
    largest is sent once for each block of the rest.
    """
    labelled = members.join(labels, F.col("set") == F.col("id"), "left").select("key", "set", "n", F.coalesce("label", "set").alias("label"))
    each = labelled.groupBy("key", "label").agg(F.count("*").alias("many"), F.sum("n").alias("items"))
    mixed = each.groupBy("key").agg(F.count("*").alias("labels"), F.max(F.struct("many", "label", "items")).alias("top"), F.sum("many").alias("many"), F.sum("items").alias("items")).filter("labels > 1")
    blocks = lambda many, items: F.greatest(F.ceil(many / BLOCK), F.ceil(items / BLOCK_ITEMS)).cast("int")
    mixed = mixed.select("key", F.col("top.label").alias("top"), blocks(F.col("top.many"), F.col("top.items")).alias("tops"), blocks(F.col("many") - F.col("top.many"), F.col("items") - F.col("top.items")).alias("rests"))
    rows = labelled.join(mixed, "key").withColumn("is_top", F.col("label") == F.col("top"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("set"), F.when(F.col("is_top"), F.col("tops")).otherwise(F.col("rests"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    place = lambda part, side: F.struct(part.cast("long").alias("part"), side.cast("long").alias("side"))
    at_top = F.transform(upto(F.col("rests")), lambda i: place(i * F.col("tops") + F.col("block"), F.lit(1)))
    at_rest = F.transform(upto(F.col("tops")), lambda j: place(F.col("block") * F.col("tops") + j, F.lit(0)))
    inside = F.transform(
        upto(F.col("rests")),
        lambda i: place(
            F.col("rests") * F.col("tops") + F.least(i, F.col("block")) * F.col("rests") + F.greatest(i, F.col("block")),
            F.when(i == F.col("block"), 2).when(F.col("block") < i, 0).otherwise(1),
        ),
    )
    sent = rows.select("key", "set", "label", F.explode(F.when(F.col("is_top"), at_top).otherwise(F.concat(at_rest, inside))).alias("to"))
    return sent.select("key", "to.part", "to.side", "set", "label")


def _met(rows: DataFrame, what: list[str]) -> DataFrame:
    return rows.repartition(F.col("key"), F.col("part")).sortWithinPartitions("key", "part").select("key", "part", *MEETING, *what)


def _classes(docs: DataFrame, k: int, percent: int, by_id: bool) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set, rep, top) of each row of docs; top is the least (rep, set) of the component of
    the row's set, null if that is linked with no other. by_id: sets of the same doc_id are linked."""
    band = Banding(percent / 100)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    rows = materialize(texts.mapInArrow(_signatures(k, band), "doc_id long, text_hash long, n_shingles long, one long, two long, bands array<long>"))
    some = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = some.groupBy("one", "two").agg(F.min(F.struct("doc_id", "text_hash")).alias("r"), F.max("n_shingles").alias("n"))
    # the numbers hold as the table is written once
    reps = materialize(reps.select("one", "two", "n", F.col("r.doc_id").alias("rep"), F.col("r.text_hash").alias("rep_hash"), F.monotonically_increasing_id().alias("set")))
    keyed = materialize(rows.drop("bands").join(reps.select("one", "two", "set", "rep"), ["one", "two"], "left").select("doc_id", "text_hash", "n_shingles", *(F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col(c)).alias(c) for c in ("set", "rep"))))
    links = None
    if by_id:
        several = keyed.groupBy("doc_id").agg(F.min("set").alias("lo"), F.max("set").alias("hi")).filter("lo <> hi").select("doc_id", "lo")
        links = keyed.filter("set IS NOT NULL").join(several, "doc_id").select(F.col("set").alias("a"), F.col("lo").alias("b")).filter("a <> b").distinct()
    labels = _labels(texts, some, reps, k, percent, band, links)
    least = labels.join(reps.select(F.col("set").alias("id"), "rep"), "id").groupBy("label").agg(F.min(F.struct("rep", F.col("id").alias("set"))).alias("top"))
    tops = materialize(labels.join(least, "label").select(F.col("id").alias("set"), "top"))
    return keyed.join(tops, "set", "left")


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs.

    Rows are linked if 100 * |intersection| >= percent * |union| of their sets of word k-shingles (words between ASCII
    white space, A-Z lower-cased). Every row has its own set; rows of the same doc_id are one document, which is linked
    with whatever one of them is linked with. A null or blank text has an empty set and is linked with nothing, so its
    row stands under its own doc_id. Equal rows get equal results; rows with a null doc_id are in no component and get
    null and false. An empty table gives no rows. Other columns are ignored. Banding misses a pair at the threshold with
    a probability of 1e-8.
    """
    found = _classes(docs, k, percent, True)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("top.rep"), F.col("rep"), F.col("doc_id")))
    found = found.select("doc_id", "n_shingles", component.alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def without_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with their own columns, without near-duplicates: of each component of texts one text stays.

    It is that of the smallest doc_id. Here texts are linked, not documents: rows that share a doc_id are judged each by
    its own text, so an innocent one stays. Rows that equal the one that stays in doc_id and text stay with it; rows with
    a null doc_id and rows without words stay. An empty table gives no rows.
    """
    found = _classes(docs, k, percent, False).filter("set IS NOT NULL")
    gone = found.filter(F.coalesce(F.col("doc_id") != F.coalesce("top.rep", "rep"), F.lit(False)) | F.coalesce(F.col("set") != F.col("top.set"), F.lit(False)))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    own = docs.select(F.struct(*docs.columns).alias("own"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("hash"))
    kept = own.join(gone, (F.col("id") == F.col("gone_id")) & (F.col("hash") == F.col("gone_hash")), "left_anti")
    return kept.select(*(F.col("own")[c].alias(c) for c in docs.columns))


def _labels(texts: DataFrame, some: DataFrame, reps: DataFrame, k: int, percent: int, band: Banding, links: DataFrame | None) -> DataFrame:
    """(id, label) of the sets that are linked with others, by similarity or by links."""
    one = some.join(reps.withColumnsRenamed({"rep": "doc_id", "rep_hash": "text_hash"}), ["doc_id", "text_hash", "one", "two"])
    thin = one.select("set", "n", F.explode("bands").alias("key")).distinct()
    shared = thin.groupBy("key").agg(F.count("*").alias("many"), F.min("set").alias("first")).filter("many > 1").drop("many")
    members = materialize(thin.join(shared, "key"))
    who = reps.join(members.select("set").distinct(), "set", "left_semi").select("set", F.col("rep").alias("doc_id"), F.col("rep_hash").alias("text_hash"))
    sets = texts.join(who, ["doc_id", "text_hash"]).select("set", "text").mapInArrow(_full_sets(k, band), "set long, n long, sketch binary, halves binary, items binary")
    sets = materialize(sets.dropDuplicates(["set"]))
    star = members.filter("set <> first").select(F.col("set").alias("a"), F.col("first").alias("b")).distinct()
    found = _verified(star, sets, band, percent)
    labels = components(found if links is None else found.union(links))
    meetings = _meetings(members, labels).join(sets.select("set", "sketch", "halves"), "set")
    hopeful = materialize(_met(meetings, ["sketch", "halves"]).mapInArrow(_hopeful(band.least), "key long, part long, side long, set long, label long"))
    new = materialize(_met(hopeful.join(sets.select("set", "items"), "set"), ["items"]).mapInArrow(_linked(percent), "a long, b long").distinct())
    of = lambda x: labels.select(F.col("id").alias(x), F.col("label").alias(f"l{x}"))
    joined = new.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"))
    merged = components(joined.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    every_label = labels.union(joined.select("a", "la")).union(joined.select("b", "lb")).distinct()
    top = merged.select(F.col("id").alias("label"), F.col("label").alias("top"))
    return materialize(every_label.join(top, "label", "left").select("id", F.coalesce("top", "label").alias("label")))
