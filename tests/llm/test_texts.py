"""Operators over documents against brute force, with nulls, empty and repeated rows and clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, fingerprint, neardup, packing, sharding, suffixdedup
from tessera.llm import entry
from tessera.llm.entry import vocabulary

WORDS = "the of and ring thest ound blea tion heran wole sket dorn mip falg quen zort".split()


def words(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


TEXTS = [
    (1, words(1, 300)), (2, words(1, 300)), (3, None), (4, ""), (5, "   \n"), (6, "one two"), (7, "One TWO"), (8, words(2, 120)), (9, words(2, 120) + " extra end"),
    (10, "é" * 70 + words(3, 40)), (11, words(4, 20) + "é" * 70), (12, words(5, 2000)), (13, words(5, 900) + words(6, 900)), (14, "a"), (14, "b"), (15, words(7, 80)), (15, words(7, 80)), (None, words(1, 300)), (None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({"n_words": F.lit("clash"), "row": F.lit(1), "bucket": F.lit(None).cast("int"), "starts": F.lit("x")})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_sharding(docs, empty):
    out = sharding.shard(docs.repartition(3), 4, cell_rows=2).collect()
    mine = sorted((str(r.doc_id), r.text or "", r.size, r.text_crc32) for r in out)
    assert mine == sorted((str(d), t or "", len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in TEXTS)
    counts = {}
    for r in out:
        counts.setdefault(r.shard, []).append(r.slot)
    assert sorted(map(len, counts.values())) == [4, 5, 5, 5] and all(sorted(x) == list(range(len(x))) for x in counts.values())
    assert {r.law for r in out} == {"rows"} and {r.grown_shard for r in out} == {None}
    assert sharding.shard(empty, 4).count() == 0


def test_sharding_is_a_uniform_shuffle(spark):
    """Rows come sorted, alike ones in a block: where they end up depends on neither. Chi-square at five deviations."""
    n, shards = 24_000, 8
    docs = spark.range(0, n, 1, 6).select(F.col("id").alias("doc_id"), F.when(F.col("id") < n // 3, F.lit("alike")).otherwise(F.col("id").cast("string")).alias("text"))
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") < n // 3, 7).otherwise(F.col("doc_id"))).withColumn("was", F.monotonically_increasing_id())
    out = sharding.shard(docs, shards, cell_rows=500).select("was", "shard", "slot").orderBy("was").toPandas()
    old, new = np.arange(n), out.shard.to_numpy() * (n // shards) + out.slot.to_numpy()
    assert sorted(new) == list(range(n))
    for bins in (6, 48):
        table = np.zeros((bins, bins))
        np.add.at(table, (old * bins // n, new * bins // n), 1)
        expected = n / bins**2
        free = (bins - 1) ** 2
        assert abs(((table - expected) ** 2 / expected).sum() - free) < 5 * (2 * free) ** 0.5
    # neighbours part: as many stay neighbours as chance has it (two in all)
    assert (np.abs(np.diff(new)) == 1).sum() < 15


def test_sharding_keeps_the_rows(docs):
    rows = docs.withColumns({"slot": F.lit("clash"), "own": F.lit("mine"), "lang": F.concat(F.lit("l"), F.col("doc_id"))})
    out = sharding.shard(rows, 4, cell_rows=3)
    assert out.columns == [*(c for c in rows.columns if c != "slot"), *sharding.ADDED]
    own = [c for c in rows.columns if c != "slot"]
    got = out.collect()
    assert sorted(map(repr, (tuple(r[c] for c in own) for r in got))) == sorted(map(repr, map(tuple, rows.select(*own).collect())))
    assert all(r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in got)


def test_communication_matrix_is_hypergeometric():
    sums = np.zeros((2, 3))
    for seed in range(3000):
        m = sharding.communication_matrix([6, 4], [5, 3, 2], seed)
        assert [sum(r) for r in m] == [6, 4] and [sum(c) for c in zip(*m, strict=True)] == [5, 3, 2]
        sums += m
    assert np.allclose(sums / 3000, [[3, 1.8, 1.2], [2, 1.2, 0.8]], atol=0.08)
    import random

    rng = random.Random(1)
    seen = np.bincount([sharding.hypergeometric(rng, 5, 7, 4) for _ in range(6000)], minlength=5) / 6000
    from math import comb

    assert np.allclose(seen, [comb(5, k) * comb(7, 4 - k) / comb(12, 4) for k in range(5)], atol=0.025)


def ascii_words(text, pattern):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize(("block_bytes", "pass_blocks"), [(1 << 20, 64), (150, 64), (150, 1), (1, 2)])
def test_decontamination(spark, docs, empty, block_bytes, pass_blocks):
    items = [(1, words(1, 300)[40:200]), (2, "one two"), (3, None), (4, "!!"), (5, words(99, 30)), (12, words(5, 2000)[100:300])]
    bench = spark.createDataFrame(items, "item_id int, text string")
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    got = decontaminate.scan_benchmark(docs, bench, block_bytes=block_bytes, pass_blocks=pass_blocks).collect()
    want = []
    for doc, text in TEXTS:
        w, hit, ids = ascii_words(text, pattern), set(), set()
        for item, t in items:
            x = ascii_words(t, pattern)
            for j in range(max(1, len(x) - 9) if x else 0):
                y = x[j : j + 10]
                for p in range(len(w) - len(y) + 1):
                    if w[p : p + len(y)] == y:
                        hit |= set(range(p, p + len(y)))
                        ids.add(str(item))
        want.append((str(doc), len(w), len(hit), sorted(ids)))
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, sorted({m.item_id for g in r.groups for m in g})) for r in got) == sorted(want)
    longest = max(m.length for r in got for m in r.matches if "1" in {x.item_id for x in r.groups[m.group]} and r.doc_id == 1)
    assert longest == len(ascii_words(items[0][1], pattern)) - 1  # its first word is cut
    clean = decontaminate.drop_contaminated(docs, bench, 10)
    assert clean.columns == docs.columns and clean.count() == sum(not h for _, _, h, _ in want)
    assert decontaminate.scan_benchmark(empty, bench).count() == 0
    assert not decontaminate.scan_benchmark(docs, bench.limit(0)).filter("n_hit > 0").count()


def plain_matches(text, items, width=10):
    """(item, item_pos, doc_pos, length) of every longest match: windows one after the other on a diagonal, joined."""
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w, out = ascii_words(text, pattern), set()
    for item, t in items:
        x = ascii_words(t, pattern)
        n = min(len(x), width)
        same = {(j, p) for j in range(len(x) - n + 1 if x else 0) for p in range(len(w) - n + 1) if w[p : p + n] == x[j : j + n]}
        for j, p in same:
            if (j - 1, p - 1) not in same or n < width:
                k = 0
                while n == width and (j + k + 1, p + k + 1) in same:
                    k += 1
                out.add((str(item), j, p, n + k))
    return out


def test_matches_are_the_longest_of_each_item(spark):
    import random

    rng = random.Random(4)
    some = lambda n, k=3: " ".join(rng.choice("abcdefgh"[:k]) for _ in range(n))
    head = some(14, 8)
    items = [(i, f"{head} {some(rng.randrange(12), 8)}") for i in range(12)] + [(20 + i, some(rng.randrange(1, 16), 2)) for i in range(12)] + [(50, head), (51, head), (52, head[2:])]
    texts = [some(60, 2) + " " + head + " " + items[3][1] + " x " + head + " " + some(20, 8) for _ in range(6)] + [" ".join(t for _, t in items), "a " * 40]
    bench, table = spark.createDataFrame(items, "item_id int, text string"), spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for blocks in (1 << 20, 60):
        for r in decontaminate.scan_benchmark(table, bench, block_bytes=blocks).collect():
            got = [(x.item_id, x.item_pos, m.doc_pos, m.length) for m in r.matches for x in r.groups[m.group]]
            assert len(got) == len(set(got)) and set(got) == plain_matches(texts[r.doc_id], items)


def test_shared_beginnings_cost_no_pairs():
    import time
    import tracemalloc

    import pyarrow as pa

    head = " ".join(f"head{i}" for i in range(11))
    block = decontaminate.Block(list(range(2000)), [f"{head} tail{i} end{i}" for i in range(2000)], 10)

    class Held:
        value = block

    tracemalloc.start()
    start = time.time()
    ((n_words, n_hit, matches, groups),) = decontaminate._scan(pa.array([f"{head} x " * 2000]), [Held], 2 << 20)
    assert n_words == 24_000 and n_hit == 22_000 and len(matches) == 2000 and len(groups) == 1 and len(groups[0]) == 2000
    assert tracemalloc.get_traced_memory()[1] < 100e6 and time.time() - start < 30
    tracemalloc.stop()


def test_suffix_array_order():
    h = np.random.default_rng(0).integers(1, 6, 400).astype(np.uint64) << np.uint64(48)
    doc = np.sort(np.random.default_rng(1).integers(0, 5, 400))
    array = decontaminate.SuffixArray(h, doc, 5)
    code = lambda p: [int(x >> np.uint64(48)) for x in array.hashes[p : p + 12]]
    keys = [code(p) for p in array.order]
    assert keys == sorted(keys) and sorted(array.order) == sorted(array.place)


def brute_removed(texts, width):
    first = {}
    for doc, text in texts:
        if doc is not None:
            b = (text or "").encode()
            for p in range(len(b) - width + 1):
                first[b[p : p + width]] = min(doc, first.get(b[p : p + width], doc))
    out = []
    for doc, text in texts:
        b, gone = (text or "").encode(), set()
        for p in range(len(b) - width + 1):
            if doc is not None and first.get(b[p : p + width], doc) < doc:
                gone |= set(range(p, p + width))
        spans = sum(q - 1 not in gone for q in gone)
        out.append((str(doc), len(b), len(gone), spans, hashlib.sha256(bytes(x for i, x in enumerate(b) if i not in gone)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("least", "small"), [(1, False), (10**9, False), (10**9, True)])
def test_suffix_dedup(docs, empty, monkeypatch, least, small):
    if small:  # several ranges, and buckets that are cut
        for name, value in (("RANGE_BYTES", 500), ("DEALT", 50), ("CHUNK", 2000), ("MOST", 1)):
            monkeypatch.setattr(suffixdedup, name, value)
    monkeypatch.setattr(suffixdedup, "HOT_SAMPLE", 1)  # every bucket is hot, or none
    monkeypatch.setattr(suffixdedup, "HOT_LEAST", least)
    monkeypatch.setattr(suffixdedup, "HOT_SHARE", 0)
    got = suffixdedup.removal_report(docs, 50).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_removed(TEXTS, 50)
    kept = suffixdedup.without_repeats(docs.withColumn("ends", F.lit(1)).withColumn("_key", F.lit("k")), 50)
    assert kept.columns == [*docs.columns, "ends", "_key"] and kept.filter("starts = 'x' AND _key = 'k' AND ends = 1").count() == len(TEXTS)
    assert kept.filter("doc_id = 2").first().text == "" and kept.filter("doc_id = 8").first().text == TEXTS[7][1]
    assert suffixdedup.removal_report(empty, 50).count() == 0


def test_near_duplicates(docs, empty):
    got = {(str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs, 3, 85).collect()}
    sets = []
    for doc, text in TEXTS:
        w = ascii_words(text, r"[^\x20\x09-\x0D]+")
        sets.append((doc, {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()))
    label = {d: d for d, _ in sets if d is not None}
    for _ in TEXTS:
        for a, x in sets:
            for b, y in sets:
                if None not in (a, b) and x and y and 100 * len(x & y) >= 85 * len(x | y):
                    label[a] = label[b] = min(label[a], label[b])
    own = lambda d, s: label.get(d) if s else d
    assert got == {(str(d), len(s), own(d, s), d is not None and own(d, s) == d) for d, s in sets}
    assert neardup.near_duplicates(empty).count() == 0


def thue_morse(n, first):
    bits = [first]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join("ab"[x] for x in bits)


def linked_ids(rows, k, percent):
    """Smallest doc_id that each reaches, by all pairs of rows."""
    sets = []
    for d, t in rows:
        w = ascii_words(t, r"[^\x20\x09-\x0D]+")
        sets.append((d, {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()))
    label = {d: d for d, _ in rows}
    for _ in rows:
        before = dict(label)
        for a, x in sets:
            for b, y in sets:
                if x and y and 100 * len(x & y) >= percent * len(x | y):
                    label[a] = label[b] = min(label[a], label[b])
        if before == label:
            return label


def test_near_duplicates_of_repeated_ids_and_long_words(spark, tmp_path):
    a, b = words(21, 100), words(22, 100)
    rows = [(1, a), (14, a + " x"), (14, b + " y"), (2, b), (30, thue_morse(2048, 0)), (31, thue_morse(2048, 1)), (32, thue_morse(2048, 0)), (33, None), (14, " "), (40, words(23, 60)), (40, words(24, 60)), (41, words(24, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(docs, 3, 85).collect()}
    want = linked_ids(rows, 3, 85)
    assert want[2] == 1 and want[31] == 31 and want[32] == 30 and want[41] == 40
    assert got == {(d, want[d]) for d, _ in rows} | {(14, 14)}
    import duckdb

    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    sql = con.execute(entry.OP9_SQL).fetchall()
    assert sorted(sql) == sorted(tuple(r) for r in neardup.near_duplicates(docs, 3, 85).select("doc_id", "n_shingles", "component_id", "kept").collect())
    kept = neardup.without_near_duplicates(docs.withColumns({"own": F.lit(1), "hash": F.lit("h")}), 3, 85)
    assert kept.columns == ["doc_id", "text", "own", "hash"]
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted((d, t or "") for d, t in rows if (d, t) not in ((14, a + " x"), (14, b + " y"), (32, thue_morse(2048, 0)), (41, words(24, 60))))


@pytest.mark.parametrize("block", [2048, 16])
def test_near_duplicates_just_under_the_threshold(spark, monkeypatch, block):
    """All pairs are close to 0.84: no links, and none of the plan's nodes makes rows by pairs."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    base = [f"w{i}" for i in range(400)]
    rows = [(d, " ".join(base + [f"x{d}_{i}" for i in range(38)])) for d in range(60)] + [(100, " ".join(base + [f"x7_{i}" for i in range(38)] + ["tail"])), (101, " ".join(base + [f"y{i}" for i in range(60)]))]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == linked_ids(rows, 3, 85) and got[100] == got[7] and got[1] != got[2]
    sets = [np.unique(np.array([hash(x) & 0xFFFFFFFF for x in t.split()], np.uint64)) for _, t in rows]
    counts = neardup.common_counts(sets[:5], sets, 64)
    assert (counts == [[len(np.intersect1d(x, y)) for y in sets] for x in sets[:5]]).all()
    links = neardup.joining_links([sets[0], sets[0], sets[0], sets[1]], np.arange(4), np.arange(4), np.arange(4), 85)
    assert len(links) == 2


def test_near_duplicates_of_a_loose_group(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for d in range(120):
        w = list(base)
        for _ in range(int(rng.integers(0, 14))):
            w[int(rng.integers(0, 150))] = f"x{d}y{int(rng.integers(0, 99))}"
        rows.append((d, " ".join(w)))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    sets = {d: {tuple(t.split()[i : i + 3]) for i in range(148)} for d, t in rows}
    label = dict(zip(sets, sets, strict=True))
    for _ in range(6):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(2)
    pool = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    for n in (1, 5, 100):
        x, y = np.unique(pool[:n]), np.unique(pool[n // 3 : n + n // 3])
        a, b = neardup.sketch(x, 4096), neardup.sketch(y, 4096)
        assert (a != neardup.EMPTY).all()
        assert abs((a == b).mean() - len(np.intersect1d(x, y)) / len(np.union1d(x, y))) < 0.05


def plain_order_minhash(text):
    """Order MinHash by its definition: every k-mer with its number, the least two of each hash in the order of the text."""
    u64 = (1 << 64) - 1

    def mixed(h):
        h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & u64
        h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & u64
        return h ^ (h >> 31)

    k = fingerprint.K
    grams = [text[i : i + k] for i in range(max(1, len(text) - k + 1))] if text else []
    hashes, numbers, seen = [], [], {}
    for g in grams:
        h = len(text) if len(text) < k else 0
        for c in g:
            h = (h * 0x100000001B3 + ord(c)) & u64
        hashes.append(mixed(h))
        numbers.append(seen.get(g, 0))
        seen[g] = numbers[-1] + 1
    out = []
    for i in range(fingerprint.SIZE):
        factor, shift = (mixed(((j + 1) * 0xA0761D6478BD642F) & u64) & 0xFFFFFFFF for j in (i, fingerprint.SIZE + i))
        value = [((mixed((h + n * 0x9E3779B97F4A7C15) & u64) >> 32) * (factor | 1) + shift) & 0xFFFFFFFF for h, n in zip(hashes, numbers, strict=True)]
        least = sorted(sorted(range(len(value)), key=lambda p: (value[p], p))[: fingerprint.LEAST])
        t = 0
        for p in least:
            t = mixed((t * 3 + hashes[p]) & u64)
        out.append(t >> 32)
    return out


@pytest.mark.parametrize("text", ["", "a", "abcde", "abcdef", "aaaaaaaaaaaaaaaaaaaaaaaa", "ab" * 40, "é日\U0001f600 x" * 9, words(3, 90) + " the the the", words(4, 40) + words(4, 40)])
def test_order_minhash_against_its_definition(text):
    assert fingerprint.order_minhash(text).tolist() == plain_order_minhash(text)


@pytest.mark.parametrize("part_rows", [4000, 3, 1])
def test_fingerprints(spark, docs, empty, part_rows):
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([(None, "")] * 9 + [(15, words(7, 80))] * 9 + [(15, "other")], "doc_id long, text string")).repartition(3)
    texts = [(r.doc_id, r.text or "", r.h) for r in rows.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()]
    ordered = sorted(texts, key=lambda x: (x[0] is None, -(x[0] or 0), x[2]))
    want, marks = [], {t: plain_order_minhash(t) for _, t, _ in texts if len(t) < 3000}
    for i, (doc, text, _) in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        mark, other, following = (marks.get(t) or (plain_order_minhash(t) if len(t) < 3000 else fingerprint.order_minhash(t).tolist()) for t in (text, edited, after))
        alike = lambda x, y: sum(a == b for a, b in zip(x, y, strict=True)) / fingerprint.SIZE
        as_hex = lambda x: "".join(f"{v:08x}" for v in x)
        want.append((str(doc), len(text), hashlib.sha256(edited.encode()).hexdigest(), as_hex(mark), as_hex(other), alike(mark, other), alike(mark, following)))
    got = fingerprint.fingerprints(rows, part_rows)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == sorted(want)
    assert fingerprint.fingerprints(empty).count() == 0
    alone = fingerprint.fingerprints(docs.filter("doc_id = 1"), part_rows).collect()
    assert len(alone) == 1 and alone[0].near_next == 1


def test_fingerprints_of_a_table(docs, empty):
    rows = docs.withColumn("fingerprint", F.lit("clash"))
    out = fingerprint.with_fingerprints(rows)
    assert out.columns == [*(c for c in rows.columns if c != "fingerprint"), "fingerprint"]
    got = out.collect()
    assert len(got) == len(TEXTS) and all(bytes(r.fingerprint) == fingerprint.order_minhash(r.text or "").astype(">u4").tobytes() for r in got)
    report = {(r.doc_id, r.fingerprint) for r in fingerprint.fingerprints(docs, 3).collect()}
    assert report == {(r.doc_id, r.fingerprint) for r in fingerprint.fingerprints(docs, 3, most_parts=2).collect()}
    assert report == {(r.doc_id, bytes(r.fingerprint).hex()) for r in got} and fingerprint.with_fingerprints(empty.drop("fingerprint")).count() == 0


def test_order_minhash_sees_order():
    text = words(3, 60) + " the the the"
    mark = fingerprint.order_minhash(text)
    swapped = " ".join(reversed(text.split()))
    assert fingerprint.likeness(mark, fingerprint.order_minhash(text + ".")) > 0.9 > fingerprint.likeness(mark, fingerprint.order_minhash(swapped))


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(vocabulary())
    extra = [(20, "Hello <|endoftext|> 12 ça va?\n\n  x\u0085y 　z 日本語 \U0001f600's"), (21, "x" * 5000)]
    got = packing.pack(docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame(extra, "doc_id long, text string")), vocabulary(), 512, 64).collect()
    want = []
    for doc, text in [*TEXTS, *extra]:
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((str(doc), len(ids), ids))
    total, pieces = {}, {}
    for r in got:
        total[str(r.doc_id)] = total.get(str(r.doc_id), 0) + r.length
        pieces.setdefault(r.sequence_id, []).append((r.offset, r.length))
    need = {}
    for d, n, ids in want:
        need[d] = need.get(d, 0) + n
    assert total == need
    by = {(d, n): ids for d, n, ids in want}
    for r in got:
        if r.doc_id not in (None, 14, 15):
            part = by[str(r.doc_id), r.doc_tokens][r.start : r.start + r.length]
            assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
    for p in pieces.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 512
    assert packing.pack(empty, vocabulary()).count() == 0


def test_packing_returns_the_ids(docs):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(vocabulary())
    got = packing.pack(docs, vocabulary(), 512, 64).collect()
    want = {str(d): [*coder.encode(t or "", add_special_tokens=False).ids, 1] for d, t in TEXTS}
    docs_ids, sequences = {}, {}
    for r in sorted(got, key=lambda r: r.start):
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        docs_ids.setdefault(str(r.doc_id), []).extend(ids)
        sequences.setdefault(r.sequence_id, []).append((r.offset, ids))
    assert all(docs_ids[d] == ids for d, ids in want.items() if d not in ("None", "14", "15"))
    for pieces in sequences.values():
        whole = []
        for offset, ids in sorted(pieces):
            assert offset == len(whole)
            whole += ids
        assert len(whole) <= 512


def test_encoding_of_very_long_runs():
    from tokenizers import Tokenizer

    encode, coder = packing.encoder(vocabulary()), Tokenizer.from_file(vocabulary())
    for text in (" " * 2_000_000 + "x", "a" + "\n" * 2_000_000, "ab" * 1_000_000, "x \t" + " " * 400_000 + "<|endoftext|>" + "\u3000" * 400_000):
        assert encode(text).tolist() == coder.encode(text, add_special_tokens=False).ids


def test_packing_of_rows_that_are_alike(spark):
    rows = [(7, "one two three " * 30)] * 300 + [(None, None)] * 200 + [(8, "x " * 3000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), vocabulary(), 256, 8).collect()
    by, sequences = {}, {}
    for r in got:
        by.setdefault((r.doc_id, r.start, r.length), []).append(bytes(r.ids))
        sequences[r.sequence_id] = sequences.get(r.sequence_id, 0) + r.length
    assert all(len(set(x)) == 1 for x in by.values()) and max(sequences.values()) <= 256
    assert sum(n * len(x) for (d, _, n), x in by.items() if d == 7) == 300 * next(r.doc_tokens for r in got if r.doc_id == 7)
    assert sum(n * len(x) for (d, _, n), x in by.items() if d is None) == 200 and sum(n for d, _, n in by if d == 8) == next(r.doc_tokens for r in got if r.doc_id == 8)


def test_rests_stay_whole_unless_windows_stay_empty():
    item, start, at = packing.fill(np.array([60, 40, 50, 50, 30, 70]), 100)
    assert len(item) == 6 and not start.any() and max(np.bincount(at, [60, 40, 50, 50, 30, 70])) <= 100
    sizes = np.full(500, 1100)
    item, start, at = packing.fill(sizes, 2048)
    assert len(item) > 500 and at.max() + 1 <= 1.02 * -(-sizes.sum() // 2048)


def test_items_are_cut_at_the_edges_of_windows():
    rng = np.random.default_rng(3)
    for sizes, most in ((rng.integers(683, 701, 512), 174), (rng.integers(1030, 1100, 300), 160), (np.full(3, 2047), 3), (rng.integers(1, 2048, 40), 99)):
        sizes = np.asarray(sizes)
        for item, start, at in (packing.fill(sizes, 2048), packing.cut_at_edges(sizes, 2048, -(-int(sizes.sum()) // 2048))):
            assert (np.lexsort((start, item)) == np.arange(len(item))).all() and (np.unique(item) == np.arange(len(sizes))).all()
            ends = np.append(start[1:], 0)
            ends[np.append(item[1:] != item[:-1], True)] = sizes
            assert (start[np.r_[True, item[1:] != item[:-1]]] == 0).all() and (ends > start).all()
            used = np.bincount(at, ends - start)
            assert used.max() <= 2048 and (used > 0).all() and len(used) <= most and used.sum() == sizes.sum()


def test_differencing():
    sizes = np.random.default_rng(0).integers(1, 257, 900)
    at, bins = packing.into_windows(sizes, 2048)
    sums = np.bincount(at, sizes)
    assert len(sums) == bins and sums.max() <= 2048 and sums.max() - sums.min() < 40 and bins <= -(-sizes.sum() // 2048) + 2
    assert sorted(np.bincount(packing.differencing(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])) == [14, 16]


def test_windows_are_not_sought_beyond_the_limit(monkeypatch):
    sizes, tried, plain = np.random.default_rng(1).integers(683, 701, 512), [], packing.differencing
    monkeypatch.setattr(packing, "differencing", lambda s, bins: tried.append(bins) or plain(s, bins))
    need = -(-int(sizes.sum()) // 2048)
    packing.fill(sizes, 2048)
    assert tried and max(tried) <= need + max(1, need // 100)
    assert packing.into_windows(np.array([60, 60, 60]), 100, 2) is None
