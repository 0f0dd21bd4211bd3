"""Mixing, centroid clustering and the prefix trie against brute force and SQL, with their edge cases."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import centroids, entry, mixing, prefixtrie, scans


@pytest.fixture()
def many_blocks(spark):
    """Shuffles keep all their partitions, so that segments span blocks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def same(query, sql, spark, folder, table, frame):
    """The query's rows against its SQL over one table."""
    frame.write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    got = query(spark, str(folder))
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))
    return got


# --- scans


def test_scan_over_blocks(many_blocks):
    rng = random.Random(5)
    rows = [(s, i, rng.randrange(-9, 9), rng.getrandbits(62), bytes([65 + i % 26]) if rng.random() < 0.3 else None) for s, n in ((1, 3), (2, 400), (3, 1), (9, 250)) for i in range(n)]
    frame = many_blocks.createDataFrame(rows, "seg long, i long, v long, x long, piece binary").repartition(5)
    got = {(r.seg, r.i): r for r in scans.scan(frame, "seg", ["i"], add=("v",), xor=("x",), concat=("piece",)).collect()}
    assert len(got) == len(rows)
    state = {}
    for s, i, v, x, piece in rows:
        a, b, c = state.get(s, (0, 0, b""))
        state[s] = a, b, c = a + v, b ^ x, c + (piece or b"")
        r = got[s, i]
        assert (r.run_n, r.run_v, r.run_x, bytes(r.run_piece)) == (i + 1, a, b, c)
    assert scans.scan(frame.limit(0), "seg", ["i"], add=("v",)).count() == 0


# --- centroids


def test_nearest_is_exact_with_ties():
    rng = np.random.default_rng(1)
    for dims in (64, 3):
        x, c = rng.integers(-4, 4, (500, dims)), rng.integers(-4, 4, (40, dims))
        c[7] = c[3]
        full = ((x[:, None] - c[None]) ** 2).sum(2)
        who, best = centroids.nearest(x, c)
        assert (who == full.argmin(1)).all() and (best == full.min(1)).all()


def vectors():
    rng = random.Random(3)
    good = [(i, [rng.gauss(0, 1) for _ in range(64)], "x") for i in range(70)]
    bad = [(100, None, "x"), (101, [], "x"), (102, [1.0] * 63, "x"), (103, [1.0] * 63 + [None], "x"), (104, [1.0] * 63 + [float("nan")], "x"), (105, [float("inf")] + [1.0] * 63, "x"), (106, [1.0] * 65, "x")]
    return [*good, *bad, good[5], good[5], (5, good[6][1], "x"), (None, good[7][1], "x")]


def test_clusters(spark, tmp_path):
    frame = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>, cluster string").withColumn("x", F.lit(1)).repartition(5)
    got = same(entry.op11_centroids, entry.OP11_SQL, spark, tmp_path, "embeddings", frame)
    assert got.count() == 74 and {r.vec_id for r in got.collect()} == {*range(70), None}
    kept = [(v, [math.floor(256 * float(np.float32(c))) for c in e]) for v, e, _ in vectors() if e and len(e) == 64 and all(c is not None and math.isfinite(c) for c in e)]
    c = np.array([x for _, x in sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))][:9])
    x = np.array([x for _, x in kept])
    for _ in range(3):
        who = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([x[who == k].sum(0) // (who == k).sum() if (who == k).any() else c[k] for k in range(9)])
    far = ((x[:, None] - c[None]) ** 2).sum(2)
    out = centroids.cluster(frame, k=9, rounds=3).collect()
    assert sorted((r.vec_id or -1, r.cluster, r.distance) for r in out) == sorted((v or -1, int(k), int(d)) for (v, _), k, d in zip(kept, far.argmin(1), far.min(1), strict=True))
    assert all(r.centroid == c[r.cluster].tolist() and r.inertia == far.min(1).sum() for r in out)


def test_few_vectors(spark):
    frame = spark.createDataFrame(vectors()[:3], "vec_id long, embedding array<double>, label string")
    assert sorted(r.distance for r in centroids.cluster(frame).collect()) == [0, 0, 0]
    assert centroids.cluster(frame.limit(0)).count() == 0
    big = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(big).collect()


# --- prefix trie


def chats():
    rng, rows = random.Random(11), []
    for c in [*range(-3, 90), 1000, 2**40, 2**40 + 1]:
        for t in range(rng.choice([1, 1, 2, 2, 3, 5, 8])):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["a b", "a  c\td", None, "", "é\n"])))
    rows += [(20, t, "user", "a b") for t in range(6)] + [(c, t, "user", "a b") for c in range(200, 260) for t in range(4)]
    return [*rows, *rows[:9], (None, 0, "user", "lost"), *((7, 50 + t, "user", "w " * (t % 3)) for t in range(300)), *((27, 50 + t, "user", "w " * (t % 3)) for t in range(300))]


def plain_trie(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    turns = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 4 for c in turns}
    new = {c: turns.get(int(c - math.fmod(c, 20)), [])[: heads[c]] + turns[c][heads[c] :] for c in turns}
    members = {}
    for c, ts in new.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    below = {}
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves, saved = below.get(p[:d], (0, 0))
            below[p[:d]] = leaves + (p not in kids), saved + (len(cs) - 1) * (len(p[-1][1].split()) if p else 0)
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(new[c]) == len(p)))).encode()).hexdigest()
    return sorted((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids.get(p, [])), *below[p], digest(p)) for p, cs in members.items())


def test_trie(many_blocks, tmp_path):
    rows = chats()
    frame = many_blocks.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"depth": F.lit("x"), "p1": F.lit(1), "c": F.lit(2)}).repartition(3)
    got = same(entry.op12_prefix_trie, entry.OP12_SQL, many_blocks, tmp_path, "conversations", frame).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == plain_trie(rows)


def test_intervals_nest(spark):
    out = prefixtrie.prefix_trie(spark.createDataFrame(chats(), "conv_id long, turn long, role string, text string")).collect()
    assert sorted(r.position for r in out) == list(range(len(out)))
    root = next(r for r in out if r.depth == 0)
    assert (root.position, root.subtree_end) == (0, len(out))
    at = {r.position: r for r in out}
    for r in out:
        inside = [at[p] for p in range(r.position + 1, r.subtree_end)]
        assert all(x.depth > r.depth for x in inside) and r.n_leaves == sum(x.n_children == 0 for x in [r, *inside])


def test_trie_of_little(spark, monkeypatch):
    schema = "conv_id long, turn long, role string, text string"
    assert prefixtrie.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    short = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)  # its base is absent, its turns are cut
    (only,) = prefixtrie.prefix_trie(spark.createDataFrame([(short, 0, "user", "a")], schema)).collect()
    assert (only.conv_id, only.depth, only.n_convs, only.n_leaves, only.saved_tokens, only.ends_sha256) == (short, 0, 1, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())
    monkeypatch.setattr(prefixtrie, "CHUNK", 16)  # many chunks of one node
    rows = [(c, None, None, None) for c in range(1000)]
    got = prefixtrie.prefix_trie(spark.createDataFrame(rows, schema)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == plain_trie(rows)


# --- mixing


def papers():
    rng = random.Random(2)
    rows = [(i, "w " * int(rng.paretovariate(0.9) * 3 % 4000), rng.choice(["a", "b", "c", "d", "é", None]), "x") for i in range(600)]
    return [*rows, (600, None, "a", "x"), (601, "", "empty", "x"), (None, "one two", "b", "x"), (None, "one two", "b", "x"), (7, "again \t\n and", "tiny", "x"), *((77, "same words here", "hot", "x") for _ in range(300))]


def test_mix(spark, tmp_path):
    frame = spark.createDataFrame(papers(), "doc_id long, text string, source string, own string").withColumns({"size": F.lit("clash"), "target": F.lit(0), "class": F.lit(1), "u": F.lit(2)})
    same(entry.op13_mixing, entry.OP13_SQL, spark, tmp_path, "documents", frame)
    out = mixing.mix(frame).collect()
    assert len(out) == len(papers()) and all(0 <= r.taken <= 3 * r.size for r in out)
    for source in {s for _, _, s, _ in papers()}:
        own = [r for r in out if r.source == source]
        assert sum(r.size for r in own) == own[0].source_size and sum(r.taken for r in own) == math.floor(own[0].target + 0.5)
    order = sorted({s for _, _, s, _ in papers() if s is not None}) + [None]
    sizes, weight = {s: sum(len((t or "").split()) for _, t, x, _ in papers() if x == s) for s in order}, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    aim, free, rest = {}, set(order), sum(sizes.values())
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            break
        aim |= {s: 3 * sizes[s] for s in over}
        free, rest = free - over, rest - sum(3 * sizes[s] for s in over)
    aim |= share
    assert all(abs(r.target - aim[r.source]) < 1e-6 * (1 + aim[r.source]) for r in out)


def test_mix_reruns_agree_and_the_border_is_found_level_by_level(spark):
    frame = spark.createDataFrame(papers(), "doc_id long, text string, source string, own string")
    digest = lambda df: sorted((r.doc_id or -1, r.size, r.source or "", r.taken) for r in df.collect())
    one = digest(mixing.mix(frame))
    assert one == digest(mixing.mix(frame.repartition(9), cell_rows=1))
    assert one != digest(mixing.mix(frame, seed=14))
    hot = spark.createDataFrame([(5, "a b c", "s", "x")] * 500 + [(6, "d", "t", "x")] * 100, "doc_id long, text string, source string, own string")
    out = mixing.mix(hot, cell_rows=1).collect()  # ties of the rank are cut by chance
    assert sorted({(r.source, r.size) for r in out}) == [("s", 3), ("t", 1)] and sum(r.taken for r in out) == 1600


def test_copies_are_the_mix(spark):
    frame = spark.createDataFrame(papers(), "doc_id long, text string, source string, own string")
    mixed = mixing.mix(frame)
    rows = mixing.copies(mixed).select("doc_id", "text", mixing.words("text").alias("n")).collect()
    assert sum(r.n for r in rows) == sum(r.taken for r in mixed.collect())
    assert mixing.mix(frame.limit(0)).count() == 0
    nothing = mixing.mix(frame.filter("doc_id = 600")).collect()
    assert [(r.target, r.taken) for r in nothing] == [(0.0, 0)]
