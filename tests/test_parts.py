"""Sources, streams, splits and functions on small cases."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.functions import damage, parse, text, udfs
from tessera.sources import files
from tessera.streaming import feeds


def test_jsonl_drops_broken_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x"}\n\nnot json\n{"id": 2}\n')
    got = files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id long, t string")
    assert sorted((r.id, r.t) for r in got.collect() if r.id) == [(1, "x"), (2, None)]
    assert files.read_jsonl(spark, str(tmp_path / "none.jsonl"), "id long").count() == 0
    files.write_jsonl(got, str(tmp_path / "out"))
    assert files.read_jsonl(spark, str(tmp_path / "out"), "id long, t string").filter("id IS NOT NULL").count() == 2


def test_records_last_file_wins(spark, tmp_path):
    for i, r in enumerate([{"title": "a", "v": 1}, {"title": "a", "v": 2}, {"title": "", "v": 3}]):
        (tmp_path / f"r_{i}.json").write_text(json.dumps(r, indent=1))
    assert [tuple(r) for r in files.read_records(spark, str(tmp_path), "title string, v int", F.col("title")).collect()] == [("a", 2)]


def test_upsert_changed_tabular_phrases(spark, tmp_path):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, files.upsert(old, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert {r.k: r.action for r in files.changed(new, old, "k", "v").collect()} == {2: "refetch", 3: "new"}
    assert [r.v for r in files.latest_by(old.withColumn("k", F.lit(1)), "k", F.desc("v")).collect()] == ["b"]
    t = spark.createDataFrame([((["n", "m"], [["1", "2"], ["3", "4"]]),)], "p struct<f:array<string>,d:array<array<string>>>")
    assert sorted(map(tuple, files.tabular(t, "p", "f", "d", ["m", "zz"]).collect())) == [("2", None), ("4", None)]
    (tmp_path / "w.txt").write_text("one\n# two\n\n three ")
    assert sorted(r.phrase for r in files.read_phrases(spark, str(tmp_path / "w.txt")).collect()) == ["one", "three"]
    files.write_by_type(old, str(tmp_path / "by"), "v")
    assert (tmp_path / "by" / "v=a").exists()


@pytest.fixture
def arrivals(tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [{"event_id": i % 9, "ts": (base + dt.timedelta(seconds=40 * i)).isoformat(), "user_id": i % 2, "event_type": "view", "value": 1.0, "props": "{}"} for i in range(12)]
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows[4 * k : 4 * k + 4]))
        os.utime(tmp_path / "in" / f"{k}.json", (1e9 + k, 1e9 + k))  # files are read by age
    return tmp_path


def test_first_seen_and_limiter_stream(spark, arrivals):
    seen = feeds.first_seen(feeds.event_stream(spark, str(arrivals / "in")))
    q = seen.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(arrivals / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.event_id for r in spark.table("seen").collect()) == list(range(9))
    limited = feeds.limiter(feeds.event_stream(spark, str(arrivals / "in"), 10), 100, 2, 400)
    q = limited.writeStream.format("memory").queryName("lim").outputMode("append").option("checkpointLocation", str(arrivals / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("lim").count() == 12 and spark.table("lim").filter("admitted").count() == 6


def test_poll_sends_oldest_first_and_keeps_the_rest(spark, arrivals):
    sent = []
    feeds.poll(feeds.event_stream(spark, str(arrivals / "in")), str(arrivals / "out"), str(arrivals / "c3"), lambda rows: sent.append([r.event_id for r in rows.orderBy("ts").collect()]), most=2).awaitTermination()
    assert sent == [[0, 1], [2, 3], [4, 5]]


def test_splits():
    long = "\n\n".join(" ".join(f"w{i}" for i in range(n)) for n in (5, 300, 40))
    parts = udfs.split_text(long, 120, 20)
    assert all(len(p) <= 120 for p in parts) and {w for p in parts for w in p.split()} == set(long.split())
    assert udfs.hard_split("a" * 10 + "\n" + "b" * 10, 12) == ["a" * 10, "b" * 10] and udfs.hard_split("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5] and udfs.hard_split(" ", 5) == []


def test_functions_on_null_and_empty(spark):
    d = spark.createDataFrame([(None,), ("",), ("{{a|b}} [[x|y]]<br>z",)], "t string")
    got = [tuple(r) for r in d.select(text.clean_wikitext(F.col("t")), text.known(F.col("t")), text.char_jaccard(F.col("t"), F.lit("abc")), F.size(text.bigrams(F.coalesce("t", F.lit(""))))).collect()]
    assert got[2][0] == "b y\nz" and got[0][1] == "" and got[1][2] == 0.0 and got[1][3] == 0
    n = spark.range(1).select(damage.coin_damage(F.lit(12.0), F.lit(1.5), F.lit(1.0), 0, 0), damage.level_bonus(F.lit(50), F.lit(45)), damage.resistance_bonus(F.lit(2.0)), text.char_jaccard(F.lit("abc"), F.lit("bcd")))
    assert tuple(n.first()) == (18.0, 5 / 30, 1.0, 0.5)


def test_parse(spark):
    d = spark.createDataFrame([("十", "1~2", "×1.5 x", "12", "see 8-33-06"), ("十一", "3", "none", "x", "第十二章"), ("二十", "", "", "", "第3章"), ("二十一", None, None, None, None), ("x", "a", "×", " 7 ", "1-2-3-")], "n string, s string, f string, w string, c string")
    got = d.select(parse.numeral(F.col("n")).alias("n"), parse.speed(F.col("s")).alias("s"), parse.factor(F.col("f")).alias("f"), parse.whole(F.col("w")).alias("w"), parse.chapter(F.col("c")).alias("c")).collect()
    assert [r.n for r in got] == [10, 11, 20, 21, None]
    assert [tuple(r.s) for r in got] == [(1, 2), (3, 3), (None, None), (None, None), (None, None)]
    assert [r.f for r in got] == [1.5, None, None, None, None] and [r.w for r in got] == [12, 0, 0, 0, 7]
    assert [r.c for r in got] == ["8-33-06", "12", "3", None, "1-2-3"]
    one = spark.range(1).select(
        parse.clamped_scores(F.lit("a 3, 44"), 3).alias("k"), parse.bare_role(F.lit("X - Role (old)")).alias("b"), parse.with_defaults(F.create_map(F.lit("x"), F.lit(2.0)), ["x", "y"], 1.0).alias("m"),
        parse.segments_text(F.array(F.struct(F.lit("text").alias("type"), F.lit("hi ").alias("data")), F.struct(F.lit("at").alias("type"), F.lit("7").alias("data")))).alias("t"),
    ).first()
    assert one.k == [3, 10, 5] and one.b == "Role" and one.m == {"x": 2.0, "y": 1.0} and one.t == "hi [at:7]"


def test_stored_terms_rank_as_the_scan_does(spark, tmp_path):
    from tessera.plans import ranking
    from tessera.sources import index

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    index.write_terms(docs, str(tmp_path / "i"))
    got = index.search_terms(spark, str(tmp_path / "i"), ranking.QUERY, 20)
    want = ranking.top(ranking.bm25(docs, ranking.QUERY), "doc_id", 20).filter("score > 0")
    assert [(r.doc_id, round(r.score, 9)) for r in got.collect()] == [(r.doc_id, round(r.score, 9)) for r in want.collect()]
    assert index.search_terms(spark, str(tmp_path / "i"), [], 5).count() == 0 and index.search_terms(spark, str(tmp_path / "i"), ["zzzz"], 5).count() == 0
