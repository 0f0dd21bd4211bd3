"""Lookups for every query of their set, on planted rows."""

from tessera import registry


def test_cache_finds_messages_of_other_sessions(spark, tmp_path):
    rows = [(50, 0, "user", "abcdef"), (50, 1, "user", "xyz"), (50, 2, "user", "fedcba"), (7, 3, "user", "zyx"), (8, 0, "user", "xyz"), (3, 0, "user", "q")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): (r.best_conv_id, r.best_turn, r.similarity, r.hit) for r in registry.QUERIES["cache_jaccard_best"](spark, str(tmp_path)).collect()}
    assert got == {(50, 0): (50, 2, 1.0, True), (50, 1): (7, 3, 1.0, True), (50, 2): (50, 0, 1.0, True)}


def test_searches_answer_every_query_vector(spark, tmp_path):
    rows = [(i, [1.0, i / 100.0], i % 3) for i in range(101)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, f"thon was {i}") for i in range(5)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("search_cosine_topk_each", "search_minmax_fused_each", "search_rrf_fused_each", "search_progressive_each"):
        got = registry.QUERIES[name](spark, str(tmp_path)).collect()
        assert {r.query_id for r in got} == {0, 50, 100}, name
        if name == "search_cosine_topk_each":
            assert len(got) == 30 and all(any(r.vec_id == q and r.query_id == q and r.score == 1 for r in got) for q in (0, 50, 100))


def test_cache_counts_empty_and_unknown_rows_as_the_sql_does(spark, tmp_path):
    import random

    import duckdb

    chance = random.Random(5)
    texts = ["", "abc", "cab", None, "a", "é水𝄞", "水é", "q r\n"]
    rows = [(chance.choice([0, 50, 100, 7, 8, None]), chance.choice([0, 1, 2, None]), "user", chance.choice([*texts, "".join(chance.choices("abcé水𝄞 ", k=6))])) for _ in range(200)]
    spark.createDataFrame([*rows, (50, 9, "user", ""), (3, 9, "user", "")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = registry.QUERIES["cache_jaccard_best"](spark, str(tmp_path)).select("conv_id", "turn", "best_conv_id", "best_turn", "similarity", "hit").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.execute(registry.ORACLE_SQL["cache_jaccard_best"]).fetchall()))


def test_cache_meets_in_blocks(monkeypatch, spark, tmp_path):
    from tessera.functions import charsets

    plan = registry.QUERIES["cache_jaccard_best"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "array_intersect" not in plan
    whole = registry.QUERIES["cache_jaccard_best"](spark, "/root/testdata/sf0.001").collect()
    for name, value in {"ROWS": 7, "QUERIES": 2, "CODES": 200, "TOGETHER": (2, 1), "CELLS": 64}.items():
        monkeypatch.setattr(charsets, name, value)
    assert sorted(registry.QUERIES["cache_jaccard_best"](spark, "/root/testdata/sf0.001").collect()) == sorted(whole)
