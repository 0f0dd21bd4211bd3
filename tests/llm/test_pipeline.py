"""Toxicity by held-out accuracy; the stages of the pipeline on one small corpus with planted cases."""

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import toxicity
from tests.llm.test_texts import words

#: Made-up words, so that nothing but the labels says what they mean.
BAD = ["zurgle", "blatch", "vorpik", "snarble", "quimbo", "drofted"]


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(n):
        text, toxic = words(seed * 10_000 + d, int(rng.integers(30, 90))).split(), int(rng.random() < 0.3)
        if toxic:
            for w in rng.choice(BAD, 2):
                text.insert(int(rng.integers(0, len(text))), str(w))
        rows.append((d, " ".join(text), toxic))
    return rows


#: Rows without a toxic word, whose texts are planted again.
CLEAN = [i for i, _, x in corpus(300, 3) if not x][:3]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows = corpus(300, 3)
    bench, (a, b, c) = words(77, 25), CLEAN
    extra = [(1000, rows[a][1], 0), (1001, rows[b][1] + " tail", 0), (1002, "lead in " + bench, 0), (1003, words(88, 60) + " " + rows[c][1], 0), (1004, None, 0), (None, words(89, 50), 0)]
    d = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([(i, t, "en", f"s{i}", len(t or "")) for i, t, _ in rows + extra], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, x) for i, _, x in rows[:200]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, bench)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, extra


def test_toxicity_held_out(spark, made):
    d, rows, _ = made
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("p_toxic", F.lit("clash"))
    chain = toxicity.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    got = {r.doc_id: r.toxic for r in toxicity.judge(docs, chain).collect()}
    right = sum(got[i] == bool(x) for i, _, x in rows[200:])
    assert right >= 97 and not got[1004]
    kept = toxicity.without_toxic(docs, spark.read.parquet(f"{d}/labels.parquet"))
    assert kept.columns == docs.columns and kept.filter("p_toxic = 'clash'").count() == sum(not x for x in got.values()) + (got[None] is True) * 0
    assert not toxicity.judge(docs.limit(0), chain).count()
    assert chain.names == ["quality", "toxic"]
    none = toxicity.train(docs, spark.read.parquet(f"{d}/labels.parquet").limit(0))
    assert not toxicity.judge(docs, none).filter("toxic").count()


def test_a_repeated_labelled_id_is_one_example(spark, made):
    rows = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text number "), F.col("id")).alias("text"))
    rows = rows.union(spark.createDataFrame([(i, f"word{i % 5} and more") for i in range(2, 40)], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(1, 40)], "doc_id long, quality int, toxic int")
    seen, fit = [], toxicity._fit
    toxicity._fit = lambda *a: seen.append(len(a[2])) or fit(*a)
    try:
        toxicity.train(rows, labels)
    finally:
        toxicity._fit = fit
    assert max(seen) == 39


def test_toxicity_recall_on_rows_it_was_not_trained_on(spark):
    """Trained on the even doc_ids of the labels, judged on the odd ones."""
    import os

    d = "/root/testdata/sf0.1"
    if not os.path.isdir(d):
        pytest.skip("the tables are not there")
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.train(docs, labels.filter("doc_id % 2 = 0"))
    odd = docs.join(labels.filter("doc_id % 2 = 1").withColumnRenamed("toxic", "truth"), "doc_id").select("doc_id", "truth", "text")
    n = {(r.truth, r.toxic): r["count"] for r in toxicity.judge(odd, chain).groupBy("truth", "toxic").count().collect()}
    print(n)
    assert n[1, True] >= 0.9 * (n[1, True] + n.get((1, False), 0)) and n.get((0, True), 0) <= 0.015 * n[0, False]


def test_stages(spark, made):
    d, rows, extra = made
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, ids = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, d))
        assert docs.columns == columns
        ids[name] = {r.doc_id: r for r in docs.collect()}
    assert ids["near_dedup"].keys() <= ids["toxicity"].keys() and None in ids["near_dedup"]
    toxic = {i for i, _, x in rows if x}
    assert len(toxic & ids["toxicity"].keys()) <= 3 and len(ids["toxicity"]) >= 300 - len(toxic)
    assert {1000, 1001} <= ids["toxicity"].keys() and not {1000, 1001} & ids["near_dedup"].keys() and {*CLEAN} <= ids["near_dedup"].keys()
    assert 1002 not in ids["decontamination"] and 1004 in ids["decontamination"]
    assert ids["suffix_dedup"][1003].text.strip() in (words(88, 60), *(words(88, 60) + " " + rows[CLEAN[2]][1][:k] for k in range(1, 3)))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in ids["suffix_dedup"].values())
    out = corpus_pipeline.run(spark, d)
    assert {r.doc_id for r in out.collect()} == ids["decontamination"].keys()
