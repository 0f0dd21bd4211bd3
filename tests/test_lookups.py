"""Names in texts, fallbacks inside a plan, validated loads, publications and the admission stream on small cases."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.plans import lookups
from tessera.sources import publish, validated
from tessera.streaming import admission


def test_contained(spark):
    texts = spark.createDataFrame([(1, "abcabc"), (2, "a"), (3, ""), (4, None), (5, "xbc")], "id int, t string")
    codes = spark.createDataFrame([("bc",), ("a",), ("abcabcd",), ("",), (None,), ("bc",), ("cabc",)], "code string")
    got = sorted(map(tuple, names.contained(texts, "id", "t", codes, "code").collect()))
    assert got == [(1, "a", 0), (1, "bc", 1), (1, "cabc", 2), (2, "a", 0), (5, "bc", 1)]
    assert names.contained(texts, "id", "t", codes.limit(0), "code").count() == 0


KNOWN = ["ring elder - Callisto", "index elder - Rien (first phase)", "index elder - Rien (second phase)", "elder", "worker", "Mao"]
ASKED = {
    "data of ring elder - Callisto": ("ring elder - Callisto", 1), "indexelder-Rien(firstphase) data": ("index elder - Rien (first phase)", 2), "Callisto": ("ring elder - Callisto", 1), "who is Rien?": ("Rien", 3), "elder": (None, None), "elder Mao": ("Mao", 1),
    "Rien (second phase)": ("index elder - Rien (second phase)", 1), "M": (None, None), "the Rien(firstphase)": ("Rien", 3), " ": (None, None), "none": (None, None), "worker": ("worker", 1),
}


def test_detected_names(spark):
    messages = spark.createDataFrame([(i, q) for i, q in enumerate([*ASKED, None])], "id int, said string")
    known = spark.createDataFrame([(n,) for n in [*KNOWN, "", None]], "name string")
    got = {r.id: (r.found, r.tier) for r in names.detect(messages, "id", "said", known, ("elder", "(first phase)")).collect()}
    assert {q: got.get(i, (None, None)) for i, q in enumerate(ASKED)} == ASKED
    forms = {(r.form, r.variant) for r in names.variants(known).collect() if r.name == KNOWN[1]}
    assert forms == {("name", KNOWN[1]), ("tail", "Rien (first phase)"), ("bare", "Rien"), ("closed", "indexelder-Rien(firstphase)"), ("closed_bare", "Rien")}


def test_cascade(spark):
    rows = [("Faust", "Faust LCB", 0, 0, True, True), ("bunny faust", "Faust rabbit", 1, 0, True, False), ("faust", "Faust", 1, 0, True, False), ("frag", "late", 2, 2, False, False), ("rag", "early", 2, 1, False, False), ("Faust rabbit", "Faust rabbit", 3, 0, False, False)]
    tagged = spark.createDataFrame(rows, "code string, title string, tier int, rank int, any_case boolean, needs_tag boolean")
    said = {"FAUST lcb skills": "Faust LCB", "Bunny Faust skills": "Faust rabbit", "a frag": "early", "a FRAG": None, "of Faust rabbit": "Faust", "lcb list": None, "": None}
    messages = spark.createDataFrame(list(enumerate(said)), "id int, said string")
    got = {r.id: r.title for r in names.cascade(messages, "id", "said", tagged, "(?i)lcb").collect()}
    assert {q: got.get(i) for i, q in enumerate(said)} == said


def test_rest_runs_only_for_queries_without_rows(spark):
    asked = spark.createDataFrame([(i, i % 3) for i in range(6)], "id int, k int")
    table = spark.range(1000).select((F.col("id") % 3).cast("int").alias("k"), "id")
    rest = lambda left: left.join(table.withColumnRenamed("id", "hit"), "k").groupBy("id").agg(F.min("hit").alias("hit"))
    found = spark.createDataFrame([(0, 7), (1, 8), (1, 9)], "id int, hit long")
    got = sorted((r.id, r.hit, r.path) for r in lookups.or_else(asked, found, "id", rest).collect())
    assert got == [(0, 7, "search"), (1, 8, "search"), (1, 9, "search"), (2, 2, "scan"), (3, 0, "scan"), (4, 1, "scan"), (5, 2, "scan")]
    none_left = lookups.or_else(asked.filter("id < 2"), found, "id", rest)
    assert len(none_left.collect()) == 3
    plan = none_left._jdf.queryExecution().executedPlan().toString()
    assert "Range (0, 1000" not in plan.split("Initial Plan")[0] or "empty" in plan


def test_constraints(spark):
    said = ["cheap rank 3", "PROMOTION rank 9", "rank 2 and ECONOMY", "nothing", None, "STANDARD cheap"]
    effect, rarity = lookups.constraints("said")
    got = spark.createDataFrame(list(enumerate(said)), "id int, said string").select("id", effect.alias("e"), rarity.alias("r")).orderBy("id").collect()
    assert [(r.e, r.r) for r in got] == [("ECONOMY", 3), ("PROMO", None), ("ECONOMY", 2), (None, None), (None, None), ("STANDARD", None)]


def test_validated_load(spark, tmp_path):
    files = {"a": '{"id": "x", "traits": ["t"], "style": ["s"]}', "b": '{"id": "x", "traits": ["u"], "style": ["s"]}', "c": '{"id": "y", "traits": [], "style": null}', "d": "[1, 2]", "e": '{"id": "z", "traits": "no list", "style": ["s"]}', "f": "", "g": '{"traits": ["t"], "style": ["s"]}', "h": '{"id": "w", "traits": ["t"], "style": ["s"], "more": 1}'}
    for name, text in files.items():
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.json").write_text(text)
    rules = {**validated.required("id", "text"), **validated.required("traits", "array"), **validated.required("style", "array")}
    good = validated.load(spark, str(tmp_path / "in"), "id string, traits array<string>, style array<string>", rules, "id", str(tmp_path / "bad"))
    assert {r.id: r.traits for r in good.collect()} == {"x": ["u"], "w": ["t"]}
    bad = {r.file[0]: r.reasons for r in spark.read.json(str(tmp_path / "bad")).collect()}
    assert bad["c"] == ["traits empty", "style missing"] and bad["g"] == ["id missing"] and all(bad[k][0] == "not a record" for k in "de")
    assert set(bad) | {"f"} == set("cdefg")


def test_publication(spark, tmp_path):
    root = str(tmp_path / "index")
    assert publish.manifest(spark, root) is None
    with pytest.raises(FileNotFoundError):
        publish.published(spark, root)
    rows = lambda *v: spark.createDataFrame([(k, i) for i, k in enumerate(v)], "code string, n long")
    first = publish.publish(rows("a", "b"), root, "page", key="code")
    reader = publish.published(spark, root)
    assert first["count"] == 2 and first["source"] == "page"
    publish.publish(rows("c"), root, "page", key="code")
    assert [r.code for r in publish.published(spark, root).collect()] == ["c"]
    assert sorted(r.code for r in reader.collect()) == ["a", "b"]  # a reader under way keeps its version
    for wrong in (rows("d", "d"), rows("e").select(F.raise_error(F.lit("broken")).cast("string").alias("code"), "n")):
        with pytest.raises(Exception, match="different|broken"):
            publish.publish(wrong, root, key="code")
        assert [r.code for r in publish.published(spark, root).collect()] == ["c"]  # the old version stays in force
    publish.publish(rows(), root)
    assert publish.published(spark, root).count() == 0 and publish.manifest(spark, root)["count"] == 0
    publish.publish(rows("z"), root)
    left = [v for v in os.listdir(tmp_path / "index" / "versions") if not v.startswith(".")]
    assert publish.manifest(spark, root)["version"] in left and len(left) <= 4 and not [f for f in os.listdir(tmp_path / "index") if f.startswith(".CURRENT-")]


def test_admission_over_batches(spark, tmp_path):
    hour = 3600
    rules = admission.Rules(cooldown=60, window=10 * hour, most=3, strike_window=24 * hour, strikes=2, block=5 * hour, idle=2 * hour, remember=1 * hour)
    batches = [
        [(1, 1, 0, ""), (2, 1, 30, ""), (3, 1, 100, "bad"), (4, 1, 200, ""), (1, 1, 300, ""), (9, 2, 0, "vile"), (10, 2, 100, "vile"), (11, 2, 200, ""), (None, None, 5, "")],
        [(4, 1, 400, ""), (5, 1, 500, ""), (6, 1, 600, ""), (12, 2, 4 * hour, ""), (20, 3, 9 * hour, "")],
        [(1, 1, 11 * hour, ""), (13, 2, 12 * hour, ""), (14, 2, 8 * hour, "late"), (21, 3, 30 * hour, "")],
        [(22, 3, 31 * hour, "")],
    ]
    (tmp_path / "in").mkdir()

    def arrive(i):
        lines = [json.dumps({"event_id": e, "user_id": u, "ts": f"2024-01-{1 + t // 86400:02d}T{t % 86400 // 3600:02d}:{t % 3600 // 60:02d}:{t % 60:02d}Z", "kind": k}) for e, u, t, k in batches[i]]
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(lines))
        events = spark.readStream.schema("event_id long, user_id long, ts timestamp, kind string").json(str(tmp_path / "in"))
        admission.run_once(admission.admission(events, F.col("kind") == "bad", F.col("kind") == "vile", rules, "0 seconds"), str(tmp_path / "out"), str(tmp_path / "ck"))

    for i in range(len(batches)):  # every run starts anew from the checkpoint
        arrive(i)
    rows = spark.read.schema(admission.VERDICT).parquet(str(tmp_path / "out")).collect()
    got = sorted(((r.user_id, r.event_id, r.verdict, r.session) for r in rows if r.verdict != "expired"), key=lambda r: r[:3])
    assert got == sorted([
        (1, 1, "admitted", 1), (1, 2, "cooldown", None), (1, 3, "refused", None), (1, 4, "admitted", 1), (1, 1, "repeat", None), (2, 9, "withheld", 1), (2, 10, "withheld", 1), (2, 11, "blocked", None),
        (1, 4, "repeat", None), (1, 5, "admitted", 1), (1, 6, "limit", None), (2, 12, "blocked", None), (3, 20, "admitted", 1), (1, 1, "admitted", 2), (2, 13, "admitted", 2), (3, 21, "admitted", 2), (3, 22, "admitted", 2),
    ], key=lambda r: r[:3])
    ended = sorted((r.user_id, r.session) for r in rows if r.verdict == "expired")
    assert ended == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1)]
