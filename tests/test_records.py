"""Markup and formatters of nested records on small cases."""

from pyspark.sql import functions as F

from tessera.functions import formats, markup


def test_templates():
    assert markup.without_templates("a{{b|{{c}}|{d}}}e}}f{{g") == "a}ef"  # the first pair of braces closes
    assert markup.without_templates("x}}y") == "x}}y"
    assert markup.without_templates("{{" * 50_000 + "}}" * 50_000 + "z") == "z"
    assert markup.parameters("Dialog|a|{{b|c}}|d = e") == ["a", "{{b|c}}", "d = e"]


def test_blocks():
    page = "== one ==\n{{Dialog|role=Ann2|text=Hi {{S|x}} '''you'''<b>!</b>}}\n{{Dialog|role=Bob\n{{Dialog-p|f|t|Cy|so|more}}{{Image|q}}{{Dialog|text=alone}}{{Dialog|role=Dan}}\n=== two ===\n{{Other|{{Dialog|text=in}}}}"
    got = [(b["type"], b["role"], b["text"]) for b in markup.blocks(page)]
    assert got == [("section", "", "one"), ("dialogue", "Ann", "Hi {{S|x}} you!"), ("dialogue", "Cy", "so"), ("narration", "", "alone"), ("section", "", "two"), ("narration", "", "in")]
    assert markup.blocks(None) == markup.blocks("") == markup.blocks("no marks {{Dialog") == []


def test_blocks_in_spark(spark):
    d = spark.createDataFrame([(1, "== a ==\n{{Dialog|text=b}}"), (2, ""), (3, None)], "id int, page string")
    assert {r.id: [tuple(b) for b in r.b] for r in d.select("id", markup.dialogue_blocks("page").alias("b")).collect()} == {1: [("section", "", "a"), ("narration", "", "b")], 2: [], 3: []}
    t = spark.createDataFrame([("a{{b}}",), (None,)], "t string").select(markup.strip_templates("t").alias("t"))
    assert [r.t for r in t.collect()] == ["a", None]


def test_formats(spark):
    stage = "array<struct<stage:string,base:int,power:int>>"
    d = spark.createDataFrame([(1, [("I", 1, 2), ("IV", 3, -4), ("V", None, None)]), (2, [("I", None, 5)]), (3, [])], f"id int, s {stage}")
    lines = {r.id: r.t for r in d.select("id", formats.stage_line(formats.chosen_stage(F.col("s"))).alias("t")).collect()}
    assert lines == {1: "IV: base 3 | power -4", 2: "I: base - | power +5", 3: "no stage"}
    one = spark.range(1)
    table = lambda *v: F.array(*(F.struct(F.lit(k).alias("k"), F.lit(x).cast("int").alias("v")) for k, x in v))
    keys = [formats.skill_header(F.lit(k), F.lit("n")) for k in ("strong2x", "guard", "3-1", "4", "")]
    row = one.select(
        formats.table_line("r ", table(("a", 1), ("b", None))), formats.table_line("r ", table(("a", None))), formats.numbered(F.array(F.lit("x"), F.lit("y"))),
        formats.skill_name(F.lit(" "), F.lit(None).cast("string"), F.lit(2)), F.size(formats.nodes(F.array(F.lit(" \n"), F.lit("a")), "s")), *keys,
    ).first()
    assert tuple(row) == ("r a:1", None, "1. x\n2. y", "skill 2", 1, "[strong skill 2] n", "[guard] n", "[skill 3 variant] n", "[skill 4] n", "n")
    video = lambda *mb: F.array(*(F.struct(F.lit(f"v{m}").alias("url"), F.lit(m).alias("mb")) for m in mb))
    got = one.select(formats.segments(F.lit(" "), F.array(F.lit("i")), video(1, 9), 5).alias("s")).first().s
    assert [tuple(s) for s in got] == [("image", "i"), ("video", "v1"), ("text", "video: v9")]


def test_cleaning(spark):
    from tessera.functions import cleaning

    d = spark.createDataFrame([(1, None), (2, ""), (3, "file:a.png" + " | b" * 100_000 + "\nReal words here\n12.\nx.png\nab"), (4, "== T ==\n* a\n'''b'''[[c|d]]<!-- x\n -->")], "id int, t string")
    got = {r.id: (r.a, r.b) for r in d.select("id", cleaning.clean_page(F.col("t")).alias("a"), cleaning.wiki_to_markdown(F.col("t")).alias("b")).filter("id <> 3").collect()}
    assert got == {1: (None, None), 2: ("", ""), 4: ("", "1. T\n- a\n**b**d")}  # by the order of the rewrites a heading of the first level ends as a list
    assert [r.a for r in d.filter("id = 3").select(cleaning.clean_page(F.col("t")).alias("a")).collect()] == ["Real words here\nab"]
