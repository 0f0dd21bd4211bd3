"""Markup trees, matches with places, dictionary rewriting and values inside templates on small cases."""

import re
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions import rewriting, wikitree
from tessera.plans import markup_rows

TREES = [
    ("{{T|wave=1|value}} end", "wave：1\n1：value end"), ("[[Page|shown]] [[Page]]", "shown Page"), ("[http://e.org/x site] [http://e.org/x]", "site http://e.org/x"), ("== a {{b|c}} ==\ntext", "\na 1：c\n\ntext"),
    ("x<br>y<br/>z<ref>gone {{a|b}}</ref><!-- c -->", "x\ny\nz"), ("{{{1|d}}}&amp;{{a}}", "&amp;"), ("{{T|n=1|v|{{U|k={{W|z}}}}}}", "n：1\n1：v\n2：k：1：z"), ("{{a|b=c=d|e}}", "b：c=d\n1：e"), ("{{a||b= |c}}", "2：c"), ("{{ {{n}} |x}}", "1：x"),
    ("'''bold''' and ''it'' don't '' open", " and  don't '' open"), ("* item\n# two\n----\nend", " item\n two\n\nend"), ("{|\n| a || b\n|}\nafter", "\nafter"), ("{{open|a=1 [[l|m]] x", "{{open|a=1 m x"), ("a}} ]] ] </b> = | {x}", "a}} ]] ] </b> = | {x}"), ("<div>never", "<div>never"),
    ("{{a|<b>x}}</b>", "1：<b>x</b>"), ("[[f|{{t|a=b}}]]", "{{t|a=b}}"), ("= x =\n== not = \n=======", "\nx\n\n== not = \n======="), ("[http://e.org a\nb]", "[http://e.org a\nb]"), ('{{S|n=?({{h|{"c":"5"} }})}}', 'n：?(1：{"c":"5"})'), ("", ""),
]


@pytest.mark.parametrize(("markup", "shown"), TREES)
def test_trees(markup, shown):
    assert wikitree.plain(markup) == shown


def test_tree_nodes_and_null():
    assert wikitree.plain(None) is None and wikitree.nodes(None) == wikitree.nodes("plain") == []
    got = [(n["kind"], n["name"], n["parent"], n["last"]) for n in wikitree.nodes("{{A|x=[[P|q]]|{{B|1}}}}<br>")]
    assert got == [("template", "A", -1, 5), ("part", "x", 0, 2), ("link", "P", 1, 2), ("part", "1", 0, 5), ("template", "B", 3, 5), ("part", "1", 4, 5), ("tag", "br", -1, 6)]


def test_trees_take_linear_time():
    start = time.time()
    for deep in ("{{a|" * 20_000, "[[" * 50_000, "<b>" * 50_000, "''" * 50_001, "{{a|b=" * 10_000 + "}}" * 10_000, "=" * 100_000 + "\n=" * 50_000, "{{{" * 20_000 + "}}" * 30_000):
        wikitree.plain(deep)
    assert time.time() - start < 20


TEXTS = ["a1 b22 c", "", None, "no match", "22", "x 1", "é1é2 ", "1\n2"]


def test_matches_have_places(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string").select("id", rewriting.between("t", r"(\d)(\d?)", 2).alias("m")).collect()
    for r in rows:
        text = TEXTS[r.id]
        if text is None:
            assert r.m is None
            continue
        found = list(re.finditer(r"(\d)(\d?)", text))
        ends = [m.start() for m in found[1:]] + [len(text)]
        assert [tuple(x) for x in r.m] == [(m.start(), m.end(), m[0], m[1], m[2], text[m.end() : e]) for m, e in zip(found, ends, strict=False)]


def test_sections_and_voices(spark):
    page = "x\n=== skill voices ===\nno\n==voices==\n" + (
        '|width="55px"|[[file:one.ogg|50px]]||met：\n|-\n|style="color:#E5CAA5"|\n|| ||\nA talent without equal.\n|width="55px"|[[file: two .ogg|50px]]||morning：Hello there\nmorning：\n|| yes sir\n[[file:three.ogg]]\n12\n'
    )
    d = spark.createDataFrame([(1, page + "== next ==\n[[file:four.ogg]]||t：u"), (2, "nothing"), (3, None)], "id int, page string")
    got = {r.id: r.v for r in d.select("id", markup_rows.voice_lines(rewriting.section("page", "voices")).alias("v")).collect()}
    assert [(v.file, v.title, v.text) for v in got[1]] == [("one.ogg", "met", "A talent without equal."), ("two .ogg", "morning", "Hello thereyes sir")]
    assert got[1][0].start == 15 and not got[2] and not got[3]


CODES = [("Charge", "充"), ("Breath", "息"), ("Breath Up", "息+"), ("Up", "上"), ("Sin 7", "罪七"), ("+1", "一"), ("", "x"), ("Lost", " ")]


def test_keys(spark):
    texts = ["Breath Up, Breathless Breath", "Charge强度 aCharge Charges Charge7", "Sin 7 Sin 71 Up+1 a+1b Lost", "", None, "Breath Up Up"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    layers = [spark.createDataFrame([("Up", "顶")], "code string, name string"), spark.createDataFrame(CODES, "code string, name string")]
    got = {r.id: r.t for r in rewriting.replace_keys(rows, "id", "t", layers).collect()}
    assert got == {0: "息+, Breathless 息", 1: "充强度 aCharge Charges 充7", 2: "罪七 罪七1 顶+1 a+1b Lost", 3: "", 4: None, 5: "息+ 顶"}
    none = rewriting.replace_keys(rows, "id", "t", [spark.createDataFrame([], "code string, name string")])
    assert {r.id: r.t for r in none.collect()} == dict(enumerate(texts))


def test_template_codes(spark):
    rows = spark.createDataFrame([(1, "{{Buff| A }}x{{Buff|B}}"), (2, "{{Buff|A}}{{Buff|Z}}"), (3, "plain"), (4, None), (5, "")], "id int, t string")
    names = [spark.createDataFrame([("A", ""), ("B", "b")], "code string, name string"), spark.createDataFrame([("A", "a"), ("B", "late")], "code string, name string")]
    own = spark.createDataFrame([(2, "A", "mine")], "id int, code string, name string")
    got = rewriting.replace_matches(rows, "id", "t", r"\{\{Buff\|([^}|]+)\}\}", names, lambda m, code: F.concat(F.lit("?"), code), own)
    assert {r.id: r.t for r in got.collect()} == {1: "axb", 2: "mine?Z", 3: "plain", 4: None, 5: ""}


def test_values_of_templates(spark):
    values = ["5", " -3 ", "???", '?({{#html:Hide|{"content":"50"} }})', '{"content":7}', '{"content":"x"}', '{"content":', "", None, '{"other":1}']
    d = spark.createDataFrame(list(enumerate(values)), "id int, v string")
    got = {r.id: r.n for r in d.select("id", markup_rows.hidden_number(F.col("v")).alias("n")).collect()}
    assert got == {0: 5, 1: -3, 2: None, 3: 50, 4: 7, 5: None, 6: None, 7: None, 8: None, 9: None}
    pages = spark.createDataFrame([(1, "{{Skill|a=1|b={{X|a=2}}|a=3}}{{Other|a=9}}{{Skill}}{{Skill|a=open"), (2, None)], "id int, page string")
    found = wikitree.template_parts(pages, ["id"], "page", F.col("name") == "Skill").orderBy("template").collect()
    assert [(r.id, r.parts) for r in found] == [(1, {"a": "3", "b": "a：2"}), (1, None)]


def test_templates_come_out_of_one_reading(spark):
    pages = spark.createDataFrame([(1, "{{A|x=1|\n y = 2=3}}{{B|{{A|p|q|k\n=v}}}}{{A}}{{A|"), (2, "{{A|x=''|}}"), (3, None)], "id int, page string")
    found = wikitree.template_parts(pages, ["id"], "page", F.col("name") == "A")
    assert sorted((r.id, r.nth, r.parts) for r in found.collect()) == [(1, 1, {"x": "1", "y": "2=3"}), (1, 2, {"1": "p", "2": "q", "k": "v"}), (1, 3, None), (2, 1, {"x": "''|"})]
    plan = found._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_hits_become_objects_a_few_texts_at_a_time():
    import pyarrow as pa

    hit = pa.struct([("start", pa.int32()), ("less", pa.int32()), ("name", pa.string())])
    one = [{"start": 0, "less": -2, "name": "<ab>"}, {"start": 1, "less": -2, "name": "gone"}, {"start": 3, "less": -1, "name": "<d>"}]
    rows = [(i, "ab d", one) for i in range(300)] + [(300, None, None), (301, "x", None), (302, "", [])]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.list_(hit)), strict=True)], ["id", "t", "hits"])
    got = list(rewriting._put("id", "t")([batch.slice(1)]))
    assert max(b.num_rows for b in got) <= 64
    assert [(r["id"], r["t"]) for b in got for r in b.to_pylist()] == [(i, "<ab> <d>") for i in range(1, 300)] + [(300, None), (301, "x"), (302, "")]


def test_a_page_is_cut_once(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "id int, page string")
    found = d.select("id", markup_rows.voice_lines(rewriting.section("page", "voices")).alias("v"))
    analysed = found._jdf.queryExecution().analyzed().toString()
    assert analysed.count("split(") <= 3 and analysed.count("regexp_extract_all(") <= 4  # the page, its section, a slice's lines
    assert [r.v for r in found.collect()] == [None, None]


def test_effects_of_coins_are_judged_once(spark):
    from tessera.functions import details

    one = "struct<timing:string,description:string,coin_index:int>"
    d = spark.createDataFrame([(1, [("on", "cuts", 2), ("on", "first", 1), ("", "cuts", 2), ("on", "+3", 2)]), (2, None)], f"id int, e array<{one}>")
    found = d.select("id", details.coins_merged(F.col("e")).alias("c"))
    assert found._jdf.queryExecution().analyzed().toString().count("RLIKE") == 1
    assert {r.id: r.c for r in found.collect()} == {1: ["硬币2：[on] cuts；cuts", "硬币1：[on] first"], 2: None}


def test_plain_links_are_read_at_once(monkeypatch):
    import random
    import re

    from tessera.functions import wikitree

    pieces = ["{{A", "{{B|x=1", "}}", "}}}", "{{{", "|", "|x=1", "|y = two ", "=", "[[a|b]]", "[[a|b|c]]", "[[ d ]]", "[[]]", "[[e|]]", "[[|f]]", "[[", "]]", "[", "]", "'''", "<b>", "</b>", "\n", "\n== h ==\n", "|n=a\nb", "\n|}", "text"]
    chance, opened = random.Random(6), []
    texts = ["{{T" + "".join(chance.choices(pieces, k=chance.randint(0, 20))) + "}}" for _ in range(5000)]
    read = lambda: [(wikitree.nodes(t), wikitree.plain(t), wikitree.templates(t)) for t in texts]
    got, one = read(), wikitree.Markup._open
    monkeypatch.setattr(wikitree.Markup, "_open", lambda self, kind, *a: opened.append(kind) or one(self, kind, *a))
    assert wikitree.templates("{{T|a=[[x|y]] z|{{D|[[w]]}}}}") == [(0, "T", {"a": "y z", "1": "1：w"}), (4, "D", {"1": "w"})]
    assert opened == ["template", "template"]
    monkeypatch.setattr(wikitree, "_LINK", re.compile("(?!)"))
    assert got == read() and "link" in opened
