"""Chunks of typed records, cleaners and finer texts on the cases that their rules name."""

import json

from pyspark.sql import functions as F

from tessera.functions import chunkers, cleaners, details
from tessera.plans import facts


def chunks_of(spark, *records):
    d = spark.createDataFrame([(i, r if r is None or isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)], "id int, j string")
    rows = d.select("id", F.posexplode(chunkers.chunks(F.from_json("j", chunkers.SCHEMA))).alias("i", "c")).select("id", "i", "c.*").orderBy("id", "i").collect()
    return [(r.id, r.section, r.label, r.content) for r in rows]


def test_dispatch(spark):
    none = [{"page_type": "other", "title": "x"}, {"title": "x"}, None, "not json", {"page_type": "enemy"}, {"page_type": "story_dialogue", "blocks": []}, {"page_type": "status_effect", "name": "n"}, {"page_type": "knowledge", "text": " \n"}]
    assert chunks_of(spark, *none) == []
    assert chunks_of(spark, {"page_type": "personality", "title": "T"}, {"page_type": "ego_gift", "title": "G"}) == [(0, "info", "", "人格：T"), (1, "base", "G", "")]


def test_skills_and_voices(spark):
    stage = {"stage": "IV", "base_value": 4, "coin_power": 3, "effects": [{"timing": "使用时", "description": "gains 2"}]}
    record = {
        "page_type": "personality", "title": "T", "physical_resistances": {"slash": 2.0, "blunt": 0.9}, "ego_resources": {"gloom": 2},
        "skills": [{"skill_index": 0, "skill_name": "cut", "sin_type": "gloom", "damage_type": "slash", "attack_capacity": 2, "coin_count": 1, "stage_groups": [[stage], [{"stage": "I"}]]}, {"skill_index": 1, "guard_type": "evade"}, {"skill_index": 2, "stage_groups": [[{"stage": "I", "coin_power": 0}]]}],
        "battle_passive": "calm", "voice_lines": [{"title": "met", "text": "hi"}, {"title": "no", "text": ""}], "skill_voice": [{"file": "a.ogg", "skill_index": 2}, {"file": ""}],
    }
    got = chunks_of(spark, record)
    assert [(s, lab) for _, s, lab, _ in got] == [("info", ""), ("skill", "attack"), ("skill", "attack"), ("skill", "conditional"), ("passive", ""), ("voice", "met"), ("skill_voice", "技能2")]
    assert got[0][3] == "人格：T\n物理抗性：slash：脆弱 / blunt：×0.9\nE.G.O资源：gloom×2"
    assert got[1][3] == "人格：T\n技能：cut（IV阶）\n罪孽类型：gloom\n伤害类型：slash\n硬币数量：1\n攻击容量：2\n基础值：4\n变动值：+3\n[使用时] gains 2"
    assert got[3][3] == "人格：T\n技能：技能3（I阶）\n变动值：0" and got[6][3] == "人格：T\n技能：技能2\n技能语音文件：a.ogg"


def test_dialogue_pieces(spark):
    blocks = [{"type": "dialogue", "role": "A", "text": str(i)} for i in range(41)] + [{"type": "section", "text": "two"}, {"type": "image"}, {"type": "section", "text": "three"}, {"type": "narration", "text": "n"}]
    got = chunks_of(spark, {"page_type": "story_dialogue", "title": "D", "blocks": blocks})
    assert [(s, c.count("[A]")) for _, s, _, c in got] == [("D", 40), ("D", 1), ("three", 0)] and got[2][3] == "[旁白]\nn"


def test_cleaners(spark):
    texts = [None, "", "name：[shop][heal]\n镜牢经费：600\nHeals.\n\n\n\nMore.  \n（强化版·Ⅱ级）", "镜牢经费.png：5", "a：[x\nb"]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", cleaners.gift_content(F.col("t")).alias("t"))
    assert {r.id: r.t for r in d.collect()} == {0: "", 1: "", 2: "Heals.\n\nMore.", 3: "", 4: "a：[x\nb"}
    row = spark.range(1).select(
        cleaners.sin_name(F.lit("lust.PNG")).alias("a"), cleaners.sin_name(F.lit(None).cast("string")).alias("b"), cleaners.names(F.array(F.lit(" x "), F.lit("无"), F.lit(None), F.lit("ALEPH评级"))).alias("c"), cleaners.unit_id(F.lit(None).cast("string"), F.lit(" n "), F.lit("")).alias("d"),
        cleaners.speed_shown(F.lit(1), F.lit(None).cast("int")).alias("e"), cleaners.speed_shown(F.lit(None).cast("int"), F.lit(2)).alias("f"), cleaners.with_all(F.create_map(F.lit("z"), F.lit(0.0), F.lit("斩击"), F.lit(2.0)), cleaners.BLOWS).alias("g"),
    ).first()
    assert tuple(row) == ("lust", "", ["x"], "|n|", "1", None, {"z": 0.0, "斩击": 2.0, "突刺": 1.0, "打击": 1.0})


def test_details(spark):
    one = spark.range(1)
    titles = [details.skill_title(F.lit(k), F.lit("n"), F.lit(g), F.lit(2)) for k, g in (("强化2技能", True), ("守备技能", False), ("3技能", True), ("1技能2", False), ("5技能", False), ("", False), ("12技能", False))]
    assert list(one.select(*titles).first()) == ["【强化技能二】n（强化2技能）", "【守备技能】n", "【守备技能】n", "【技能一衍生】n（1技能2）", "【技能五】n", "【技能三】n", "【技能12】n"]
    who = one.select(*(details.identity(F.lit(n)) for n in ("index elder - Rien（first）", "Mao", "a - b - c"))).first()
    assert [tuple(w) for w in who] == [("Rien", "index elder（first）"), ("Mao", ""), ("c", "a - b")]
    effects = F.array(*(F.struct(F.lit(t).alias("timing"), F.lit(d).alias("description"), F.lit(c).alias("coin_index")) for t, d, c in (("hit", "[hit] a", 2), ("hit", "b", 1), ("", "c", 2), ("hit", "[hit] a", 2), ("hit", "-5", 1), ("x", "攻击容量", 1), ("x", "head", 0))))
    assert one.select(details.coins_merged(effects).alias("x")).first().x == ["硬币2：[hit] a；c", "硬币1：[hit] b"]
    none = F.lit(None).cast("array<struct<title:string,text:string>>")
    talks = F.array(F.struct(F.lit("s").alias("title"), F.lit("t" * 60).alias("text"), F.lit("u").alias("answer")))
    told = lambda note, said, talk: details.story_facts(F.lit("R"), F.lit(note), said, F.lit("F"), talk)
    empty, full = one.select(told("", none, talks), told("who", F.array(F.struct(F.lit("p").alias("title"), F.lit("x" * 71).alias("text"))), talks)).first()
    assert empty == "" and full == "- 身份：who\n- 剧情登场（R）：\n  ·（p）" + "x" * 70 + "…\n- 与F的剧情互动：\n  ·（s）R：" + "t" * 50 + "\n    F：u"


def test_links(spark):
    html = '<IMG alt=x src = "//a/b.png"><img src=\'//a/b.png\'><img data-src="no"><video><source src="https://v/1.mp4"></video><iframe  src="//w"></iframe>'
    row = spark.range(1).select(facts.links(F.lit(html), facts._IMAGE).alias("i"), facts.links(F.lit(html), facts._VIDEO).alias("v"), facts.links(F.lit(""), facts._IMAGE).alias("e")).first()
    assert (row.i, row.v, row.e) == (["https://a/b.png"], ["https://v/1.mp4", "https://w"], [])
