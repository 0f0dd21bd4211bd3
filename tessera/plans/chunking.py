"""Records of all types to chunks through one dispatch, and the cleaning of records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import chunkers, cleaners
from tessera.plans.catalog import query
from tessera.plans.layouts import _LINES, _lines, _text

TYPES = ("personality", "ego", "ego_gift", "story_dialogue", "story_note", "status_effect", "knowledge", "enemy", "event", "unknown")


def _record(kind: str, id_: Column) -> Column:
    """A JSON record of this type from the lines of an order; fields that a record may lack are null in some."""
    each = lambda f: F.transform("lines", lambda line, i: f(line, i + 1))
    maybe = lambda test, c: F.when(test, c if isinstance(c, Column) else F.lit(c))
    title = _text("T", id_)
    effect = lambda x, n: F.array(F.struct(F.lit("on").alias("timing"), _text("does ", n).alias("description"), (n % 2).alias("coin_index")))
    stage = lambda x, i: F.struct(F.lit("I").alias("stage"), maybe(x["l_suppkey"] % 2 == 0, x["q"]).alias("base_value"), (x["q"] - 25).alias("coin_power"), (i % 3).alias("attack_capacity"), maybe(i % 2 == 0, effect(x, i)).alias("effects"))
    fields = {"page_type": F.lit(kind), "title": title}
    if kind == "personality":
        skill = lambda x, i: F.struct((i - 1).alias("skill_index"), maybe(i % 2 == 1, _text("skill ", x["l_partkey"])).alias("skill_name"), maybe(x["l_suppkey"] % 3 == 0, "gloom").alias("sin_type"), maybe(x["l_suppkey"] % 5 == 0, "evade").alias("guard_type"), i.alias("coin_count"), F.array(F.array(stage(x, i))).alias("stage_groups"), effect(x, i).alias("coin_effects"))
        fields |= {"release_date": maybe(id_ % 3 == 0, "2024.01.01"), "physical_resistances": F.create_map(F.lit("slash"), F.lit(0.5), F.lit("blunt"), F.lit(1.25)), "skills": each(skill), "support_passive": maybe(id_ % 4 == 0, _text("aid ", id_)), "voice_lines": F.array(F.struct(F.lit("a.ogg").alias("file"), F.lit("met").alias("title"), _text("hi ", id_).alias("text")), F.struct(F.lit("b.ogg").alias("file"), F.lit("no").alias("title"), F.lit("").alias("text")))}
    elif kind == "ego":
        fields |= {"resource_costs": F.create_map(F.lit("gloom"), F.size("lines")), "awakening_stages": F.array(F.struct(F.lit(2).alias("coin_count"), F.lit(0).alias("sanity_cost"), F.lit(3).alias("attack_bonus"), each(stage).alias("stages"))), "passive_name": maybe(id_ % 3 == 1, "calm")}
    elif kind == "ego_gift":
        fields |= {"gift_name": maybe(id_ % 4 == 2, "ring"), "content": _text("gives ", F.size("lines")), "stage": maybe(id_ % 3 == 2, "upgraded_2")}
    elif kind == "story_dialogue":
        block = lambda x, i: F.struct(F.when(i % 3 == 0, "section").when(i % 3 == 1, "dialogue").otherwise("narration").alias("type"), maybe(i % 3 == 1, _text("R", i)).alias("role"), _text("says ", x["l_partkey"]).alias("text"))
        fields |= {"blocks": each(block)}
    elif kind == "story_note":
        entry = lambda x, i: F.struct(_text("记录 #", i, " 2024.1.", i).alias("title"), F.when(i % 3 == 0, "").otherwise(_text("note ", x["l_partkey"])).alias("text"), maybe(i % 2 == 0, F.array(F.lit("A"), _text("B", i))).alias("path"))
        fields |= {"entries": each(entry)}
    elif kind == "status_effect":
        fields |= {"name": maybe(id_ % 4 == 1, "burn"), "keywords": each(lambda x, i: _text("k", i)), "description": F.when(id_ % 3 == 0, "").otherwise("deals {0}")}
    elif kind == "knowledge":
        fields |= {"text": F.when(id_ % 5 == 1, " \n").otherwise(_text(" the rule of ", id_, "\n"))}
    elif kind == "enemy":
        skill = lambda x, i: F.struct(_text("skill ", x["l_partkey"]).alias("skill_name"), x["q"].alias("base_value"), (x["q"] - 25).alias("coin_power"), maybe(x["l_suppkey"] % 4 == 0, 3).alias("importance"), (x["l_suppkey"] % 3 == 0).alias("is_guard"), F.lit("evade").alias("guard_type"), maybe(i % 2 == 0, F.array(_text("hit ", i))).alias("coin_effects"))
        fields |= {"enemies": F.array(F.struct(F.lit("beast").alias("enemy_name"), maybe(id_ % 4 == 3, "head").alias("body_part"), F.size("lines").alias("hp"), F.array(F.lit("暴怒"), F.lit("fear "), F.lit("fear")).alias("panic_types"), each(skill).alias("skills")))}
    elif kind == "event":
        option = lambda x, i: F.struct(_text("choose ", i).alias("choice_text"), maybe(x["l_suppkey"] % 2 == 0, "check").alias("check_type"), F.lit("gloom").alias("check_sin"), (x["q"] % 2).alias("check_threshold"), F.array(_text("wins ", i)).alias("success_outcomes"))
        fields |= {"narration": _text(" once ", id_), "trigger_location": maybe(id_ % 4 == 0, "hall"), "options": each(option), "related_abnormalities": F.array(F.lit("one"))}
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())))


_SIGN = "CASE WHEN q > 25 THEN '+' ELSE '' END || (q - 25)"
_STAGE_SQL = f"CASE WHEN u % 2 = 0 THEN chr(10) || '基础值：' || q ELSE '' END || chr(10) || '{{0}}：' || {_SIGN} || {{1}} || CASE WHEN pos % 2 = 0 THEN chr(10) || '[on] does ' || pos ELSE '' END"


@query(f"""WITH {_LINES.replace("l_partkey, l_suppkey, l_returnflag,", "l_partkey AS p, l_suppkey AS u, ")}, o AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1), l AS (SELECT l_orderkey AS id, * FROM ln),
 c AS (SELECT id, 0 AS ord, 'info' AS section, '人格：T' || id || CASE WHEN id % 3 = 0 THEN chr(10) || '实装日期：2024.01.01' ELSE '' END || chr(10) || '物理抗性：slash：抵抗 / blunt：×1.25' AS content FROM o WHERE id % 10 = 0
  UNION ALL SELECT id, pos, 'skill', '人格：T' || id || chr(10) || '技能：' || CASE WHEN pos % 2 = 1 THEN 'skill ' || p ELSE '技能' || pos END || '（I阶）' || CASE WHEN u % 3 = 0 THEN chr(10) || '罪孽类型：gloom' ELSE '' END || CASE WHEN u % 5 = 0 THEN chr(10) || '守备类型：evade' ELSE '' END || chr(10) || '硬币数量：' || pos || {_STAGE_SQL.format("变动值", "''")} || chr(10) || CASE WHEN pos % 2 = 1 THEN '硬币1' ELSE '' END || '[on] does ' || pos FROM l WHERE id % 10 = 0
  UNION ALL SELECT id, 1000, 'passive', '人格：T' || id || chr(10) || '支援被动：aid ' || id FROM o WHERE id % 10 = 0 AND id % 4 = 0
  UNION ALL SELECT id, 1001, 'voice', '人格：T' || id || chr(10) || '语音标题：met' || chr(10) || '台词：hi ' || id || chr(10) || '语音文件：a.ogg' FROM o WHERE id % 10 = 0
  UNION ALL SELECT id, 0, 'info', 'E.G.O：T' || id || chr(10) || '资源消耗：gloom×' || n FROM o WHERE id % 10 = 1
  UNION ALL SELECT id, pos, 'awakening', 'E.G.O：T' || id || chr(10) || '模式：E.G.O觉醒（I阶）' || chr(10) || '硬币数量：2' || chr(10) || '攻击加权：+3' || {_STAGE_SQL.format("硬币威力", "CASE WHEN pos % 3 > 1 THEN chr(10) || '攻击容量：' || (pos % 3) ELSE '' END")} FROM l WHERE id % 10 = 1
  UNION ALL SELECT id, 1000, 'passive', 'E.G.O：T' || id || chr(10) || '被动：' || chr(10) || '被动名称：calm' FROM o WHERE id % 10 = 1 AND id % 3 = 1
  UNION ALL SELECT id, 0, CASE WHEN id % 3 = 2 THEN 'upgraded_2' ELSE 'base' END, 'gives ' || n FROM o WHERE id % 10 = 2
  UNION ALL SELECT id, (pos // 3), CASE WHEN pos // 3 = 0 THEN 'T' || id ELSE any_value(sec) END, string_agg(CASE WHEN pos % 3 = 1 THEN '[R' || pos || ']' ELSE '[旁白]' END || chr(10) || 'says ' || p, chr(10) ORDER BY pos) FROM (SELECT l.*, s.sec FROM l LEFT JOIN (SELECT id AS sid, pos AS sp, 'says ' || p AS sec FROM l) s ON sid = id AND sp = pos - pos % 3) WHERE id % 10 = 3 AND pos % 3 > 0 GROUP BY id, pos // 3
  UNION ALL SELECT id, pos, 'note', '[' || CASE WHEN pos % 2 = 0 THEN 'A > B' || pos ELSE '记录 #' || pos || ' 2024.1.' || pos END || ']' || chr(10) || '记录 #' || pos || ' 2024.1.' || pos || chr(10) || chr(10) || 'note ' || p FROM l WHERE id % 10 = 4 AND pos % 3 > 0
  UNION ALL SELECT id, 0, 'effect', '状态效果：' || CASE WHEN id % 4 = 1 THEN 'burn' ELSE 'T' || id END || chr(10) || '关键词：' || (SELECT string_agg('k' || pos, '、' ORDER BY pos) FROM l WHERE l.id = o.id) || chr(10) || chr(10) || 'deals {{0}}' FROM o WHERE id % 10 = 5 AND id % 3 > 0
  UNION ALL SELECT id, 0, 'text', '# T' || id || chr(10) || chr(10) || 'the rule of ' || id FROM o WHERE id % 10 = 6 AND id % 5 <> 1
  UNION ALL SELECT o.id, 0, 'unit', '# beast' || CASE WHEN o.id % 4 = 3 THEN chr(10) || '部位: head' ELSE '' END || chr(10) || '来源: T' || o.id || chr(10) || chr(10) || '## 基础数值' || chr(10) || '- 生命值 (HP): ' || n || chr(10) || '- 防御等级: 0' || chr(10) || '- 速度范围: 0-0' || chr(10) || chr(10) || '## 恐慌类型' || chr(10) || '- fear' || chr(10) || chr(10) || '## 技能列表' || chr(10)
   || string_agg('### 技能' || pos || ': skill ' || p || chr(10) || '- 罪孽属性: ' || chr(10) || '- 伤害类型: ' || chr(10) || '- 基础值: ' || q || chr(10) || '- 硬币威力: ' || {_SIGN} || chr(10) || '- 硬币数量: 0' || chr(10) || '- 攻击容量: 1' || CASE WHEN u % 4 = 0 THEN chr(10) || '- 重要性: 3' ELSE '' END || CASE WHEN u % 3 = 0 THEN chr(10) || '- 类型: 守备 (evade)' ELSE '' END || CASE WHEN pos % 2 = 0 THEN chr(10) || '- 硬币效果:' || chr(10) || '  * hit ' || pos ELSE '' END || chr(10), chr(10) ORDER BY pos) FROM o JOIN l ON l.id = o.id WHERE o.id % 10 = 7 GROUP BY o.id, n
  UNION ALL SELECT id, 0, 'event', '# T' || id || CASE WHEN id % 4 = 0 THEN chr(10) || '触发地点: hall' ELSE '' END || chr(10) || chr(10) || '## 事件描述' || chr(10) || 'once ' || id || chr(10) || chr(10) || '## 选项与判定' || chr(10)
   || string_agg('### 选项' || pos || ': choose ' || pos || CASE WHEN u % 2 = 0 THEN chr(10) || '判定: check | 罪孽: gloom' || CASE WHEN q % 2 > 0 THEN ' | 阈值: 1' ELSE '' END ELSE '' END || chr(10) || '成功结果:' || chr(10) || '  - wins ' || pos || chr(10), chr(10) ORDER BY pos) || chr(10) || '## 关联异想体' || chr(10) || '- one' || chr(10) FROM l WHERE id % 10 = 8 GROUP BY id)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY ord) - 1 AS INTEGER) AS position, section, md5(content) AS content_md5 FROM c""")
def typed_chunks(read):
    """Chunks of records of nine types (and one that none builds), dispatched by page type in one narrow pass over JSON records."""
    id_ = F.col("l_orderkey")
    json = F.lit(None).cast("string")
    for k, kind in enumerate(TYPES):
        json = F.when(id_ % 10 == k, _record(kind, id_)).otherwise(json)
    records = _lines(read).select(id_.alias("id"), F.from_json(json, chunkers.SCHEMA).alias("r"))
    return records.select("id", F.posexplode(chunkers.chunks(F.col("r"))).alias("position", "c")).select("id", "position", "c.section", F.md5("c.content").alias("content_md5"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'heals ' || p_size WHEN 2 THEN 'gives ' || p_name || chr(10) || chr(10) || 'end' ELSE 'name：no label' || chr(10) || 'rest' END AS content, CASE WHEN p_partkey % 3 = 0 THEN '色欲' ELSE '' END AS sin, CASE WHEN p_partkey % 2 = 0 THEN 'bird' ELSE 'bird,' || p_name END AS related,
 'stage|' || p_name || '|' || CASE WHEN p_partkey % 5 = 0 THEN 'head' ELSE '' END AS unit_id, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '2' ELSE '2~' || (2 + p_size) END AS speed, CASE WHEN p_partkey % 2 = 0 THEN '打击=1.0 斩击=0.5 突刺=1.0' ELSE '打击=1.0 斩击=1.0 突刺=1.0' END AS blows, 7 AS n_sins FROM part""")
def records_cleaned(read):
    """Gifts without label, cost and version lines, events without junk, units with ids, a shown speed and all resistances."""
    k = F.col("p_partkey")
    raw = F.when(k % 4 == 0, None).when(k % 4 == 1, _text("name：[shop][heal] x\n镜牢经费.png：600\n heals ", F.col("p_size"), "\n（强化版·Ⅰ级）\n")).when(k % 4 == 2, _text("gives ", F.col("p_name"), "\n\n\n\n\n（未强化版）\nend\n")).otherwise("name：no label\nrest")
    related = F.when(k % 2 == 0, F.array(F.lit(" bird "), F.lit("无"), F.lit("HE评级x"), F.lit(""), F.lit(None))).otherwise(F.array(F.lit("bird"), F.col("p_name")))
    blows = cleaners.with_all(F.when(k % 2 == 0, F.create_map(F.lit("斩击"), F.lit(0.5))), cleaners.BLOWS)
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(blows)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), " ")
    low = F.when(k % 3 > 0, 2)
    return read("part").select(
        "p_partkey", cleaners.gift_content(raw).alias("content"), cleaners.sin_name(F.when(k % 3 == 0, "色欲.PNG")).alias("sin"), F.array_join(cleaners.names(related), ",").alias("related"), cleaners.unit_id(F.lit(" stage"), F.col("p_name"), F.when(k % 5 == 0, "head ")).alias("unit_id"),
        cleaners.speed_shown(low, F.when(k % 3 == 2, F.col("p_size") + 2)).alias("speed"), shown.alias("blows"), F.size(cleaners.with_all(F.lit(None).cast("map<string,double>"), cleaners.SINS)).alias("n_sins"),
    )
