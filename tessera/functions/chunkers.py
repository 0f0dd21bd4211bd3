"""Chunks of typed records: one parse of a JSON record by a schema of all types, one builder of columns for each page type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.formats import signed

_EFFECT = "array<struct<timing:string,description:string,coin_index:int>>"
_STAGE = f"struct<stage:string,base_value:int,coin_power:int,attack_capacity:int,effects:{_EFFECT}>"
_MODE = f"array<struct<coin_count:int,sanity_cost:int,attack_bonus:int,stages:array<{_STAGE}>>>"
_SKILL = f"struct<skill_index:int,skill_name:string,sin_type:string,damage_type:string,guard_type:string,attack_capacity:int,coin_count:int,stage_groups:array<array<{_STAGE}>>,coin_effects:{_EFFECT}>"
_UNIT = (
    "struct<enemy_name:string,body_part:string,battle_stage:string,hp:int,defense_level:int,speed_min:int,speed_max:int,chaos_threshold:string,physical_resistances:map<string,double>,sin_resistances:map<string,double>,panic_types:array<string>,passives:array<string>,appear_stages:array<string>,"
    "skills:array<struct<skill_name:string,sin_type:string,damage_type:string,base_value:int,coin_power:int,coin_count:int,attack_weight:int,importance:int,is_guard:boolean,guard_type:string,coin_effects:array<string>>>>"
)
_OPTION = "struct<choice_text:string,check_type:string,check_sin:string,check_threshold:int,success_outcomes:array<string>,failure_outcomes:array<string>>"
#: All fields of all types of records; a record has those of its type.
SCHEMA = (
    "page_type string, title string, sinner string, release_date string, acquisition string, sin_affinities map<string,int>, physical_resistances map<string,double>, ego_resources map<string,int>, resource_costs map<string,int>, sin_resistances map<string,double>, "
    f"skills array<{_SKILL}>, battle_passive string, support_passive string, voice_lines array<struct<file:string,title:string,text:string>>, skill_voice array<struct<file:string,skill_index:int,skill_label:string,skill_name:string>>, awakening_stages {_MODE}, erosion_stages {_MODE}, passive_name string, passive_description string, "
    "gift_name string, content string, stage string, chapter string, blocks array<struct<type:string,role:string,text:string>>, name string, effect_type string, sin_affinity string, keywords array<string>, properties array<string>, description string, entries array<struct<title:string,text:string,path:array<string>>>, text string, "
    f"enemies array<{_UNIT}>, event_name string, narration string, trigger_location string, options array<{_OPTION}>, ego_gifts array<struct<name:string,effect:string>>, related_abnormalities array<string>"
)
CHUNK = "array<struct<section:string,label:string,content:string>>"
#: Words for resistances and names that are no panic: fixed values.
RESISTED = {0.5: "抵抗", 0.75: "抵抗", 1.0: "普通", 1.5: "脆弱", 2.0: "脆弱"}
NO_PANIC = ("暴怒", "色欲", "怠惰", "暴食", "忧郁", "傲慢", "嫉妒")


def some(c: Column) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(c, F.lit(""))


def after(label: str, c: Column) -> Column:
    """label and value; null where there is no value."""
    return F.concat(F.lit(label), c.cast("string"))


def lines(*parts: Column | tuple) -> Column:
    """The parts that there are (texts, or arrays of texts), a line each."""
    rows = [F.coalesce(p[0], F.array().cast("array<string>")) if isinstance(p, tuple) else F.array(p.cast("string")) for p in parts]
    return F.array_join(F.concat(*rows), "\n")  # nulls are left out


def each(c: Column, f) -> tuple[Column]:
    """For lines(): a line, or several, for each element; none for a null."""
    return (F.filter(F.transform(F.coalesce(c, F.array()), f), lambda x: x.isNotNull()),)


def under(title: str, items: Column) -> tuple[Column]:
    """For lines(): a heading, items below and a blank line; nothing without items."""
    return (F.when(F.size(items) > 0, F.concat(F.array(F.lit(title)), items, F.array(F.lit("")))),)


def pairs(c: Column, mark: str) -> Column:
    """key mark value of a map, in its order, with slashes; null for an empty one."""
    shown = F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit(mark), e["value"].cast("string")))
    return F.when(F.size(shown) > 0, F.array_join(shown, " / "))


def resistances(c: Column) -> Column:
    """A map of factors in words; a factor without a word as it is."""
    word = F.create_map(*(F.lit(x) for kv in RESISTED.items() for x in kv))
    shown = F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("："), F.coalesce(F.try_element_at(word, e["value"]), F.concat(F.lit("×"), e["value"].cast("string")))))
    return F.when(F.size(shown) > 0, F.array_join(shown, " / "))


def _chunk(section: str | Column, content: Column, label: Column | str = "") -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(section).alias("section"), F.coalesce(lit(label), F.lit("")).alias("label"), content.alias("content"))


def _one(test: Column, chunk: Column) -> Column:
    return F.when(test, F.array(chunk)).otherwise(F.array().cast(CHUNK))


def _many(c: Column, f) -> Column:
    return F.coalesce(F.transform(c, f), F.array().cast(CHUNK))


def _positive(c: Column) -> Column:
    return F.when(c > 0, c)


def _effects(c: Column) -> tuple[Column]:
    return each(c, lambda e: F.concat(F.lit("["), F.coalesce(e["timing"], F.lit("")), F.lit("] "), F.coalesce(e["description"], F.lit(""))))


def personality(r: Column) -> Column:
    """Basics, a chunk for each stage of each skill, passives, voices, and voices of skills."""
    head = F.concat(F.lit("人格："), F.coalesce(r["title"], F.lit("")))
    info = lines(head, after("实装日期：", some(r["release_date"])), after("获取方式：", some(r["acquisition"])), after("罪孽亲和：", pairs(r["sin_affinities"], "×")), after("物理抗性：", resistances(r["physical_resistances"])), after("E.G.O资源：", pairs(r["ego_resources"], "×")))

    def stages(skill, place):
        name = F.coalesce(skill["skill_name"], F.concat(F.lit("技能"), (F.coalesce(skill["skill_index"], F.lit(0)) + 1).cast("string")))
        kind = F.when(some(skill["guard_type"]).isNotNull(), "guard").when(some(skill["sin_type"]).isNull() & some(skill["damage_type"]).isNull(), "conditional").otherwise("attack")
        coins = each(skill["coin_effects"], lambda e: F.concat(F.coalesce(after("硬币", _positive(e["coin_index"])), F.lit("")), F.lit("["), F.coalesce(e["timing"], F.lit("")), F.lit("] "), F.coalesce(e["description"], F.lit(""))))
        return F.transform(
            F.flatten(F.coalesce(skill["stage_groups"], F.array().cast(f"array<array<{_STAGE}>>"))),
            lambda s: _chunk("skill", lines(
                head, F.concat(F.lit("技能："), name, F.lit("（"), F.coalesce(s["stage"], F.lit("")), F.lit("阶）")), after("罪孽类型：", some(skill["sin_type"])), after("伤害类型：", some(skill["damage_type"])), after("守备类型：", some(skill["guard_type"])), after("硬币数量：", _positive(skill["coin_count"])),
                after("攻击容量：", F.when(skill["attack_capacity"] > 1, skill["attack_capacity"])), after("基础值：", s["base_value"]), after("变动值：", signed(s["coin_power"])), _effects(s["effects"]), coins,
            ), kind),
        )

    passive = lines(head, after("战斗被动：", some(r["battle_passive"])), after("支援被动：", some(r["support_passive"])))
    voice = lambda v: _chunk("voice", lines(head, after("语音标题：", some(v["title"])), after("台词：", v["text"]), after("语音文件：", some(v["file"]))), v["title"])
    called = lambda v: F.coalesce(some(v["skill_name"]), after("技能", F.nullif(v["skill_index"], F.lit(0))), some(v["skill_label"]))
    spoken = lambda v: _chunk("skill_voice", lines(head, after("技能：", called(v)), after("技能语音文件：", v["file"])), called(v))
    return F.concat(
        F.array(_chunk("info", info)), F.flatten(F.coalesce(F.transform(r["skills"], stages), F.array().cast(f"array<{CHUNK}>"))), _one(some(r["battle_passive"]).isNotNull() | some(r["support_passive"]).isNotNull(), _chunk("passive", passive)),
        _many(F.filter(r["voice_lines"], lambda v: some(v["text"]).isNotNull()), voice), _many(F.filter(r["skill_voice"], lambda v: some(v["file"]).isNotNull()), spoken),
    )


def ego(r: Column) -> Column:
    """Basics, a chunk for each stage of both modes, and the passive."""
    head = F.concat(F.lit("E.G.O："), F.coalesce(r["title"], F.lit("")))
    info = lines(head, after("实装日期：", some(r["release_date"])), after("获取方式：", some(r["acquisition"])), after("资源消耗：", pairs(r["resource_costs"], "×")), after("罪孽抗性：", resistances(r["sin_resistances"])))

    def mode(field, section, name):
        def of(m):
            return F.transform(
                F.coalesce(m["stages"], F.array().cast(f"array<{_STAGE}>")),
                lambda s: _chunk(section, lines(
                    head, F.concat(F.lit(f"模式：E.G.O{name}（"), F.coalesce(s["stage"], F.lit("")), F.lit("阶）")), after("硬币数量：", _positive(m["coin_count"])), after("理智消耗：", F.nullif(m["sanity_cost"], F.lit(0))), after("攻击加权：+", F.nullif(m["attack_bonus"], F.lit(0))),
                    after("基础值：", s["base_value"]), after("硬币威力：", signed(s["coin_power"])), after("攻击容量：", F.when(s["attack_capacity"] > 1, s["attack_capacity"])), _effects(s["effects"]),
                ), s["stage"]),
            )

        return F.flatten(F.coalesce(F.transform(r[field], of), F.array().cast(f"array<{CHUNK}>")))

    passive = lines(head, F.lit("被动："), after("被动名称：", some(r["passive_name"])), some(r["passive_description"]))
    return F.concat(F.array(_chunk("info", info)), mode("awakening_stages", "awakening", "觉醒"), mode("erosion_stages", "erosion", "侵蚀"), _one(some(r["passive_name"]).isNotNull() | some(r["passive_description"]).isNotNull(), _chunk("passive", passive)))


def gift(r: Column) -> Column:
    return F.array(_chunk(F.coalesce(r["stage"], F.lit("base")), F.coalesce(r["content"], F.lit("")), F.coalesce(some(r["gift_name"]), r["title"])))


def story_dialogue(r: Column, most: int = 40) -> Column:
    """The spoken lines of each section, in pieces of so many lines."""
    blocks = F.coalesce(r["blocks"], F.array().cast("array<struct<type:string,role:string,text:string>>"))
    chapter = F.coalesce(some(r["chapter"]), r["title"], F.lit(""))
    cuts = F.filter(F.sequence(F.lit(1), F.size(blocks)), lambda i: F.element_at(blocks, i)["type"] == "section")
    starts, ends = F.concat(F.array(F.lit(0)), cuts), F.concat(cuts, F.array(F.size(blocks) + 1))

    def piece(start, end):
        said = F.filter(F.slice(blocks, start + 1, end - start - 1), lambda b: b["type"].isin("dialogue", "narration"))
        shown = F.transform(said, lambda b: F.concat(F.lit("["), F.when(b["type"] == "narration", "旁白").otherwise(F.coalesce(b["role"], F.lit(""))), F.lit("]\n"), F.coalesce(b["text"], F.lit(""))))
        name = F.when(start == 0, chapter).otherwise(F.coalesce(F.try_element_at(blocks, start)["text"], chapter))
        n = F.ceil(F.size(shown) / most).cast("int")
        return F.transform(F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(1))), 1, n), lambda k: _chunk(name, F.array_join(F.slice(shown, k * most + 1, most), "\n")))

    return F.when(F.size(blocks) > 0, F.flatten(F.zip_with(starts, ends, piece))).otherwise(F.array().cast(CHUNK))


def story_note(r: Column) -> Column:
    """Entries with a text, under their path."""
    path = lambda e: F.when(F.size(e["path"]) > 0, F.array_join(e["path"], " > ")).otherwise(F.coalesce(e["title"], F.lit("")))
    one = lambda e: _chunk("note", F.concat(F.lit("["), path(e), F.lit("]\n"), F.coalesce(e["title"], F.lit("")), F.lit("\n\n"), e["text"]), F.regexp_extract(F.coalesce(e["title"], F.lit("")), r"记录\s*#(\d+)", 1))
    return _many(F.filter(r["entries"], lambda e: some(e["text"]).isNotNull()), one)


def status_effect(r: Column) -> Column:
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, "、"))
    name = F.coalesce(some(r["name"]), r["title"], F.lit(""))
    content = lines(after("状态效果：", name), after("类型：", some(r["effect_type"])), after("罪孽亲和：", some(r["sin_affinity"])), after("关键词：", joined(r["keywords"])), after("属性：", joined(r["properties"])), F.lit(""), r["description"])
    return _one(some(r["description"]).isNotNull(), _chunk("effect", content, name))


def knowledge(r: Column) -> Column:
    text = F.regexp_replace(r["text"], r"^\s+|\s+$", "")
    return _one(some(text).isNotNull(), _chunk("text", F.concat(F.lit("# "), F.coalesce(r["title"], F.lit("")), F.lit("\n\n"), text)))


def enemy(r: Column) -> Column:
    """A chunk for each unit: numbers, resistances, panics (each once, none that is no panic), passives, skills."""
    n = lambda c, default="0": F.coalesce(c.cast("string"), F.lit(default))
    factors = lambda c: F.transform(F.map_entries(c), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": ×"), e["value"].cast("string")))
    items = lambda c: F.transform(c, lambda x: F.concat(F.lit("- "), x))

    def skill(s, i):
        power = F.when(F.coalesce(s["coin_power"], F.lit(0)) == 0, "0").otherwise(signed(s["coin_power"]))
        place = (i + 1).cast("string")
        coins = each(s["coin_effects"], lambda e: F.concat(F.lit("  * "), e))
        return lines(
            F.concat(F.lit("### 技能"), place, F.lit(": "), F.coalesce(s["skill_name"], F.concat(F.lit("技能"), place))), F.concat(F.lit("- 罪孽属性: "), n(s["sin_type"], "")), F.concat(F.lit("- 伤害类型: "), n(s["damage_type"], "")), F.concat(F.lit("- 基础值: "), n(s["base_value"])), F.concat(F.lit("- 硬币威力: "), power),
            F.concat(F.lit("- 硬币数量: "), n(s["coin_count"])), F.concat(F.lit("- 攻击容量: "), n(s["attack_weight"], "1")), after("- 重要性: ", _positive(s["importance"])), F.when(s["is_guard"], F.concat(F.lit("- 类型: 守备 ("), n(s["guard_type"], ""), F.lit(")"))), F.when(F.size(s["coin_effects"]) > 0, "- 硬币效果:"), coins, F.lit(""),
        )

    def unit(u):
        panics = F.array_distinct(F.filter(F.transform(u["panic_types"], lambda p: F.trim(p)), lambda p: (p != "") & ~p.isin(*NO_PANIC)))
        stages = F.when(F.size(u["appear_stages"]) > 1, F.concat(F.lit("出现关卡: "), F.array_join(u["appear_stages"], "、")))
        content = lines(
            F.concat(F.lit("# "), n(u["enemy_name"], "未知敌人")), after("部位: ", some(u["body_part"])), F.concat(F.lit("来源: "), F.coalesce(u["battle_stage"], r["title"], F.lit(""))), stages, F.lit(""), F.lit("## 基础数值"), F.concat(F.lit("- 生命值 (HP): "), n(u["hp"])), F.concat(F.lit("- 防御等级: "), n(u["defense_level"])),
            F.concat(F.lit("- 速度范围: "), n(u["speed_min"]), F.lit("-"), n(u["speed_max"])), after("- 混乱阈值: ", some(u["chaos_threshold"])), F.lit(""), under("## 物理抗性", factors(u["physical_resistances"])), under("## 罪孽抗性", factors(u["sin_resistances"])),
            (F.when(F.size(u["panic_types"]) > 0, F.concat(F.array(F.lit("## 恐慌类型")), items(panics), F.array(F.lit("")))),), under("## 被动能力", items(u["passives"])), F.when(F.size(u["skills"]) > 0, "## 技能列表"), (F.transform(u["skills"], skill),),
        )
        return _chunk("unit", content, u["enemy_name"])

    return _many(r["enemies"], unit)


def event(r: Column) -> Column:
    """One chunk: place, story, choices with their checks and outcomes, gifts and what belongs to it."""
    title = F.coalesce(r["event_name"], r["title"], F.lit(""))
    items = lambda c: F.transform(c, lambda x: F.concat(F.lit("- "), x))

    def option(o, i):
        check = F.concat(some(o["check_type"]), F.coalesce(after(" | 罪孽: ", some(o["check_sin"])), F.lit("")), F.coalesce(after(" | 阈值: ", F.nullif(o["check_threshold"], F.lit(0))), F.lit("")))
        place = (i + 1).cast("string")
        outcome = lambda name, c: (F.when(F.size(c) > 0, F.concat(F.array(F.lit(name)), F.transform(c, lambda x: F.concat(F.lit("  - "), x)))),)
        return lines(F.concat(F.lit("### 选项"), place, F.lit(": "), F.coalesce(o["choice_text"], F.concat(F.lit("选项"), place))), after("判定: ", check), outcome("成功结果:", o["success_outcomes"]), outcome("失败结果:", o["failure_outcomes"]), F.lit(""))

    gifts = F.transform(r["ego_gifts"], lambda g: F.concat(F.lit("- **"), F.coalesce(g["name"], F.lit("未知饰品")), F.lit("**: "), F.coalesce(g["effect"], F.lit(""))))
    told = F.regexp_replace(F.coalesce(r["narration"], F.lit("")), r"^\s+|\s+$", "")
    content = lines(
        F.concat(F.lit("# "), title), after("触发地点: ", some(r["trigger_location"])), F.lit(""), (F.when(told != "", F.array(F.lit("## 事件描述"), told, F.lit(""))),), F.when(F.size(r["options"]) > 0, "## 选项与判定"), (F.transform(r["options"], option),), under("## E.G.O饰品", gifts), under("## 关联异想体", items(r["related_abnormalities"]))
    )
    return F.array(_chunk("event", content, title))


#: The builder of each page type.
BUILDERS = {"personality": personality, "ego": ego, "ego_gift": gift, "story_dialogue": story_dialogue, "story_note": story_note, "status_effect": status_effect, "knowledge": knowledge, "enemy": enemy, "event": event}


def chunks(record: Column) -> Column:
    """The chunks (section, label, content) of a record of SCHEMA, by its page type; none for another type or a null."""
    out = F.array().cast(CHUNK)
    for kind, build in BUILDERS.items():
        out = F.when(record["page_type"] == kind, build(record)).otherwise(out)
    return out
