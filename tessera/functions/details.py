"""Texts of the finer parts of records: passives by side, voices, gifts, effects of coins, stages with effects, facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.chunkers import after, each, lines, some
from tessera.functions.formats import signed
from tessera.functions.rewriting import let

#: Descriptions that only name a value: fixed values.
TAGS = ("基础值", "硬币威力", "攻击等级", "攻击容量", "变动值")
_PASSIVE = r"^人格被动(\d+)"


def stage_with_effects(s: Column) -> Column:
    """Stage, base value or a dash, signed power, and the effects that say something."""
    said = F.filter(s["effects"], lambda e: some(e["description"]).isNotNull())
    shown = F.transform(said, lambda e: F.concat(F.coalesce(F.concat(F.lit("["), some(e["timing"]), F.lit("] ")), F.lit("")), e["description"]))
    head = F.concat(F.coalesce(s["stage"], F.lit("")), F.lit("阶：基础值 "), F.coalesce(s["base_value"].cast("string"), F.lit("—")))
    return F.concat(head, F.coalesce(after(" | 变动值 ", signed(s["coin_power"])), F.lit("")), let(shown, lambda x: F.when(F.size(x) > 0, F.concat(F.lit(" | "), F.array_join(x, "；"))).otherwise("")))


def skill_title(key: Column, name: Column, guard: Column, place: Column) -> Column:
    """The heading of a skill by its key (strengthened, guard, derived, numbered), by its place (from 0) where it has none."""
    number = lambda c: F.coalesce(F.try_element_at(F.array(*(F.lit(x) for x in "一二三四五六七八九十")), c.try_cast("int")), c.cast("string"))
    head = lambda what: F.concat(F.lit("【"), what, F.lit("】"), name)

    def titled(k):
        key, strong, derived, plain = (k[c] for c in ("key", "strong", "derived", "plain"))
        keyed = F.concat(F.lit("（"), key, F.lit("）"))
        return (
            F.when(strong != "", F.concat(head(F.concat(F.lit("强化技能"), number(strong))), keyed)).when(guard | F.coalesce(key.startswith("守备"), F.lit(False)), head(F.lit("守备技能")))
            .when(derived != "", F.concat(head(F.concat(F.lit("技能"), number(derived), F.lit("衍生"))), keyed)).when(plain != "", head(F.concat(F.lit("技能"), number(plain)))).otherwise(head(F.concat(F.lit("技能"), number(place + 1))))
        )

    kinds = {"strong": r"^强化(\d+)技能", "derived": r"^(\d+)技能\d+", "plain": r"^(\d+)技能"}
    return let(key, lambda key: let(F.struct(key.alias("key"), *(F.regexp_extract(key, p, 1).alias(c) for c, p in kinds.items())), titled))


def coin_says(e: Column) -> Column:
    """Whether an effect of a coin says more than a number or the name of a value."""
    text = F.trim(F.coalesce(e["description"], F.lit("")))
    return (text != "") & ~text.rlike(r"^[+-]?[0-9]+$") & ~text.isin(*TAGS)


def coin_line(e: Column) -> Column:
    """[timing] and the description, unless that begins so."""
    text, timing = F.trim(F.coalesce(e["description"], F.lit(""))), F.coalesce(e["timing"], F.lit(""))
    bracket = F.concat(F.lit("["), timing, F.lit("]"))
    return F.when(text.startswith(bracket) | (timing == ""), text).otherwise(F.concat(bracket, F.lit(" "), text))


def coins_merged(effects: Column) -> Column:
    """A line for each coin, in the order of first mention, with all that is said of it, each thing once."""
    used = F.filter(effects, lambda e: (F.coalesce(e["coin_index"], F.lit(0)) > 0) & coin_says(e))
    coins = lambda used: F.array_distinct(F.transform(used, lambda e: e["coin_index"]))
    said = lambda used, c: F.array_distinct(F.transform(F.filter(used, lambda e: e["coin_index"] == c), coin_line))
    merged = lambda used: F.transform(coins(used), lambda c: F.concat(F.lit("硬币"), c.cast("string"), F.lit("："), F.array_join(said(used, c), "；")))
    return let(used, merged)


def passive_item(text: Column, names: Column) -> Column:
    """A passive as it is, or a reference with the name and text that a map id -> struct(name, description, side) has, else a note."""
    id_ = F.regexp_extract(F.trim(text), _PASSIVE, 1)
    known = F.try_element_at(names, id_)
    both = F.concat_ws("：", some(known["name"]), some(known["description"]))
    return F.when(F.trim(text) == "", None).when(id_ == "", F.trim(text)).otherwise(F.coalesce(some(both), F.concat(F.lit("人格被动 "), id_, F.lit("（详见人格被动页面）"))))


def passives(battle: Column, support: Column, names: Column) -> Column:
    """Passives by side, a line each: those of the battle text whose reference belongs to support go there."""
    items = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    helps = lambda x: F.coalesce(F.try_element_at(names, F.regexp_extract(F.trim(x), _PASSIVE, 1))["side"].contains("支援"), F.lit(False))
    group = lambda name, c: (F.when(F.size(c) > 0, F.concat(F.array(F.lit(name)), F.transform(c, lambda x: F.concat(F.lit("- "), passive_item(x, names))))),)
    told = lambda all_: lines(F.lit("被动技能："), group("战斗：", all_["fights"]), group("支援：", all_["aids"]), F.lit(""))
    sides = lambda mine: F.struct(F.filter(mine, lambda x: ~helps(x)).alias("fights"), F.concat(F.filter(mine, helps), items(support)).alias("aids"))
    return let(items(battle), lambda mine: let(sides(mine), told))


def voices(spoken: Column, called: Column, most: int = 20) -> Column:
    """Spoken lines with their title, or the file; voices of skills with their file; as many of each as stated."""
    one = lambda v: F.when(some(v["title"]).isNotNull(), F.concat(F.lit("- ["), v["title"], F.lit("] "), F.coalesce(v["text"], F.lit("")))).otherwise(after("- ", F.coalesce(some(v["text"]), some(v["file"]))))
    name = lambda v: F.coalesce(some(v["skill_name"]), some(v["skill_label"]))
    skill = lambda v: F.coalesce(F.concat(F.lit("- "), name(v), F.lit("（"), some(v["file"]), F.lit("）")), after("- ", F.coalesce(name(v), some(v["file"]))))
    part = lambda title, c, f: (F.when(F.size(c) > 0, F.concat(F.array(F.lit(title)), F.filter(F.transform(F.slice(c, 1, most), f), lambda x: x.isNotNull()), F.array(F.lit("")))),)
    return lines(part("语音台词：", spoken, one), part("技能语音：", called, skill))


def gifts(c: Column) -> Column:
    """Gifts, a line each, by the first text that they have."""
    return lines(each(F.transform(c, lambda g: F.coalesce(some(F.trim(g["name"])), some(F.trim(g["effect"])))), lambda t: after("　- ", t)))


def unit_facts(r: Column, stages: int = 4) -> Column:
    """What is known of a unit in short: place, numbers, blows, the first passive, the first skills."""
    number = lambda k: after(f"  {k}：", some(r[k].cast("string")))
    blows = F.transform(F.map_entries(r["physical_resistances"]), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    skills = F.filter(F.transform(F.slice(r["skills"], 1, stages), lambda s: some(s["skill_name"])), lambda n: n.isNotNull())
    return lines(
        F.concat(F.lit("- 敌方单位："), F.coalesce(some(r["enemy_name"]), F.lit("?"))), after("  登场关卡：", some(F.trim(r["battle_stage"]))), number("hp"), number("defense_level"), number("chaos_threshold"), F.when(F.size(blows) > 0, F.concat(F.lit("  物理抗性："), F.array_join(blows, " "))),
        after("  被动（首条）：", F.substring(F.try_element_at(r["passives"], F.lit(1)), 1, 80)), F.when(F.size(skills) > 0, F.concat(F.lit("  技能："), F.array_join(skills, "、"))),
    )


def identity(name: Column) -> Column:
    """(bare, note) of 'group - name (phase)': the bare name, and the group with the phase."""
    parts = F.split(name, " - ")
    bare = F.trim(F.regexp_replace(F.element_at(parts, -1), "[（(].*?[)）]", ""))
    group = F.trim(F.array_join(F.slice(parts, 1, F.size(parts) - 1), " - "))
    return F.struct(bare.alias("bare"), F.trim(F.concat(group, F.regexp_extract(name, "[（(].*?[)）]", 0))).alias("note"))


def cut(c: Column, n: int, sign: str = "…") -> Column:
    """At most n characters, with a sign where more follow."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n), F.lit(sign)))


def story_facts(name: Column, note: Column, said: Column, focus: Column, talks: Column) -> Column:
    """Identity, lines (title, text) and talks (title, text, answer) with a focus role; empty without lines and identity."""
    told = F.transform(said, lambda s: F.concat(F.lit("  ·（"), s["title"], F.lit("）"), cut(s["text"], 70)))
    pair = lambda t: F.concat(F.lit("  ·（"), t["title"], F.lit("）"), name, F.lit("："), F.substring(t["text"], 1, 50), F.lit("\n    "), focus, F.lit("："), F.substring(t["answer"], 1, 50))
    whole = lines(
        after("- 身份：", some(note)), (F.when(F.size(said) > 0, F.concat(F.array(F.concat(F.lit("- 剧情登场（"), name, F.lit("）："))), told)),), (F.when((F.size(talks) > 0) & (focus != ""), F.concat(F.array(F.concat(F.lit("- 与"), focus, F.lit("的剧情互动："))), F.transform(talks, pair))),)
    )
    return F.when((F.coalesce(F.size(said), F.lit(0)) <= 0) & some(note).isNull(), "").otherwise(whole)
