"""Cleaning of records of one type: contents without labels, choices and names without junk, units with all their fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line of costs, line of a version, first line of labels: fixed patterns.
COST, VERSION, LABELS = r"(?m)^镜牢经费(?:\.png)?[：:][^\n]*\n?", r"(?m)^[（(](?:未强化版|强化版·[ⅠⅡⅢ]+级)[）)]\s*$", r"^[^\n]*?：\[[^\]]*\](?:\[[^\]]*\])?"
#: What is no name: fixed values.
RATING, PLACEHOLDERS = r"(?:ZAYIN|TETH|HE|WAW|ALEPH|HELCE|TETHLCE)评级", ("事件触发地点[编辑]", "无", "触发地点[编辑]")
BLOWS, SINS = ("斩击", "突刺", "打击"), ("暴怒", "色欲", "怠惰", "暴食", "忧郁", "傲慢", "嫉妒")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def gift_content(c: Column) -> Column:
    """A gift's text without its cost line, its version line and a first line of labels; at most one blank line together; null is empty."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), COST, ""), VERSION, "")
    first = F.substring_index(text, "\n", 1)
    rest = F.when(strip(first).rlike(LABELS), F.substring(text, F.length(first) + 2, F.length(text))).otherwise(text)
    return strip(F.regexp_replace(rest, r"\n{3,}", "\n\n"))


def sin_name(c: Column) -> Column:
    """Without the ending of an image."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)\.png$", "")


def names(c: Column) -> Column:
    """An array of names without blanks, placeholders and ratings; null is empty."""
    trimmed = F.transform(F.coalesce(c, F.array().cast("array<string>")), strip)
    return F.filter(trimmed, lambda s: s.isNotNull() & (s != "") & ~s.isin(*PLACEHOLDERS) & ~s.rlike(RATING))


def unit_id(stage: Column, name: Column, part: Column) -> Column:
    """stage|name|part, each trimmed, nulls empty."""
    return F.concat_ws("|", *(strip(F.coalesce(c, F.lit(""))) for c in (stage, name, part)))


def speed_shown(low: Column, high: Column) -> Column:
    """low~high, or low alone; null without it."""
    return F.when(low.isNotNull(), F.concat_ws("~", low.cast("string"), high.cast("string")))


def with_all(c: Column, keys: tuple[str, ...], default: float = 1.0) -> Column:
    """A map with at least these keys; given values and further keys stay."""
    given = F.coalesce(c, F.create_map().cast("map<string,double>"))
    missing = F.filter(F.array(*map(F.lit, keys)), lambda k: ~F.map_contains_key(given, k))
    return F.map_concat(given, F.map_from_entries(F.transform(missing, lambda k: F.struct(k.alias("key"), F.lit(default).alias("value")))))
