"""Formatters of nested columns: arrays and structs to text, nulls and blanks left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def signed(c: Column) -> Column:
    """A whole number with its sign, also of positive ones."""
    return F.concat(F.when(c > 0, "+").otherwise(""), c.cast("string"))


def chosen_stage(stages: Column, top: str = "IV") -> Column:
    """The first stage named top, else the last of the group; null for none."""
    return F.coalesce(F.try_element_at(F.filter(stages, lambda s: s["stage"] == top), F.lit(1)), F.try_element_at(stages, F.lit(-1)))


def stage_line(s: Column, none: str = "no stage") -> Column:
    """Stage, base value or a dash, signed power if there is one."""
    base = F.concat(s["stage"], F.lit(": base "), F.coalesce(s["base"].cast("string"), F.lit("-")))
    return F.when(s.isNull(), none).otherwise(F.concat(base, F.coalesce(F.concat(F.lit(" | power "), signed(s["power"])), F.lit(""))))


def skill_name(name: Column, described: Column, number: Column) -> Column:
    """The real name, else the one found in the descriptions, else skill N."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(some(name), some(described), F.concat(F.lit("skill "), number.cast("string")))


def skill_header(key: Column, name: Column) -> Column:
    """By the key: strengthened N, guard, N variant M, N; without a key the name alone."""
    n = F.regexp_extract(key, r"^(?:strong)?(\d+)", 1)
    head = (
        F.when(key.rlike(r"^strong\d+"), F.concat(F.lit("[strong skill "), n, F.lit("] ")))
        .when(key.startswith("guard"), F.lit("[guard] "))
        .when(key.rlike(r"^\d+-\d+"), F.concat(F.lit("[skill "), n, F.lit(" variant] ")))
        .when(key.rlike(r"^\d+"), F.concat(F.lit("[skill "), n, F.lit("] ")))
    )
    return F.concat(F.coalesce(head, F.lit("")), name)


def table_line(prefix: str, pairs: Column) -> Column:
    """key:value of an array of structs (k, v) in order, entries without a value left out; null for none."""
    shown = F.transform(F.filter(pairs, lambda p: p["v"].isNotNull()), lambda p: F.concat(p["k"], F.lit(":"), p["v"].cast("string")))
    return F.when(F.size(shown) > 0, F.concat(F.lit(prefix), F.array_join(shown, "  ")))


def numbered(items: Column) -> Column:
    """1. first, 2. second and so on, a line each."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def nodes(sections: Column, sender: str) -> Column:
    """Sections with other than white space as numbered nodes of one sender."""
    kept = F.filter(F.transform(sections, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    return F.transform(kept, lambda s, i: F.struct((i + 1).alias("position"), F.lit(sender).alias("sender"), s.alias("content")))


def segments(text: Column, images: Column, videos: Column, most: float) -> Column:
    """Text, then images, then videos (structs of url and mb; those over the bound as a link) as typed segments, blanks left out."""
    one = lambda kind, data: F.struct(F.lit(kind).alias("type"), data.alias("data"))
    none = F.array().cast("array<struct<type:string,data:string>>")
    said = F.when(F.trim(text) != "", F.array(one("text", text))).otherwise(none)
    film = lambda v: F.when(v["mb"] <= most, one("video", v["url"])).otherwise(one("text", F.concat(F.lit("video: "), v["url"])))
    return F.concat(said, F.transform(F.coalesce(images, F.array()), lambda u: one("image", u)), F.transform(videos, film))
