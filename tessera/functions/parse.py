"""Column functions that read numbers, names and references out of short strings."""

from pyspark.sql import functions as F

#: Digits of Chinese numerals: fixed values.
DIGITS = {"零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}


def _digit(c):
    out = F.lit(None).cast("int")
    for k, v in DIGITS.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def numeral(c):
    """零 to 九十九 as an int; anything else null."""
    tens, ones = F.regexp_extract(c, "^(.?)十", 1), F.regexp_extract(c, "十(.?)$", 1)
    with_ten = F.when(tens == "", 1).otherwise(_digit(tens)) * 10 + F.when(ones == "", 0).otherwise(_digit(ones))
    return F.when(c.rlike("^.?十.?$"), with_ten).otherwise(_digit(c))


def speed(c):
    """a-b, a~b or a as a struct (min, max)."""
    low = F.try_to_number(F.nullif(F.regexp_extract(c, r"^\s*(\d{1,9})", 1), F.lit("")), F.lit("999999999")).cast("int")
    high = F.try_to_number(F.nullif(F.regexp_extract(c, r"[-~]\s*(\d{1,9})\s*$", 1), F.lit("")), F.lit("999999999")).cast("int")
    return F.struct(low.alias("min"), F.coalesce(high, low).alias("max"))


def factor(c):
    """The first ×number as a double, else null."""
    return F.nullif(F.regexp_extract(c, r"×\s*(\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")


def whole(c):
    """An int, 0 where it is none."""
    return F.coalesce(F.trim(c).try_cast("int"), F.lit(0))


def chapter(c):
    """n-n or n-n-n, or the number of 第N章, as a string; else null."""
    dashed = F.regexp_extract(c, r"(?<!\d)(\d+-\d+(?:-\d+)?)(?!\d)", 1)
    named = F.regexp_extract(c, "第([0-9]+|[零一二两三四五六七八九十]+)章", 1)
    return F.coalesce(F.nullif(dashed, F.lit("")), F.when(named.rlike("^[0-9]+$"), named), numeral(named).cast("string"))


def clamped_scores(c, n: int, low: int = 0, high: int = 10, missing: int = 5):
    """The first n ints, clamped, the rest filled."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"\d{1,6}"), F.lit(0)), lambda x: F.least(F.lit(high), F.greatest(F.lit(low), x.cast("int"))))
    return F.slice(F.concat(found, F.array_repeat(F.lit(missing), n)), 1, n)


def bare_role(c):
    """What stands after the last ' - ', without bracketed parts."""
    return F.trim(F.regexp_replace(F.element_at(F.split(c, " - "), -1), "[（(].*?[)）]", ""))


def with_defaults(given, keys: list[str], default: float):
    """A map with all of keys, missing ones at the default."""
    base = F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*[F.lit(default)] * len(keys)))
    return F.map_zip_with(base, F.coalesce(given, F.create_map().cast("map<string,double>")), lambda _, a, b: F.coalesce(b, a))


def segments_text(c):
    """An array of struct(type, data) as one text; other types than text appear as [type:data]."""
    return F.array_join(F.transform(c, lambda s: F.when(s["type"] == "text", s["data"]).otherwise(F.concat(F.lit("["), s["type"], F.lit(":"), s["data"], F.lit("]")))), "")


#: Signs of stages in the order in which they are looked for: fixed values. A text with II has I in it, and is so read.
STAGE_SIGNS = {"Ⅰ": "I", "Ⅱ": "II", "Ⅲ": "III", "Ⅳ": "IV", "I": "I", "II": "II", "III": "III", "IV": "IV", "1": "I", "2": "II", "3": "III", "4": "IV"}


def stage_number(c):
    """The stage of the first sign that a text has, else the text without its outer spaces."""
    return F.coalesce(*(F.when(c.contains(sign), stage) for sign, stage in STAGE_SIGNS.items()), F.trim(c))


def of_title(title, names: dict[str, str]):
    """(name, id) of the person that a title begins with, or that stands behind its last dash; empty texts without one."""
    tail = F.when(title.contains("-"), F.regexp_extract(title, r"-([^-]*)$", 1))
    name = F.coalesce(*(F.when(title.startswith(n), n) for n in names), *(F.when(tail == n, n) for n in names), F.lit(""))
    id_ = F.coalesce(*(F.when(name == n, i) for n, i in names.items()), F.lit(""))
    return F.struct(name.alias("name"), id_.alias("id"))


def person_of(title, names: dict[str, str]):
    """The person that a title begins with, else what stands before its first dash, else the title."""
    return F.coalesce(*(F.when(title.startswith(n), n) for n in names), F.substring_index(title, "-", 1))


def skill_key(key, guard, place):
    """The key of a skill: its own, or by its place (from 0) and whether it guards."""
    number = (place + 1).cast("string")
    return F.coalesce(F.nullif(key, F.lit("")), F.when(F.nullif(guard, F.lit("")).isNotNull(), F.concat(F.lit("守备技能"), number)), F.concat(number, F.lit("技能")))


def guards(guard, descriptions):
    """Whether a skill guards: it has a kind of guard, or one of its descriptions says just that."""
    return (F.coalesce(guard, F.lit("")) != "") | F.coalesce(F.exists(descriptions, lambda d: F.trim(d) == "守备技能"), F.lit(False))


def same_letters(c, variants: dict[str, str]):
    """A text with variants of letters made one; null is empty."""
    return F.translate(F.coalesce(c, F.lit("")), "".join(variants), "".join(variants.values()))


def without_prefix(c, prefix: str):
    """A trimmed text without its prefix; null is empty."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    return F.when(t.startswith(prefix), F.regexp_replace(F.substring(t, len(prefix) + 1, 2**31 - 1), r"^\s+|\s+$", "")).otherwise(t)


def filtered_type(filter_json):
    """The page type that a filter in JSON asks for, alone or as the first of several conditions; null without one."""
    f = F.try_parse_json(filter_json)
    own = F.try_variant_get(f, "$.page_type", "string")
    several = F.try_variant_get(f, "$['$and']", "array<variant>")
    inner = F.filter(F.transform(several, lambda v: F.try_variant_get(v, "$.page_type", "string")), lambda t: t.isNotNull())
    return F.coalesce(own, F.try_element_at(inner, F.lit(1)))


def document_key(title, content, n: int = 80):
    """title::beginning of the content."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit("::"), F.substring(F.coalesce(content, F.lit("")), 1, n))


def named_stage(stage, labels: dict[str, str], plain: str):
    """The label of a stage, else the stage itself, else the plain one."""
    known = F.coalesce(*(F.when(stage == k, v) for k, v in labels.items()))
    return F.coalesce(known, F.nullif(stage, F.lit("")), F.lit(plain))
