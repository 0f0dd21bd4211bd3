"""Names inside texts: dictionaries as tables met by their first letters, so that neither side is broadcast or crossed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contained(texts: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """Pairs (key, name) of texts and names that stand somewhere in them, each once, with the first place (from 0).

    Names meet texts by their first two characters (or the only one); nulls and empty names meet nothing.
    """
    head = lambda c, at=1: F.substring(c, at, 2) if isinstance(at, int) else F.substring(c, at, F.lit(2))
    codes = names.select(name).filter(F.length(name) > 0).distinct().withColumn("head", head(name))
    longest = codes.agg(F.max(F.length(name))).first()[0] or 0  # one number
    places = texts.filter(F.length(text) > 0).select(key, text, F.explode(F.sequence(F.lit(1), F.length(text))).alias("i"))
    places = places.select(key, (F.col("i") - 1).alias("place"), F.substring(text, F.col("i"), F.lit(max(longest, 1))).alias("ahead"))
    two = places.withColumn("head", head("ahead"))
    one = places.filter(F.length("ahead") > 1).withColumn("head", F.substring("ahead", 1, 1))
    hits = two.unionByName(one).join(codes, "head").filter(F.startswith("ahead", name))
    return hits.groupBy(key, name).agg(F.min("place").alias("place"))


def contained_by_length(texts: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """contained for many names that begin alike: the same pairs.

    Names meet texts by their first two characters (or the only one), of which only the lengths of names that begin so
    are known, then by all of them: a place costs the lengths that its beginning has, not the names. Nulls and empty
    names meet nothing.
    """
    codes = names.select(name).filter(F.length(name) > 0).distinct()
    heads = codes.groupBy(F.substring(name, 1, 2).alias("head")).agg(F.collect_set(F.length(name)).alias("lengths"))
    places = texts.filter(F.length(text) > 0).select(key, text, F.explode(F.sequence(F.lit(1), F.length(text))).alias("i"))
    head = F.substring(F.col(text), F.col("i"), F.lit(2))
    two = places.withColumn("head", head)
    one = places.withColumn("head", F.substring(head, 1, 1)).filter(F.length(text) > F.col("i"))
    begun = two.unionByName(one).join(heads, "head").withColumn("n", F.explode("lengths"))
    said = begun.filter(F.col("i") + F.col("n") - 1 <= F.length(text)).select(key, (F.col("i") - 1).alias("place"), F.substring(F.col(text), F.col("i"), F.col("n")).alias(name))
    hits = said.join(codes, name)
    return hits.groupBy(key, name).agg(F.min("place").alias("place"))


def bare(c: str | Column) -> Column:
    """What stands after the last ' - ', without bracketed parts."""
    last = F.trim(F.element_at(F.split(c, " - "), -1))
    return F.trim(F.regexp_replace(last, "[（(].*?[)）]", ""))


def closed(c: str | Column) -> Column:
    """Without spaces and middle dots."""
    return F.translate(c, " ·", "")


def variants(names: DataFrame, name: str = "name") -> DataFrame:
    """(name, form, variant): every name as it is, its last part, its bare form, both without spaces; empty and equal ones go."""
    n = F.col(name)
    tail = F.when(n.contains(" - "), F.trim(F.element_at(F.split(n, " - "), -1)))
    forms = {"name": n, "tail": tail, "bare": bare(n), "closed": closed(n), "closed_bare": closed(bare(n))}
    each = F.array(*(F.struct(F.lit(k).alias("form"), v.alias("variant")) for k, v in forms.items()))
    rows = names.select(n.alias("name"), F.explode(each).alias("v")).select("name", "v.*").filter(F.length("variant") > 0)
    return rows.filter((F.col("form") == "name") | (F.col("variant") != F.col("name"))).distinct()


def detect(messages: DataFrame, key: str, text: str, names: DataFrame, general: tuple[str, ...]) -> DataFrame:
    """(key, found, tier) for the messages that name something of names (name); tier 3 gives a variant only.

    1: the message contains a name or a name contains the message; 2: the same without spaces; 3: the longest variant in
    the message. In a tier the name equal to the message wins, then the longest match, then the first name. Names and
    messages that are too general count for nothing, and so do messages of one letter inside a name.
    """
    m = messages.select(key, F.trim(text).alias("q")).filter("q <> ''")
    q = m.select("q").distinct().withColumn("q_closed", closed("q"))
    n = names.select("name").filter("name <> ''").distinct().withColumn("n_closed", closed("name"))
    usable = lambda c: ~F.col(c).isin(*general) & (F.length(c) > 1)
    best = lambda hits, tier: hits.groupBy("q").agg(F.min(F.struct(F.when(F.col("match") == F.col("q"), 0).otherwise(1).alias("other"), (-F.length("match")).alias("less"), F.col("name").alias("found"))).alias("b")).select("q", "b.found", F.lit(tier).alias("tier"))

    def both(mine, theirs):
        forward = contained(q, mine, mine, n, theirs).select(mine, theirs).join(n, theirs).filter(~F.col("name").isin(*general)).select(mine, "name", F.col(theirs).alias("match"))
        backward = contained(n, theirs, theirs, q.filter(usable(mine)), mine).select(mine, theirs).join(n, theirs).select(mine, "name", F.col(mine).alias("match"))
        return q.join(forward.unionByName(backward).distinct(), mine).select("q", "name", "match")

    first = best(both("q", "name"), 1)
    second = best(both("q_closed", "n_closed").join(q.filter(F.length("q_closed") > 1), "q", "leftsemi"), 2)
    spoken = variants(names).filter(F.col("form") != "name").filter(~F.col("variant").isin(*general))
    plain, close = (spoken.filter(F.col("form").isin(*f)).select("variant").distinct() for f in (("tail", "bare", "closed_bare"), ("closed",)))
    third = contained(q, "q", "q", plain, "variant").select("q", "variant").unionByName(contained(q, "q_closed", "q_closed", close, "variant").join(q, "q_closed").select("q", "variant"))
    third = third.groupBy("q").agg(F.min(F.struct((-F.length("variant")).alias("less"), F.col("variant").alias("found"))).alias("b")).select("q", "b.found", F.lit(3).alias("tier"))
    every = first.unionByName(second).unionByName(third).groupBy("q").agg(F.min_by(F.struct("found", "tier"), "tier").alias("b"))
    return m.join(every, "q").select(key, "b.found", "b.tier")


def cascade(messages: DataFrame, key: str, text: str, tagged: DataFrame, tag: str) -> DataFrame:
    """(key, title, tier): of the tagged names (code, title, tier, rank, any_case, needs_tag) in a message the first by tier, then rank, longest and title.

    Codes match in any case where any_case is set; those that need the tag count only in messages that match its pattern.
    """
    m = messages.select(key, F.col(text).alias("said"), F.lower(text).alias("low"))
    codes = tagged.withColumn("low_code", F.lower("code"))
    hits = contained_by_length(m, key, "low", codes, "low_code").select(key, "low_code").join(codes, "low_code").join(m, key)
    fits = (F.col("any_case") | F.col("said").contains(F.col("code"))) & (~F.col("needs_tag") | F.col("said").rlike(tag))
    order = F.struct("tier", "rank", (-F.length("code")).alias("less"), "title")
    return hits.filter(fits).groupBy(key).agg(F.min(order).alias("b")).select(key, "b.title", "b.tier")
