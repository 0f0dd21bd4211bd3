"""URL filter: rules first, then naive Bayes over words that a unigram Viterbi search finds in hosts and paths."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize

UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words meet names by so many code points; what a longer word has beyond them is compared in the search itself.
KEY = 32


def segment(name: str, known: dict[int, list[tuple[int, float]]], total: float) -> list[str]:
    """The most probable words of name. known: (length, count) of the words by their start.

    A stretch that is no word costs more by its length, whatever that is; its cost is linear, so the best start of such
    a stretch is carried along and the search takes one step a letter besides its words.
    """
    n, letter = len(name), math.log(10)
    best, back = [-math.inf] * (n + 1), [0] * (n + 1)
    best[0], carried, since = 0.0, -math.inf, 0
    ends: dict[int, list[tuple[int, float]]] = {}
    for at in range(n + 1):
        for start, count in ends.pop(at, ()):
            p = best[start] + math.log(count / total)
            if p > best[at]:
                best[at], back[at] = p, start
        if at:
            p = carried + 1 - math.log(total) - at * letter
            if p > best[at]:
                best[at], back[at] = p, since
        if best[at] + at * letter > carried:
            carried, since = best[at] + at * letter, at
        for length, count in known.get(at, ()):
            ends.setdefault(at + length, []).append((at, count))
    out, end = [], n
    while end:
        out.append(name[back[end] : end])
        end = back[end]
    return out[::-1]


def _keys(lengths):
    """(name, start, key) for the pieces of each name, from each letter, that have the length of some word's key."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name in batch.column("name").to_pylist():
                for a in range(0, len(name), 4096):
                    found = [(i, name[i : i + k]) for i in range(a, min(a + 4096, len(name))) for k in lengths.value if i + k <= len(name)]
                    if found:
                        start, key = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array([hash_name(name)] * len(start), pa.int64()), pa.array(start, pa.int64()), pa.array(key, pa.string())], ["name_hash", "start", "key"])

    return run


def hash_name(name: str) -> int:
    """64 bits of a digest, by which the pieces of a name, which may be long, find it again."""
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "big", signed=True)


def _with_hash(batches):
    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([hash_name(x) for x in batch.column("name").to_pylist()], pa.int64())], [*batch.schema.names, "name_hash"])


def _segments(total: float):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            cut = []
            for name, found in zip(batch.column("name").to_pylist(), batch.column("found").to_pylist(), strict=True):
                known: dict[int, list[tuple[int, float]]] = {}
                for x in found or []:
                    if len(x["word"]) <= KEY or name.startswith(x["word"], x["start"]):
                        known.setdefault(x["start"], []).append((len(x["word"]), x["count"]))
                cut.append(segment(name, {k: sorted(v) for k, v in known.items()}, total))
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(cut, pa.list_(pa.string()))], ["name", "words"])

    return run


def parse(url):
    """Columns host and path of a URL column."""
    plain = F.coalesce(url, F.lit(""))
    part = lambda k: F.regexp_extract(plain, r"(?s)\A.*?://([^/?#]*)([^?#]*)", k)
    return F.translate(part(1), UPPER, LOW), part(2)


def longest_rule(host, path, rules: list[tuple[str, str]]):
    """The struct (rule, verdict) of the longest rule (host, then path from its first slash) that fits; of two as long, the last of rules."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda x: len(x[0])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def corpus_words(pages: DataFrame) -> DataFrame:
    """(word, count) over the text of all pages; tags are no words."""
    text = F.lower(F.regexp_replace("html", r"<[^>]*>", " "))
    return pages.select(F.explode(F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0))).alias("word")).groupBy("word").count()


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row of pages.

    Rules decide where one fits. They also label the training rows: naive Bayes (add-one smoothing) learns the words of
    all pages that a rule decides, and blocks another page if its log odds (score) are above 0. Words are counted over
    the whole html of all pages; words and names may have any length. A null url, or one without ://, has an empty host and path, no words and the log odds
    of the classes; without pages of both classes every other page is allowed. A null html has no words. Equal rows get
    equal results; an empty table gives no rows; further columns are ignored. rules is a short list in the plan.
    """
    spark, (host, path) = pages.sparkSession, parse(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules))
    names = F.regexp_extract_all(F.lower(F.concat_ws(" ", "host", "path")), F.lit(r"\p{L}+"), F.lit(0))
    rows = materialize(rows.select("page_id", "host", "path", "fit.rule", F.col("fit.verdict").alias("ruled"), names.alias("names"), F.monotonically_increasing_id().alias("row")))
    words = materialize(corpus_words(pages))
    total = float(words.agg(F.sum("count")).first()[0] or 1)

    # counts of a name by class; each distinct name is cut once
    named = materialize(rows.select(F.explode("names").alias("name"), "ruled").groupBy("name").agg(F.count_if(F.col("ruled") == "block").alias("block"), F.count_if(F.col("ruled") == "allow").alias("allow")))
    # how long keys of words are: KEY different numbers at most
    lengths = spark.sparkContext.broadcast(sorted(r[0] for r in words.select(F.least(F.length("word"), F.lit(KEY))).distinct().collect()))
    pieces = named.select("name").mapInArrow(_keys(lengths), "name_hash long, start long, key string")
    hits = pieces.join(words.withColumn("key", F.substring("word", 1, KEY)).hint("merge"), "key")
    found = hits.groupBy("name_hash").agg(F.collect_list(F.struct("start", "word", "count")).alias("found"))
    marked = named.select("name").mapInArrow(_with_hash, "name string, name_hash long")
    cut = materialize(marked.join(found.hint("merge"), "name_hash", "left").select("name", "found").mapInArrow(_segments(total), "name string, words array<string>"))

    by_word = cut.join(named.hint("merge"), "name").select(F.explode("words").alias("word"), "block", "allow").groupBy("word").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"))
    by_word = materialize(by_word)
    b, a, v = by_word.agg(F.sum("block"), F.sum("allow"), F.count("*")).first()
    classes = rows.agg(F.count_if(F.col("ruled") == "block"), F.count_if(F.col("ruled") == "allow")).first()
    both = bool(classes[0] and classes[1])
    odds = F.log((F.col("block") + 1) / F.lit(float(max(1, (b or 0) + (v or 0))))) - F.log((F.col("allow") + 1) / F.lit(float(max(1, (a or 0) + (v or 0)))))
    # written, so that the join below has a plain exchange on either side and Spark can split a name of many rows
    per_name = materialize(cut.select("name", F.explode("words").alias("word")).join(by_word.select("word", odds.alias("odds")).hint("merge"), "word").groupBy("name").agg(F.sum("odds").alias("odds")))
    scored = rows.select("row", F.explode("names").alias("name")).join(per_name.hint("merge"), "name").groupBy("row").agg(F.sum("odds").alias("odds"))
    prior = math.log(classes[0] / classes[1]) if both else 0.0
    score = F.coalesce("odds", F.lit(0.0)) + prior if both else F.lit(0.0)
    out = rows.join(scored.hint("merge"), "row", "left").withColumn("score", score)
    verdict = F.coalesce("ruled", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
