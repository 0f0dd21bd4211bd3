"""Ranked retrieval: BM25, cosine, fusion, boosts and widening rounds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.nearest import close_pairs
from tessera.functions.rounding import micro
from tessera.plans.catalog import query
from tessera.sources.staged import staged

QUERY = ("thon", "onan", "was")
K1, B, EPSILON = 1.5, 0.75, 0.25


def bm25(docs, terms, okapi: bool = False):
    """doc_id and score of every document; one pass for the statistics, one for the scores, no shuffle of texts.

    The idf is ln(1 + (N - df + 0.5) / (df + 0.5)); with okapi it has no 1 +, and a negative one becomes EPSILON times
    the mean over all words.
    """
    toks = docs.select("doc_id", T.tokens(F.col("text")).alias("t"))
    tf = toks.select("doc_id", F.size("t").alias("dl"), *((F.size("t") - F.size(F.array_remove("t", w))).alias(f"tf{i}") for i, w in enumerate(terms)))
    stats = tf.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    if okapi:
        df = toks.select(F.explode(F.array_distinct("t")).alias("w")).groupBy("w").count()
        mean = df.crossJoin(F.broadcast(docs.agg(F.count("*").alias("n")))).agg(F.avg(F.log(F.col("n") - F.col("count") + 0.5) - F.log(F.col("count") + 0.5)).alias("mean"))
        stats = stats.crossJoin(F.broadcast(mean))
    both = tf.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        f, d = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log((F.col("n") - d + 0.5) / (d + 0.5) + (0 if okapi else 1))
        if okapi:
            idf = F.when(idf < 0, EPSILON * F.col("mean")).otherwise(idf)
        score = score + F.when(f > 0, idf * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).otherwise(0.0)
    return both.select("doc_id", score.alias("score"))


def top(df, key, k, score="score"):
    return df.orderBy(F.desc(score), key).limit(k)


def cosine(vectors, query_id: int):
    """vec_id and cosine with one vector, which is broadcast as a row; a zero norm gives 0."""
    v = vectors.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    one = v.filter(F.col("vec_id") == query_id).select(F.col("v").alias("q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot("v", "v")) * F.sqrt(dot("q", "q"))
    return v.crossJoin(F.broadcast(one)).select("vec_id", "label", F.coalesce(F.try_divide(dot("v", "q"), F.nullif(norm, F.lit(0.0))), F.lit(0.0)).alias("score"))


_T = "".join(f", len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(QUERY))
_BASE = f"""tok AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}]+'), lambda x: x <> '') AS t FROM documents),
 tf AS (SELECT doc_id, len(t) AS dl{_T} FROM tok),
 st AS (SELECT count(*) AS n, avg(dl) AS avgdl{"".join(f", count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(QUERY)))} FROM tf)"""
_PART = "(tf{i} * 2.5::DOUBLE) / (tf{i} + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))"
_SUM = " + ".join(f"CASE WHEN tf{i} > 0 THEN ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE) + 1) * {_PART.format(i=i)} ELSE 0 END" for i in range(len(QUERY)))
_BM = f"{_BASE}, bm AS (SELECT doc_id, {_SUM} AS score FROM tf, st)"
_COS = """cos AS (SELECT e.vec_id, e.label, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"""


@query(f"WITH {_BM} SELECT doc_id, floor(score * 1e6 + 0.5) / 1e6 AS score FROM (SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 20) WHERE score > 0")
def search_bm25_topk(read):
    return top(bm25(read("documents"), QUERY), "doc_id", 20).filter("score > 0").select("doc_id", micro(F.col("score")).alias("score"))


_IDF = " + ".join("CASE WHEN tf{i} > 0 THEN (CASE WHEN ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) < 0 THEN 0.25::DOUBLE * mean ELSE ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) END) * ".format(i=i) + _PART.format(i=i) + " ELSE 0 END" for i in range(len(QUERY)))


@query(f"""WITH {_BASE}, voc AS (SELECT w, count(*) AS c FROM (SELECT unnest(list_distinct(t)) AS w FROM tok) GROUP BY w),
 m AS (SELECT avg(ln(n - c + 0.5::DOUBLE) - ln(c + 0.5::DOUBLE)) AS mean FROM voc, st), bm AS (SELECT doc_id, {_IDF} AS score FROM tf, st, m)
SELECT doc_id, floor(score * 1e6 + 0.5) / 1e6 AS score FROM (SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 20) WHERE score > 0""")
def search_bm25_okapi(read):
    return top(bm25(read("documents"), QUERY, okapi=True), "doc_id", 20).filter("score > 0").select("doc_id", micro(F.col("score")).alias("score"))


@query(f"WITH {_COS} SELECT vec_id, floor(score * 1e6 + 0.5) / 1e6 AS score FROM cos ORDER BY cos.score DESC, vec_id LIMIT 10")
def search_cosine_topk(read):
    return top(cosine(read("embeddings"), 0), "vec_id", 10).select("vec_id", micro(F.col("score")).alias("score"))


def minmax(df):
    """(s - min) / (max - min) of a ranked list, 0.5 if all are equal; the list is a top-k, so one partition is small."""
    every = Window.partitionBy(F.lit(1))
    lo, hi = F.min("score").over(every), F.max("score").over(every)
    return df.withColumn("norm", F.coalesce(F.try_divide(F.col("score") - lo, hi - lo), F.lit(0.5)))


_TOPS = f"{_BM}, {_COS}, b AS (SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 50), v AS (SELECT * FROM cos ORDER BY score DESC, vec_id LIMIT 50)"


@query(f"""WITH {_TOPS}, bn AS (SELECT doc_id, coalesce((score - min(score) OVER ()) / nullif(max(score) OVER () - min(score) OVER (), 0), 0.5) AS s FROM b),
 vn AS (SELECT vec_id, coalesce((score - min(score) OVER ()) / nullif(max(score) OVER () - min(score) OVER (), 0), 0.5) AS s FROM v)
SELECT coalesce(vec_id, doc_id) AS id, floor((0.4::DOUBLE * coalesce(vn.s, 0) + 0.6::DOUBLE * coalesce(bn.s, 0)) * 1e6 + 0.5) / 1e6 AS score FROM vn FULL JOIN bn ON vec_id = doc_id""")
def search_minmax_fused(read):
    b = minmax(top(bm25(read("documents"), QUERY), "doc_id", 50)).select(F.col("doc_id").alias("id"), F.col("norm").alias("b"))
    v = minmax(top(cosine(read("embeddings"), 0), "vec_id", 50)).select(F.col("vec_id").alias("id"), F.col("norm").alias("v"))
    return v.join(b, "id", "full_outer").select("id", micro(0.4 * F.coalesce("v", F.lit(0.0)) + 0.6 * F.coalesce("b", F.lit(0.0))).alias("score"))


@query(f"""WITH {_TOPS}, r AS (SELECT doc_id AS id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) AS s FROM b UNION ALL SELECT vec_id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, vec_id)) FROM v)
SELECT id, floor(sum(s) * 1e6 + 0.5) / 1e6 AS score FROM r GROUP BY id""")
def search_rrf_fused(read):
    ranked = lambda df, key: df.select(F.col(key).alias("id"), (1.0 / (60 + F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), key)))).alias("s"))
    b = ranked(top(bm25(read("documents"), QUERY), "doc_id", 50), "doc_id")
    v = ranked(top(cosine(read("embeddings"), 0), "vec_id", 50), "vec_id")
    return b.union(v).groupBy("id").agg(micro(F.sum("s")).alias("score"))


@query(f"""WITH {_COS}, r AS (SELECT 1 AS round, * FROM (SELECT * FROM cos ORDER BY score DESC, vec_id LIMIT 10) WHERE score >= 0.35::DOUBLE UNION ALL SELECT 2, * FROM (SELECT * FROM cos ORDER BY score DESC, vec_id LIMIT 20) WHERE score >= 0.25::DOUBLE
 UNION ALL SELECT 3, * FROM (SELECT * FROM cos ORDER BY score DESC, vec_id LIMIT 40) WHERE score >= 0.15::DOUBLE)
SELECT vec_id, CAST(min(round) AS INTEGER) AS round, floor(max(score) * 1e6 + 0.5) / 1e6 AS score FROM r GROUP BY vec_id""")
def search_progressive(read):
    """Rounds that widen k and lower the threshold by 0.10, merged by the best score."""
    best = top(cosine(read("embeddings"), 0), "vec_id", 40).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "vec_id")))
    at = lambda k, least: (F.col("rank") <= k) & (F.col("score") >= least)
    rounds = F.when(at(10, 0.35), 1).when(at(20, 0.25), 2).when(at(40, 0.15), 3)
    return best.select("vec_id", rounds.alias("round"), micro(F.col("score")).alias("score")).filter("round IS NOT NULL")


def cosine_each(vectors, k: int):
    """query_id, vec_id, score and rank of the k best for each query vector, those with vec_id divisible by 50, against all
    rows. Matrix products of blocks leave the pairs that can be among them, whose scores are then computed as stated."""
    v = staged(vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.monotonically_increasing_id().alias("row")))
    q = v.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("row").alias("q_row"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot("v", "v")) * F.sqrt(dot("q", "q"))
    near = close_pairs(v.select("row", "v"), q.select("q_row", "q"), k).join(v, "row").join(q, "q_row")
    scored = near.select("query_id", "vec_id", F.coalesce(F.try_divide(dot("v", "q"), F.nullif(norm, F.lit(0.0))), F.lit(0.0)).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)


def query_ids(vectors):
    return vectors.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"))


_EACH = """ve AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)"""
_EACH_B = f"{_BM}, {_EACH}, b AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm QUALIFY rank <= 50), qs AS (SELECT DISTINCT query_id FROM ve)"


@query(f"WITH {_EACH} SELECT query_id, vec_id, floor(score * 1e6 + 0.5) / 1e6 AS score FROM ve WHERE rank <= 10")
def search_cosine_topk_each(read):
    return cosine_each(read("embeddings"), 10).select("query_id", "vec_id", micro(F.col("score")).alias("score"))


@query(f"""WITH {_EACH_B}, bn AS (SELECT query_id, doc_id, s FROM qs, (SELECT doc_id, coalesce((score - min(score) OVER ()) / nullif(max(score) OVER () - min(score) OVER (), 0), 0.5) AS s FROM b)),
 vn AS (SELECT query_id, vec_id, coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 0.5) AS s FROM ve WHERE rank <= 50 WINDOW w AS (PARTITION BY query_id))
SELECT coalesce(vn.query_id, bn.query_id) AS query_id, coalesce(vec_id, doc_id) AS id, floor((0.4::DOUBLE * coalesce(vn.s, 0) + 0.6::DOUBLE * coalesce(bn.s, 0)) * 1e6 + 0.5) / 1e6 AS score FROM vn FULL JOIN bn ON vec_id = doc_id AND vn.query_id = bn.query_id""")
def search_minmax_fused_each(read):
    b = minmax(top(bm25(read("documents"), QUERY), "doc_id", 50)).select(F.col("doc_id").alias("id"), F.col("norm").alias("b"))
    own = Window.partitionBy("query_id")
    lo, hi = F.min("score").over(own), F.max("score").over(own)
    v = cosine_each(read("embeddings"), 50).select("query_id", F.col("vec_id").alias("id"), F.coalesce(F.try_divide(F.col("score") - lo, hi - lo), F.lit(0.5)).alias("v"))
    b = query_ids(read("embeddings")).crossJoin(F.broadcast(b))
    return v.join(b, ["query_id", "id"], "full_outer").select("query_id", "id", micro(0.4 * F.coalesce("v", F.lit(0.0)) + 0.6 * F.coalesce("b", F.lit(0.0))).alias("score"))


@query(f"""WITH {_EACH_B}, r AS (SELECT query_id, doc_id AS id, 1.0::DOUBLE / (60 + rank) AS s FROM b, qs UNION ALL SELECT query_id, vec_id, 1.0::DOUBLE / (60 + rank) FROM ve WHERE rank <= 50)
SELECT query_id, id, floor(sum(s) * 1e6 + 0.5) / 1e6 AS score FROM r GROUP BY query_id, id""")
def search_rrf_fused_each(read):
    part = (1.0 / (60 + F.col("rank"))).alias("s")
    b = top(bm25(read("documents"), QUERY), "doc_id", 50).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "doc_id"))).select(F.col("doc_id").alias("id"), part)
    v = cosine_each(read("embeddings"), 50).select("query_id", F.col("vec_id").alias("id"), part)
    return query_ids(read("embeddings")).crossJoin(F.broadcast(b)).union(v).groupBy("query_id", "id").agg(micro(F.sum("s")).alias("score"))


@query(f"""WITH {_EACH} SELECT query_id, vec_id, CAST(CASE WHEN rank <= 10 AND score >= 0.35::DOUBLE THEN 1 WHEN rank <= 20 AND score >= 0.25::DOUBLE THEN 2 ELSE 3 END AS INTEGER) AS round, floor(score * 1e6 + 0.5) / 1e6 AS score
FROM ve WHERE (rank <= 10 AND score >= 0.35::DOUBLE) OR (rank <= 20 AND score >= 0.25::DOUBLE) OR (rank <= 40 AND score >= 0.15::DOUBLE)""")
def search_progressive_each(read):
    at = lambda k, least: (F.col("rank") <= k) & (F.col("score") >= least)
    rounds = F.when(at(10, 0.35), 1).when(at(20, 0.25), 2).when(at(40, 0.15), 3)
    return cosine_each(read("embeddings"), 40).select("query_id", "vec_id", rounds.alias("round"), micro(F.col("score")).alias("score")).filter("round IS NOT NULL")


@query("SELECT source, min(doc_id) AS doc_id FROM documents WHERE source LIKE 'src1%' GROUP BY source")
def search_prefix_exhaustive(read):
    return read("documents").filter(F.col("source").startswith("src1")).groupBy("source").agg(F.min("doc_id").alias("doc_id"))


@query(r"""WITH k AS (SELECT doc_id, lower(source || ' ' || lang) AS meta, (CASE WHEN position('src1' IN lower(source || ' ' || lang)) > 0 THEN 1 ELSE 0 END) + (CASE WHEN position('en' IN lower(source || ' ' || lang)) > 0 THEN 1 ELSE 0 END) AS hits FROM documents)
SELECT doc_id, floor(least(0.3::DOUBLE, least(0.15::DOUBLE, 0.05::DOUBLE * hits) + CASE WHEN hits > 0 AND position('src1 en' IN meta) > 0 THEN 0.15::DOUBLE ELSE 0 END) * 1e6 + 0.5) / 1e6 AS boost FROM k""")
def keyword_boost(read):
    meta, words = F.lower(F.concat_ws(" ", "source", "lang")), ("src1", "en")
    hits = sum((F.when(meta.contains(w), 1).otherwise(0) for w in words), F.lit(0))
    whole = F.when((hits > 0) & meta.contains(" ".join(words)), 0.15).otherwise(0.0)
    return read("documents").select("doc_id", micro(F.least(F.lit(0.3), F.least(F.lit(0.15), 0.05 * hits) + whole)).alias("boost"))


@query(f"""WITH {_BM}, d AS (SELECT b.doc_id, source, text, row_number() OVER (ORDER BY score DESC, b.doc_id) AS r FROM (SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 20) b JOIN documents USING (doc_id)),
 e AS (SELECT *, '[' || source || '] ' || text AS part, coalesce(sum(length('[' || source || '] ' || text)) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT doc_id, CAST(r AS INTEGER) AS position, md5(substr(part, 1, CAST(20000 - before AS BIGINT))) AS piece_md5 FROM e WHERE before < 20000""")
def context_budget(read):
    """Ranked documents until a budget of characters is full, the last one cut."""
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "doc_id")  # of a top-k
    docs = read("documents")
    ranked = top(bm25(docs, QUERY), "doc_id", 20).withColumn("position", F.row_number().over(order))
    parts = docs.join(F.broadcast(ranked), "doc_id").withColumn("part", F.concat(F.lit("["), "source", F.lit("] "), "text"))
    before = F.coalesce(F.sum(F.length("part")).over(Window.partitionBy(F.lit(1)).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = parts.withColumn("before", before).filter("before < 20000")
    return kept.select("doc_id", "position", F.md5(F.substring(F.col("part"), F.lit(1), (20000 - F.col("before")).cast("int"))).alias("piece_md5"))
