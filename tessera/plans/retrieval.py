"""The retrieval round and the loop of widening rounds around it.

A document's id is that of its vector; its source is its title, its language the type of the page. Queries are the vectors
with an id divisible by 50; all of them say the words of QUERY.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.nearest import close_pairs
from tessera.functions.rounding import micro
from tessera.plans.catalog import query
from tessera.plans.ranking import _BM, QUERY, bm25, top
from tessera.sources.staged import staged

#: Weights of keyword search by the number of its hits that are left, and else; bonuses; penalty. Fixed values.
WEIGHTS, ELSE_WEIGHT = ((5, 0.05), (10, 0.15), (20, 0.30), (40, 0.50)), 0.6
EXACT_BOOST, LOOSE_BOOST, EXACT_BONUS, LOOSE_BONUS, PENALTY = 1.35, 1.15, 0.45, 0.20, 0.20
#: Rounds as (vectors, keyword hits, threshold): the pool widens, the threshold falls by 0.10 down to 0.15. Fixed values.
TOP_K, ROUNDS, SATURATION, CAP = 10, ((10, 20, 0.35), (20, 40, 0.25), (40, 80, 0.15)), 0.3, 17
PAGE_TYPE, TITLE, PENALISED = "en", "src1", ("src3", "src4")


def by_title(exact, loose, other):
    return F.when(F.col("source") == TITLE, exact).when(F.col("source").contains(TITLE), loose).otherwise(other)


def candidates(docs, vectors, most: int):
    """Of every query: the most similar documents of the page type, with their rank; the filter comes before the ranks.

    Similarity is 1 - (1 - cosine). Pairs of query and document meet in blocks; those that can be among the most similar
    leave about most rows a query and task, and their similarity is then computed as stated.
    """
    kept = docs.filter(F.col("lang") == PAGE_TYPE).select(F.col("doc_id").alias("id"), "source", "lang")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    v = vectors.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    v = v.withColumn("length", F.nullif(F.sqrt(dot("v", "v")), F.lit(0.0)))  # once a row, not a pair
    number = F.monotonically_increasing_id()
    q = staged(v.filter(F.col("id") % 50 == 0).select(F.col("id").alias("query_id"), F.col("v").alias("q"), F.col("length").alias("q_length"), number.alias("q_row")))
    v = staged(v.join(kept, "id").withColumn("row", number))
    cosine = F.coalesce(F.try_divide(dot("v", "q"), F.col("length") * F.col("q_length")), F.lit(0.0))
    pairs = close_pairs(v.select("row", "v"), q.select("q_row", "q"), most)
    near = pairs.join(v, "row").join(q, "q_row").select("query_id", "id", "source", "lang", cosine.alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def keyword_hits(docs, most: int):
    """The best documents by keywords with their rank; the page type is asked for after the limit."""
    ranked = top(bm25(docs, QUERY), "doc_id", most).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "doc_id")))
    named = docs.join(F.broadcast(ranked), "doc_id").filter(F.col("lang") == PAGE_TYPE)  # most rows
    return named.select(F.col("doc_id").alias("id"), "source", "lang", "rank", (F.col("score") * by_title(EXACT_BOOST, LOOSE_BOOST, 1.0)).alias("score"))


def queries_of(vectors):
    return vectors.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"))


def retrieval_round(queries, near, hits, vec_k: int, bm25_k: int, threshold: float):
    """query_id, key, id, score: one document for each composite key, the best first. near and hits carry what is asked of documents."""
    spread = lambda s, *w: F.coalesce(F.try_divide(s - F.min(s).over(*w), F.max(s).over(*w) - F.min(s).over(*w)), F.lit(0.5))
    own, whole = Window.partitionBy("query_id"), Window.partitionBy(F.lit(1))  # a top-k each
    v = near.filter(F.col("rank") <= vec_k).select("query_id", "id", "source", "lang", spread(F.col("score"), own).alias("v"))
    b = hits.filter(F.col("rank") <= bm25_k).select("id", F.col("source").alias("b_source"), F.col("lang").alias("b_lang"), spread(F.col("score"), whole).alias("b"), F.count("*").over(whole).alias("n"))
    weight = F.lit(ELSE_WEIGHT)
    for least, w in reversed(WEIGHTS):
        weight = F.when(F.col("n") < least, w).otherwise(weight)
    b = b.select("id", "b_source", "b_lang", "b", weight.alias("w"))
    every = b.agg(F.coalesce(F.max("w"), F.lit(WEIGHTS[0][1])).alias("w"))  # one row
    asked = queries.join(near.select("query_id").distinct(), "query_id", "leftsemi")
    fused = v.join(asked.crossJoin(F.broadcast(b.drop("w"))), ["query_id", "id"], "full_outer").crossJoin(F.broadcast(every))  # bm25_k rows, and one
    named = fused.select("query_id", "id", F.coalesce("source", "b_source").alias("source"), F.coalesce("lang", "b_lang").alias("lang"), ((1 - F.col("w")) * F.coalesce("v", F.lit(0.0)) + F.col("w") * F.coalesce("b", F.lit(0.0))).alias("fused"))
    similar = named.withColumn("similarity", F.col("fused") + by_title(EXACT_BONUS, LOOSE_BONUS, 0.0)).filter(F.col("similarity") >= threshold)
    meta = F.lower(F.concat_ws(" ", "source", "lang"))
    count = F.when(meta.contains("src1"), 1).otherwise(0) + F.when(meta.contains("en"), 1).otherwise(0)
    boost = F.least(F.lit(0.3), F.least(F.lit(0.15), 0.05 * count) + F.when((count > 0) & meta.contains("src1 en"), 0.15).otherwise(0.0))
    penal = F.arrays_overlap(F.split(F.concat_ws(",", "lang", "source"), ","), F.array(*map(F.lit, PENALISED)))
    scored = similar.select("query_id", "id", F.concat_ws("|", "source", (F.col("id") % 3).cast("string")).alias("key"), micro(F.col("similarity") + boost - F.when(penal, PENALTY).otherwise(0.0)).alias("score"))
    first = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "id")
    return scored.withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r")


_TITLE = lambda a, b, c: f"CASE WHEN source = '{TITLE}' THEN {a}::DOUBLE WHEN source LIKE '%{TITLE}%' THEN {b}::DOUBLE ELSE {c}::DOUBLE END"
_META = "lower(source || ' ' || lang)"
_HITS = f"((CASE WHEN {_META} LIKE '%src1%' THEN 1 ELSE 0 END) + (CASE WHEN {_META} LIKE '%en%' THEN 1 ELSE 0 END))"
_SQL = f"""{_BM}, nv AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS rank
  FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id, embeddings q WHERE d.lang = '{PAGE_TYPE}' AND q.vec_id % 50 = 0),
 kb AS (SELECT doc_id AS id, rank, score * {_TITLE(EXACT_BOOST, LOOSE_BOOST, 1.0)} AS score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm) JOIN documents USING (doc_id) WHERE lang = '{PAGE_TYPE}')"""


def _round_sql(n: int, vec_k: int, bm25_k: int, threshold: float) -> str:
    weight = "CASE " + " ".join(f"WHEN count(*) < {least} THEN {w}::DOUBLE" for least, w in WEIGHTS) + f" ELSE {ELSE_WEIGHT}::DOUBLE END"
    return f"""v{n} AS (SELECT query_id, id, coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 0.5) AS v FROM nv WHERE rank <= {vec_k} WINDOW w AS (PARTITION BY query_id)),
 b{n} AS (SELECT id, coalesce((score - min(score) OVER ()) / nullif(max(score) OVER () - min(score) OVER (), 0), 0.5) AS b FROM kb WHERE rank <= {bm25_k}), w{n} AS (SELECT {weight} AS w FROM b{n}),
 f{n} AS (SELECT coalesce(v.query_id, b.query_id) AS query_id, coalesce(v.id, b.id) AS id, (1 - w) * coalesce(v, 0) + w * coalesce(b, 0) AS fused FROM v{n} v FULL JOIN (SELECT query_id, id, b FROM b{n}, (SELECT DISTINCT query_id FROM nv)) b ON v.query_id = b.query_id AND v.id = b.id, w{n}),
 s{n} AS (SELECT query_id, id, source || '|' || id % 3 AS key, floor((similarity + least(0.3::DOUBLE, least(0.15::DOUBLE, 0.05::DOUBLE * {_HITS}) + CASE WHEN {_META} LIKE '%src1 en%' THEN 0.15::DOUBLE ELSE 0 END)
   - CASE WHEN list_has_any(string_split(lang || ',' || source, ','), {list(PENALISED)}) THEN {PENALTY}::DOUBLE ELSE 0 END) * 1e6 + 0.5) / 1e6 AS score
  FROM (SELECT f.*, source, lang, fused + {_TITLE(EXACT_BONUS, LOOSE_BONUS, 0.0)} AS similarity FROM f{n} f JOIN documents ON doc_id = f.id) WHERE similarity >= {threshold}::DOUBLE),
 r{n} AS (SELECT * FROM s{n} QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY score DESC, id) = 1)"""


@query(f"WITH {_SQL}, {_round_sql(0, *ROUNDS[1])} SELECT query_id, key, id, score FROM r0")
def search_round_pipeline(read):
    """One round: filtered vectors, keyword hits filtered after their limit, boosts, fusion by weights that the number of
    hits gives, bonus, threshold, keyword boost, penalty, and one document for each key."""
    docs, (vec_k, bm25_k, threshold) = read("documents"), ROUNDS[1]
    near, hits = staged(candidates(docs, read("embeddings"), vec_k)), staged(keyword_hits(docs, bm25_k))
    return retrieval_round(queries_of(read("embeddings")), near, hits, vec_k, bm25_k, threshold).select("query_id", "key", "id", "score")


_ALL = " UNION ALL ".join(f"SELECT {n} AS round, query_id, key, id, score FROM r{n}" for n in range(len(ROUNDS)))


@query(f"""WITH {_SQL}, {", ".join(_round_sql(n, *r) for n, r in enumerate(ROUNDS))}, a AS ({_ALL}),
 k AS (SELECT query_id, key, min(round) AS first FROM a GROUP BY query_id, key),
 c AS (SELECT query_id, first AS round, count(*) AS new FROM k GROUP BY query_id, first),
 g AS (SELECT q.query_id, r.round, coalesce(new, 0) AS new, sum(coalesce(new, 0)) OVER (PARTITION BY q.query_id ORDER BY r.round) AS total FROM (SELECT DISTINCT query_id FROM k) q CROSS JOIN (SELECT unnest(range({len(ROUNDS)})) AS round) r LEFT JOIN c ON c.query_id = q.query_id AND c.round = r.round),
 stop AS (SELECT query_id, coalesce(min(round) FILTER (WHERE total >= {TOP_K} AND new < {SATURATION * TOP_K}), {len(ROUNDS) - 1}) AS last FROM g GROUP BY query_id),
 m AS (SELECT a.query_id, key, arg_max(id, (score, -round, -id)) AS id, max(score) AS score FROM a JOIN stop ON a.query_id = stop.query_id AND round <= last GROUP BY a.query_id, key),
 o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS position, count(*) OVER (PARTITION BY query_id) AS n FROM m),
 t AS (SELECT o.*, lang, length(text) AS len, len(regexp_extract_all(text, '\\p{{L}}')) AS l, len(regexp_extract_all(text, '\\p{{L}}{{3,}}')) AS w, len(regexp_extract_all(text, '[*#%&$!]{{2,}}')) AS h FROM o JOIN documents ON doc_id = id WHERE position <= greatest({TOP_K}, least(n, {TOP_K * CAP})))
SELECT query_id, CAST(position AS INTEGER) AS position, key, id, score FROM t
WHERE CASE WHEN len < 20 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.6::DOUBLE * l / len + 0.5::DOUBLE * least(w::DOUBLE / len, 0.3::DOUBLE) - least(0.8::DOUBLE, 0.15::DOUBLE * h))) END >= CASE lang WHEN 'en' THEN 0.35::DOUBLE WHEN 'de' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END""")
def search_progressive_pipeline(read):
    """Rounds until enough keys are found and a round adds few; the best score of a key over its rounds; as many results as
    the keys found allow; texts under the quality of their type go. The widest ranks are written once; every round reads its part of them."""
    docs = read("documents")
    near, hits = staged(candidates(docs, read("embeddings"), ROUNDS[-1][0])), staged(keyword_hits(docs, ROUNDS[-1][1]))
    rounds = None
    for n, r in enumerate(ROUNDS):
        one = retrieval_round(queries_of(read("embeddings")), near, hits, *r).withColumn("round", F.lit(n))
        rounds = one if rounds is None else rounds.unionByName(one)
    rounds = staged(rounds)
    first = rounds.groupBy("query_id", "key").agg(F.min("round").alias("first"))
    new = first.groupBy("query_id").agg(*(F.count_if(F.col("first") == n).alias(f"new{n}") for n in range(len(ROUNDS))))
    last, total = F.lit(len(ROUNDS) - 1), lambda n: sum((F.col(f"new{k}") for k in range(n + 1)), F.lit(0))
    for n in reversed(range(len(ROUNDS) - 1)):
        last = F.when((total(n) >= TOP_K) & (F.col(f"new{n}") < SATURATION * TOP_K), n).otherwise(last)
    held = rounds.join(new.select("query_id", last.alias("last")), "query_id").filter(F.col("round") <= F.col("last"))
    merged = held.groupBy("query_id", "key").agg(F.max(F.struct("score", (-F.col("round")).alias("r"), (-F.col("id")).alias("i"))).alias("m"))
    own = Window.partitionBy("query_id")
    ranked = merged.select("query_id", "key", (-F.col("m.i")).alias("id"), F.col("m.score").alias("score")).withColumns({"position": F.row_number().over(own.orderBy(F.desc("score"), "key")), "n": F.count("*").over(own)})
    ranked = staged(ranked.filter(F.col("position") <= F.greatest(F.lit(TOP_K), F.least(F.col("n"), F.lit(TOP_K * CAP)))))  # of known size: Spark broadcasts it only where it is small
    good = T.quality(F.col("text"), r"\p{L}", r"[*#%&$!]{2,}") >= F.when(F.col("lang") == "en", 0.35).when(F.col("lang") == "de", 0.3).otherwise(0.2)
    return docs.select(F.col("doc_id").alias("id"), "lang", "text").join(ranked, "id").filter(good).select("query_id", "position", "key", "id", "score")
