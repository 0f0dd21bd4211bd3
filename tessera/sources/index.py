"""A stored index of words for keyword search: written once, of which a query reads only its own words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.plans.ranking import K1, B


def write_terms(docs: DataFrame, path: str, parts: int = 64) -> None:
    """Rows (word, doc_id, tf, dl) in folders by the word's hash, sorted by word within a file; totals and numbers of documents beside them.

    A null text has no words, but counts as a document. Texts are shuffled by document and their words counted there, so
    a frequent word is in many tasks and rows of words are shuffled once: Spark rebalances folders into files of its
    advisory size, so a large folder is split.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tokens = T.tokens(F.coalesce("text", F.lit("")))
    mine = docs.select("doc_id", "text").repartition(n, "doc_id").select("doc_id", tokens.alias("t"))
    words = docs.select(tokens.alias("t"))
    each = mine.select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("word")).groupBy("word", "doc_id", "dl").agg(F.count("*").alias("tf"))
    part = F.pmod(F.xxhash64("word"), F.lit(parts)).cast("int")
    each.withColumn("part", part).hint("rebalance", "part").sortWithinPartitions("part", "word").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
    words.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avgdl")).write.mode("overwrite").parquet(f"{path}/totals")
    postings = docs.sparkSession.read.parquet(f"{path}/postings")
    postings.groupBy("part", "word").agg(F.count("*").alias("df")).hint("rebalance", "part").sortWithinPartitions("part", "word").write.mode("overwrite").partitionBy("part").parquet(f"{path}/words")


def search_terms(spark: SparkSession, path: str, words, k: int, parts: int = 64) -> DataFrame:
    """The k best documents (doc_id, score) by BM25 with idf ln(1 + (N - df + 0.5) / (df + 0.5)); documents without a word of the query have no row.

    Folders are pruned by the words' hashes, row groups by the words; texts are not read.
    """
    words = sorted(set(words))
    if not words:
        return spark.createDataFrame([], "doc_id long, score double")
    wanted = sorted({r.part for r in spark.createDataFrame([(w,) for w in words], "word string").select(F.pmod(F.xxhash64("word"), F.lit(parts)).cast("int").alias("part")).collect()})  # of the query's words
    mine = lambda table: spark.read.parquet(f"{path}/{table}").filter(F.col("part").isin(wanted) & F.col("word").isin(words))
    stats = mine("words").select("word", "df").crossJoin(F.broadcast(spark.read.parquet(f"{path}/totals")))  # a row a word, and one row
    j = mine("postings").join(F.broadcast(stats), "word")
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    score = idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return j.groupBy("doc_id").agg(F.sum(score).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)
