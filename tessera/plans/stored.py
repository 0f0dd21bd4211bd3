"""Queries through stored tables: held to rules with a quarantine, published in versions, searched by a stored index of words."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions.rounding import micro
from tessera.plans import ranking
from tessera.plans.catalog import ORACLE_SQL, query
from tessera.sources import index, publish, validated
from tessera.sources.staged import folder, staged

_RULES_SQL = """list_filter([CASE WHEN c_mktsegment IS NULL THEN 'segment missing' END, CASE WHEN trim(c_mktsegment) = '' THEN 'segment empty' END, CASE WHEN n IS NULL THEN 'orders missing' END, CASE WHEN c_acctbal < 0 THEN 'balance below zero' END], lambda r: r IS NOT NULL)"""


@query(f"""WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
 c AS (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN -1 ELSE 1 END AS c_acctbal, n FROM customer LEFT JOIN o ON o_custkey = c_custkey), j AS (SELECT *, {_RULES_SQL} AS r FROM c)
SELECT CASE WHEN len(r) = 0 THEN 'good' ELSE array_to_string(r, '; ') END AS outcome, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM j GROUP BY 1""")
def records_validated(read):
    """Records against rules, all reasons of a bad one together; good and bad go to tables of their own and are read back."""
    o = read("orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("orders"))
    segment = F.when(F.col("c_custkey") % 7 == 0, None).when(F.col("c_custkey") % 7 == 1, " ").otherwise(F.col("c_mktsegment"))
    rows = read("customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", segment.alias("segment"), "orders", F.when(F.col("c_custkey") % 5 == 0, -1).otherwise(1).alias("balance"))
    rules = {**validated.required("segment", "text"), **validated.required("orders", "array"), "balance below zero": F.col("balance") < 0}
    good, bad = validated.split(staged(validated.judge(rows, rules)))
    both = staged(good).select("c_custkey", F.lit("good").alias("outcome")).unionByName(staged(bad).select("c_custkey", F.array_join("reasons", "; ").alias("outcome")))
    return both.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


@query("""SELECT p_name AS code, count(*) AS n, 'second' AS version, (SELECT count(DISTINCT p_name) FROM part WHERE p_size % 2 = 0) AS published FROM part WHERE p_size % 2 = 0 GROUP BY p_name""")
def index_published(read):
    """An index of codes in two publications: readers get the second one whole, with the number of rows of its manifest."""
    spark = read("part").sparkSession
    root = f"{folder(spark)}/published-{uuid.uuid4().hex}"
    table = lambda rows, version: rows.groupBy(F.col("p_name").alias("code")).agg(F.count("*").alias("n")).withColumn("version", F.lit(version))
    publish.publish(table(read("part").filter("p_size % 2 = 1"), "first"), root, "part", key="code")
    publish.publish(table(read("part").filter("p_size % 2 = 0"), "second"), root, "part", key="code")
    told = publish.manifest(spark, root)
    return publish.published(spark, root).withColumn("published", F.lit(told["count"]).cast("long"))


@query(ORACLE_SQL["search_bm25_topk"])
def search_stored_terms(read):
    """search_bm25_topk from a stored index of words: texts are read once, when it is written."""
    spark = read("documents").sparkSession
    path = f"{folder(spark)}/terms-{uuid.uuid4().hex}"
    index.write_terms(read("documents").select("doc_id", "text"), path)
    return index.search_terms(spark, path, ranking.QUERY, 20).select("doc_id", micro(F.col("score")).alias("score"))
