"""File sources and sinks: JSON lines, keyed upserts, revision state and phrase lists."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, limit: int = 0) -> DataFrame:
    """Rows of JSON lines; broken and blank lines are dropped, a missing path is an empty table."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    try:
        rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], schema)
    return rows.limit(limit) if limit else rows


def read_records(spark: SparkSession, path: str, schema: T.StructType | str, key) -> DataFrame:
    """Directory of one JSON object a file; of records with the same key the last file by name wins; keyless ones go."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("_file", F.col("_metadata.file_path"))
    best = rows.withColumn("_key", key).filter("_key IS NOT NULL AND _key <> ''").groupBy("_key").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "_file"]), "_file").alias("r"))
    return best.select("r.*")


def latest_by(rows: DataFrame, key: str, *order) -> DataFrame:
    """The last row of each key in this order; rows without key go."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.filter(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones of their key; the rest of old stays and new keys are added."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def changed(current: DataFrame, state: DataFrame, key: str, revision: str) -> DataFrame:
    """current with action: reuse if the state has the same revision, refetch if another, new if none."""
    seen = state.select(key, F.col(revision).alias("_seen"))
    action = F.when(F.col("_seen").isNull(), "new").when(F.col("_seen") == F.col(revision), "reuse").otherwise("refetch")
    return current.join(seen, key, "left").withColumn("action", action).drop("_seen")


def tabular(rows: DataFrame, payload: str, fields: str, data: str, wanted: list[str]) -> DataFrame:
    """Rows of a columnar payload (names and arrays of values), each wanted field found by its name or null."""
    p = rows.select(F.col(payload)[fields].alias("names"), F.explode(F.col(payload)[data]).alias("v"))
    return p.select(*(F.get("v", F.nullif(F.array_position("names", F.lit(w)), F.lit(0)).cast("int") - 1).alias(w) for w in wanted))


def read_phrases(spark: SparkSession, path: str) -> DataFrame:
    """A phrase a line; blank lines and those from # on are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("phrase")).filter("phrase <> '' AND NOT startswith(phrase, '#')")


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).json(path)


def write_by_type(rows: DataFrame, path: str, column: str) -> None:
    """One folder for each value of a column of few values."""
    rows.write.mode("overwrite").partitionBy(column).json(path)
