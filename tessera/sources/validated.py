"""Loads that hold records to rules: good ones go on, bad ones go to a quarantine with the reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def required(name: str, kind: str) -> dict[str, Column]:
    """Rules for a field that must be there, and, if it is text or an array, must not be empty. A rule is true where a record breaks it."""
    c = F.col(name)
    rules = {f"{name} missing": c.isNull()}
    if kind == "array":
        rules[f"{name} empty"] = F.size(c) == 0
    elif kind == "text":
        rules[f"{name} empty"] = F.trim(c) == ""
    return rules


def judge(rows: DataFrame, rules: dict[str, Column], reasons: str = "reasons") -> DataFrame:
    """rows with reasons: the names of all rules that a record breaks, in their order; a rule that comes out null is kept."""
    broken = F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()))
    return rows.withColumn(reasons, F.filter(broken, lambda r: r.isNotNull()))


def split(judged: DataFrame, reasons: str = "reasons") -> tuple[DataFrame, DataFrame]:
    """(good without reasons, bad with them)."""
    return judged.filter(F.size(reasons) == 0).drop(reasons), judged.filter(F.size(reasons) > 0)


def read_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a file, with its file's name; what is not an object, or breaks the schema, stays as text in broken."""
    wanted = T.StructType.fromDDL(schema)
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.trim("value").alias("value"))
    parsed = F.from_json("value", T.StructType([*wanted.fields, T.StructField("broken", T.StringType())]), {"columnNameOfCorruptRecord": "broken"})
    whole = F.col("value").startswith("{") & F.col("value").endswith("}")
    rows = raw.withColumn("r", F.when(whole, parsed))
    broken = F.when(~whole, F.col("value")).otherwise(F.col("r.broken"))
    return rows.select("file", *(F.col("r")[f.name].alias(f.name) for f in wanted.fields), broken.alias("broken"))


def load(spark: SparkSession, path: str, schema: str, rules: dict[str, Column], key: str, quarantine: str | None = None) -> DataFrame:
    """The valid records of a folder, one for each key: of several the one of the last file. Bad ones are written to quarantine as JSON lines, if given.

    A record that is no object, or does not fit the schema, has that as its first reason.
    """
    judged = judge(read_files(spark, path, schema), {"not a record": F.col("broken").isNotNull(), **rules})
    good, bad = split(judged)
    if quarantine is not None:
        bad.select("file", "reasons", F.col(key), "broken").write.mode("overwrite").json(quarantine)
    good = good.drop("broken")
    last = good.groupBy(key).agg(F.max_by(F.struct(*good.columns), "file").alias("r"))
    return last.select("r.*")
