"""Publication of tables in versions: written apart, checked against a count, and switched to by one rename."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CURRENT = "CURRENT"


def _files(spark: SparkSession, root: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(root)
    return hadoop, hadoop.FileContext.getFileContext(path.toUri(), spark.sparkContext._jsc.hadoopConfiguration()), path


def manifest(spark: SparkSession, root: str) -> dict | None:
    """What is published: version, number of rows, source, time and schema; None before the first publication."""
    hadoop, files, path = _files(spark, root)
    place = hadoop.Path(path, _CURRENT)
    if not files.util().exists(place):
        return None
    rows = spark.read.text(f"{root}/{_CURRENT}", wholetext=True).collect()  # one small file
    return json.loads(rows[0].value)


def publish(rows: DataFrame, root: str, source: str = "", keep: int = 2, key: str | None = None) -> dict:
    """Writes rows as a new version and switches readers to it; returns the manifest.

    The version is written beside the others and counted as written; with a key, rows without one or that share one are
    refused. Only then the manifest replaces the old one by a rename, which readers see whole or not at all. A failure
    before that leaves the old version in force. Of the versions before, keep - 1 stay for readers under way.
    """
    spark = rows.sparkSession
    hadoop, files, path = _files(spark, root)
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    place = f"{root}/versions/{version}"
    rows.write.parquet(place)
    written = spark.read.schema(rows.schema).parquet(place)
    facts = written.agg(F.count("*").alias("n"), *([F.count_distinct(key).alias("k")] if key else [])).first()
    if key and facts.k != facts.n:
        files.delete(hadoop.Path(place), True)
        raise ValueError(f"{facts.n} rows have {facts.k} different values of {key}")
    told = {"version": version, "count": facts.n, "source": source, "written": int(version[:20]) // 10**9, "schema": json.loads(rows.schema.json())}
    fresh = hadoop.Path(path, f".{_CURRENT}-{version}")
    flags = spark._jvm.java.util.EnumSet.of(spark._jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
    no_options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.CreateOpts, 0)
    out = files.create(fresh, flags, no_options)
    try:
        out.write(bytearray(json.dumps(told, ensure_ascii=False).encode()))
    finally:
        out.close()
    renames = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    renames[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(fresh, hadoop.Path(path, _CURRENT), renames)
    _forget(spark, root, keep)
    return told


def _forget(spark: SparkSession, root: str, keep: int) -> None:
    """Deletes all but the last versions up to the one in force; later ones may still be in the making."""
    hadoop, files, path = _files(spark, root)
    now = manifest(spark, root)["version"]
    names = sorted(s.getPath().getName() for s in files.util().listStatus(hadoop.Path(path, "versions")))
    for old in [n for n in names if n <= now][: -max(keep, 1)]:
        files.delete(hadoop.Path(f"{root}/versions/{old}"), True)


def published(spark: SparkSession, root: str) -> DataFrame:
    """The table in force; what is published later does not change it."""
    told = manifest(spark, root)
    if told is None:
        raise FileNotFoundError(f"nothing is published in {root}")
    from pyspark.sql.types import StructType

    return spark.read.schema(StructType.fromJson(told["schema"])).parquet(f"{root}/versions/{told['version']}")
