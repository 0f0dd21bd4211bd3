"""Queries that run a stream over the given tables to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.plans.catalog import query
from tessera.sources.staged import folder
from tessera.streaming import admission


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 s(user_id, n, event_id, verdict, session, last, active, blocked, times, struck) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), '', 0, -1e18, -1e18, -1e18, CAST([] AS DOUBLE[]), CAST([] AS DOUBLE[]) FROM e
  UNION ALL SELECT e.user_id, e.n, e.event_id, v.verdict, CASE WHEN ok AND e.t - active >= 43200 THEN session + 1 ELSE session END, CASE WHEN ok THEN e.t ELSE last END, CASE WHEN ok THEN e.t ELSE active END,
   CASE WHEN v.verdict = 'withheld' AND len(hits) >= 2 THEN e.t + 259200 ELSE blocked END, CASE WHEN ok THEN list_append(list_filter(times, lambda x: e.t - x < 172800), e.t) ELSE times END, CASE WHEN v.verdict = 'withheld' THEN CASE WHEN len(hits) >= 2 THEN [] ELSE hits END ELSE struck END
  FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1, LATERAL (SELECT CASE WHEN e.event_type = 'error' THEN 'refused' WHEN e.t < blocked THEN 'blocked' WHEN e.t - last < 10800 THEN 'cooldown' WHEN len(list_filter(times, lambda x: e.t - x < 172800)) >= 8 THEN 'limit' WHEN e.event_type = 'signup' THEN 'withheld' ELSE 'admitted' END AS verdict) v,
   LATERAL (SELECT v.verdict IN ('admitted', 'withheld') AS ok, list_append(list_filter(struck, lambda x: e.t - x < 432000), e.t) AS hits) w)
SELECT event_id, verdict, CASE WHEN verdict IN ('admitted', 'withheld') THEN CAST(session AS INTEGER) END AS session FROM s WHERE n > 0 UNION ALL SELECT event_id, 'repeat', NULL FROM events WHERE event_id % 10 = 0""")
def admission_stream(read):
    """Messages through the admission operator as a stream: repeats (every tenth event comes twice), refusals, blocks, limits and sessions."""
    events = read("events")
    spark = events.sparkSession
    place, name = events.inputFiles()[0].rsplit("/", 1)
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", name if place.rsplit("/", 1)[-1] != "events.parquet" else "*.parquet").parquet(place)
    twice = F.when(F.col("event_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    stream = stream.withColumn("again", F.explode(twice)).withColumn("ts", F.col("ts").cast("timestamp") + F.make_dt_interval(secs=F.col("again") * 60))
    verdicts = admission.admission(stream, F.col("event_type") == "error", F.col("event_type") == "signup")
    root = f"{folder(spark)}/admission-{uuid.uuid4().hex}"
    admission.run_once(verdicts, f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema(admission.VERDICT).parquet(f"{root}/out").filter("verdict <> 'expired'").select("event_id", "verdict", "session")
