"""Feeds, admission control, sessions and draws over events; the streaming twins are in tessera.streaming."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.plans.catalog import query

SECONDS = "epoch(ts)"


def seconds():
    return F.unix_micros(F.col("ts").cast("timestamp")) / 1e6


@query("SELECT event_id, user_id FROM events WHERE event_type <> 'error' AND ts >= TIMESTAMP '2024-01-10' AND user_id NOT IN (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND value > 90)")
def feed_new_posts(read):
    """New posts: not of a muted user, no reposts, from a bound on."""
    e = read("events")
    muted = e.filter("event_type = 'signup' AND value > 90").select("user_id").distinct()
    return e.filter("event_type <> 'error' AND ts >= TIMESTAMP_NTZ '2024-01-10'").join(muted, "user_id", "left_anti").select("event_id", "user_id")


@query("""WITH p AS (SELECT *, CASE WHEN event_type NOT IN ('signup', 'error') THEN event_id END AS own FROM events),
 c AS (SELECT *, CASE WHEN event_type = 'signup' THEN last_value(own IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS parent FROM p)
SELECT user_id, coalesce(parent, event_id) AS thread, count(*) AS n, max(event_id) AS last_event FROM c GROUP BY 1, 2""")
def feed_threads(read):
    """Replies go to their author's post before them; reposts and replies without one stand alone."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(~F.col("event_type").isin("signup", "error"), F.col("event_id"))
    e = read("events").withColumn("own", own)
    parent = F.when(F.col("event_type") == "signup", F.last("own", ignorenulls=True).over(w))
    return e.withColumn("thread", F.coalesce(parent, F.col("event_id"))).groupBy("user_id", "thread").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))


@query("WITH m AS (SELECT user_id, max(ts) AS w FROM events WHERE event_type = 'view' GROUP BY user_id) SELECT event_id FROM events LEFT JOIN m USING (user_id) WHERE w IS NULL OR ts > w")
def feed_watermark_increment(read):
    """Events after their user's high-water mark."""
    e = read("events")
    mark = e.filter("event_type = 'view'").groupBy("user_id").agg(F.max("ts").alias("w"))
    return e.join(mark, "user_id", "left").filter("w IS NULL OR ts > w").select("event_id")


def admit(times, cooldown: float):
    """(count, last) of the times of a sorted array that come at least cooldown after the last one admitted: a fold."""
    kept = lambda acc, t: F.struct((acc["n"] + 1).alias("n"), t.alias("last"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("last"))
    return F.aggregate(times, start, lambda acc, t: F.when(acc["last"].isNull() | (t - acc["last"] >= cooldown), kept(acc, t)).otherwise(acc))


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch(ts) AS t FROM events), a(user_id, t) AS (SELECT user_id, min(t) FROM e GROUP BY user_id
 UNION ALL SELECT x.user_id, x.t FROM (SELECT a.user_id, (SELECT min(e.t) FROM e WHERE e.user_id = a.user_id AND e.t - a.t >= 86400) AS t FROM a) x WHERE x.t IS NOT NULL)
SELECT user_id, count(*) AS admitted, floor(max(t)) AS last_admitted FROM a GROUP BY user_id""")
def rate_limit_admission(read, cooldown: float = 86400.0):
    """Only admitted events count for the cooldown; rejected ones leave no trace."""
    g = read("events").select("user_id", seconds().alias("t")).groupBy("user_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    a = g.select("user_id", admit(F.col("ts"), cooldown).alias("a"))
    return a.select("user_id", F.col("a.n").alias("admitted"), F.floor("a.last").cast("double").alias("last_admitted"))


@query("SELECT event_id, count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS n FROM events")
def sliding_count(read, span: int = 60_000_000):
    """Events of the last span microseconds. Time is cut into spans, and an event is also sent to the next one, so a window
    over all events is many small ones."""
    e = read("events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).withColumn("cut", F.floor(F.col("t") / span))
    sent = e.select("event_id", "t", F.explode(F.array(F.struct("cut", F.lit(True).alias("own")), F.struct((F.col("cut") + 1).alias("cut"), F.lit(False).alias("own")))).alias("s"))
    w = Window.partitionBy("s.cut").orderBy("t").rangeBetween(-span, 0)
    return sent.withColumn("n", F.count("*").over(w)).filter("s.own").select("event_id", "n")


@query("""WITH f AS (SELECT *, event_type = 'error' AS bad, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS calm FROM events),
 s AS (SELECT *, count(*) FILTER (WHERE bad) OVER (PARTITION BY user_id, calm ORDER BY ts, event_id) AS streak FROM f)
SELECT event_id, user_id, streak FROM s WHERE bad AND streak >= 3""")
def violation_breaker(read):
    """Events that are the third or a later violation in a row of their user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = read("events").withColumn("bad", F.col("event_type") == "error").withColumn("calm", F.sum(F.when(~F.col("bad"), 1).otherwise(0)).over(w))
    run = Window.partitionBy("user_id", "calm").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("streak", F.count_if("bad").over(run)).filter("bad AND streak >= 3").select("event_id", "user_id", "streak")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch(ts) AS t, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 s(user_id, n, event_id, streak, until, verdict) AS (SELECT user_id, n, event_id, bad::INT, -1e18::DOUBLE, CASE WHEN bad THEN 'rejected' ELSE 'ok' END FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.n, e.event_id, CASE WHEN e.t < s.until THEN s.streak WHEN NOT e.bad THEN 0 WHEN s.streak >= 3 THEN 1 ELSE s.streak + 1 END,
   CASE WHEN e.t >= s.until AND e.bad AND s.streak = 2 THEN e.t + 86400 ELSE s.until END, CASE WHEN e.t < s.until THEN 'blocked' WHEN e.bad THEN 'rejected' ELSE 'ok' END FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
SELECT event_id, verdict FROM s""")
def violation_block(read, most: int = 3, block: float = 86400.0):
    """The third violation in a row blocks a session for a time, in which all is rejected and nothing counts; after it, and
    after a clean message, the count starts again. Sessions stream through their task in order of time."""
    rows = read("events").select("event_id", "user_id", seconds().alias("t"), (F.col("event_type") == "error").alias("bad"))

    def run(batches):
        import pyarrow as pa

        user, streak, until = object(), 0, float("-inf")
        for batch in batches:
            verdicts = []
            for u, t, bad in zip(*(batch.column(c).to_pylist() for c in ("user_id", "t", "bad")), strict=True):
                if u != user:
                    user, streak, until = u, 0, float("-inf")
                if t < until:
                    verdicts.append("blocked")
                    continue
                streak = 0 if not bad else 1 if streak >= most else streak + 1
                until = t + block if streak == most else until
                verdicts.append("rejected" if bad else "ok")
            yield pa.RecordBatch.from_arrays([batch.column("event_id"), pa.array(verdicts, pa.string())], ["event_id", "verdict"])

    return rows.repartition("user_id").sortWithinPartitions("user_id", "t", "event_id").mapInArrow(run, "event_id long, verdict string")


@query("""WITH g AS (SELECT *, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 43200 THEN 1 ELSE 0 END AS cut FROM events),
 s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM s GROUP BY user_id, session""")
def sessionise_idle(read, idle: float = 43200.0):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    g = read("events").withColumn("t", seconds())
    g = g.withColumn("cut", F.when(F.col("t") - F.lag("t").over(w) > idle, 1).otherwise(0)).withColumn("session", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 50")
def retention_keep_newest(read, keep: int = 50):
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return read("events").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= keep).select("event_type", "event_id")


@query("SELECT user_id, arg_max(event_type, event_id) AS state, max(event_id) AS at FROM events GROUP BY user_id")
def session_state_last(read):
    return read("events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("state"), F.max("event_id").alias("at"))


@query("""WITH u AS (SELECT event_id, event_id // 10 AS batch, CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM events),
 k AS (SELECT *, CASE WHEN u < 0.81::DOUBLE THEN 'one' WHEN u < 0.94::DOUBLE THEN 'two' WHEN u < 0.97::DOUBLE THEN 'three' ELSE 'ego' END AS kind, count(*) OVER (PARTITION BY event_id // 10) AS n, event_id = max(event_id) OVER (PARTITION BY event_id // 10) AS is_last FROM u),
 a AS (SELECT *, bool_or(kind IN ('two', 'three')) OVER (PARTITION BY batch) AS good FROM k)
SELECT event_id, CASE WHEN n >= 10 AND is_last AND NOT good THEN 'two' ELSE kind END AS kind FROM a""")
def draw_with_pity(read):
    """Draws by cumulative weights; a batch of ten without a two or three ends with a two."""
    u = F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 8), 16, 10).cast("double") / 4294967296.0
    kind = F.when(F.col("u") < 0.81, "one").when(F.col("u") < 0.94, "two").when(F.col("u") < 0.97, "three").otherwise("ego")
    batch = Window.partitionBy("batch")
    k = read("events").select("event_id", F.floor(F.col("event_id") / 10).alias("batch"), u.alias("u")).withColumn("kind", kind)
    pity = (F.count("*").over(batch) >= 10) & (F.col("event_id") == F.max("event_id").over(batch)) & ~F.max(F.col("kind").isin("two", "three")).over(batch)
    return k.select("event_id", F.when(pity, "two").otherwise(F.col("kind")).alias("kind"))
