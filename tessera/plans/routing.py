"""Query understanding, guards and state of sessions: ordered intent rules, limits, pending choices, acceptance rules."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.plans.catalog import query
from tessera.plans.feeds import seconds

def word(*words: str) -> str:
    """A pattern of whole words, which RE2 and Java read alike whatever letters stand beside them."""
    return rf"(^|[^\p{{L}}])({'|'.join(words)})([^\p{{L}}]|$)"


#: Rules in their order: pattern, page type, template of the rewritten query, listing. A parameter: the first that fits holds.
RULES = (
    (word("who are you", "introduce yourself"), "character", "{name} introduction", False),
    (word("list", "which", "how many") + r".*(tion|ion)", "personality", "{name} personality list", True),
    (r"tion[^\p{L}]*\?", "personality", None, False),
    (word("was", "hat"), "plot", "{name} plot", False),
    (word("und", "ver", "der"), "character", "{name} skills", False),
    (word("las", "los", "ción"), "accessory", None, False),
    (word("les", "des", "la"), None, None, False),
    (word("the", "of", "and"), "other", None, False),
)
NICKNAMES = {"zu": "zur", "est": "estion", "then": "thenion"}
_NAME = r"([a-z]{3,})ion([^\p{L}]|$)"


def _quoted(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


_RULES = "(VALUES " + ", ".join(f"({i}, {_quoted(p)}, {_quoted(t)}, {_quoted(w)}, {str(b).lower()})" for i, (p, t, w, b) in enumerate(RULES)) + ") r(no, pattern, page_type, template, listing)"
_EXPANDED = "regexp_replace(" * len(NICKNAMES) + "lower(text)" + "".join(f", '{word(k)}', '\\1{v}\\3', 'g')" for k, v in NICKNAMES.items())


@query(f"""WITH q AS (SELECT conv_id, turn, {_EXPANDED} AS t FROM conversations WHERE role = 'user'),
 f AS (SELECT conv_id, turn, t, CASE {" ".join(f"WHEN regexp_matches(t, {_quoted(p)}) THEN {i}" for i, (p, *_) in enumerate(RULES))} END AS no FROM q)
SELECT conv_id, turn, CAST(coalesce(no, -1) AS INTEGER) AS rule, page_type, coalesce(listing, false) AS listing, nullif(regexp_extract(t, '{_NAME}', 1), '') AS target,
 md5(CASE WHEN template IS NULL THEN t ELSE replace(template, '{{name}}', regexp_extract(t, '{_NAME}', 1)) END) AS rewritten_md5 FROM f LEFT JOIN {_RULES} USING (no)""")
def intent_rules(read):
    """Nicknames, then the first rule that fits: page type, listing, target and the query that its template makes."""
    t = F.lower("text")
    for k, v in NICKNAMES.items():
        t = F.regexp_replace(t, word(k), f"$1{v}$3")
    q = read("conversations").filter("role = 'user'").select("conv_id", "turn", t.alias("t"))
    none = F.struct(F.lit(-1).alias("rule"), F.lit(None).cast("string").alias("page_type"), F.lit(False).alias("listing"), F.lit(None).cast("string").alias("template"))
    fit = none
    for i, (pattern, page_type, template, listing) in reversed(list(enumerate(RULES))):
        this = F.struct(F.lit(i).alias("rule"), F.lit(page_type).cast("string").alias("page_type"), F.lit(listing).alias("listing"), F.lit(template).cast("string").alias("template"))
        fit = F.when(F.col("t").rlike(pattern), this).otherwise(fit)
    name = F.regexp_extract("t", _NAME, 1)
    q = q.select("conv_id", "turn", "t", fit.alias("f"), name.alias("name"))
    return q.select("conv_id", "turn", "f.rule", "f.page_type", "f.listing", F.nullif("name", F.lit("")).alias("target"), F.md5(F.coalesce(F.replace("f.template", F.lit("{name}"), "name"), "t")).alias("rewritten_md5"))


@query("""SELECT conv_id, turn, len(list_distinct(list_concat(regexp_extract_all(text, '[à-ÿ]{2,}'), regexp_extract_all(lower(text), '[a-z0-9]{2,}')))) AS n_keywords FROM conversations""")
def keywords_extract(read):
    """Runs of at least two letters of one script, and of at least two ASCII signs, as one set."""
    runs = F.array_union(F.regexp_extract_all("text", F.lit("[à-ÿ]{2,}"), F.lit(0)), F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{2,}"), F.lit(0)))
    return read("conversations").select("conv_id", "turn", F.size(runs).cast("long").alias("n_keywords"))


#: Filter that a type of query implies; what the user asks for goes before it key by key.
IMPLIED = {"en": {"page_type": "personality", "effect": "burn"}, "de": {"page_type": "enemy"}}


@query(f"""SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN source END, CASE lang WHEN 'en' THEN '{IMPLIED["en"]["page_type"]}' WHEN 'de' THEN '{IMPLIED["de"]["page_type"]}' END) AS page_type, CASE lang WHEN 'en' THEN '{IMPLIED["en"]["effect"]}' END AS effect FROM documents""")
def filter_merge(read):
    """Two filters as maps; where both have a key the user's value holds."""
    implied = F.coalesce(*(F.when(F.col("lang") == lang, F.create_map(*(F.lit(x) for kv in m.items() for x in kv))) for lang, m in IMPLIED.items()), F.create_map().cast("map<string,string>"))
    asked = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("page_type"), F.col("source"))).otherwise(F.create_map().cast("map<string,string>"))
    rest = lambda m, a: F.map_filter(m, lambda k, _: ~F.map_contains_key(a, k))
    d = read("documents").select("doc_id", implied.alias("m"), asked.alias("a")).select("doc_id", F.map_concat(rest("m", F.col("a")), "a").alias("f"))
    return d.select("doc_id", F.try_element_at("f", F.lit("page_type")).alias("page_type"), F.try_element_at("f", F.lit("effect")).alias("effect"))


@query("""WITH s AS (SELECT o_custkey AS q, o_orderkey AS candidate, CAST(o_totalprice / 5000 AS DOUBLE) AS score FROM orders),
 l AS (SELECT *, lead(score) OVER w AS next, row_number() OVER w AS r FROM s WINDOW w AS (PARTITION BY q ORDER BY score DESC, candidate))
SELECT q, candidate, score >= 85 AND (next IS NULL OR score - next >= 10) AS accepted FROM l WHERE r = 1""")
def disambiguation_accept(read):
    """The best candidate is accepted from 85 on if it stands alone or ten ahead of the next."""
    w = Window.partitionBy("q").orderBy(F.desc("score"), "candidate")
    s = read("orders").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("candidate"), (F.col("o_totalprice") / 5000).cast("double").alias("score"))
    best = s.withColumns({"next": F.lead("score").over(w), "r": F.row_number().over(w)}).filter("r = 1")
    return best.select("q", "candidate", ((F.col("score") >= 85) & (F.col("next").isNull() | (F.col("score") - F.col("next") >= 10))).alias("accepted"))


@query("""WITH a AS (SELECT conv_id, turn, length(text) AS n, CASE WHEN length(text) < 200 THEN 1 WHEN length(text) < 600 THEN 2 ELSE 3 END AS c, lead(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS n2, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS turn2 FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, CASE WHEN (CASE WHEN n2 < 200 THEN 1 WHEN n2 < 600 THEN 2 ELSE 3 END, n2) > (c, n) THEN turn2 ELSE turn END AS chosen FROM a WHERE n2 IS NOT NULL""")
def reflect_accept(read):
    """A second answer takes the first one's place if it is more confident, or as confident and longer."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    conf = lambda n: F.when(n < 200, 1).when(n < 600, 2).otherwise(3)
    a = read("conversations").filter("role = 'assistant'").select("conv_id", "turn", F.length("text").alias("n")).withColumns({"n2": F.lead("n").over(w), "turn2": F.lead("turn").over(w)}).filter("n2 IS NOT NULL")
    better = F.struct(conf(F.col("n2")), F.col("n2")) > F.struct(conf(F.col("n")), F.col("n"))
    return a.select("conv_id", "turn", F.when(better, F.col("turn2")).otherwise(F.col("turn")).alias("chosen"))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(ask, '(^|[^\\p{L}])(was|les|der|que)([^\\p{L}]|$)') AND (length(text) < 40 OR position('.' IN text) = 0) THEN 'guarded' WHEN regexp_matches(lower(text), 'not found|no entry') THEN 'miss' ELSE 'answered' END AS outcome
FROM (SELECT *, lower(lag(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS ask FROM conversations) WHERE role = 'assistant'""")
def answer_guard(read):
    """An answer to a question for data that is short or names no source gives way to a constant text; misses are marked."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = read("conversations").withColumn("ask", F.lower(F.lag("text").over(w))).filter("role = 'assistant'")
    guarded = F.col("ask").rlike(word("was", "les", "der", "que")) & ((F.length("text") < 40) | (F.instr("text", ".") == 0))
    return c.select("conv_id", "turn", F.when(guarded, "guarded").when(F.lower("text").rlike("not found|no entry"), "miss").otherwise("answered").alias("outcome"))


@query("""SELECT conv_id, turn, role <> 'user' OR conv_id % 7 = 0 OR contains(text, '?') OR starts_with(text, 'De') OR (conv_id % 5 <> 0 AND regexp_matches(text, '(?i)onan|thon')) AS responds,
 regexp_matches(lower(text), 'tion|ung') AS allowed FROM conversations""")
def respond_and_topic(read):
    """A message is answered if it is private, at the bot, a command, or has a keyword where no address is needed; and
    whether it has a topic of the whitelist."""
    t, conv = F.col("text"), F.col("conv_id")
    responds = (F.col("role") != "user") | (conv % 7 == 0) | t.contains("?") | t.startswith("De") | ((conv % 5 != 0) & t.rlike("(?i)onan|thon"))
    return read("conversations").select("conv_id", "turn", responds.alias("responds"), F.lower(t).rlike("tion|ung").alias("allowed"))


@query("SELECT conv_id, count(*) > 8 AS compress, min(turn) AS first_turn FROM conversations GROUP BY conv_id")
def history_needs_compress(read):
    return read("conversations").groupBy("conv_id").agg((F.count("*") > 8).alias("compress"), F.min("turn").alias("first_turn"))


@query("SELECT user_id AS group_id, min(event_id) AS first_event FROM events GROUP BY user_id")
def groups_remembered(read):
    """Idempotent insert of groups: each once, with the event that brought it."""
    return read("events").groupBy(F.col("user_id").alias("group_id")).agg(F.min("event_id").alias("first_event"))


@query("""WITH l AS (SELECT user_id, max(ts) AS seen FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events)
SELECT user_id, epoch(now) - epoch(seen) > 1800 AS expired, CASE WHEN epoch(now) - epoch(seen) <= 1800 THEN user_id END AS session FROM l, n""")
def session_expiry(read, idle: float = 1800.0):
    """Sessions idle for longer than half an hour are evicted; asking for one gives null."""
    e = read("events").select("user_id", seconds().alias("t"))
    last = e.groupBy("user_id").agg(F.max("t").alias("seen")).crossJoin(F.broadcast(e.agg(F.max("t").alias("now"))))
    expired = F.col("now") - F.col("seen") > idle
    return last.select("user_id", expired.alias("expired"), F.when(~expired, F.col("user_id")).alias("session"))


@query("""WITH p AS (SELECT *, lag(event_type) OVER w AS was, lag(value) OVER w AS options FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN event_type = 'click' AND value < options THEN 'chosen' WHEN event_type = 'error' THEN 'cancelled' ELSE 'cleared' END AS outcome FROM p WHERE was = 'view'""")
def pending_choice(read):
    """What a session waits for is used up by its next message: a number in range chooses, a word cancels, all else clears."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = read("events").withColumns({"was": F.lag("event_type").over(w), "options": F.lag("value").over(w)}).filter("was = 'view'")
    return p.select("event_id", F.when((F.col("event_type") == "click") & (F.col("value") < F.col("options")), "chosen").when(F.col("event_type") == "error", "cancelled").otherwise("cleared").alias("outcome"))


@query("""WITH i AS (SELECT page_id, page_id // 10 AS reply, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS url FROM pages),
 f AS (SELECT reply, url, min(page_id) AS page_id FROM i GROUP BY reply, url)
SELECT reply, count(*) AS n_images, min(url) AS first_url FROM f WHERE page_id % 10 < 3 GROUP BY reply""")
def media_budget(read):
    """Images are sent once a reply, and only those of its first three messages."""
    links = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    i = read("pages").select("page_id", F.floor(F.col("page_id") / 10).alias("reply"), F.explode(links).alias("url"))
    f = i.groupBy("reply", "url").agg(F.min("page_id").alias("page_id")).filter(F.col("page_id") % 10 < 3)
    return f.groupBy("reply").agg(F.count("*").alias("n_images"), F.min("url").alias("first_url"))


@query("""SELECT bucket, n, n > 2 * avg(n) OVER () AS outlier FROM (SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS bucket, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, bucket LIMIT 15)""")
def anomaly_histogram(read):
    """The fifteen most frequent values of a histogram, and which stand out."""
    h = read("lineitem").groupBy(F.floor(F.col("l_quantity") / 5).cast("long").alias("bucket")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bucket").limit(15)
    return h.select("bucket", "n", (F.col("n") > 2 * F.avg("n").over(Window.partitionBy(F.lit(1)))).alias("outlier"))


@query("""SELECT l_orderkey, 1 + sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_discount AS DOUBLE) ELSE 0 END) + sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_tax AS DOUBLE) ELSE 0 END) AS multiplier,
 round_even(sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS DOUBLE) ELSE 0 END) * greatest(0, 0.75::DOUBLE), 0) AS additive, round_even(sum(CAST(l_tax AS DOUBLE) * 10), 0) AS fixed FROM lineitem GROUP BY l_orderkey""")
def damage_parts(read):
    """The second multiplier from the buffs of either side, the additive part times a resistance of at least 0, and the
    fixed part; both parts are rounded half to even. A sum of doubles depends on its order, which decides halves: lines
    are added in the order of the table (file, then row), however they are read."""
    one = F.struct("_metadata.file_path", "_metadata.row_index", "l_returnflag", "l_linestatus", *(F.col(c).cast("double").alias(c) for c in ("l_discount", "l_tax", "l_quantity")))
    orders = read("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("lines"))
    total = lambda value: F.aggregate("lines", F.lit(0.0), lambda s, x: s + value(x))
    part = lambda test, c: total(lambda x: F.when(test(x), x[c]).otherwise(0.0))
    multiplier = 1 + part(lambda x: x["l_returnflag"] == "R", "l_discount") + part(lambda x: x["l_returnflag"] == "A", "l_tax")
    resistance = F.greatest(F.lit(0.0), F.lit(1.0) + F.lit(0.5) - F.lit(0.75))
    additive, fixed = F.bround(part(lambda x: x["l_linestatus"] == "O", "l_quantity") * resistance, 0), F.bround(total(lambda x: x["l_tax"] * 10), 0)
    return orders.select("l_orderkey", multiplier.alias("multiplier"), additive.alias("additive"), fixed.alias("fixed"))




@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, user_id % 10 AS g, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS n FROM events),
 s(g, n, event_id, verdict, users, times) AS (SELECT g, n, event_id, 'ok', map([user_id], [t]), [t] FROM e WHERE n = 1
  UNION ALL SELECT e.g, e.n, e.event_id, v.verdict, CASE WHEN v.verdict = 'ok' THEN map_concat(s.users, map([e.user_id], [e.t])) ELSE s.users END, CASE WHEN v.verdict = 'ok' THEN list_append(list_filter(s.times, lambda x: e.t - x < 86400), e.t) ELSE s.times END
  FROM s JOIN e ON e.g = s.g AND e.n = s.n + 1, LATERAL (SELECT CASE WHEN e.t - coalesce(s.users[e.user_id], -1e18) < 43200 THEN 'user' WHEN len(list_filter(s.times, lambda x: e.t - x < 86400)) >= 3 THEN 'group' ELSE 'ok' END AS verdict) v)
SELECT event_id, verdict FROM s""")
def rate_limit_ordered(read, cooldown: float = 43200.0, window: float = 86400.0, most: int = 3):
    """Rules in their order, user before group, over admitted events alone: rejected ones leave no trace.

    Groups are state of their own; each streams through its task in order of time and keeps a deque of at most `most` times.
    """
    rows = read("events").select("event_id", "user_id", (F.col("user_id") % 10).alias("g"), seconds().alias("t"))

    def run(batches):
        import pyarrow as pa

        from tessera.functions.limits import Limiter

        group, limiter = object(), None
        for batch in batches:
            verdicts = []
            for g, user, t in zip(*(batch.column(c).to_pylist() for c in ("g", "user_id", "t")), strict=True):
                if g != group:
                    group, limiter = g, Limiter(cooldown, window, most)
                verdicts.append(limiter.check(user, t))
            yield pa.RecordBatch.from_arrays([batch.column("event_id"), pa.array(verdicts, pa.string())], ["event_id", "verdict"])

    return rows.repartition("g").sortWithinPartitions("g", "t", "event_id").mapInArrow(run, "event_id long, verdict string")


