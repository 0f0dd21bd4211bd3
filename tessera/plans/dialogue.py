"""Ordered-sequence queries over conversations: neighbours, bands, scores, chunks, memory, intents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import charsets
from tessera.functions import text as T
from tessera.functions.rounding import micro
from tessera.plans.catalog import query



def by_turn():
    return Window.partitionBy("conv_id").orderBy("turn")


#: Word lists of the rules, over the vocabulary of the test tables: parameters, not the reference's lists.
OPINION, COMPARE, DATA = ("thonre", "onhe"), ("than", "with"), ("the", "of")
UNSURE = ("maybe", "ti ", "wh.")


def any_of(c, words):
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def _sql_any(c, words):
    return "(" + " OR ".join(f"position('{w}' IN {c}) > 0" for w in words) + ")"


@query("""SELECT conv_id, turn, coalesce(lag(text) OVER w, '') = '' AS opens, md5(coalesce(lag(text) OVER w, '')) AS prev_md5, md5(coalesce(lead(text) OVER w, '')) AS next_md5
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def dialogue_neighbours(read):
    prev, nxt = F.coalesce(F.lag("text").over(by_turn()), F.lit("")), F.coalesce(F.lead("text").over(by_turn()), F.lit(""))
    return read("conversations").select("conv_id", "turn", (prev == "").alias("opens"), F.md5(prev).alias("prev_md5"), F.md5(nxt).alias("next_md5"))


@query("""WITH p AS (SELECT u.conv_id, u.turn AS user_turn, a.turn AS reply_turn, abs(u.turn - a.turn) AS distance, length(a.text) AS n FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn BETWEEN u.turn - 2 AND u.turn + 2 WHERE u.role = 'user' AND a.role = 'assistant')
SELECT conv_id, user_turn, reply_turn, distance FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY distance, n DESC, user_turn, reply_turn) AS r FROM p) WHERE r = 1""")
def dialogue_band_pairs(read):
    """The best pair within two turns: each turn looks at its four neighbours, so no pair is joined."""
    c = read("conversations")
    near = [F.struct(*(f(k, d).over(by_turn()).alias(k) for k in ("role", "turn", "text"))) for d in (1, 2) for f in (F.lag, F.lead)]
    pairs = c.select("conv_id", "turn", "role", F.array(*near).alias("near")).filter("role = 'user'").select("conv_id", "turn", F.explode("near").alias("a")).filter("a.role = 'assistant' AND abs(turn - a.turn) <= 2")
    best = F.min(F.struct(F.abs(F.col("turn") - F.col("a.turn")).alias("distance"), (-F.length("a.text")).alias("n"), F.col("turn").alias("user_turn"), F.col("a.turn").alias("reply_turn")))
    return pairs.groupBy("conv_id").agg(best.alias("b")).select("conv_id", "b.user_turn", "b.reply_turn", "b.distance")


@query("""WITH n AS (SELECT role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS other FROM conversations), p AS (SELECT role, other FROM n WHERE other IS NOT NULL UNION ALL SELECT other, role FROM n WHERE other IS NOT NULL)
SELECT role, other, count(*) AS n FROM p GROUP BY role, other""")
def dialogue_cooccurrence(read):
    n = read("conversations").select("role", F.lead("role").over(by_turn()).alias("other")).dropna()
    return n.union(n.select("other", "role")).groupBy("role", "other").agg(F.count("*").alias("n"))


_SCORE = f"""least(1.5::DOUBLE, 0.5::DOUBLE * ({" + ".join(f"CASE WHEN position('{w}' IN text) > 0 THEN 1 ELSE 0 END" for w in OPINION)})) + least(0.8::DOUBLE, 0.4::DOUBLE * ({" + ".join(f"CASE WHEN position('{w}' IN text) > 0 THEN 1 ELSE 0 END" for w in COMPARE)}))
 + CASE WHEN role = 'assistant' THEN 0.8::DOUBLE ELSE 0 END + CASE WHEN length(text) BETWEEN 40 AND 400 THEN 0.3::DOUBLE WHEN length(text) > 400 THEN 0.15::DOUBLE ELSE 0 END - CASE WHEN length(text) < 20 THEN 0.5::DOUBLE ELSE 0 END"""


def line_score(c, role):
    """Opinion and relation words within caps, focus role, length, less for short lines."""
    hits = lambda ws: sum((F.when(c.contains(w), 1).otherwise(0) for w in ws), F.lit(0))
    n = F.length(c)
    return (
        F.least(F.lit(1.5), 0.5 * hits(OPINION)) + F.least(F.lit(0.8), 0.4 * hits(COMPARE)) + F.when(role == "assistant", 0.8).otherwise(0.0)
        + F.when(n.between(40, 400), 0.3).when(n > 400, 0.15).otherwise(0.0) - F.when(n < 20, 0.5).otherwise(0.0)
    )


@query(f"SELECT conv_id, turn, floor(score * 1e6 + 0.5) / 1e6 AS score FROM (SELECT conv_id, turn, {_SCORE} AS score FROM conversations) ORDER BY score DESC, conv_id, turn LIMIT 15")
def dialogue_line_score_topk(read):
    s = read("conversations").select("conv_id", "turn", micro(line_score(F.col("text"), F.col("role"))).alias("score"))
    return s.orderBy(F.desc("score"), "conv_id", "turn").limit(15)


@query(r"""WITH t AS (SELECT conv_id, turn, text, list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda x: x <> '') AS w FROM conversations WHERE length(text) BETWEEN 6 AND 140),
 s AS (SELECT text, min(conv_id) AS conv_id, max(1.3::DOUBLE * (CASE WHEN list_contains(w, 'thon') THEN 1 ELSE 0 END) + 1.0::DOUBLE * (CASE WHEN list_contains(w, 'of') THEN 1 ELSE 0 END)) AS score FROM t GROUP BY text)
SELECT conv_id, md5(text) AS line_md5, score FROM s WHERE score > 0 ORDER BY score DESC, conv_id, text LIMIT 10""")
def corpus_retrieve_lines(read):
    w = T.tokens(F.col("text"))
    score = F.when(F.array_contains(w, "thon"), 1.3).otherwise(0.0) + F.when(F.array_contains(w, "of"), 1.0).otherwise(0.0)
    s = read("conversations").filter(F.length("text").between(6, 140)).select("conv_id", "text", score.alias("s")).groupBy("text").agg(F.min("conv_id").alias("conv_id"), F.max("s").alias("score"))
    return s.filter("score > 0").orderBy(F.desc("score"), "conv_id", "text").limit(10).select("conv_id", F.md5("text").alias("line_md5"), "score")


@query("""WITH n AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS chunk FROM conversations)
SELECT conv_id, CAST(chunk AS INTEGER) AS chunk, count(*) AS n_lines, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS content_md5 FROM n GROUP BY conv_id, chunk""")
def dialogue_chunks(read, lines: int = 3):
    n = read("conversations").withColumn("chunk", F.floor((F.row_number().over(by_turn()) - 1) / lines).cast("int"))
    said = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line"))))
    return n.groupBy("conv_id", "chunk").agg(F.count("*").alias("n_lines"), said.alias("s")).select("conv_id", "chunk", "n_lines", F.md5(F.array_join("s.line", "\n")).alias("content_md5"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations)
SELECT conv_id, md5(string_agg(CASE role WHEN 'user' THEN 'User: ' WHEN 'assistant' THEN 'Assistant: ' ELSE 'System: ' END || text, chr(10) ORDER BY turn)) AS history_md5, count(*) AS n FROM r WHERE k <= 4 GROUP BY conv_id""")
def memory_window(read, window: int = 2):
    last = read("conversations").withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).filter(F.col("k") <= 2 * window)
    who = F.when(F.col("role") == "user", "User: ").when(F.col("role") == "assistant", "Assistant: ").otherwise("System: ")
    rows = last.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(who, "text").alias("line")))).alias("s"), F.count("*").alias("n"))
    return rows.select("conv_id", F.md5(F.array_join("s.line", "\n")).alias("history_md5"), "n")


@query(f"""SELECT conv_id, turn, CASE WHEN {_sql_any("t", OPINION)} THEN 'strong_opinion' WHEN {_sql_any("t", COMPARE)} THEN 'compare' WHEN {_sql_any("t", ("and",))} AND NOT {_sql_any("t", DATA)} THEN 'opinion' WHEN {_sql_any("t", DATA)} THEN 'data' ELSE 'other' END AS intent,
 CASE WHEN length(t) <= 10 THEN 'cheap' ELSE 'main' END AS model FROM (SELECT conv_id, turn, lower(text) AS t FROM conversations WHERE role = 'user')""")
def intent_route(read):
    t = F.lower("text")
    intent = F.when(any_of(t, OPINION), "strong_opinion").when(any_of(t, COMPARE), "compare").when(any_of(t, ("and",)) & ~any_of(t, DATA), "opinion").when(any_of(t, DATA), "data").otherwise("other")
    return read("conversations").filter("role = 'user'").select("conv_id", "turn", intent.alias("intent"), F.when(F.length(t) <= 10, "cheap").otherwise("main").alias("model"))


@query(f"""SELECT conv_id, turn, CASE WHEN {_sql_any("text", UNSURE)} THEN 0.1::DOUBLE WHEN length(text) < 10 THEN 0.05::DOUBLE WHEN length(text) < 30 THEN 0.4::DOUBLE ELSE 0.75::DOUBLE END AS confidence FROM conversations WHERE role = 'assistant'""")
def reply_confidence(read):
    c = F.when(any_of(F.col("text"), UNSURE), 0.1).when(F.length("text") < 10, 0.05).when(F.length("text") < 30, 0.4).otherwise(0.75)
    return read("conversations").filter("role = 'assistant'").select("conv_id", "turn", c.alias("confidence"))


@query("""SELECT conv_id, turn, floor(coalesce(len(list_intersect(a, b))::DOUBLE / nullif(len(list_distinct(list_concat(a, b))), 0), 0) * 1e6 + 0.5) / 1e6 AS similarity
FROM (SELECT conv_id, turn, list_distinct(string_split(text, '')) AS a, list_distinct(string_split(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '')) AS b FROM conversations) WHERE b IS NOT NULL""")
def cache_jaccard_lookup(read):
    """A message against the one before it in its session, by the sets of their characters."""
    c = read("conversations").select("conv_id", "turn", "text", F.lag("text").over(by_turn()).alias("was")).filter("was IS NOT NULL")
    return c.select("conv_id", "turn", micro(T.char_jaccard(F.col("text"), F.col("was"))).alias("similarity"))


@query("""WITH c AS (SELECT conv_id, turn, list_distinct(string_split(text, '')) AS s FROM conversations),
 p AS (SELECT q.conv_id, q.turn, k.conv_id AS best_conv_id, k.turn AS best_turn, coalesce(len(list_intersect(q.s, k.s))::DOUBLE / nullif(len(list_distinct(list_concat(q.s, k.s))), 0), 0) AS sim
  FROM c q, c k WHERE q.conv_id % 50 = 0 AND NOT (k.conv_id = q.conv_id AND k.turn = q.turn))
SELECT conv_id, turn, best_conv_id, best_turn, floor(sim * 1e6 + 0.5) / 1e6 AS similarity, sim >= 0.92::DOUBLE AS hit FROM p
QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY sim DESC, best_conv_id, best_turn) = 1""")
def cache_jaccard_best(read):
    """Each message of a session divisible by 50 against all other messages: the best by character sets, of ties the
    first, a hit from 0.92 on. Pairs meet block by block and leave one row for each query and block."""
    c = read("conversations").select("conv_id", "turn", "text")
    found = charsets.closest(c, c.filter(F.col("conv_id") % 50 == 0), ["conv_id", "turn"], "text")
    best = found.groupBy(F.col("q_a").alias("conv_id"), F.col("q_b").alias("turn")).agg(F.max(F.struct(F.col("score").alias("s"), (-F.col("a")).alias("c"), (-F.col("b")).alias("t"))).alias("m"))
    return best.select("conv_id", "turn", (-F.col("m.c")).alias("best_conv_id"), (-F.col("m.t")).alias("best_turn"), micro(F.col("m.s")).alias("similarity"), (F.col("m.s") >= 0.92).alias("hit"))


@query("SELECT coalesce(role, 'all') AS role, count(*) AS n, count(DISTINCT conv_id) AS n_conversations, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY ROLLUP (role)")
def corpus_stats(read):
    n = read("conversations").withColumn("chars", F.length("text"))
    return n.rollup("role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("n_conversations"), F.sum("chars").alias("chars")).select(F.coalesce("role", F.lit("all")).alias("role"), "n", "n_conversations", "chars")


@query(r"""SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace(CASE WHEN position(chr(10) IN text) > 0 AND regexp_matches(split_part(text, chr(10), 1), '^(Th|An)') THEN substr(text, position(chr(10) IN text) + 1) ELSE text END, '\([^()]{0,60}\)', '', 'g'), ' {2,}', ' ', 'g'), ' ')) AS repaired_md5 FROM conversations WHERE role = 'assistant'""")
def reply_repair(read):
    """First line off if it is an aside and more follows, bracketed directions out, runs of spaces to one."""
    t = F.col("text")
    rest = F.when((F.instr(t, "\n") > 0) & F.substring_index(t, "\n", 1).rlike("^(Th|An)"), F.substring(t, F.instr(t, "\n") + 1, F.length(t))).otherwise(t)
    fixed = F.trim(F.regexp_replace(F.regexp_replace(rest, r"\([^()]{0,60}\)", ""), " {2,}", " "))
    return read("conversations").filter("role = 'assistant'").select("conv_id", "turn", F.md5(fixed).alias("repaired_md5"))
