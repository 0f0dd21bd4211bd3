"""Lookups, dedup, merges, groups and the damage model over the relational tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import damage as D
from tessera.functions import text as T
from tessera.functions.rounding import micro
from tessera.plans.catalog import query


@query("SELECT lang, min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents GROUP BY lang, text")
def dedup_first_wins(read):
    return read("documents").groupBy("lang", "text").agg(F.min("doc_id").alias("doc_id")).select("lang", "doc_id", F.md5("text").alias("text_md5"))


@query("SELECT source, lang, max(doc_id) AS doc_id, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY source, lang")
def dedup_last_wins(read):
    return read("documents").groupBy("source", "lang").agg(F.max("doc_id").alias("doc_id"), F.max_by("n_chars", "doc_id").alias("n_chars"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN d.lang ELSE 'q' || l.quality END AS tag, l.doc_id IS NOT NULL AS replaced FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels) l USING (doc_id) UNION ALL SELECT doc_id, 'q' || quality, true FROM (SELECT DISTINCT doc_id, quality FROM labels) l ANTI JOIN documents USING (doc_id)")
def upsert_by_key(read):
    """Rows of a new version replace those of the old one by key; others stay, new ones are added."""
    old = read("documents").select("doc_id", F.col("lang").alias("tag"), F.lit(False).alias("replaced"))
    new = read("labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("tag"), F.lit(True).alias("replaced")).distinct()
    return old.join(new, "doc_id", "left_anti").unionByName(new)


@query("""SELECT CASE WHEN s.doc_id IS NULL THEN 'new' WHEN s.rev = d.n_chars % 2 THEN 'reuse' ELSE 'refetch' END AS action, count(*) AS n, CAST(sum(d.n_chars) AS BIGINT) AS chars FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS rev FROM labels GROUP BY doc_id) s USING (doc_id) GROUP BY 1""")
def incremental_snapshot(read):
    """Against the revisions seen before: reuse, fetch again or new; vanished keys do not come back."""
    state = read("labels").groupBy("doc_id").agg(F.min("quality").alias("rev"))
    action = F.when(F.col("rev").isNull(), "new").when(F.col("rev") == F.col("n_chars") % 2, "reuse").otherwise("refetch")
    return read("documents").select("doc_id", "n_chars").join(state, "doc_id", "left").groupBy(action.alias("action")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""SELECT 'document' AS kind, doc_id AS id, lang, NULL AS url FROM documents UNION ALL SELECT 'page', page_id, NULL, url FROM pages UNION ALL SELECT 'event', event_id, NULL, NULL FROM events""")
def union_heterogeneous(read):
    d = read("documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "lang")
    p = read("pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), "url")
    e = read("events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"))
    return d.unionByName(p, allowMissingColumns=True).unionByName(e, allowMissingColumns=True)


@query("""WITH s AS (SELECT l_orderkey, string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS sig FROM lineitem GROUP BY l_orderkey)
SELECT sig, count(*) AS n, min(l_orderkey) AS first_order FROM s GROUP BY sig""")
def signature_groups(read):
    """Records with the same sorted list of parts form a group; its first one stands for it."""
    part = F.struct("l_linenumber", "l_returnflag")
    s = read("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(part)).alias("p"))
    s = s.select("l_orderkey", F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_returnflag"])), ",").alias("sig"))
    return s.groupBy("sig").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_order"))


@query("""SELECT c_custkey, coalesce(n_name, 'unresolved:' || c_nationkey) AS nation, coalesce(r_name, 'none') AS region FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def dim_fallback_lookup(read):
    """Codes to names by two dimension tables, with a default for those that are not there (here nations from 20 on)."""
    known = read("nation").filter("n_nationkey < 20")
    j = read("customer").join(known, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.select("c_custkey", F.coalesce("n_name", F.concat(F.lit("unresolved:"), F.col("c_nationkey").cast("string"))).alias("nation"), F.coalesce("r_name", F.lit("none")).alias("region"))


@query("""SELECT o_orderkey, o_orderpriority, count(l_orderkey) AS n, coalesce(string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber), '') AS variants FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderpriority""")
def one_to_many_variants(read):
    v = read("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("l_linenumber")).alias("v"))
    j = read("orders").join(v, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.select("o_orderkey", "o_orderpriority", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce(F.array_join(F.col("v").cast("array<string>"), ","), F.lit("")).alias("variants"))


@query("""WITH n AS (SELECT DISTINCT p_name AS name FROM part), w AS (SELECT name, unnest(string_split(name, ' ')) AS word FROM n), q AS (SELECT DISTINCT word FROM w)
SELECT q.word AS query, count(*) AS n_names, min(n.name) AS first_name, count(*) = 1 AS is_unique FROM q JOIN n ON position(q.word IN n.name) > 0 GROUP BY q.word""")
def name_containment_join(read):
    """Queries that a name contains: names are exploded to their substrings, so the theta join becomes an equi-join."""
    n = read("part").select(F.col("p_name").alias("name")).distinct()
    q = n.select(F.explode(F.split("name", " ")).alias("word")).distinct()
    subs = F.flatten(F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.transform(F.sequence(F.lit(1), F.length("name") - i + 1), lambda k: F.substring("name", i, k))))
    s = n.select("name", F.explode(F.array_distinct(subs)).alias("word"))
    return q.join(s, "word").groupBy(F.col("word").alias("query")).agg(F.count("*").alias("n_names"), F.min("name").alias("first_name"), (F.count("*") == 1).alias("is_unique"))


_BI = "list_distinct(list_transform(range(1, length({c})), lambda i: substr({c}, i, 2)))"


@query(f"""WITH n AS (SELECT DISTINCT p_name AS name FROM part), g AS (SELECT name, unnest({_BI.format(c="name")}) AS g FROM n),
 t AS (SELECT g, count(*) AS df, CASE WHEN count(*) <= 1 THEN 1.0::DOUBLE WHEN count(*) <= 3 THEN 0.9::DOUBLE WHEN count(*) <= 8 THEN 0.7::DOUBLE WHEN count(*) <= 20 THEN 0.4::DOUBLE WHEN count(*) <= 50 THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END AS tier FROM g GROUP BY g),
 q AS (SELECT unnest({_BI.format(c="'blue gizmo'")}) AS g), total AS (SELECT sum(tier) AS total FROM q JOIN t USING (g))
SELECT name, floor(100 * sum(tier) / max(total) * 1e6 + 0.5) / 1e6 AS score FROM g JOIN q USING (g) JOIN t USING (g), total GROUP BY name HAVING 100 * sum(tier) / max(total) >= 55""")
def name_bigram_disambiguate(read, text: str = "blue gizmo"):
    """Share of the query's bigram weight that a name covers, from 55 on; rare bigrams weigh more."""
    g = read("part").select(F.col("p_name").alias("name")).distinct().select("name", F.explode(T.bigrams(F.col("name"))).alias("g"))
    d = F.col("df")
    tier = F.when(d <= 1, 1.0).when(d <= 3, 0.9).when(d <= 8, 0.7).when(d <= 20, 0.4).when(d <= 50, 0.2).otherwise(0.1)
    t = g.groupBy("g").agg(F.count("*").alias("df")).withColumn("tier", tier).filter(F.array_contains(T.bigrams(F.lit(text)), F.col("g")))
    total = t.agg(F.sum("tier").alias("total"))
    s = g.join(t, "g").groupBy("name").agg(F.sum("tier").alias("s")).crossJoin(F.broadcast(total))  # one row
    return s.select("name", micro(100 * F.col("s") / F.col("total")).alias("score"), (100 * F.col("s") / F.col("total")).alias("raw")).filter("raw >= 55").drop("raw")


@query("SELECT DISTINCT p_name AS name, length(p_name) AS n FROM part WHERE regexp_matches(p_name, 's.*l.*g')")
def name_subsequence_match(read, core: str = "slg"):
    """Names in which the query's characters occur in order: a fold over the characters."""
    at = F.aggregate(F.split(F.lit(core), ""), F.lit(0), lambda at, c: F.when(at < 0, at).otherwise(F.coalesce(F.nullif(F.position(c, F.col("p_name"), at + 1), F.lit(0)), F.lit(-1))))
    return read("part").select("p_name").distinct().filter(at > 0).select(F.col("p_name").alias("name"), F.length("p_name").cast("long").alias("n"))


@query("SELECT name, floor((1 - levenshtein(name, 'red wigdet')::DOUBLE / greatest(length(name), 10)) * 1e6 + 0.5) / 1e6 AS ratio FROM (SELECT DISTINCT p_name AS name FROM part) ORDER BY ratio DESC, name LIMIT 5")
def name_fuzzy_ratio(read, text: str = "red wigdet"):
    n = read("part").select(F.col("p_name").alias("name")).distinct()
    ratio = micro(1 - F.levenshtein("name", F.lit(text)) / F.greatest(F.length("name"), F.lit(len(text))))
    return n.select("name", ratio.alias("ratio")).orderBy(F.desc("ratio"), "name").limit(5)


@query("""WITH o AS (SELECT *, row_number() OVER w AS pos, lag(l_linenumber) OVER w AS was FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
 i AS (SELECT *, sum(CASE WHEN l_linenumber <= was THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY pos) AS island FROM o)
SELECT l_orderkey, CAST(island AS BIGINT) AS island, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY pos) AS line_numbers FROM i GROUP BY l_orderkey, island""")
def islands_by_nonincrease(read):
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    o = read("lineitem").withColumns({"pos": F.row_number().over(w), "was": F.lag("l_linenumber").over(w)})
    i = o.withColumn("island", F.sum(F.when(F.col("l_linenumber") <= F.col("was"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = i.groupBy("l_orderkey", "island").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("l_linenumber").cast("string").alias("n")))).alias("s"))
    return g.select("l_orderkey", "island", F.array_join("s.n", ",").alias("line_numbers"))


@query("SELECT p_name AS name, CASE WHEN p_size <= 10 THEN 'one' WHEN position('red' IN p_name) > 0 THEN 'two' ELSE 'three' END AS rarity, count(*) AS n, repeat('*', CAST(least(max(p_size), 6) AS BIGINT)) AS stars FROM part GROUP BY 1, 2")
def rarity_partition(read):
    kind = F.when(F.col("p_size") <= 10, "one").when(F.col("p_name").contains("red"), "two").otherwise("three")
    g = read("part").groupBy(F.col("p_name").alias("name"), kind.alias("rarity")).agg(F.count("*").alias("n"), F.max("p_size").alias("m"))
    return g.select("name", "rarity", "n", F.repeat(F.lit("*"), F.least("m", F.lit(6))).alias("stars"))


@query("SELECT quality, floor(avg(CASE WHEN toxic = 0 THEN n_chars END) * 1e6 + 0.5) / 1e6 AS clean, floor(avg(CASE WHEN toxic = 1 THEN n_chars END) * 1e6 + 0.5) / 1e6 AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY quality")
def pivot_scores(read):
    j = read("labels").join(read("documents").select("doc_id", "n_chars"), "doc_id")
    p = j.groupBy("quality").pivot("toxic", [0, 1]).agg(F.avg("n_chars"))
    return p.select("quality", micro(F.col("0")).alias("clean"), micro(F.col("1")).alias("toxic"))


_DAMAGE = """i AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_linenumber AS base, 1 + p_size % 5 AS power, 1 + l_linenumber % 3 AS coins, l_quantity AS atk, 45 AS def, p_size / 25.0::DOUBLE AS phys0, l_discount * 20 AS sin0, p_size % 4 AS chaos, l_returnflag = 'R' AS crit FROM lineitem JOIN part ON l_partkey = p_partkey),
 r AS (SELECT *, CASE WHEN chaos >= 2 THEN (chaos - 1) * 0.5::DOUBLE + l_tax0 ELSE greatest(-2.0::DOUBLE, least(2.0::DOUBLE, phys0 + l_tax0)) END AS phys, greatest(-2.0::DOUBLE, least(2.0::DOUBLE, sin0)) AS sin FROM (SELECT *, 0.05::DOUBLE AS l_tax0 FROM i)),
 b AS (SELECT *, CASE WHEN phys > 1 THEN phys - 1 WHEN phys > 0 THEN (phys - 1) / 2 ELSE -0.5::DOUBLE END AS pb, CASE WHEN sin > 1 THEN sin - 1 WHEN sin > 0 THEN (sin - 1) / 2 ELSE -0.5::DOUBLE END AS sb FROM r)"""


def _fight(read):
    j = read("lineitem").join(read("part"), F.col("l_partkey") == F.col("p_partkey"))
    j = j.withColumns({"base": F.col("l_linenumber"), "power": 1 + F.col("p_size") % 5, "coins": 1 + F.col("l_linenumber") % 3, "crit": F.col("l_returnflag") == "R"})
    phys = D.resistance(F.col("p_size") / 25.0, F.lit(0.0), F.lit(0.05), F.col("p_size") % 4)
    return j.withColumns({"phys": phys, "sin": D.clamp2(F.col("l_discount") * 20)})


@query(f"""WITH {_DAMAGE}, t AS (SELECT *, 1 + 0.03::DOUBLE * 2 + CASE WHEN crit THEN 1.2::DOUBLE - 1 ELSE 0 END + (atk - def) / (abs(atk - def) + 25) + 0.03::DOUBLE * 1 + pb + sb AS t1 FROM b),
 d AS (SELECT *, greatest(1.0::DOUBLE, floor(0.05::DOUBLE * (base + power * coins)), round_even((base + power * coins) * t1 * 1.1::DOUBLE + 2 + 1, 0)) AS m FROM t)
SELECT l_partkey, count(*) AS n, min(m) AS least, max(m) AS most, CAST(sum(m) AS DOUBLE) AS total FROM d GROUP BY l_partkey""")
def damage_max(read):
    f = _fight(read)
    t1 = D.type1(2, F.col("crit"), 1.2, F.col("l_quantity"), F.lit(45), 1, F.col("phys"), F.col("sin"))
    _, high = D.power_range(F.col("base"), F.col("power"), F.col("coins"))
    m = D.coin_damage(high, t1, 1.1, 2, 1)
    return f.select("l_partkey", m.alias("m")).groupBy("l_partkey").agg(F.count("*").alias("n"), F.min("m").alias("least"), F.max("m").alias("most"), F.sum("m").alias("total"))


@query(f"""WITH {_DAMAGE}, t AS (SELECT *, 1 + pb + sb AS t1 FROM b),
 d AS (SELECT *, greatest(1.0::DOUBLE, floor(0.05::DOUBLE * base), round_even(base * t1, 0)) AS lo, greatest(1.0::DOUBLE, floor(0.05::DOUBLE * (base + power * coins)), round_even((base + power * coins) * t1, 0)) AS hi FROM t)
SELECT l_partkey, min(lo) AS least, max(hi) AS most, CAST(sum((lo + hi) / 2) AS DOUBLE) AS expected FROM d GROUP BY l_partkey""")
def damage_expected(read):
    f = _fight(read)
    t1 = 1 + D.resistance_bonus(F.col("phys")) + D.resistance_bonus(F.col("sin"))
    low, high = D.power_range(F.col("base"), F.col("power"), F.col("coins"))
    f = f.select("l_partkey", D.coin_damage(low, t1, 1.0, 0, 0).alias("lo"), D.coin_damage(high, t1, 1.0, 0, 0).alias("hi"))
    return f.groupBy("l_partkey").agg(F.min("lo").alias("least"), F.max("hi").alias("most"), F.sum((F.col("lo") + F.col("hi")) / 2).alias("expected"))


@query("""SELECT r_name || '/' || n_name AS account, replace('https://feed.example/{h}/rss', '{h}', lower(n_name)) AS url FROM region, nation""")
def feed_accounts(read):
    """Every handle with every template: two tables of fixed size."""
    return read("nation").crossJoin(F.broadcast(read("region"))).select(F.concat_ws("/", "r_name", "n_name").alias("account"), F.replace(F.lit("https://feed.example/{h}/rss"), F.lit("{h}"), F.lower("n_name")).alias("url"))
