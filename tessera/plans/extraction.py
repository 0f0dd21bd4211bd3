"""Semi-structured extraction, record formatting, tiered lookups and chunk builders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.plans.catalog import query


@query(r"""SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, md5(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title_md5, len(regexp_extract_all(html, '<h[1-6][ >]')) AS n_headings, len(regexp_extract_all(html, '<p[ >]')) AS n_paragraphs,
 len(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li>')) AS n_nav, html LIKE '%class="ad"%' AS has_ad FROM pages""")
def page_structure(read):
    h = F.col("html")
    n = lambda c, p: F.regexp_count(c, F.lit(p)).cast("long")
    return read("pages").select(
        "page_id", F.regexp_extract(h, '<html lang="([a-z]+)"', 1).alias("lang"), F.md5(F.regexp_extract(h, "(?s)<title>(.*?)</title>", 1)).alias("title_md5"), n(h, "<h[1-6][ >]").alias("n_headings"),
        n(h, "<p[ >]").alias("n_paragraphs"), n(F.regexp_extract(h, "(?s)<nav>(.*?)</nav>", 1), "<li>").alias("n_nav"), h.contains('class="ad"').alias("has_ad"),
    )


@query(r"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
 f AS (SELECT *, last_value(CASE WHEN length(line) < 40 THEN i END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM l)
SELECT doc_id, CAST(coalesce(heading, 0) AS INTEGER) AS section, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY i)) AS section_md5 FROM f GROUP BY 1, 2""")
def section_islands(read):
    """Lines belong to the last heading (a short line) before them: a state machine as a forward fill."""
    l = read("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))  # noqa: E741
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    f = l.withColumn("section", F.coalesce(F.last(F.when(F.length("line") < 40, F.col("i") + 1), ignorenulls=True).over(w), F.lit(0)))
    g = f.groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.struct("i", "line"))).alias("s"))
    return g.select("doc_id", "section", "n_lines", F.md5(F.array_join("s.line", "\n")).alias("section_md5"))


@query("SELECT p_name, p_size, min(p_brand) AS p_brand FROM part GROUP BY p_name, p_size HAVING count(DISTINCT p_brand) = 1")
def unambiguous_keys(read):
    """Keys with conflicting values are dropped."""
    g = read("part").groupBy("p_name", "p_size").agg(F.min("p_brand").alias("lo"), F.max("p_brand").alias("hi"))
    return g.filter("lo = hi").select("p_name", "p_size", F.col("lo").alias("p_brand"))


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos FROM lineitem)
SELECT l_orderkey, pos, coalesce(CASE WHEN l_returnflag = 'R' THEN l_partkey END, first_value(CASE WHEN l_returnflag = 'R' THEN l_partkey END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS value FROM o""")
def distribute_first(read):
    """Parts without a value take the group's first one."""
    order = ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    w = Window.partitionBy("l_orderkey").orderBy(*order)
    v = F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))
    first = F.first(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return read("lineitem").select("l_orderkey", F.row_number().over(w).cast("long").alias("pos"), F.coalesce(v, first).alias("value"))


@query("""WITH u AS (SELECT conv_id, turn, generate_subscripts(string_split(text, ' '), 1) AS i, unnest(string_split(text, ' ')) AS word FROM conversations),
 z AS (SELECT a.conv_id, a.turn, a.i, a.word AS code, b.word AS name FROM u a JOIN u b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.i = b.i)
SELECT conv_id, code, arg_min(name, turn * 100000 + i) AS name FROM z GROUP BY conv_id, code""")
def zip_by_position(read):
    """Codes of one list with the names of the next by position; the first occurrence of a code wins."""
    u = read("conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("i", "word"))
    b = u.select("conv_id", (F.col("turn") - 1).alias("turn"), "i", F.col("word").alias("name"))
    z = u.join(b, ["conv_id", "turn", "i"])
    return z.groupBy("conv_id", F.col("word").alias("code")).agg(F.min_by("name", F.struct("turn", "i")).alias("name"))


@query("""WITH f AS (SELECT unnest(['A', 'N', 'R']) AS flag), c AS (SELECT l_suppkey, l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT s_suppkey, string_agg(f.flag || '=' || coalesce(n, 0), ' ' ORDER BY f.flag) AS line FROM supplier CROSS JOIN f LEFT JOIN c ON c.l_suppkey = s_suppkey AND c.flag = f.flag GROUP BY s_suppkey""")
def map_with_defaults(read):
    """A map of each key's counts with missing entries at 0, as one line."""
    flags = ["A", "N", "R"]
    c = read("lineitem").groupBy("l_suppkey", "l_returnflag").count().groupBy("l_suppkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "count"))).alias("m"))
    j = read("supplier").join(c, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    shown = [F.concat(F.lit(f"{k}="), F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0)).cast("string")) for k in flags]
    return j.select("s_suppkey", F.concat_ws(" ", *shown).alias("line"))


@query("""WITH h AS (SELECT o_orderkey, o_orderpriority || ' order ' || o_orderkey AS head FROM orders), b AS (SELECT l_orderkey, string_agg('- ' || l_linenumber || ' x' || CAST(floor(l_quantity) AS BIGINT) || ' ' || l_returnflag, chr(10) ORDER BY l_linenumber, l_quantity, l_returnflag) AS body FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, md5(head || chr(10) || coalesce(body, 'none')) AS text_md5 FROM h LEFT JOIN b ON o_orderkey = l_orderkey""")
def format_record_full(read):
    """A header and a line for each variant in order, or a placeholder."""
    show = lambda x: F.concat(F.lit("- "), x["l_linenumber"].cast("string"), F.lit(" x"), F.floor(x["l_quantity"]).cast("string"), F.lit(" "), x["l_returnflag"])
    b = read("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag"))).alias("v"))
    j = read("orders").join(b, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    head = F.concat("o_orderpriority", F.lit(" order "), F.col("o_orderkey").cast("string"))
    return j.select("o_orderkey", F.md5(F.concat(head, F.lit("\n"), F.coalesce(F.array_join(F.transform("v", show), "\n"), F.lit("none")))).alias("text_md5"))


@query("""WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_suppkey IN (1, 2) GROUP BY 1, 2)
SELECT coalesce(a.l_returnflag, b.l_returnflag) AS field, coalesce(a.n, 0) AS first, coalesce(b.n, 0) AS second FROM (SELECT * FROM c WHERE l_suppkey = 1) a FULL JOIN (SELECT * FROM c WHERE l_suppkey = 2) b ON a.l_returnflag = b.l_returnflag""")
def compare_records(read, a: int = 1, b: int = 2):
    """Two records side by side over the union of their fields."""
    c = read("lineitem").filter(F.col("l_suppkey").isin(a, b))
    return c.groupBy(F.col("l_returnflag").alias("field")).agg(F.count_if(F.col("l_suppkey") == a).alias("first"), F.count_if(F.col("l_suppkey") == b).alias("second"))


@query("""WITH n AS (SELECT DISTINCT p_name AS name FROM part), q(q) AS (VALUES ('red widget'), ('RED WIDGET'), ('redwidget'), ('widget'), ('gizm'), ('nothing')),
 t AS (SELECT q, name, CASE WHEN name = q THEN 1 WHEN name = lower(q) THEN 2 WHEN replace(name, ' ', '') = replace(lower(q), ' ', '') THEN 3 WHEN position(lower(q) IN name) > 0 THEN 4 END AS tier FROM q, n),
 b AS (SELECT q, min(tier) AS tier FROM t WHERE tier IS NOT NULL GROUP BY q)
SELECT q.q AS query, coalesce(b.tier, 0) AS tier, count(t.name) AS n, CASE WHEN count(t.name) = 1 THEN min(t.name) END AS resolved FROM q LEFT JOIN b USING (q) LEFT JOIN t ON t.q = q.q AND t.tier = b.tier GROUP BY q.q, b.tier""")
def name_tiered_lookup(read, queries=("red widget", "RED WIDGET", "redwidget", "widget", "gizm", "nothing")):
    """Exact, then any case, then without spaces, then contained; accepted only when unique in its tier."""
    n = read("part").select(F.col("p_name").alias("name")).distinct()
    name = F.col("name")
    found = F.array(*(
        F.struct(F.lit(q).alias("q"), F.when(name == q, 1).when(name == q.lower(), 2).when(F.replace(name, F.lit(" "), F.lit("")) == q.lower().replace(" ", ""), 3).when(name.contains(q.lower()), 4).alias("tier")) for q in queries
    ))
    t = n.select("name", F.explode(found).alias("f")).select("name", "f.q", "f.tier")
    best = t.groupBy("q").agg(F.min("tier").alias("best"))
    hit = t.join(F.broadcast(best), "q")  # a row for each query
    g = hit.groupBy(F.col("q").alias("query"), F.coalesce("best", F.lit(0)).alias("tier")).agg(F.count_if(F.col("tier") == F.col("best")).alias("n"), F.min(F.when(F.col("tier") == F.col("best"), F.col("name"))).alias("one"))
    return g.select("query", "tier", "n", F.when(F.col("n") == 1, F.col("one")).alias("resolved"))


@query("""SELECT s_suppkey AS id, section, content FROM (SELECT s_suppkey, unnest([{'section': 'info', 'content': s_name}, {'section': 'nation', 'content': n_name}, {'section': 'balance', 'content': CASE WHEN s_acctbal > 0 THEN 'positive' ELSE '' END}], recursive := true) FROM supplier JOIN nation ON s_nationkey = n_nationkey) WHERE content <> ''""")
def record_chunks(read):
    """A chunk for each non-empty section of a record."""
    j = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    part = lambda k, c: F.struct(F.lit(k).alias("section"), c.alias("content"))
    parts = F.array(part("info", F.col("s_name")), part("nation", F.col("n_name")), part("balance", F.when(F.col("s_acctbal") > 0, "positive").otherwise("")))
    return j.select(F.col("s_suppkey").alias("id"), F.explode(parts).alias("p")).select("id", "p.section", "p.content").filter("content <> ''")


@query(r"""WITH l AS (SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS a FROM pages), e AS (SELECT page_id, generate_subscripts(a, 1) AS i, unnest(a) AS t FROM l)
SELECT page_id, CAST((i - 1) // 4 AS INTEGER) AS bucket, string_agg(t, ' ' ORDER BY i) AS links FROM e GROUP BY 1, 2""")
def link_buckets(read, size: int = 4):
    e = read("pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'<a [^>]*href="([^"]*)"'), F.lit(1))).alias("i", "t"))
    g = e.groupBy("page_id", F.floor(F.col("i") / size).cast("int").alias("bucket")).agg(F.array_sort(F.collect_list(F.struct("i", "t"))).alias("s"))
    return g.select("page_id", "bucket", F.array_join("s.t", " ").alias("links"))


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS r FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM l WHERE r = 1)
SELECT event_type, user_id, event_id FROM k WHERE n <= 20""")
def cache_bounded(read, size: int = 20):
    """The last entry of each key, the newest few of a group."""
    last = read("events").groupBy("event_type", "user_id").agg(F.max(F.struct("ts", "event_id")).alias("e")).select("event_type", "user_id", "e.ts", "e.event_id")
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return last.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= size).select("event_type", "user_id", "event_id")


@query("""SELECT role, conv_id, count(*) AS n, sum(count(*)) OVER (PARTITION BY role) AS role_lines, count(*) OVER (PARTITION BY role) AS role_pages, md5(string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn)) AS places_md5 FROM conversations GROUP BY role, conv_id""")
def role_index(read):
    """The index as rows (role, page) with the places there; the role's totals are added up by parts and joined."""
    c = read("conversations")
    places = c.groupBy("role", "conv_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("turn")), ",")).alias("places_md5"))
    totals = places.groupBy("role").agg(F.sum("n").alias("role_lines"), F.count("*").alias("role_pages"))
    return places.join(F.broadcast(totals), "role").select("role", "conv_id", "n", "role_lines", "role_pages", "places_md5")  # a row a role


@query(r"""SELECT doc_id, coalesce(nullif(md5(array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')[1:3], lambda x: trim(x, ' ')), chr(10))), md5('')), 'none') AS effect_md5,
 length(text) - length(replace(text, ',', '')) AS n_commas, replace(lang, 'e', '&#101;') AS escaped FROM documents""")
def effect_lines(read):
    """The first three non-blank lines or a placeholder; escapes."""
    lines = F.transform(F.slice(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), 1, 3), lambda x: F.trim(x))
    return read("documents").select(
        "doc_id", F.coalesce(F.nullif(F.md5(F.array_join(lines, "\n")), F.md5(F.lit(""))), F.lit("none")).alias("effect_md5"),
        (F.length("text") - F.length(F.replace("text", F.lit(","), F.lit("")))).cast("long").alias("n_commas"), F.replace("lang", F.lit("e"), F.lit("&#101;")).alias("escaped"),
    )


@query(r"""WITH w AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda x: length(x) >= 3))) AS w FROM documents), d AS (SELECT w, count(*) AS df FROM w GROUP BY w)
SELECT CASE WHEN df <= 1 THEN 1.0::DOUBLE WHEN df <= 3 THEN 0.9::DOUBLE WHEN df <= 8 THEN 0.7::DOUBLE WHEN df <= 20 THEN 0.4::DOUBLE WHEN df <= 50 THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END AS tier, count(*) AS n_words, CAST(sum(df) AS BIGINT) AS uses FROM d GROUP BY 1""")
def token_tiers(read):
    w = read("documents").select(F.explode(F.array_distinct(F.filter(T.tokens(F.col("text")), lambda x: F.length(x) >= 3))).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    d = F.col("df")
    tier = F.when(d <= 1, 1.0).when(d <= 3, 0.9).when(d <= 8, 0.7).when(d <= 20, 0.4).when(d <= 50, 0.2).otherwise(0.1)
    return w.groupBy(tier.alias("tier")).agg(F.count("*").alias("n_words"), F.sum("df").alias("uses"))


@query("""WITH g AS (SELECT l_orderkey, l_returnflag, count(*) AS n, CAST(sum(floor(l_quantity)) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2),
 c AS (SELECT o_orderkey AS id, 0 AS position, 'info' AS section, o_orderpriority || ' / ' || o_orderstatus AS content FROM orders UNION ALL SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag), 'group ' || l_returnflag, n || ' lines, ' || q || ' units' FROM g JOIN orders ON o_orderkey = l_orderkey
 UNION ALL SELECT l_orderkey, 99, 'cost', string_agg(l_returnflag || 'x' || q, ' / ' ORDER BY l_returnflag) FROM g JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey)
SELECT id, CAST(position AS INTEGER) AS position, section, content FROM c""")
def nested_record_chunks(read):
    """Of a nested record: an info chunk, one for each group of parts, and one with the map of costs."""
    g = read("lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"), F.sum(F.floor("l_quantity")).cast("string").alias("q"))
    nested = g.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_returnflag", "n", "q"))).alias("groups"))
    j = read("orders").join(nested, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    chunk = lambda p, s, c: F.struct(p.alias("position"), s.alias("section"), c.alias("content"))
    info = F.array(chunk(F.lit(0), F.lit("info"), F.concat_ws(" / ", "o_orderpriority", "o_orderstatus")))
    each = F.transform("groups", lambda x, i: chunk(i + 1, F.concat(F.lit("group "), x["l_returnflag"]), F.concat(x["n"].cast("string"), F.lit(" lines, "), x["q"], F.lit(" units"))))
    cost = F.array(chunk(F.lit(99), F.lit("cost"), F.array_join(F.transform("groups", lambda x: F.concat_ws("x", x["l_returnflag"], x["q"])), " / ")))
    parts = F.when(F.col("groups").isNull(), info).otherwise(F.concat(info, each, cost))
    return j.select(F.col("o_orderkey").alias("id"), F.explode(parts).alias("c")).select("id", "c.*")


@query("SELECT doc_id AS id, source AS title, lang AS category, length(text) AS n_chars, md5('[' || source || '] ' || trim(text, ' ')) AS content_md5 FROM documents WHERE length(trim(text, ' ')) >= 60")
def knowledge_chunks(read):
    t = F.trim("text")
    d = read("documents").filter(F.length(t) >= 60)
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("lang").alias("category"), F.length("text").cast("long").alias("n_chars"), F.md5(F.concat(F.lit("["), "source", F.lit("] "), t)).alias("content_md5"))
