"""Nested records: extraction from pages and markup, attribution of parts, direct answers, full texts of records."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import cleaning, formats, markup
from tessera.functions import text as T
from tessera.plans.catalog import ORACLE_SQL, query
from tessera.plans.texts import HTML_TEXT_SQL

_PART = r"(?s)<(h[1-6]|p)(?:\s[^>]*)?>(.*?)</(?:h[1-6]|p)>"


@query(rf"""WITH m AS (SELECT page_id, generate_subscripts(regexp_extract_all(html, '{_PART}', 1), 1) AS i, unnest(regexp_extract_all(html, '{_PART}', 1)) AS tag, unnest(regexp_extract_all(html, '{_PART}', 2)) AS body FROM pages),
 c AS (SELECT page_id, i, tag, trim(regexp_replace(regexp_replace(body, '<[^>]+>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'), ' ') AS body, sum(CASE WHEN tag <> 'p' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS section FROM m)
SELECT page_id, CAST(section AS INTEGER) AS section, max(CASE WHEN tag <> 'p' THEN CAST(tag[2:] AS INTEGER) END) AS level, max(CASE WHEN tag <> 'p' THEN body END) AS heading, count(*) FILTER (WHERE tag = 'p') AS n_paragraphs,
 md5(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (WHERE tag = 'p' AND body <> ''), '')) AS body_md5 FROM c GROUP BY page_id, section""")
def page_sections(read):
    """A page as rows: a section for each heading with level, text and the paragraphs up to the next; section 0 is what stands before the first. One narrow pass: a page is cut inside its row."""
    h, clean = F.col("html"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), r"[ \t\n\r]+", " "))
    found = lambda group: F.regexp_extract_all(h, F.lit(_PART), F.lit(group))
    p = read("pages").select("page_id", F.zip_with(found(1), found(2), lambda tag, body: F.struct(tag.alias("tag"), clean(body).alias("body"))).alias("p")).filter(F.size("p") > 0)
    heads = F.filter(F.sequence(F.lit(1), F.size("p")), lambda i: F.element_at("p", i)["tag"] != "p")
    p = p.select("page_id", "p", F.concat(F.array(F.lit(1)), heads).alias("at"), F.concat(heads, F.array(F.size("p") + 1)).alias("to"))
    p = p.select("page_id", F.posexplode(F.zip_with("at", "to", lambda a, b: F.slice("p", a, b - a))).alias("section", "s")).filter(F.size("s") > 0)
    text = F.filter("s", lambda x: x["tag"] == "p")
    head = F.when(F.col("section") > 0, F.col("s")[0])
    return p.select(
        "page_id", "section", F.substring(head["tag"], 2, 1).cast("int").alias("level"), head["body"].alias("heading"), F.size(text).cast("long").alias("n_paragraphs"),
        F.md5(F.array_join(F.filter(F.transform(text, lambda x: x["body"]), lambda b: b != ""), "\n")).alias("body_md5"),
    )


@query(r"""WITH t AS (SELECT conv_id, turn, role, regexp_replace(text, '^\s+|\s+$', '', 'g') AS said FROM conversations),
 k AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN '' ELSE role END AS role, CASE WHEN turn % 3 = 1 THEN said || ' {{Status|' || turn || '}} end' ELSE said END AS said FROM t WHERE said <> '')
SELECT conv_id, 0::INTEGER AS position, 'section' AS type, '' AS role, md5('conversation ' || conv_id) AS text_md5 FROM conversations GROUP BY conv_id
UNION ALL SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, said) AS INTEGER), CASE WHEN role = '' THEN 'narration' ELSE 'dialogue' END, role, md5(said) FROM k""")
def dialogue_blocks(read):
    """Dialogue pages (here written from the turns, with nested templates, named and unnamed parts) read back into typed blocks."""
    said = F.regexp_replace("text", r"^\s+|\s+$", "")
    said = F.when((F.col("turn") % 3 == 1) & (said != ""), F.concat(said, F.lit(" {{Status|"), F.col("turn").cast("string"), F.lit("}} end"))).otherwise(said)
    role = F.when(F.col("role") == "system", "").otherwise(F.col("role"))
    c = read("conversations").select("conv_id", "turn", role.alias("role"), said.alias("said"))
    named = F.concat(F.lit("{{Dialog\n|role="), "role", F.lit("7\n|voice=a.ogg\n|text="), "said", F.lit("\n}}"))
    line = F.when(F.col("role") == "", F.concat(F.lit("{{Dialog-p|none|4="), "said", F.lit("}}"))).when(F.col("turn") % 2 == 0, named).otherwise(F.concat(F.lit("{{Dialog-p|face|tag|"), "role", F.lit("|"), "said", F.lit("}}")))
    lines = c.filter(F.col("said").isNotNull()).select("conv_id", "turn", "role", "said", line.alias("line"))
    pages = read("conversations").select("conv_id").distinct().join(lines.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "said", "line"))).alias("s")), "conv_id", "left")
    page = F.concat(F.lit("== conversation "), F.col("conv_id").cast("string"), F.lit(" ==\n{{Image|x}}\n"), F.coalesce(F.array_join("s.line", "\n"), F.lit("")))
    b = pages.select("conv_id", F.posexplode(markup.dialogue_blocks(page)).alias("position", "b"))
    return b.select("conv_id", "position", "b.type", "b.role", F.md5("b.text").alias("text_md5"))


@query(r"""SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace(text, 'https?://[^ \n]{10,}', '', 'g'), ' {2,}', ' ', 'g'), ' ')) AS text_md5 FROM conversations""")
def context_noise(read):
    """Templates with all that is in them, links, runs of one sign and of spaces go from the texts (here planted in them)."""
    planted = F.concat(F.lit("{{a|{{b|c}}{{d}}}}"), "text", F.lit("{{x|https://example.com/long/path {{y}}}} https://example.com/long/path"))
    t = F.regexp_replace(markup.strip_templates(planted), r"https?://[^ \n]{10,}", "")
    return read("conversations").select("conv_id", "turn", F.md5(F.trim(F.regexp_replace(F.regexp_replace(t, r"([!?.,;~])\1{2,}", "$1"), " {2,}", " "))).alias("text_md5"))


#: Rows of a task whose windows are sorted in memory.
TASK_ROWS = 500_000
_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
_SIDES = """s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_linenumber % 2 = 1 AS own, l_suppkey % 7 AS icon, l_partkey % 5 AS name, CASE WHEN l_discount > 0.05 THEN l_quantity END AS given, l_quantity AS shown FROM lineitem)"""


@query(f"""WITH {_SIDES}, r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, own, icon ORDER BY {", ".join(_ORDER)}) AS k FROM s),
 p AS (SELECT a.*, b.shown AS other FROM r a LEFT JOIN r b ON a.l_orderkey = b.l_orderkey AND a.icon = b.icon AND a.k = b.k AND a.own <> b.own),
 q AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, own, other IS NULL, name ORDER BY {", ".join(_ORDER)}) AS j FROM p), l AS (SELECT * FROM q WHERE other IS NULL)
SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_suppkey, CASE WHEN a.other IS NOT NULL THEN 'icon' WHEN b.shown IS NOT NULL THEN 'name' ELSE 'none' END AS matched, coalesce(a.given, a.other, b.shown) AS value
FROM q a LEFT JOIN l b ON a.other IS NULL AND a.l_orderkey = b.l_orderkey AND a.name = b.name AND a.j = b.j AND a.own <> b.own WHERE a.own""")
def skill_attribution(read):
    """Rows of an authoritative list paired with rows shown on the page, each used once: the k-th of an icon with the k-th, then those left by name.

    Given values win over shown ones; rows without a partner stay. One shuffle, by record: both pairings are windows over
    it, whose sorts hold the rows of a task; so tasks grow in number with the table.
    """
    rows = read("lineitem")
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))
    l = rows.select(  # noqa: E741
        "l_orderkey", *_ORDER, (F.col("l_linenumber") % 2 == 1).alias("own"), (F.col("l_suppkey") % 7).alias("icon"), (F.col("l_partkey") % 5).alias("name"),
        F.when(F.col("l_discount") > 0.05, F.col("l_quantity")).alias("given"), F.col("l_quantity").alias("shown"),
    ).repartition(n, "l_orderkey")
    other = lambda *by: F.max(F.when(~F.col("own"), F.col("shown"))).over(Window.partitionBy("l_orderkey", *by))
    both = lambda *by: F.count("*").over(Window.partitionBy("l_orderkey", *by)) == 2
    l = l.withColumn("k", F.row_number().over(Window.partitionBy("l_orderkey", "own", "icon").orderBy(*_ORDER)))  # noqa: E741
    l = l.withColumn("paired", both("icon", "k")).withColumn("by_icon", F.when(F.col("paired"), other("icon", "k")))  # noqa: E741
    l = l.withColumn("j", F.row_number().over(Window.partitionBy("l_orderkey", "own", "paired", "name").orderBy(*_ORDER)))  # noqa: E741
    l = l.withColumn("by_name", F.when(~F.col("paired"), other("paired", "name", "j")))  # noqa: E741
    matched = F.when(F.col("by_icon").isNotNull(), "icon").when(F.col("by_name").isNotNull(), "name").otherwise("none")
    return l.filter("own").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", matched.alias("matched"), F.coalesce("given", "by_icon", "by_name").alias("value"))


#: Questions, words that say nothing of a name, and names too general to be found inside a question. Parameters.
QUESTIONS = ("ECONOMY - red widget", "tell me of red widget", "PROMO-blueanvil data", "the redwidget story", "gadget", "small ring data", "STANDARD", "x", "nothing at all")
_NOISE = r"(?:tell me of|data|story|the) *"
GENERAL = ("STANDARD",)
_Q = "(VALUES " + ", ".join(f"('{q}')" for q in QUESTIONS) + ") q(q)"


@query(f"""WITH n AS (SELECT p_type || ' - ' || p_name AS name, p_name AS bare, count(*) AS n, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY 1, 2),
 c AS (SELECT q, name, n, lo, hi, replace(q, ' ', '') AS qn, replace(name, ' ', '') AS nn, replace(bare, ' ', '') AS bn, trim(regexp_replace(q, '{_NOISE}', '', 'g'), ' ') AS k FROM {_Q}, n),
 t AS (SELECT q, name, n, lo, hi, CASE WHEN contains(q, name) OR (length(q) >= 2 AND contains(name, q) AND q NOT IN ('STANDARD')) THEN 1 WHEN length(qn) >= 2 AND (contains(qn, nn) OR (contains(nn, qn) AND qn NOT IN ('STANDARD'))) THEN 2 WHEN length(qn) >= 2 AND length(bn) >= 2 AND contains(qn, bn) THEN 3 WHEN k = name THEN 4 END AS tier FROM c),
 b AS (SELECT q, min(tier) AS tier FROM t GROUP BY q), h AS (SELECT t.* FROM t JOIN b ON t.q = b.q AND t.tier = b.tier),
 g AS (SELECT q, min(tier) AS tier, count(*) AS n_candidates, coalesce(max(CASE WHEN name = q THEN name END), CASE WHEN count(*) = 1 THEN min(name) END) AS resolved, string_agg(name, chr(10) ORDER BY name) AS names FROM h GROUP BY q)
SELECT q.q AS question, coalesce(g.tier, 0) AS tier, coalesce(n_candidates, 0) AS n_candidates, CASE WHEN g.q IS NULL THEN 'none' WHEN resolved IS NOT NULL THEN 'answer' ELSE 'choices' END AS kind,
 CASE WHEN resolved IS NOT NULL THEN (SELECT resolved || ': ' || n || ' records, sizes ' || lo || '-' || hi FROM n WHERE name = resolved) WHEN g.q IS NOT NULL THEN (SELECT string_agg(i || '. ' || x, chr(10) ORDER BY i) FROM (SELECT unnest(string_split(names, chr(10))) AS x, generate_subscripts(string_split(names, chr(10)), 1) AS i)) END AS answer FROM {_Q} LEFT JOIN g ON g.q = q.q""")
def direct_answer(read, questions=QUESTIONS, general=GENERAL):
    """Four tiers of candidates: contained either way, without spaces, the bare name, the question without its noise words.

    One candidate, or one that equals the question, is answered; several are a numbered list to choose from; none is none.
    """
    p = read("part")
    names = p.groupBy(F.concat_ws(" - ", "p_type", "p_name").alias("name"), "p_name").agg(F.count("*").alias("n"), F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))
    close = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    name, n, b = F.col("name"), close(F.col("name")), close(F.col("p_name"))

    def tier(q: str):
        c, s, k = F.lit(q), q.replace(" ", ""), F.trim(F.regexp_replace(F.lit(q), _NOISE, ""))
        first = F.contains(c, name) | (name.contains(q) if len(q) >= 2 and q not in general else F.lit(False))
        second = (F.contains(F.lit(s), n) | (n.contains(s) if s not in general else F.lit(False))) & F.lit(len(s) >= 2)
        third = F.contains(F.lit(s), b) & (F.length(b) >= 2) & F.lit(len(s) >= 2)
        return F.struct(c.alias("question"), F.when(first, 1).when(second, 2).when(third, 3).when(k == name, 4).alias("tier"))

    t = names.select("name", "n", "lo", "hi", F.explode(F.array(*map(tier, questions))).alias("t")).select("name", "n", "lo", "hi", "t.*")
    best = t.groupBy("question").agg(F.min("tier").alias("best"))
    text = F.concat("name", F.lit(": "), F.col("n").cast("string"), F.lit(" records, sizes "), F.col("lo").cast("string"), F.lit("-"), F.col("hi").cast("string"))
    hit = F.col("tier") == F.col("best")
    g = t.join(F.broadcast(best), "question").groupBy("question", F.coalesce("best", F.lit(0)).alias("tier")).agg(  # a row for each question
        F.count_if(hit).alias("n_candidates"), F.max(F.when(hit & (F.col("name") == F.col("question")), text)).alias("equal"), F.min(F.when(hit, text)).alias("one"),
        F.array_sort(F.collect_list(F.when(hit, F.col("name")))).alias("names"),
    )
    answer = F.coalesce("equal", F.when(F.col("n_candidates") == 1, F.col("one")))
    kind = F.when(F.col("n_candidates") == 0, "none").when(answer.isNotNull(), "answer").otherwise("choices")
    return g.select("question", "tier", "n_candidates", kind.alias("kind"), F.coalesce(answer, F.when(F.col("n_candidates") > 1, formats.numbered(F.col("names")))).alias("answer"))


_STAGES = ("I", "II", "III", "IV", "V")


@query(f"""WITH l AS (SELECT l_orderkey, l_suppkey % 3 AS part, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, ['{"', '".join(_STAGES)}'][l_partkey % 5 + 1] AS stage, CASE WHEN l_tax > 0.01 THEN CAST(floor(l_quantity) AS INTEGER) END AS base, CASE WHEN l_tax < 0.07 THEN CAST(floor(l_quantity) AS INTEGER) - 25 END AS power FROM lineitem),
 o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, part ORDER BY {", ".join(_ORDER)}) AS i, row_number() OVER (PARTITION BY l_orderkey, part ORDER BY stage <> 'IV', CASE WHEN stage = 'IV' THEN l_linenumber ELSE -l_linenumber END, CASE WHEN stage = 'IV' THEN l_partkey ELSE -l_partkey END, CASE WHEN stage = 'IV' THEN l_suppkey ELSE -l_suppkey END, CASE WHEN stage = 'IV' THEN l_extendedprice ELSE -l_extendedprice END) AS c FROM l),
 f AS (SELECT l_orderkey, part, min(CASE WHEN i = 1 THEN l_returnflag END) AS flag, min(CASE WHEN i = 1 THEN l_linenumber END) AS line, min(CASE WHEN c = 1 THEN stage || ': base ' || coalesce(CAST(base AS VARCHAR), '-') || coalesce(' | power ' || CASE WHEN power > 0 THEN '+' ELSE '' END || power, '') END) AS shown FROM o GROUP BY 1, 2),
 s AS (SELECT l_orderkey, string_agg(CASE WHEN flag = 'A' THEN '[strong skill ' || line || '] ' WHEN flag = 'N' THEN '[guard] ' WHEN line % 2 = 0 THEN '[skill ' || line || '] ' ELSE '[skill ' || line || ' variant] ' END || CASE WHEN flag = 'N' THEN 'skill ' || (part + 1) ELSE 'part ' || part END || chr(10) || shown, chr(10) ORDER BY part) AS body FROM f GROUP BY 1),
 v AS (SELECT l_orderkey, l_returnflag, min(l_linenumber) AS first_line, max(CASE WHEN l_discount > 0.03 THEN CAST(round(l_discount * 100) AS INTEGER) END) AS v FROM lineitem GROUP BY 1, 2),
 w AS (SELECT l_orderkey, 'passives: ' || string_agg(l_returnflag, ', ' ORDER BY first_line, l_returnflag) AS passives, 'resistances: ' || string_agg(l_returnflag || ':' || v, '  ' ORDER BY l_returnflag) AS resistances FROM v GROUP BY 1)
SELECT o_orderkey, md5(concat_ws(chr(10), 'record ' || o_orderkey, resistances, passives, coalesce(body, 'no skills'))) AS text_md5 FROM orders LEFT JOIN s ON s.l_orderkey = o_orderkey LEFT JOIN w ON w.l_orderkey = o_orderkey""")
def format_skills_full(read):
    """The whole text of a nested record: table of resistances, passives of all parts each once, and of each skill its header and the stage IV or the last."""
    q = F.floor("l_quantity").cast("int")
    stage = F.element_at(F.array(*map(F.lit, _STAGES)), (F.col("l_partkey") % 5 + 1).cast("int"))
    l = read("lineitem").select(  # noqa: E741
        "l_orderkey", *_ORDER, "l_returnflag", (F.col("l_suppkey") % 3).alias("part"), stage.alias("stage"), F.when(F.col("l_tax") > 0.01, q).alias("base"), F.when(F.col("l_tax") < 0.07, q - 25).alias("power"),
        F.when(F.col("l_discount") > 0.03, F.round(F.col("l_discount") * 100).cast("int")).alias("v"),
    )
    g = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*_ORDER, "l_returnflag", "part", "stage", "base", "power", "v"))).alias("s"))

    def skill(part):
        mine = F.filter("s", lambda x: x["part"] == part)
        first = mine[0]
        line, flag = first["l_linenumber"].cast("string"), first["l_returnflag"]
        key = F.when(flag == "A", F.concat(F.lit("strong"), line)).when(flag == "N", "guard").when(first["l_linenumber"] % 2 == 0, line).otherwise(F.concat(line, F.lit("-1")))
        name = formats.skill_name(F.when(flag == "N", " "), F.when(flag != "N", F.concat(F.lit("part "), part.cast("string"))), part + 1)
        return F.concat(formats.skill_header(key, name), F.lit("\n"), formats.stage_line(formats.chosen_stage(mine)))

    parts = F.array_sort(F.array_distinct("s.part"))
    seen = F.array_distinct(F.transform(F.array_sort(F.transform("s", lambda x: F.struct(x["l_linenumber"], x["l_returnflag"]))), lambda x: x["l_returnflag"]))
    pairs = F.transform(F.array_sort(F.array_distinct("s.l_returnflag")), lambda k: F.struct(k.alias("k"), F.array_max(F.transform(F.filter("s", lambda x: x["l_returnflag"] == k), lambda x: x["v"])).alias("v")))
    j = read("orders").join(g, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    body = F.coalesce(F.array_join(F.transform(parts, skill), "\n"), F.lit("no skills"))
    passives = F.concat(F.lit("passives: "), F.array_join(seen, ", "))
    return j.select("o_orderkey", F.md5(F.concat_ws("\n", F.concat(F.lit("record "), F.col("o_orderkey").cast("string")), formats.table_line("resistances: ", pairs), passives, body)).alias("text_md5"))


@query(r"""WITH t AS (SELECT conv_id, turn, role, trim(text, ' ') AS said, lead(CASE WHEN role = 'assistant' THEN text END) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations),
 o AS (SELECT conv_id, turn, said, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, array_to_string(list_transform(list_filter(list_transform(string_split(coalesce(after, ''), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), lambda x: '  - ' || CASE WHEN turn % 4 < 2 THEN 'success: ' ELSE 'failure: ' END || x), chr(10)) AS outcomes FROM t WHERE role = 'user' AND said <> ''),
 g AS (SELECT conv_id, string_agg(n || '. ' || said || CASE WHEN outcomes = '' THEN '' ELSE chr(10) || outcomes END, chr(10) ORDER BY turn) AS options FROM o GROUP BY conv_id),
 s AS (SELECT conv_id, nullif(string_agg(CASE WHEN role = 'system' AND said <> '' THEN '  ' || said END, chr(10) ORDER BY turn), '') AS narration FROM t GROUP BY conv_id)
SELECT s.conv_id, md5(concat_ws(chr(10), 'event ' || s.conv_id, narration, options, CASE WHEN narration IS NULL AND options IS NULL THEN 'no details yet' END)) AS text_md5 FROM s LEFT JOIN g ON g.conv_id = s.conv_id""")
def format_options_full(read):
    """The whole text of an event: narration, then numbered options with a line for each outcome; a remark where both are missing."""
    c = read("conversations").select("conv_id", "turn", "role", F.trim("text").alias("said"), F.lead(F.when(F.col("role") == "assistant", F.col("text"))).over(Window.partitionBy("conv_id").orderBy("turn")).alias("after"))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "said", "after"))).alias("s"))
    some = lambda role: F.filter("s", lambda x: (x["role"] == role) & (x["said"] != ""))
    line = lambda x: lambda y: F.concat(F.lit("  - "), F.when(x["turn"] % 4 < 2, "success: ").otherwise("failure: "), y)
    outcomes = lambda x: F.transform(F.filter(F.transform(F.split(F.coalesce(x["after"], F.lit("")), "\n"), lambda y: F.trim(y)), lambda y: y != ""), line(x))
    option = F.transform(some("user"), lambda x, i: F.array_join(F.concat(F.array(F.concat((i + 1).cast("string"), F.lit(". "), x["said"])), outcomes(x)), "\n"))
    narration = F.nullif(F.array_join(F.transform(some("system"), lambda x: F.concat(F.lit("  "), x["said"])), "\n"), F.lit(""))
    options = F.nullif(F.array_join(option, "\n"), F.lit(""))
    missing = F.when(narration.isNull() & options.isNull(), "no details yet")
    return g.select("conv_id", F.md5(F.concat_ws("\n", F.concat(F.lit("event "), F.col("conv_id").cast("string")), narration, options, missing)).alias("text_md5"))


@query(rf"""WITH {HTML_TEXT_SQL}, e AS (SELECT page_id, url, substr(CASE page_id % 3 WHEN 0 THEN 'RT by @src' || page_id || ': ' WHEN 1 THEN 'R to @src' || page_id || ': ' ELSE '' END || regexp_extract(html, '(?s)<title>(.*?)</title>', 1), 1, 100) AS title, text || CASE WHEN page_id % 2 = 0 THEN ' https://mirror.example/search?q=x' ELSE '' END AS text, html FROM pages JOIN html_text USING (page_id))
SELECT page_id, 'x_' || coalesce(nullif(regexp_extract(url, '/[a-z]{{2}}/([0-9]+)', 1), ''), url) AS id, page_id % 3 = 0 AS retweet, page_id % 3 = 1 AS is_reply, CASE WHEN page_id % 3 = 1 THEN 'src' || page_id ELSE '' END AS reply_to, md5(regexp_replace(title, '^R to @[A-Za-z0-9_]+: *', '')) AS title_md5,
 md5(regexp_replace(regexp_replace(text, 'https?://[^ \n]*mirror[^ \n]*search[^ \n]*', '', 'g'), '^\s+|\s+$', '', 'g')) AS text_md5, regexp_matches(lower(title || text), 'video') AS is_video FROM e""")
def feed_entries(read, mirror: str = "mirror"):
    """Entries of a feed (here made of pages) as rows: forwarded or a reply by the title's prefix, whose mark goes; links to the mirror's search go from the text."""
    prefix = lambda s: F.concat(F.lit(s), F.col("page_id").cast("string"), F.lit(": "))
    mark = F.when(F.col("page_id") % 3 == 0, prefix("RT by @src")).when(F.col("page_id") % 3 == 1, prefix("R to @src")).otherwise("")
    text = F.concat(T.html_text(F.col("html")), F.when(F.col("page_id") % 2 == 0, f" https://{mirror}.example/search?q=x").otherwise(""))
    e = read("pages").select("page_id", "url", F.substring(F.concat(mark, F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)), 1, 100).alias("title"), text.alias("text"))
    reply = r"^\s*R to @([A-Za-z0-9_]+)[:：]\s*"
    clean = F.regexp_replace(F.regexp_replace("text", rf"(?i)https?://[^ \n]*{mirror}[^ \n]*search[^ \n]*", ""), r"^\s+|\s+$", "")
    return e.select(
        "page_id", F.concat(F.lit("x_"), F.coalesce(F.nullif(F.regexp_extract("url", "/[a-z]{2}/([0-9]+)", 1), F.lit("")), F.col("url"))).alias("id"), F.col("title").rlike(r"^\s*RT\s+by\s+@").alias("retweet"), F.col("title").rlike(reply).alias("is_reply"),
        F.regexp_extract("title", reply, 1).alias("reply_to"), F.md5(F.regexp_replace("title", reply, "")).alias("title_md5"), F.md5(clean).alias("text_md5"), F.lower(F.concat("title", "text")).rlike("video").alias("is_video"),
    )


_SEGMENTS = "array<struct<type:string,data:struct<qq:string,text:string>>>"


@query(r"""SELECT conv_id, turn, turn % 3 = 0 AS at_bot, CASE WHEN turn % 4 = 1 THEN 'find' ELSE '' END AS command, md5(regexp_replace(CASE WHEN turn % 4 = 1 THEN '/find ' ELSE '' END || text, '^\s+|\s+$', '', 'g')) AS text_md5, md5(CASE WHEN turn % 4 = 1 THEN regexp_replace(text, '^\s+|\s+$', '', 'g') ELSE '' END) AS args_md5
FROM conversations WHERE role = 'user'""")
def message_rows(read, bot: str = "1001"):
    """JSON events of a chat (here made of the turns) as rows: messages only, codes out of the text, mention of the bot, command and its words."""
    at = F.struct(F.lit("at").alias("type"), F.struct(F.lit(bot).alias("qq"), F.lit(None).cast("string").alias("text")).alias("data"))
    said = F.struct(F.lit("text").alias("type"), F.struct(F.lit(None).cast("string").alias("qq"), F.concat(F.when(F.col("turn") % 4 == 1, "/find ").otherwise(""), "text").alias("text")).alias("data"))
    message = F.when(F.col("turn") % 3 == 0, F.array(at, said)).otherwise(F.array(said))
    event = F.to_json(F.struct(F.when(F.col("role") == "user", "message").otherwise("notice").alias("post_type"), message.alias("message")))
    e = read("conversations").select("conv_id", "turn", F.from_json(event, f"post_type string, message {_SEGMENTS}").alias("e")).filter("e.post_type = 'message'")
    text = F.array_join(F.transform("e.message", lambda s: F.when(s["type"] == "at", F.concat(F.lit("[CQ:at,qq="), s["data"]["qq"], F.lit("]"))).otherwise(s["data"]["text"])), "")
    bare = F.regexp_replace(F.regexp_replace(text, r"\[CQ:[^\]]*\]", ""), r"^\s+|\s+$", "")
    asked = F.exists("e.message", lambda s: (s["type"] == "at") & (s["data"]["qq"] == bot))
    m = e.select("conv_id", "turn", asked.alias("at_bot"), bare.alias("t"))
    command = r"(?s)^/(\S+)\s*(.*)$"
    return m.select("conv_id", "turn", "at_bot", F.regexp_extract("t", command, 1).alias("command"), F.md5("t").alias("text_md5"), F.md5(F.regexp_extract("t", command, 2)).alias("args_md5"))


@query(r"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l, n_chars FROM documents)
SELECT doc_id, CAST(len(l) AS INTEGER) AS n_nodes, md5(array_to_string(l, chr(30))) AS nodes_md5, CASE WHEN n_chars % 5 > 2 THEN 'text:video: https://v.example/' || doc_id ELSE 'video:https://v.example/' || doc_id END AS last_segment FROM p""")
def forward_nodes(read):
    """Sections as nodes of a forwarded message, blank ones left out, and a reply's segments: text, images, videos, those too large as a link."""
    n = formats.nodes(F.split("text", "\n"), "sender")
    url = F.concat(F.lit("https://v.example/"), F.col("doc_id").cast("string"))
    parts = formats.segments(F.col("source"), F.array(), F.array(F.struct(url.alias("url"), (F.col("n_chars") % 5).alias("mb"))), 2)
    d = read("documents").select("doc_id", n.alias("n"), F.element_at(parts, -1).alias("s"))
    return d.select("doc_id", F.size("n").alias("n_nodes"), F.md5(F.array_join("n.content", "\x1e")).alias("nodes_md5"), F.concat_ws(":", "s.type", "s.data").alias("last_segment"))


_LEFTOVERS = "chr(10) || '|600px|center|x' || chr(10) || 'File:a/b.png | left' || chr(10) || '<b style=\"color:red\">see' || ' {{{1}}}{{t|u}} text here</b>' || chr(10) || 'justify-content: end' || chr(10) || '12.' || chr(10) || 'ab-face_1.png：sad' || chr(10) || '{| a | b |}x' || chr(10) || 'name: thing' || chr(10)"
_WORTH = " AND ".join(f"NOT regexp_matches(x, '{p.replace(chr(39), chr(39) * 2)}')" for p in cleaning.NOISE_LINES)


@query(f"""WITH p AS (SELECT page_id, {cleaning.sql(f"html || {_LEFTOVERS} || html", cleaning.CLEAN_PATTERNS)} AS t FROM pages),
 l AS (SELECT page_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '{cleaning.EDGES}', '', 'g')), lambda x: {_WORTH} AND (len(regexp_extract_all(x, '[\\x{{4e00}}-\\x{{9fff}}]')) >= 3 OR len(regexp_extract_all(x, '[A-Za-z\\x{{4e00}}-\\x{{9fff}}]')) >= 5 OR regexp_matches(x, '{cleaning.KEPT_LINE}'))) AS l FROM p)
SELECT page_id, CAST(len(l) AS INTEGER) AS n_lines, md5(array_to_string(l, chr(10))) AS cleaned_md5 FROM l""")
def text_clean_markup(read):
    """The 23 ordered rewrites of page text and the rule for lines, on pages with leftovers of markup planted in them."""
    t = cleaning.clean_page(F.concat("html", F.expr(_LEFTOVERS.replace("chr(10)", "'\\n'")), "html"))
    return read("pages").select("page_id", t.alias("t")).select("page_id", F.when(F.col("t") == "", 0).otherwise(F.size(F.split("t", "\n"))).alias("n_lines"), F.md5("t").alias("cleaned_md5"))


_MARKS = "'== A title ==' || chr(10) || '* item' || chr(10) || '# one' || chr(10) || chr(10) || chr(10) || '===== Deep =====' || chr(10) || '<!-- no ' || chr(10) || ' no -->[[page|shown]] [[plain]] [https://e.example/x out] <ref name=\"a\">r</ref>{{t|u}} '"


@query(f"""SELECT conv_id, turn, md5(regexp_replace({cleaning.sql(f"{_MARKS} || repeat(chr(39), 3) || text || repeat(chr(39), 3)", cleaning.WIKI_PATTERNS)}, '{cleaning.EDGES}', '', 'g')) AS markdown_md5 FROM conversations""")
def wikitext_markdown(read):
    """The 17 ordered rewrites of wiki markup to Markdown, on turns with markup planted around them."""
    raw = F.concat(F.expr(_MARKS.replace("chr(10)", "'\\n'")), F.lit("'''"), "text", F.lit("'''"))
    return read("conversations").select("conv_id", "turn", F.md5(cleaning.wiki_to_markdown(raw)).alias("markdown_md5"))


@query("""WITH n AS (SELECT array_to_string(string_split(text, ' ')[1:2], ' ') AS name FROM benchmark GROUP BY 1), d AS (SELECT doc_id, string_split(regexp_replace(text, '[ \\n]+', ' ', 'g'), ' ') AS w FROM documents),
 g AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS name FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d))
SELECT name, count(*) AS n_documents, min(doc_id) AS first_document FROM n JOIN g USING (name) GROUP BY name""")
def names_in_texts(read):
    """Names of two words that a text contains: the texts' pairs of words meet the names, so no text meets every name."""
    n = read("benchmark").select(F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("name")).distinct()
    d = read("documents").select("doc_id", F.split(F.regexp_replace("text", r"[ \n]+", " "), " ").alias("w"))
    pairs = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))
    g = d.filter(F.size("w") > 1).select("doc_id", F.explode(F.array_distinct(pairs)).alias("name"))
    return n.join(g, "name").groupBy("name").agg(F.count("*").alias("n_documents"), F.min("doc_id").alias("first_document"))


_COMPARED = ("ECONOMY - red widget and PROMO - blue anvil", "small ring vs blue anvil", "ECONOMY - red widget vs ECONOMY - red widget", "ECONOMY - red widget", "ECONOMY - red wid versus PROMO - blue anv")
_BETWEEN = r"^(.*?)\s*(?: and | versus | vs )\s*(.*)$"


@query(f"""WITH n AS (SELECT p_type || ' - ' || p_name AS name, count(*) AS n, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY 1), v(q) AS (VALUES {", ".join(f"('{q}')" for q in _COMPARED)}), q AS (SELECT q, 1 AS side, regexp_extract(q, '{_BETWEEN}', 1) AS s FROM v UNION ALL SELECT q, 2, regexp_extract(q, '{_BETWEEN}', 2) FROM v),
 h AS (SELECT q, side, name, n, lo, hi, name = s AS equal, count(*) OVER (PARTITION BY q, side) AS c FROM q JOIN n ON s <> '' AND (contains(name, s) OR (length(s) >= 2 AND contains(s, name)))),
 r AS (SELECT q, side, name, n, lo, hi FROM h WHERE equal OR (c = 1))
SELECT v.q AS question, 'name: ' || a.name || ' | ' || b.name || chr(10) || 'records: ' || a.n || ' | ' || b.n || chr(10) || 'sizes: ' || a.lo || '-' || a.hi || ' | ' || b.lo || '-' || b.hi AS answer
FROM v LEFT JOIN r a ON a.q = v.q AND a.side = 1 LEFT JOIN r b ON b.q = v.q AND b.side = 2 AND a.name <> b.name""")
def compare_answer(read, questions=_COMPARED):
    """A question cut at its first and, vs or versus; both sides must resolve, exactly or as the only name contained either way, to different records."""
    names = read("part").groupBy(F.concat_ws(" - ", "p_type", "p_name").alias("name")).agg(F.count("*").alias("n"), F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))

    def sides(q: str):
        found = re.match(_BETWEEN, q)
        return [(q, i, s) for i, s in enumerate(found.groups())] if found else [(q, 0, "")]

    asked = F.array(*(F.struct(F.lit(q).alias("question"), F.lit(i).alias("side"), F.lit(s).alias("s")) for question in questions for q, i, s in sides(question)))
    name, s = F.col("name"), F.col("s")
    t = names.select("*", F.explode(asked).alias("a")).select("name", "n", "lo", "hi", "a.*")
    hit = (s != "") & (F.contains(name, s) | ((F.length(s) >= 2) & F.contains(s, name)))
    whole = F.struct("name", F.col("n").cast("string").alias("n"), F.concat_ws("-", F.col("lo").cast("string"), F.col("hi").cast("string")).alias("sizes"))
    one = t.groupBy("question", "side").agg(F.count_if(hit).alias("c"), F.min(F.when(hit & (name == s), whole)).alias("equal"), F.min(F.when(hit, whole)).alias("first"))
    r = one.groupBy("question").pivot("side", [0, 1]).agg(F.first(F.coalesce("equal", F.when(F.col("c") == 1, F.col("first")))))
    line = lambda label, k: F.concat(F.lit(label), F.col(f"`0`.{k}"), F.lit(" | "), F.col(f"`1`.{k}"))
    both = F.concat(line("name: ", "name"), F.lit("\n"), line("records: ", "n"), F.lit("\n"), line("sizes: ", "sizes"))
    return r.select("question", F.when(F.col("`0`.name") != F.col("`1`.name"), both).alias("answer"))


@query("""WITH e AS (SELECT *, count(*) FILTER (WHERE event_type = 'view') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS thread FROM events),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id, thread ORDER BY ts, event_id) AS i FROM e WHERE thread > 0),
 t AS (SELECT user_id, thread, min(event_id) FILTER (WHERE i = 1) AS post, count(*) - 1 AS n_replies, string_agg(CASE WHEN i = 1 THEN 'post ' ELSE '> ' || event_type || ' ' END || event_id, chr(10) ORDER BY i) FILTER (WHERE i <= 4) AS body FROM r GROUP BY 1, 2)
SELECT user_id, post, n_replies, body FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY thread DESC) AS n FROM t) WHERE n <= 2""")
def feed_latest(read, newest: int = 2, replies: int = 3):
    """Of each account the newest posts, each with its text and the first few of what follows up to the next post. Threads are totalled before they are ranked."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read("events").select("user_id", "ts", "event_id", "event_type").withColumn("thread", F.count_if(F.col("event_type") == "view").over(by.rowsBetween(Window.unboundedPreceding, 0))).filter("thread > 0")
    r = e.withColumn("i", F.row_number().over(Window.partitionBy("user_id", "thread").orderBy("ts", "event_id")))
    line = F.concat(F.when(F.col("i") == 1, "post ").otherwise(F.concat(F.lit("> "), "event_type", F.lit(" "))), F.col("event_id").cast("string"))
    t = r.groupBy("user_id", "thread").agg(F.min(F.when(F.col("i") == 1, F.col("event_id"))).alias("post"), (F.count("*") - 1).alias("n_replies"), F.array_sort(F.collect_list(F.when(F.col("i") <= replies + 1, F.struct("i", line.alias("line"))))).alias("s"))
    last = Window.partitionBy("user_id").orderBy(F.desc("thread"))
    return t.withColumn("n", F.row_number().over(last)).filter(F.col("n") <= newest).select("user_id", "post", "n_replies", F.array_join("s.line", "\n").alias("body"))


#: Messages for the whole cascade: those of direct_answer and compare_answer, a switch, a number, misspelt names.
MESSAGES = tuple(dict.fromkeys((*QUESTIONS, *_COMPARED, "become guide", "2", "pull 10", "pull", "ECONOMY - red wigdet", "ECONOMY - red rign", "how do I win")))
_MV = "(VALUES " + ", ".join(f"('{q}')" for q in MESSAGES) + ")"


@query(f"""WITH m(q) AS {_MV}, d AS ({ORACLE_SQL["direct_answer"].replace(_Q, _MV + " q(q)")}), c AS ({ORACLE_SQL["compare_answer"].replace("(VALUES " + ", ".join(f"('{q}')" for q in _COMPARED) + ")", _MV)}),
 n AS (SELECT DISTINCT p_type || ' - ' || p_name AS name FROM part), s AS (SELECT q, name, 100 * (1 - levenshtein(name, q)::DOUBLE / greatest(length(name), length(q))) AS score FROM m, n),
 k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, name) AS i FROM s), f AS (SELECT q, max(CASE WHEN i = 1 THEN name END) AS name, max(CASE WHEN i = 1 THEN score END) AS top, max(CASE WHEN i = 2 THEN score END) AS next FROM k WHERE i <= 2 GROUP BY q)
SELECT m.q AS message, CASE WHEN regexp_matches(m.q, '^become [a-z]+$') THEN 'switch' WHEN regexp_matches(m.q, '^[0-9]+$') THEN 'choice' WHEN regexp_matches(m.q, '^pull( [0-9]+)?$') THEN 'draw' WHEN d.kind <> 'none' THEN d.kind WHEN c.answer IS NOT NULL THEN 'compared' WHEN f.top >= 85 AND (f.next IS NULL OR f.top - f.next >= 10) THEN 'fuzzy' ELSE 'search' END AS step,
 CASE WHEN regexp_matches(m.q, '^become [a-z]+$') THEN m.q[8:] WHEN regexp_matches(m.q, '^[0-9]+$') THEN m.q WHEN regexp_matches(m.q, '^pull( [0-9]+)?$') THEN coalesce(nullif(m.q[6:], ''), '1') WHEN d.kind <> 'none' THEN d.answer WHEN c.answer IS NOT NULL THEN c.answer WHEN f.top >= 85 AND (f.next IS NULL OR f.top - f.next >= 10) THEN f.name END AS answer
FROM m LEFT JOIN d ON d.question = m.q LEFT JOIN c ON c.question = m.q LEFT JOIN f ON f.q = m.q""")
def answer_cascade(read, messages=MESSAGES):
    """The first step that has an answer: a switch of the speaker, a number that chooses, draws, a direct answer or choices, two records compared, a fuzzy name (85 or more, and 10 ahead of the next), else search."""
    names = read("part").select(F.concat_ws(" - ", "p_type", "p_name").alias("name")).distinct()
    t = names.select("name", F.explode(F.array(*map(F.lit, messages))).alias("message"))
    t = t.withColumn("score", 100 * (1 - F.levenshtein("name", "message") / F.greatest(F.length("name"), F.length("message"))))
    k = t.withColumn("i", F.row_number().over(Window.partitionBy("message").orderBy(F.desc("score"), "name"))).filter("i <= 2")
    of = lambda i, c: F.max(F.when(F.col("i") == i, F.col(c)))
    f = k.groupBy("message").agg(of(1, "name").alias("fuzzy"), of(1, "score").alias("top"), of(2, "score").alias("next"))
    d = direct_answer(read, messages).select(F.col("question").alias("message"), "kind", F.col("answer").alias("direct"))
    c = compare_answer(read, messages).select(F.col("question").alias("message"), F.col("answer").alias("compared"))
    j = f.join(d, "message", "left").join(c, "message", "left")  # a row for each message
    m = F.col("message")
    sure = (F.col("top") >= 85) & (F.col("next").isNull() | (F.col("top") - F.col("next") >= 10))
    steps = (
        (m.rlike("^become [a-z]+$"), F.lit("switch"), F.substring(m, 8, 1000)), (m.rlike("^[0-9]+$"), F.lit("choice"), m), (m.rlike("^pull( [0-9]+)?$"), F.lit("draw"), F.coalesce(F.nullif(F.substring(m, 6, 1000), F.lit("")), F.lit("1"))),
        (F.col("kind") != "none", F.col("kind"), F.col("direct")), (F.col("compared").isNotNull(), F.lit("compared"), F.col("compared")), (sure, F.lit("fuzzy"), F.col("fuzzy")),
    )
    found = F.struct(F.lit("search").alias("step"), F.lit(None).cast("string").alias("answer"))
    for holds, step, answer in reversed(steps):
        found = F.when(holds, F.struct(step.alias("step"), answer.alias("answer"))).otherwise(found)
    return j.select("message", found.alias("f")).select("message", "f.*")
