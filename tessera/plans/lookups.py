"""Names in messages by tiers, lookups that fall back inside one plan, and whole branches of pages by number or name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.plans.catalog import query
from tessera.sources.staged import staged

#: Another word for a first name, too general words, and the sign of the first tier. Parameters.
ALIASES, GENERAL, TAG = {"thrift": "ECONOMY"}, ("ECONOMY", "STANDARD", "(phase one)"), "(?i)lcb"


def _said(*cases: tuple[int, Column], n: int) -> Column:
    out = F.lit("nothing known")
    for k, c in cases:
        out = F.when(F.col("p_partkey") % n == k, c).otherwise(out)
    return out


@query("""WITH m AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'who is ' || upper(p_name || '/' || left(p_type, 3)) || '?' WHEN 1 THEN p_type || ' Lcb sinner skills' WHEN 2 THEN 'skills of ' || p_type || ' - ' || p_name WHEN 3 THEN 'about ' || p_brand || ' and ' || p_type || ' - ' || p_name WHEN 4 THEN 'THRIFT LCB' WHEN 5 THEN 'lcb list'
   WHEN 6 THEN 'skills of ' || p_name || '/' || lower(left(p_type, 3)) || ', not ' || p_type || ' - red widget' ELSE 'nothing known' END AS said FROM part),
 d AS (SELECT DISTINCT p_type AS code, p_type || 'LCB' AS title, 0 AS tier, 0 AS rank, true AS ci, true AS tag FROM part UNION ALL SELECT 'thrift', 'ECONOMYLCB', 0, 0, true, true
  UNION ALL SELECT DISTINCT p_name || '/' || lower(left(p_type, 3)), min(p_type) || ' - ' || p_name, 1, 0, true, false FROM part GROUP BY p_name, lower(left(p_type, 3))
  UNION ALL SELECT p_brand, min(p_type || ' - ' || p_name), 2, -CAST(substr(p_brand, 7) AS INTEGER), false, false FROM part GROUP BY p_brand
  UNION ALL SELECT DISTINCT p_type || ' - ' || p_name, p_type || ' - ' || p_name, 3, 0, false, false FROM part),
 h AS (SELECT p_partkey, title, tier, row_number() OVER (PARTITION BY p_partkey ORDER BY tier, rank, -length(code), title) AS r FROM m JOIN d ON contains(lower(said), lower(code)) AND (ci OR contains(said, code)) AND (NOT tag OR contains(lower(said), 'lcb')))
SELECT p_partkey, said, title, CAST(tier AS INTEGER) AS tier FROM m LEFT JOIN (SELECT * FROM h WHERE r = 1) USING (p_partkey)""")
def names_cascade(read):
    """The title that a message means: first names with the tag, nicknames in any case, fragments in their written order, titles; the longest first."""
    p = read("part")
    title, short = F.concat_ws(" - ", "p_type", "p_name"), F.concat("p_name", F.lit("/"), F.lower(F.substring("p_type", 1, 3)))
    said = _said(
        (0, F.concat(F.lit("who is "), F.upper(short), F.lit("?"))), (1, F.concat("p_type", F.lit(" Lcb sinner skills"))), (2, F.concat(F.lit("skills of "), title)), (3, F.concat(F.lit("about "), "p_brand", F.lit(" and "), title)), (4, F.lit("THRIFT LCB")), (5, F.lit("lcb list")),
        (6, F.concat(F.lit("skills of "), short, F.lit(", not "), "p_type", F.lit(" - red widget"))), n=8,
    )
    messages = p.select("p_partkey", said.alias("said"))
    row = lambda df, code, title, tier, rank=0, any_case=False, needs_tag=False: df.select(code.alias("code"), title.alias("title"), F.lit(tier).alias("tier"), (F.lit(rank) if isinstance(rank, int) else rank).alias("rank"), F.lit(any_case).alias("any_case"), F.lit(needs_tag).alias("needs_tag"))
    first = row(p.select("p_type").distinct(), F.col("p_type"), F.concat("p_type", F.lit("LCB")), 0, any_case=True, needs_tag=True)
    other = p.sparkSession.createDataFrame(list(ALIASES.items()), "code string, name string")
    other = row(other, F.col("code"), F.concat("name", F.lit("LCB")), 0, any_case=True, needs_tag=True)
    nick = row(p.groupBy(short.alias("code"), "p_name").agg(F.min("p_type").alias("t")), F.col("code"), F.concat_ws(" - ", "t", "p_name"), 1, any_case=True)
    brands = p.groupBy("p_brand").agg(F.min(title).alias("t"))
    fragments = row(brands, F.col("p_brand"), F.col("t"), 2, rank=-F.substring("p_brand", 7, 9).cast("int"))
    titles = row(p.select(title.alias("t")).distinct(), F.col("t"), F.col("t"), 3)
    tagged = first.unionByName(other).unionByName(nick).unionByName(fragments).unionByName(titles)
    return messages.join(names.cascade(messages, "p_partkey", "said", tagged, TAG), "p_partkey", "left")


_KNOWN = "p_type || ' - ' || p_name || CASE WHEN length(p_name) % 2 = 0 THEN ' (phase one)' ELSE '' END"


@query(f"""WITH n AS (SELECT DISTINCT {_KNOWN} AS name, p_name AS bare FROM part), m AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'data of ' || {_KNOWN} || ' now' WHEN 1 THEN 'say ' || replace({_KNOWN}, ' ', '') WHEN 2 THEN ' ' || p_name WHEN 3 THEN 'x' || replace(p_name, ' ', '') || ' info' WHEN 4 THEN p_type || ' - ' WHEN 5 THEN {_KNOWN} ELSE 'zzz' END AS said FROM part),
 q AS (SELECT DISTINCT trim(said) AS q FROM m), a AS (SELECT q, name, bare, replace(q, ' ', '') AS qc, replace(name, ' ', '') AS nc FROM q, n),
 one AS (SELECT q, name, CASE WHEN contains(q, name) THEN name ELSE q END AS match FROM a WHERE contains(q, name) OR (contains(name, q) AND length(q) > 1 AND q NOT IN ('ECONOMY', 'STANDARD', '(phase one)'))),
 two AS (SELECT q, name, CASE WHEN contains(qc, nc) THEN nc ELSE qc END AS match FROM a WHERE length(qc) > 1 AND (contains(qc, nc) OR (contains(nc, qc) AND qc NOT IN ('ECONOMY', 'STANDARD', '(phase one)')))),
 form AS (SELECT bare AS v, false AS c FROM n UNION SELECT replace(bare, ' ', ''), false FROM n UNION SELECT split_part(name, ' - ', 2), false FROM n UNION SELECT replace(name, ' ', ''), true FROM n),
 three AS (SELECT q, v FROM q, form WHERE contains(CASE WHEN c THEN replace(q, ' ', '') ELSE q END, v)),
 b AS (SELECT q, 1 AS tier, name AS found, row_number() OVER (PARTITION BY q ORDER BY match <> q, -length(match), name) AS r FROM one UNION ALL SELECT q, 2, name, row_number() OVER (PARTITION BY q ORDER BY match <> q, -length(match), name) FROM two UNION ALL SELECT q, 3, v, row_number() OVER (PARTITION BY q ORDER BY -length(v), v) FROM three),
 w AS (SELECT q, min(tier) AS tier, arg_min(found, tier) AS found FROM b WHERE r = 1 GROUP BY q)
SELECT p_partkey, trim(said) AS said, found, CAST(tier AS INTEGER) AS tier FROM m LEFT JOIN w ON w.q = trim(said)""")
def names_both_ways(read):
    """What a message names: contained either way, without spaces, then by variants of names (last part, without brackets)."""
    known = F.concat_ws(" - ", "p_type", F.concat("p_name", F.when(F.length("p_name") % 2 == 0, " (phase one)").otherwise("")))
    said = _said(
        (0, F.concat(F.lit("data of "), known, F.lit(" now"))), (1, F.concat(F.lit("say "), names.closed(known))), (2, F.concat(F.lit(" "), "p_name")), (3, F.concat(F.lit("x"), names.closed("p_name"), F.lit(" info"))), (4, F.concat("p_type", F.lit(" - "))), (5, known), (6, F.lit("zzz")), n=7,
    )
    messages = read("part").select("p_partkey", F.trim(said).alias("said"))
    return messages.join(names.detect(messages, "p_partkey", "said", read("part").select(known.alias("name")), GENERAL), "p_partkey", "left")


# --- lookups -----------------------------------------------------------------------------------------------------

#: Words for effects (other words for one of them too) and the digits of rarities. Parameters.
EFFECTS = {"ECONOMY": "ECONOMY", "cheap": "ECONOMY", "STANDARD": "STANDARD", "PROMO": "PROMO", "PROMOTION": "PROMO"}
_EFFECT = "(" + "|".join(sorted(EFFECTS, key=lambda w: (-len(w), w))) + ")"


def constraints(text: str) -> tuple[Column, Column]:
    """(effect, rarity) that a question asks for, by its first words of that kind; null where it names none."""
    words = F.create_map(*(F.lit(x) for pair in EFFECTS.items() for x in pair))
    effect, rarity = F.nullif(F.regexp_extract(text, _EFFECT, 1), F.lit("")), F.nullif(F.regexp_extract(text, "rank ([0-6])", 1), F.lit(""))
    return F.when(effect.isNotNull(), F.try_element_at(words, effect)), rarity.cast("int")


def or_else(queries: DataFrame, found: DataFrame, key: str, rest) -> DataFrame:
    """found, and for the queries (key) that have no row there the rows of rest(those queries), without a branch on the driver.

    The queries left over are a table of known size, with which rest joins: where none are left, Spark broadcasts nothing
    and drops the scan at run time; many are joined as any two tables.
    """
    left = staged(queries.join(found.select(key).distinct(), key, "leftanti"))
    return found.withColumn("path", F.lit("search")).unionByName(rest(left).withColumn("path", F.lit("scan")))


@query(f"""WITH q AS (SELECT s_suppkey, 'Brand#' || (s_suppkey % 25 + 1) AS brand, CASE s_suppkey % 5 WHEN 0 THEN 'cheap rank ' || (s_suppkey % 7) WHEN 1 THEN 'PROMOTION things' WHEN 2 THEN 'rank ' || (s_suppkey % 9) WHEN 3 THEN 'STANDARD or ECONOMY of rank 1' ELSE 'anything' END AS said FROM supplier),
 c AS (SELECT *, CASE regexp_extract(said, '{_EFFECT}', 1) WHEN 'cheap' THEN 'ECONOMY' WHEN 'PROMOTION' THEN 'PROMO' WHEN '' THEN NULL ELSE regexp_extract(said, '{_EFFECT}', 1) END AS effect, TRY_CAST(nullif(regexp_extract(said, 'rank ([0-6])', 1), '') AS INTEGER) AS rarity FROM q),
 h AS (SELECT s_suppkey, p_partkey, p_name, p_type, p_size % 7 AS rarity, row_number() OVER (PARTITION BY s_suppkey ORDER BY p_partkey) AS r FROM c JOIN part ON p_brand = brand),
 f AS (SELECT c.s_suppkey, p_partkey, p_name FROM h JOIN c ON c.s_suppkey = h.s_suppkey AND r <= 5 AND (effect IS NULL OR effect = p_type) AND (c.rarity IS NULL OR c.rarity = h.rarity)),
 l AS (SELECT * FROM c WHERE s_suppkey NOT IN (SELECT s_suppkey FROM f) AND (effect IS NOT NULL OR rarity IS NOT NULL))
SELECT *, 'search' AS path FROM f UNION ALL SELECT s_suppkey, min(p_partkey), p_name, 'scan' FROM l JOIN part ON (effect IS NULL OR effect = p_type) AND (rarity IS NULL OR rarity = p_size % 7) GROUP BY s_suppkey, p_name""")
def lookup_fallback(read):
    """Found records held to the effect and rarity that a question asks for; a question left without any takes all records that fit, each title once."""
    said = F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("cheap rank "), (F.col("s_suppkey") % 7).cast("string"))).when(F.col("s_suppkey") % 5 == 1, "PROMOTION things").when(F.col("s_suppkey") % 5 == 2, F.concat(F.lit("rank "), (F.col("s_suppkey") % 9).cast("string")))
    said = said.when(F.col("s_suppkey") % 5 == 3, "STANDARD or ECONOMY of rank 1").otherwise("anything")
    effect, rarity = constraints("said")
    q = read("supplier").select("s_suppkey", F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25 + 1).cast("string")).alias("brand"), said.alias("said")).select("s_suppkey", "brand", effect.alias("effect"), rarity.alias("rarity"))
    p = read("part").select("p_partkey", "p_name", "p_type", "p_brand", (F.col("p_size") % 7).alias("has"))
    top = p.withColumn("r", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))).filter("r <= 5")  # a question's best five
    fits = "(effect is null or effect = p_type) and (rarity is null or rarity = has)"
    found = q.join(top, F.col("brand") == F.col("p_brand")).filter(fits).select("s_suppkey", "p_partkey", "p_name")

    def scan(left: DataFrame) -> DataFrame:
        # all that fits, by its own values: records under their effect, rarity, both, so that the join is one of equal keys
        open_ = left.filter("effect is not null or rarity is not null")
        kinds = p.groupBy("p_type", "has", "p_name").agg(F.min("p_partkey").alias("p_partkey"))
        asked = F.explode(F.array(F.struct(F.col("p_type").alias("e"), F.col("has").alias("r")), F.struct(F.col("p_type").alias("e"), F.lit(None).cast("long").alias("r")), F.struct(F.lit(None).cast("string").alias("e"), F.col("has").alias("r"))))
        under = kinds.select("p_name", "p_partkey", asked.alias("k")).select("p_name", "p_partkey", "k.*")
        hits = open_.join(under, open_["effect"].eqNullSafe(under["e"]) & open_["rarity"].eqNullSafe(under["r"].cast("int")))
        return hits.groupBy("s_suppkey", "p_name").agg(F.min("p_partkey").alias("p_partkey")).select("s_suppkey", "p_partkey", "p_name")

    return or_else(q, found, "s_suppkey", scan)


#: Numbers of chapters that are asked for (bad ones find nothing), and names. Parameters.
CHAPTERS, NAMES = ("8-33-06", "8-3", "8", "8-", "x8", "3-11", ""), ("ion", "ring", "Vi")


@query(f"""WITH d AS (SELECT doc_id, (doc_id % 9) || '-' || (doc_id % 40) || '-' || lpad(CAST(doc_id % 7 AS VARCHAR), 2, '0') AS title, CASE WHEN doc_id % 3 = 0 THEN 'other' ELSE 'dialogue' END AS kind FROM documents),
 q AS (SELECT unnest({list(CHAPTERS)!r}) AS chapter)
SELECT chapter, title, min(doc_id) AS doc_id FROM q JOIN d ON kind = 'dialogue' AND starts_with(title, chapter) WHERE regexp_full_match(chapter, '[0-9]+(-[0-9]+)*') GROUP BY chapter, title""")
def chapter_pages(read, chapters=CHAPTERS):
    """All dialogue pages below a chapter number, the first of each title: numbers meet titles by the titles' own beginnings."""
    d = read("documents")
    title = F.concat_ws("-", (F.col("doc_id") % 9).cast("string"), (F.col("doc_id") % 40).cast("string"), F.lpad((F.col("doc_id") % 7).cast("string"), 2, "0"))
    pages = d.select("doc_id", title.alias("title"), F.when(F.col("doc_id") % 3 == 0, "other").otherwise("dialogue").alias("kind")).filter("kind = 'dialogue'").groupBy("title").agg(F.min("doc_id").alias("doc_id"))
    asked = d.sparkSession.createDataFrame([(c,) for c in chapters], "chapter string").filter(F.col("chapter").rlike(r"^\d+(-\d+)*$"))
    starts = pages.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.length("title")), lambda n: F.substring("title", F.lit(1), n))).alias("chapter"))
    return starts.join(asked, "chapter").select("chapter", "title", "doc_id")


@query(f"""WITH d AS (SELECT doc_id, source || '-' || (doc_id % 50) AS title, text FROM documents WHERE doc_id % 4 = 0), q AS (SELECT unnest({list(NAMES)!r}) AS name)
SELECT name, title, min(doc_id) AS doc_id FROM q JOIN d ON contains(title, name) OR contains(text, name) GROUP BY name, title""")
def named_pages(read, asked=NAMES):
    """All pages of a kind that have a name in their title or text, the first of each title; one pass for a short list of names."""
    d = read("documents").filter("doc_id % 4 = 0").select("doc_id", F.concat_ws("-", "source", (F.col("doc_id") % 50).cast("string")).alias("title"), "text")
    hit = F.filter(F.array(*map(F.lit, asked)), lambda n: F.contains("title", n) | F.contains("text", n))
    return d.select("doc_id", "title", F.explode(hit).alias("name")).groupBy("name", "title").agg(F.min("doc_id").alias("doc_id"))
