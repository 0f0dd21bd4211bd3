"""Cleaning, classification, quality and link queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.rounding import micro
from tessera.plans.catalog import query


@query(r"""
WITH c AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\[\[[^\]|]*\|([^\]]*)\]\]', '\1', 'g'), '\[\[([^\]]*)\]\]', '\1', 'g'), '<[^>]*>', '', 'g'), '[*#%&$!]{2,}', '', 'g'), '[ \t]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: len(regexp_extract_all(x, '\p{L}')) >= 6) AS l FROM documents)
SELECT doc_id, CAST(len(l) AS INTEGER) AS n_lines, md5(array_to_string(l, chr(10))) AS cleaned_md5 FROM c""")
def text_clean_lines(read):
    c = T.clean(F.col("text"))
    return read("documents").select("doc_id", c.alias("c")).select("doc_id", F.when(F.col("c") == "", 0).otherwise(F.size(F.split("c", "\n"))).alias("n_lines"), F.md5("c").alias("cleaned_md5"))


@query(r"""
WITH q AS (SELECT doc_id, lang, length(text) AS n, len(regexp_extract_all(text, '\p{L}')) AS l, len(regexp_extract_all(text, '\p{L}{3,}')) AS w, len(regexp_extract_all(text, '[*#%&$!]{2,}')) AS h FROM documents),
 s AS (SELECT doc_id, lang, CASE WHEN n < 20 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.6::DOUBLE * l / n + 0.5::DOUBLE * least(w::DOUBLE / n, 0.3::DOUBLE) - least(0.8::DOUBLE, 0.15::DOUBLE * h))) END AS score FROM q)
SELECT doc_id, floor(score * 1e6 + 0.5) / 1e6 AS score, score >= CASE lang WHEN 'en' THEN 0.35::DOUBLE WHEN 'de' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END AS kept FROM s""")
def text_quality_filter(read):
    score = T.quality(F.col("text"), r"\p{L}", r"[*#%&$!]{2,}")
    threshold = F.when(F.col("lang") == "en", 0.35).when(F.col("lang") == "de", 0.3).otherwise(0.2)
    return read("documents").select("doc_id", "lang", score.alias("s")).select("doc_id", micro(F.col("s")).alias("score"), (F.col("s") >= threshold).alias("kept"))


@query(r"""
SELECT doc_id, len(regexp_extract_all(text, '\p{L}{3,}')) < 3 OR len(regexp_extract_all(text, '[*#%&$!]{2,}|https?://|\{\{|\}\}')) >= len(regexp_extract_all(text, '\p{L}{3,}')) AS noise,
 length(trim(text, ' ')) < 30 OR len(regexp_extract_all(text, '\p{L}{3,}')) < 3 AS empty,
 len(l) >= 5 AND len(r) >= 3 AND len(list_filter(r, lambda x: regexp_matches(x, '^[^:\s]{1,20}: '))) >= 0.4 * len(r) AS dialogue
FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l, list_filter(string_split(text, chr(10))[4:], lambda x: length(trim(x, ' ')) > 3) AS r FROM documents)""")
def text_noise_flags(read):
    words = T.count(F.col("text"), r"\p{L}{3,}")
    noise = (words < 3) | (T.count(F.col("text"), r"[*#%&$!]{2,}|https?://|\{\{|\}\}") >= words)
    return read("documents").select("doc_id", noise.alias("noise"), T.empty_after_clean(F.col("text")).alias("empty"), T.dialogue_like(F.col("text")).alias("dialogue"))


@query(r"""
SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
 CASE WHEN regexp_matches(url, '/(fr|es)/') THEN 'plot' WHEN regexp_matches(url, '\.html$') THEN 'article' WHEN url LIKE '%utm_source%' OR url LIKE '%?page=%' THEN 'listing' WHEN html LIKE '%<article>%' THEN 'character' ELSE 'other' END AS page_type,
 regexp_matches(url, '(?i)/(login|search|tag|user|template|file|category)[:/]') OR length(html) < 300 AS junk
FROM pages""")
def page_type_classify(read):
    u, h = F.col("url"), F.col("html")
    kind = F.when(u.rlike("/(fr|es)/"), "plot").when(u.rlike(r"\.html$"), "article").when(u.contains("utm_source") | u.contains("?page="), "listing").when(h.contains("<article>"), "character").otherwise("other")
    junk = u.rlike("(?i)/(login|search|tag|user|template|file|category)[:/]") | (F.length(h) < 300)
    return read("pages").select("page_id", F.regexp_extract(u, "^https?://([^/?#]+)", 1).alias("host"), kind.alias("page_type"), junk.alias("junk"))


#: The chain of functions.text.html_text as common tables that end in html_text (page_id, text).
HTML_TEXT_SQL = r"""a AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'g') AS h FROM pages),
 b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h, '(?i)<a [^>]*href="([^"]*)"[^>]*>', ' \1 ', 'g'), '(?i)<(br|p|/p|div|/div|li|/li|tr|/tr|h[1-6]|/h[1-6])[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS h FROM a),
 c AS (SELECT page_id, replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS h FROM b),
 html_text AS (SELECT page_id, array_to_string(list_filter(list_transform(string_split(h, chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'), ' ')), lambda x: x <> ''), chr(10)) AS text FROM c)"""


@query(f"WITH {HTML_TEXT_SQL} SELECT page_id, md5(text) AS text_md5 FROM html_text")
def html_to_text(read):
    return read("pages").select("page_id", F.md5(T.html_text(F.col("html"))).alias("text_md5"))


_LINKS = r"""l AS (SELECT page_id, url, list_filter(list_transform(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1), lambda x: trim(x, ' ')), lambda x: x <> '') AS a FROM pages),
 e AS (SELECT DISTINCT page_id, url, unnest(a) AS t FROM l),
 t AS (SELECT page_id, CASE WHEN t LIKE '//%' THEN 'https:' || t WHEN t LIKE '/%' THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || t ELSE t END AS target FROM e)"""


@query(f"WITH {_LINKS} SELECT page_id, count(DISTINCT target) AS n_links, md5(string_agg(DISTINCT target, ' ' ORDER BY target)) AS links_md5 FROM t GROUP BY page_id")
def links_extract_distinct(read):
    full = F.array_distinct(F.transform(T.links(F.col("html")), lambda x: T.absolute(x, F.col("url"))))
    return read("pages").select("page_id", full.alias("l")).filter(F.size("l") > 0).select("page_id", F.size("l").cast("long").alias("n_links"), F.md5(F.array_join(F.array_sort("l"), " ")).alias("links_md5"))


@query(f"WITH {_LINKS} SELECT regexp_extract(target, '[^/]*$') AS target, count(DISTINCT page_id) AS n_sources, min(page_id) AS first_source FROM t GROUP BY 1")
def link_reverse_index(read):
    t = read("pages").select("page_id", F.explode(F.transform(T.links(F.col("html")), lambda x: T.absolute(x, F.col("url")))).alias("t"))
    return t.select("page_id", F.regexp_extract("t", "[^/]*$", 0).alias("target")).distinct().groupBy("target").agg(F.count("*").alias("n_sources"), F.min("page_id").alias("first_source"))


@query(r"""SELECT page_id, coalesce(nullif(regexp_extract(url, '/[a-z]{2}/([0-9]+)', 1), ''), url) AS item, coalesce(nullif(lower(regexp_extract(url, '^[^?#]*/[^/?#]*\.([A-Za-z0-9]{2,5})(?:[?#].*)?$', 1)), ''), 'file') AS ext FROM pages""")
def url_id_extract(read):
    return read("pages").select("page_id", F.coalesce(F.nullif(F.regexp_extract("url", "/[a-z]{2}/([0-9]+)", 1), F.lit("")), F.col("url")).alias("item"), T.extension(F.col("url"), "file").alias("ext"))


@query(r"""SELECT doc_id, 'doc_' || coalesce(nullif(regexp_replace(regexp_replace(source || ' ' || lang, '[^0-9A-Za-z\p{L}-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unnamed') AS file_name, regexp_extract(source, '[0-9]+$') AS suffix, trim(regexp_replace(source, '[0-9]+$', ''), ' ') AS bare FROM documents""")
def file_names(read):
    return read("documents").select("doc_id", T.file_name("doc", F.concat_ws(" ", "source", "lang")).alias("file_name"), F.regexp_extract("source", "[0-9]+$", 0).alias("suffix"), F.trim(F.regexp_replace("source", "[0-9]+$", "")).alias("bare"))


@query(r"""
WITH c AS (SELECT lang, length(text) AS n, len(regexp_extract_all(text, '\p{L}{3,}')) >= 3 AND length(trim(text, ' ')) >= 30 AS kept FROM documents)
SELECT lang, count(*) FILTER (WHERE kept) AS kept, count(*) FILTER (WHERE NOT kept) AS discarded, CAST(sum(n) AS BIGINT) AS chars FROM c GROUP BY lang""")
def clean_counters(read):
    d = read("documents").select("lang", F.length("text").alias("n"), (~T.empty_after_clean(F.col("text"))).alias("kept"))
    return d.groupBy("lang").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("discarded"), F.sum("n").alias("chars"))


@query(r"""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN lower(trim(event_type, ' ')) IN ('none', 'null') THEN '' ELSE trim(event_type, ' ') END AS kind FROM events""")
def json_props_parse(read):
    return read("events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), T.known(F.col("event_type")).alias("kind"))
