"""Facts and finer texts of records, and announcements out of feed items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import details
from tessera.plans.catalog import query
from tessera.plans.layouts import _LINES, _if, _lines, _text


@query("""WITH n AS (SELECT *, row_number() OVER w AS i, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
 b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY -least(length(text), 200), turn, text) AS best FROM n WHERE role = 'assistant'),
 l AS (SELECT conv_id, string_agg('  ·（' || conv_id || '-' || turn || '）' || CASE WHEN length(text) <= 70 THEN text ELSE left(text, 70) || '…' END, chr(10) ORDER BY best) AS x FROM b WHERE best <= 2 GROUP BY conv_id),
 p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS k FROM n WHERE role = 'assistant' AND r2 = 'user'),
 t AS (SELECT conv_id, string_agg('  ·（' || conv_id || '-' || turn || '）assistant：' || left(text, 50) || chr(10) || '    user：' || left(t2, 50), chr(10) ORDER BY k) AS x FROM p WHERE k <= 3 GROUP BY conv_id)
SELECT conv_id, md5(concat_ws(chr(10), CASE WHEN conv_id % 2 = 0 THEN '- 身份：ring elder（phase ' || (conv_id % 3) || '）' END, '- 剧情登场（assistant）：' || chr(10) || l.x, '- 与user的剧情互动：' || chr(10) || t.x)) AS facts_md5 FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN l USING (conv_id) LEFT JOIN t USING (conv_id)""")
def story_facts(read, entity: str = "assistant", focus: str = "user", most: int = 2, pairs: int = 3):
    """What a story tells of a role: who it is, its fullest lines, and its talks with another role; in one shuffle by conversation."""
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = read("conversations").withColumns({"i": F.row_number().over(by), "r2": F.lead("role").over(by), "t2": F.lead("text").over(by)})
    title = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    mine = F.col("role") == entity
    full = F.when(mine, F.struct((-F.least(F.length("text"), F.lit(200))).alias("less"), "turn", F.col("text").alias("text"), title.alias("title")))
    talk = F.when(mine & (F.col("r2") == focus), F.struct("i", title.alias("title"), F.col("text").alias("text"), F.col("t2").alias("answer")))
    g = n.groupBy("conv_id").agg(F.slice(F.array_sort(F.collect_list(full)), 1, most).alias("said"), F.slice(F.array_sort(F.collect_list(talk)), 1, pairs).alias("talks"))
    who = details.identity(_text("ring elder - ", F.lit(entity), "（phase ", F.col("conv_id") % 3, "）"))
    note = F.when(F.col("conv_id") % 2 == 0, who["note"])
    return g.select("conv_id", F.md5(details.story_facts(who["bare"], note, F.col("said"), F.lit(focus), F.col("talks"))).alias("facts_md5"))


@query(f"""WITH {_LINES}, s AS (SELECT l_orderkey, string_agg(CASE WHEN l_partkey % 5 = 0 THEN '【强化技能' || coalesce(['一','二','三','四','五','六','七','八','九','十'][pos], CAST(pos AS VARCHAR)) || '】n' || pos || '（强化' || pos || '技能）' WHEN l_suppkey % 4 = 0 THEN '【守备技能】n' || pos WHEN l_partkey % 5 = 1 THEN '【技能' || coalesce(['一','二','三','四','五','六','七','八','九','十'][pos], CAST(pos AS VARCHAR)) || '衍生】n' || pos || '（' || pos || '技能2）' ELSE '【技能' || coalesce(['一','二','三','四','五','六','七','八','九','十'][pos], CAST(pos AS VARCHAR)) || '】n' || pos END
  || chr(10) || 'I阶：基础值 ' || CASE WHEN l_suppkey % 2 = 0 THEN CAST(q AS VARCHAR) ELSE '—' END || ' | 变动值 ' || CASE WHEN q > 25 THEN '+' ELSE '' END || (q - 25) || CASE WHEN pos % 2 = 0 THEN ' | [on] hits ' || pos || '；burns' ELSE '' END
  || chr(10) || '硬币2：[on] cuts ' || q || '；cuts' || chr(10) || '硬币1：[on] first', chr(10) ORDER BY pos) AS skills FROM ln GROUP BY 1)
SELECT o_orderkey, md5(skills) AS skills_md5, md5('被动技能：' || chr(10) || '战斗：' || chr(10) || '- calm' || chr(10) || '- 人格被动 99（详见人格被动页面）' || chr(10) || '支援：' || chr(10) || '- aid：helps ' || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || '- only name' ELSE '' END || chr(10)) AS passives_md5,
 md5(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '语音台词：' || chr(10) || '- [met] hi ' || o_orderkey || chr(10) || '- b.ogg' || chr(10) END || CASE WHEN o_orderkey % 3 = 1 THEN '' ELSE CASE WHEN o_orderkey % 3 = 2 THEN chr(10) ELSE '' END || '技能语音：' || chr(10) || '- cut（c.ogg）' || chr(10) || '- only' || chr(10) END) AS voices_md5, '　- ring' || chr(10) || '　- heals' AS gifts,
 md5('- 敌方单位：beast' || chr(10) || '  登场关卡：stage ' || o_orderkey || chr(10) || '  hp：' || o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || '  chaos_threshold：5/9' ELSE '' END || chr(10) || '  物理抗性：slash=0.5' || chr(10) || '  被动（首条）：' || repeat('p', 80) || chr(10) || '  技能：one、two') AS facts_md5 FROM orders JOIN s ON l_orderkey = o_orderkey""")
def record_details(read):
    """The finer parts of full texts: headings of skills by key or guard, stages with effects, coins merged, passives by side, voices, gifts, facts."""
    effect = "array<struct<timing:string,description:string,coin_index:int>>"
    say = lambda timing, text, coin: F.struct(F.lit(timing).alias("timing"), (F.lit(text) if isinstance(text, str) else text).alias("description"), F.lit(coin).cast("int").alias("coin_index"))

    def skill(x, i):
        key = F.when(x["l_partkey"] % 5 == 0, _text("强化", i, "技能")).when(x["l_partkey"] % 5 == 1, _text(i, "技能2")).when(x["l_partkey"] % 5 == 2, _text(i, "技能")).when(x["l_partkey"] % 5 == 3, F.lit("")).otherwise(F.lit(None).cast("string"))
        stage = F.struct(F.lit("I").alias("stage"), F.when(x["l_suppkey"] % 2 == 0, x["q"]).alias("base_value"), (x["q"] - 25).alias("coin_power"), F.when(i % 2 == 0, F.array(say("on", _text("hits ", i), 0), say("on", "", 0), say("", "burns", 0))).otherwise(F.array().cast(effect)).alias("effects"))
        coins = F.array(say("on", _text("cuts ", x["q"]), 2), say("on", "[on] first", 1), say("", "cuts", 2), say("", "cuts", 2), say("on", "+3", 2), say("on", "基础值", 1), say("on", "head", 0))
        title = details.skill_title(F.coalesce(key, F.lit("")), _text("n", i), x["l_suppkey"] % 4 == 0, i - 1)
        return F.array_join(F.concat(F.array(title, details.stage_with_effects(stage)), details.coins_merged(coins)), "\n")

    o = F.col("o_orderkey")
    names = F.create_map(F.lit("7"), F.struct(F.lit("aid").alias("name"), F.lit("helps ").alias("description"), F.lit("支援被动").alias("side")), F.lit("8"), F.struct(F.lit("calm").alias("name"), F.lit("").alias("description"), F.lit("战斗").alias("side")))
    passives = details.passives(F.lit("人格被动8\n \n人格被动7\n人格被动99"), _if(o % 2 == 0, "only name"), names)
    voice = lambda file, title, text: F.struct(F.lit(file).alias("file"), F.lit(title).alias("title"), text.alias("text"))
    spoken = F.when(o % 3 > 0, F.array(voice("a.ogg", "met", _text("hi ", o)), voice("b.ogg", "", F.lit("")), voice("", "", F.lit(""))))
    call = lambda file, name, label: F.struct(F.lit(file).alias("file"), F.lit(name).alias("skill_name"), F.lit(label).alias("skill_label"))
    called = F.when(o % 3 != 1, F.array(call("c.ogg", "", "cut"), call("", "only", "x")))
    gift = lambda name, effect: F.struct(F.lit(name).alias("name"), F.lit(effect).alias("effect"))
    unit = F.struct(
        F.lit("beast").alias("enemy_name"), _text(" stage ", o).alias("battle_stage"), F.col("o_custkey").alias("hp"), F.lit(None).cast("int").alias("defense_level"), F.when(o % 2 == 0, "5/9").otherwise("").alias("chaos_threshold"), F.create_map(F.lit("slash"), F.lit(0.5)).alias("physical_resistances"), F.array(F.lit("p" * 100), F.lit("q")).alias("passives"),
        F.array(*(F.struct(F.lit(x).alias("skill_name")) for x in ("one", "", "two", None, "five"))).alias("skills"),
    )
    skills = _lines(read).select("l_orderkey", F.array_join(F.transform("lines", lambda x, i: skill(x, i + 1)), "\n").alias("skills"))
    j = read("orders").join(skills, o == F.col("l_orderkey"))
    return j.select("o_orderkey", F.md5("skills").alias("skills_md5"), F.md5(passives).alias("passives_md5"), F.md5(details.voices(spoken, called)).alias("voices_md5"), details.gifts(F.array(gift(" ring", "x"), gift("", "heals"), gift("", ""))).alias("gifts"), F.md5(details.unit_facts(unit)).alias("facts_md5"))


#: The image and video sources of a text, in any order of attributes.
_IMAGE, _VIDEO = r"""(?is)<img\b[^>]*?\ssrc\s*=\s*["']([^"']+)["']""", r"""(?is)<(?:video|source|iframe)\b[^>]*?\ssrc\s*=\s*["']([^"']+)["']"""


def links(html, pattern: str):
    """The distinct links of a kind in order, with a scheme where they have none."""
    found = F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), lambda u: F.trim(u))
    return F.array_distinct(F.transform(F.filter(found, lambda u: u != ""), lambda u: F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(u)))


@query(r"""SELECT page_id, CASE WHEN page_id % 3 = 2 THEN CAST(page_id AS VARCHAR) ELSE CAST(7000000000 + page_id AS VARCHAR) END AS announcement_id, 'news ' || page_id AS title, CASE WHEN page_id % 4 = 3 THEN 'news ' || page_id ELSE 'first ' || page_id || chr(10) || 'second & last' END AS text, CASE WHEN page_id % 2 = 0 THEN make_timestamp(2024, 1, 1 + page_id % 28, 10, 30, 0) END AS published_at,
 CASE WHEN page_id % 4 = 3 THEN '' ELSE 'https://i.example/a.png,https://i.example/b.png' END AS images, CASE WHEN page_id % 4 = 3 THEN '' ELSE 'https://v.example/c' END AS videos, 'feed_42_' || CASE WHEN page_id % 3 = 2 THEN CAST(page_id AS VARCHAR) ELSE CAST(7000000000 + page_id AS VARCHAR) END AS id FROM pages""")
def announcement_rows(read, feed: str = "42"):
    """Feed items (XML) as rows: id from the item's guid or link, text of its markup or else the title, time in UTC or null, images and videos once each."""
    k = F.col("page_id")
    body = '<p>first @</p><img class="x" src="//i.example/a.png"><br/>second &amp;amp; last<img src=\'https://i.example/b.png\'/><img src="//i.example/a.png"><iframe src="//v.example/c"></iframe>'
    body = F.when(k % 4 == 3, "").otherwise(F.concat(F.lit("<![CDATA["), F.replace(F.lit(body.replace("&amp;amp;", "&amp;")), F.lit("@"), k.cast("string")), F.lit("]]>")))
    url = _text("https://store.example/news/app/1/announcements/detail/", k + 7000000000, "?x=1")
    guid = F.when(k % 3 == 0, F.concat(F.lit("<guid>"), url, F.lit("</guid>"))).when(k % 3 == 2, F.concat(F.lit("<guid>"), k.cast("string"), F.lit("</guid>"))).otherwise("")
    date = F.when(k % 2 == 0, F.concat(F.lit("<pubDate>Mon, "), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit(" Jan 2024 12:30:00 +0200</pubDate>"))).otherwise("<pubDate>soon</pubDate>")
    item = F.concat(F.lit("<item><title> news "), k.cast("string"), F.lit(" </title>"), guid, F.lit("<link>"), url, F.lit("</link>"), date, F.lit("<description>"), body, F.lit("</description></item>"))
    rows = read("pages").select("page_id", F.from_xml(item, "title string, guid string, link string, pubDate string, description string").alias("e"))
    html = F.coalesce("e.description", F.lit(""))
    raw = F.trim(F.coalesce(F.nullif("e.guid", F.lit("")), "e.link", F.lit("")))
    number = F.regexp_extract(raw, r"/(?:announcements|news)/detail/(\d+)", 1)
    id_ = F.when(number != "", number).otherwise(raw)
    flat = F.regexp_replace(F.regexp_replace(html, r"(?i)<br\s*/?>|</?(?:p|div|li|tr)(?:\s[^>]*)?>|<hr\s*/?>", "\n"), r"<[^>]+>", "")
    flat = F.replace(F.replace(F.replace(flat, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    text = F.array_join(F.filter(F.transform(F.split(flat, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")
    title = F.trim("e.title")
    time = F.try_to_timestamp(F.regexp_replace("e.pubDate", r"^\s*[A-Za-z]{3},\s*", ""), F.lit("dd MMM yyyy HH:mm:ss Z"))
    return rows.select(
        "page_id", id_.alias("announcement_id"), title.alias("title"), F.coalesce(F.nullif(text, F.lit("")), title).alias("text"), time.cast("timestamp_ntz").alias("published_at"),
        F.array_join(links(html, _IMAGE), ",").alias("images"), F.array_join(links(html, _VIDEO), ",").alias("videos"), F.concat_ws("_", F.lit("feed"), F.lit(feed), id_).alias("id"),
    )
