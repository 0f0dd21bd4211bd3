"""Markup in depth: the tree of a page's markup, matches with their places, dictionary rewriting, values inside templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import rewriting, wikitree
from tessera.functions.parse import whole
from tessera.plans.catalog import query
from tessera.sources.staged import staged

#: Pages in four forms around a turn's text (@): nested templates, links and tags, what is never closed, lists and tables.
_MARKUP = (
    "== head {{x|k=v}} ==\n{{Box|title=@|plain|deep={{In| x = @}}|none=}} end<ref>note {{a|b}}</ref>",
    "@ [[Target|shown]] [[Page]] [http://e.org/p site] [http://e.org/q]<br/>after {{{1|}}}'''bold'''and ' one<!-- gone -->",
    "{{open|a=@|[[never\nb} &amp; c",
    "* item\n#: next\n{|\n|cell\n|}\n@ </b> ]] <i>kept",
)


def _filled(template: str, value: str | Column) -> Column:
    """The template with @ put in."""
    pieces = template.split("@")
    parts = [p for piece in pieces for p in (F.lit(piece), F.col(value) if isinstance(value, str) else value)][:-1]
    return F.concat(*parts)


@query(r"""SELECT conv_id, turn, md5(CASE turn % 4 WHEN 0 THEN chr(10) || 'head k：v' || chr(10) || chr(10) || 'title：' || text || chr(10) || '1：plain' || chr(10) || 'deep：x：' || text || ' end'
  WHEN 1 THEN text || ' shown Page site http://e.org/q' || chr(10) || 'after and '' one' WHEN 2 THEN '{{open|a=' || text || '|[[never' || chr(10) || 'b} &amp; c'
  ELSE ' item' || chr(10) || ' next' || chr(10) || chr(10) || text || ' </b> ]] <i>kept' END) AS text_md5 FROM conversations""")
def markup_tree_text(read):
    """The text that a markup stands for, through its tree: nested templates with named parts, links, headings, breaks, and what is never closed."""
    forms = F.array(*(_filled(m, "text") for m in _MARKUP))
    c = read("conversations").withColumn("markup", F.element_at(forms, (F.col("turn") % 4 + 1).cast("int")))
    return c.select("conv_id", "turn", F.md5(wikitree.plain_text("markup")).alias("text_md5"))


# --- matches with their places -----------------------------------------------------------------------------------

#: The anchor of a voice file, the title behind it, and the sign that a line needs to be spoken. Parameters.
VOICE, TITLE, SPOKEN = r"\[\[\s*file\s*:\s*([^|\]]+\.ogg)", r"\|\|\s*([^|\n]+?)\s*：\s*([^|\n]*)", r"\p{L}{2}"
_VOICE = '|width="55px"|[[file: a#.ogg|50px]]||when met ：in @\n|-\n|style="color:#E5CAA5"|\n|| ||\nwhen met：\n | spoken @\n'
_BATTLE = '|width="135px"|skill three-call||width="75px"|[[file:Battle_s3_#_1.ogg|50px]]||skill three-line\n|-\n'


def voice_pages(read) -> DataFrame:
    """A page a conversation: a voice row for each turn, a section of skill voices for those of the assistant."""
    t = F.struct("turn", "role", F.col("text").alias("said"))
    c = read("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(t)).alias("t"))

    def rows(template, of):
        put = lambda x: F.replace(F.replace(F.lit(template), F.lit("@"), F.replace(x["said"], F.lit("\n"), F.lit(" "))), F.lit("#"), x["turn"].cast("string"))
        return F.array_join(F.transform(of, put), "")

    mine = F.filter("t", lambda x: x["role"] == "assistant")
    return c.select("conv_id", F.concat(F.lit("intro [[file: no.ogg]]\n=== voices ===\n"), rows(_VOICE, F.col("t")), F.lit("=== skill voices ===\n"), rows(_BATTLE, mine), F.lit("== end ==\n[[file: z.ogg]]||t：u")).alias("page"))


def voice_lines(section: Column) -> Column:
    """(file, start, title, text) of each voice file of a section: what stands between its anchor and the next, without the table's own lines."""
    strip = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")

    def kept(title, lines):
        cleaned = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: strip(F.regexp_replace(strip(x), r"^\|+", "")))
        return F.filter(cleaned, lambda x: x.rlike(SPOKEN) & ~x.rlike("^(?:width=|style=)") & ((title == "") | (x != F.concat(title, F.lit("：")))))

    def line(seg):
        inline, lines = strip(F.regexp_extract(seg["slice"], TITLE, 2)), F.split(seg["slice"], "\n")
        named = lambda title: F.struct(strip(seg["g1"]).alias("file"), seg["start"].alias("start"), title.alias("title"), F.concat(inline, F.array_join(rewriting.let(lines, lambda x: kept(title, x)), "")).alias("text"))
        return rewriting.let(strip(F.regexp_extract(seg["slice"], TITLE, 1)), named)

    return F.filter(F.transform(rewriting.between(section, VOICE, 1), line), lambda v: (v["file"] != "") & ((v["title"] != "") | (v["text"] != "")))


@query(r"""WITH t AS (SELECT conv_id, turn, replace(text, chr(10), ' ') AS said FROM conversations),
 v AS (SELECT *, CAST(strlen('|width="55px"|') + coalesce(sum(strlen('|width="55px"|[[file: a.ogg|50px]]||when met ：in ') - 2 + strlen(CAST(turn AS VARCHAR)) + 2 * length(said) + strlen('.|-.|style="color:#E5CAA5"|.|| ||.when met：. | spoken .') - 2) OVER (PARTITION BY conv_id ORDER BY turn, said ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS INTEGER) AS start FROM t)
SELECT conv_id, start, 'a' || turn || '.ogg' AS file, 'when met' AS title, md5('in ' || said || 'spoken ' || said) AS text_md5 FROM v""")
def voice_offsets(read):
    """Voice rows of a section with the place of their anchor: matches with positions, and what stands between one and the next."""
    v = voice_pages(read).select("conv_id", F.explode(voice_lines(rewriting.section("page", "voices"))).alias("v"))
    return v.select("conv_id", "v.start", "v.file", "v.title", F.md5("v.text").alias("text_md5"))


@query(r"""SELECT conv_id, 'Battle_s3_' || turn || '_1.ogg' AS file, 3 AS skill_index, 'skill three' AS label, 'skill ' || (conv_id % 7) AS skill FROM conversations WHERE role = 'assistant'""")
def skill_voices(read):
    """Voices of skills, line by line, with the number in the file's name, the label in the line, and the skill of that number."""
    lines = voice_pages(read).select("conv_id", F.explode(F.split(rewriting.section("page", "skill voices"), "\n")).alias("line"))
    file = r"\[\[\s*file\s*:\s*(Battle_s(\d+)_[^|\]]+\.ogg)"
    found = lines.select("conv_id", F.regexp_extract("line", file, 1).alias("file"), F.regexp_extract("line", file, 2).try_cast("int").alias("skill_index"), F.regexp_extract("line", r"(skill\s*[a-z]+)", 1).alias("label")).filter("file <> ''")
    names = read("conversations").select("conv_id", F.lit(3).alias("skill_index"), F.concat(F.lit("skill "), (F.col("conv_id") % 7).cast("string")).alias("skill")).distinct()
    return found.join(names, ["conv_id", "skill_index"], "left")


@query(r"""SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS INTEGER) AS i, 'note #' || turn || '  2024.1.' || (turn + 1) AS title, md5(CASE WHEN length(text) > 400 THEN left(text, 400) || '...' ELSE text END) AS text_md5 FROM conversations WHERE turn % 3 <> 1""")
def note_records(read, longest: int = 400):
    """Records of a page without marks: a title line opens each, its text goes to the next; empty ones go, long ones are cut as stated."""
    said = F.when(F.col("turn") % 3 == 1, "\n ").otherwise(F.concat(F.lit("\n\n"), "text", F.lit("\n")))
    one = F.concat(F.lit("note #"), F.col("turn").cast("string"), F.lit("  2024.1."), (F.col("turn") + 1).cast("string"), said)
    pages = read("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("said"), one.alias("one")))).alias("r"))
    page = F.concat(F.lit("before note 7\n"), F.array_join("r.one", ""))
    text = lambda m: F.regexp_replace(m["slice"], r"^\s+|\s+$", "")
    found = F.filter(F.transform(rewriting.between(page, r"note\s*#\d+\s+\d{4}\.\d{1,2}\.\d{1,2}"), lambda m: F.struct(m["match"].alias("title"), text(m).alias("text"))), lambda m: m["text"] != "")
    cut = F.when(F.length("m.text") > longest, F.concat(F.substring("m.text", 1, longest), F.lit("..."))).otherwise(F.col("m.text"))
    return pages.select("conv_id", F.posexplode(found).alias("i", "m")).select("conv_id", "i", "m.title", F.md5(cut).alias("text_md5"))


# --- dictionaries ------------------------------------------------------------------------------------------------


def _codes(read) -> tuple[DataFrame, DataFrame]:
    """Two layers of (code, name) from the turns: the first two words of second turns, and the first words of third turns."""
    c = read("conversations").select("turn", F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ").alias("w"))
    letters = lambda s: F.regexp_replace(s, "[^A-Za-z]", "")
    two = c.filter((F.col("turn") == 1) & (F.size("w") > 1)).select(F.array_join(F.slice("w", 1, 2), " ").alias("code")).distinct()
    one = c.filter("turn = 2").select(letters(F.col("w")[0]).alias("code")).filter("code <> ''").distinct()
    lower = c.filter("turn = 3").select(F.lower(letters(F.col("w")[0])).alias("code")).filter("code <> ''").distinct()
    name = lambda k: F.concat(F.lit(f"<{k}"), F.substring(F.md5("code"), 1, 4), F.lit(">"))
    return two.unionByName(one).withColumn("name", name("a")), one.unionByName(lower).withColumn("name", name("b"))


@query(r"""WITH RECURSIVE w AS (SELECT conv_id, turn, text, string_split(replace(text, chr(10), ' '), ' ') AS w FROM conversations),
 one AS (SELECT DISTINCT regexp_replace(w[1], '[^A-Za-z]', '', 'g') AS code FROM w WHERE turn = 2 AND code <> ''), low AS (SELECT DISTINCT lower(regexp_replace(w[1], '[^A-Za-z]', '', 'g')) AS code FROM w WHERE turn = 3 AND code <> ''),
 a AS (SELECT code, '<a' || left(md5(code), 4) || '>' AS name FROM (SELECT DISTINCT w[1] || ' ' || w[2] AS code FROM w WHERE turn = 1 AND len(w) > 1 UNION SELECT code FROM one)),
 n AS (SELECT * FROM a UNION ALL SELECT code, '<b' || left(md5(code), 4) || '>' FROM low WHERE code NOT IN (SELECT code FROM a)),
 p AS (SELECT row_number() OVER () AS id, conv_id, turn, text FROM conversations),
 s AS (SELECT id, text, i FROM (SELECT id, text, unnest(range(1, length(text) + 1)) AS i FROM p) WHERE i = 1 OR NOT regexp_matches(substr(text, i - 1, 1), '[A-Za-z]')),
 f AS (SELECT id, text, i, substr(text, i, k) AS code, k FROM s, (SELECT DISTINCT length(code) AS k FROM n)),
 h AS MATERIALIZED (SELECT id, i, max(f.k) AS k, arg_max(name, f.k) AS name FROM f JOIN n USING (code) WHERE NOT regexp_matches(substr(text, i + f.k, 1), '[A-Za-z]') GROUP BY id, i),
 walk AS (SELECT id, CAST(1 AS BIGINT) AS pos, '' AS done FROM p UNION ALL
  SELECT id, pos, done FROM (SELECT walk.id, h.i + h.k AS pos, done || substr(text, walk.pos, h.i - walk.pos) || h.name AS done, row_number() OVER (PARTITION BY walk.id ORDER BY h.i) AS r FROM walk JOIN h ON h.id = walk.id AND h.i >= walk.pos JOIN p ON p.id = walk.id) WHERE r = 1)
SELECT conv_id, turn, md5(arg_max(done, pos) || substr(any_value(text), max(pos))) AS text_md5 FROM walk JOIN p USING (id) GROUP BY id, conv_id, turn""")
def dictionary_rewrite(read):
    """Every code of a layered dictionary that stands between borders becomes its name: the leftmost, of those the longest."""
    rows = staged(read("conversations").select("conv_id", "turn", F.monotonically_increasing_id().alias("id"), "text"))
    out = rewriting.replace_keys(rows, "id", "text", list(_codes(read)))
    return rows.drop("text").join(out, "id").select("conv_id", "turn", F.md5("text").alias("text_md5"))


@query(r"""WITH d AS (SELECT turn % 5 AS code, CASE turn % 5 WHEN 0 THEN 'burn' WHEN 1 THEN 'bleed' ELSE NULL END AS name FROM conversations)
SELECT conv_id, turn, md5(text || ' gets ' || CASE WHEN turn % 5 = 0 THEN CASE WHEN conv_id % 2 = 0 THEN 'own' ELSE 'burn' END WHEN turn % 5 = 1 THEN 'bleed' WHEN turn % 5 = 2 THEN 'spare' ELSE 'unknown:c' || (turn % 5) END || ' and ' || CASE WHEN conv_id % 3 = 0 THEN 'unknown:zz' ELSE 'bleed' END || '{{Buff}} end') AS text_md5,
 md5(text || chr(10) || 'gift one：text one' || chr(10) || 'gift two' || chr(10) || 'only text' || chr(10) || 'gift' || (10 + turn)) AS passives_md5 FROM conversations""")
def code_templates(read):
    """Templates with a code become names: those of the row itself first, then layer by layer, else a label; numbered gifts become name and text."""
    spark = read("conversations").sparkSession
    second = F.when(F.col("conv_id") % 3 == 0, "zz").otherwise("c1")
    t = F.concat("text", F.lit(" gets {{Buff| c"), (F.col("turn") % 5).cast("string"), F.lit("}} and {{Buff|"), second, F.lit("}}{{Buff}} end"))
    gifts = F.concat("text", F.lit("\ngift1\ngift2\ngift3\ngift"), (F.col("turn") + 10).cast("string"))
    rows = staged(read("conversations").select("conv_id", "turn", F.monotonically_increasing_id().alias("id"), t.alias("t"), gifts.alias("g")))
    official = spark.createDataFrame([("c0", "burn"), ("c1", " "), ("c1x", "no")], "code string, name string")
    spare = spark.createDataFrame([("c1", "bleed"), ("c2", "spare"), ("c0", "late")], "code string, name string")
    own = rows.filter("conv_id % 2 = 0").select("id", F.lit("c0").alias("code"), F.lit("own").alias("name"))
    buffs = rewriting.replace_matches(rows, "id", "t", r"\{\{Buff\|([^}|]+)\}\}", [official, spare], lambda m, code: F.concat(F.lit("unknown:"), code), own)
    passives = spark.createDataFrame([("1", "gift one", "text one"), ("2", "gift two", ""), ("3", "", "only text")], "code string, n string, d string")
    passives = passives.select("code", F.concat_ws("：", F.nullif("n", F.lit("")), F.nullif("d", F.lit(""))).alias("name"))
    shown = rewriting.replace_matches(rows, "id", "g", r"(?m)^gift(\d+)$", [passives], lambda m, code: m)
    return rows.select("conv_id", "turn", "id").join(buffs, "id").join(shown, "id").select("conv_id", "turn", F.md5("t").alias("text_md5"), F.md5("g").alias("passives_md5"))


# --- values inside templates -------------------------------------------------------------------------------------

#: A number that a page hides in JSON inside a template.
_HIDDEN = r"(\{[^{}]*\})"


def hidden_number(value: Column) -> Column:
    """A part's value as an int: the value itself, or the content (a number or a text) of a JSON object inside it; else null."""
    json = F.try_parse_json(F.regexp_extract(value, _HIDDEN, 1))
    return F.coalesce(F.try_variant_get(json, "$.content", "int"), F.trim(value).try_cast("int"))


def part(names: list[str], parts: str = "parts") -> Column:
    """The first of some names that a map has with a value."""
    return F.coalesce(*(F.nullif(F.try_element_at(parts, F.lit(n)), F.lit("")) for n in names))


@query(r"""WITH s AS (SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS pos, l_partkey AS p, l_suppkey AS u, CAST(l_quantity AS INTEGER) AS q FROM lineitem)
SELECT l_orderkey, pos, 'skill ' || p AS name, CASE WHEN p % 3 = 0 THEN q WHEN p % 3 = 1 THEN -q ELSE 0 END AS base, CASE WHEN u % 2 = 0 THEN q - 20 ELSE 0 END AS power, CASE u % 4 WHEN 0 THEN q WHEN 1 THEN q + 1 WHEN 2 THEN 0 ELSE 7 END AS level, CASE p % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 0 END AS importance, CASE WHEN u % 5 = 0 THEN 'evade' WHEN u % 5 = 1 THEN 'counter' ELSE '' END AS guard,
 concat_ws(',', 'base', CASE WHEN u % 4 <> 2 THEN 'level' END, CASE WHEN u % 2 = 0 THEN 'power' END) AS present FROM s WHERE p % 11 <> 0""")
def template_values(read):
    """Skills out of templates under two sets of names: numbers hidden in JSON (as number or text), placeholders, nested templates and links in values."""
    q, p, u = F.col("l_quantity").cast("int"), F.col("l_partkey"), F.col("l_suppkey")
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    hide = lambda v: text("?({{#html:Hide|", v, "}})")
    base = F.when(p % 3 == 0, text(q)).when(p % 3 == 1, text(-q)).otherwise(F.lit("???"))
    level = F.when(u % 4 == 0, hide(text('{"content":"', q, '"}'))).when(u % 4 == 1, hide(text('{"content":', q + 1, ', "k":[1]}'))).when(u % 4 == 2, F.lit("")).otherwise(F.lit("7"))
    power = F.when(u % 2 == 0, text("\n|", F.when(p % 2 == 0, "change").otherwise("coin bonus"), "=", F.when(q >= 20, text("+", q - 20)).otherwise(text(q - 20)), " each")).otherwise("")
    # the second name of base stands before the first, empty
    names = F.when(p % 2 == 0, text("\n|name=skill ", p, "\n|base=", base)).otherwise(text("\n|skill name=skill ", p, "\n|base=\n|skill base=", base))
    weight = F.when(p % 4 == 0, "{{Importance|3|[[High|very]]}} strikes").when(p % 4 == 1, "strikes\n|importance=2").otherwise("[[a|b]] strikes")
    guard = F.when(u % 5 == 0, "evade").when(u % 5 == 1, "slash\n|effect2=clash counter").otherwise("slash")
    skill = text("{{Skill", names, "\n|icon=", F.when(p % 11 == 0, "").otherwise("i"), power, "\n|level=", level, "\n|kind=", guard, "\n|effect=", weight, "\n}}")
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", skill.alias("markup"))
    n = int(read("lineitem").sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pages = read("lineitem").repartition(n, "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(order)).alias("s"))
    pages = pages.select("l_orderkey", F.concat(F.lit("== unit ==\n{{Other|name=x}}"), F.array_join("s.markup", "\n"), F.lit("{{Skill|name=never closed")).alias("page"))
    found = wikitree.template_parts(pages, ["l_orderkey"], "page", F.col("name") == "Skill")
    get = lambda *names: part(list(names))
    rows = found.withColumn("pos", F.col("nth")).withColumns({"name": get("skill name", "name"), "b": get("base", "skill base"), "l": get("level"), "c": get("change", "coin bonus"), "kind": get("kind"), "more": F.coalesce(get("effect2"), F.lit(""))}).filter(F.col("name").isNotNull() & get("icon").isNotNull())
    number = lambda c: F.coalesce(hidden_number(F.col(c)), F.lit(0))
    given = F.array_join(F.filter(F.array(*(F.when(F.col(c).isNotNull(), label) for c, label in (("b", "base"), ("l", "level"), ("c", "power")))), lambda x: x.isNotNull()), ",")
    important = F.coalesce(get("importance"), F.nullif(F.regexp_extract(F.coalesce(get("effect"), F.lit("")), r"^1：(\d+)", 1), F.lit("")), F.lit(""))
    guard = F.when(F.col("kind").isin("guard", "evade", "counter"), F.col("kind")).otherwise(F.regexp_extract("more", "clash (counter|evade|guard)", 1))
    return rows.select("l_orderkey", "pos", "name", number("b").alias("base"), F.coalesce(F.regexp_extract("c", r"^([+-]?\d+)", 1).try_cast("int"), F.lit(0)).alias("power"), number("l").alias("level"), whole(important).alias("importance"), guard.alias("guard"), given.alias("present"))
