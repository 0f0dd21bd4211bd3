"""Skills, events and effects out of pages with panes: each pane, cell and label by the interval that it lies in."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import layout, onepage
from tessera.functions.dom import Node, Page, attr, found_in, nodes_of
from tessera.functions.onepage import attr as attr_of
from tessera.functions.rewriting import between
from tessera.plans.catalog import query
from tessera.plans.layouts import _LINES, _if, _lines, _text
from tessera.sources.staged import staged

#: Words of the pages: fixed values.
BASE, CHANGE, POWER, GUARDS, CAPACITY = r"基础值[：:]\s*(\d+)", r"变动值[：:]\s*([+-]?\d+)", r"硬币威力[：:]\s*([+-]?\d+)", ("闪避", "反击", "防御"), r"攻击容量[：:]\s*(\d+)"
STAGES = ("I", "II", "III", "IV")
GOOD, BAD, WON, LOST = "有利判定", "不利判定", "#67AD69", "#CD3532"
_COIN, _SKILL, _SIN = re.compile(r"coin(\d+)", re.A), re.compile(r"skill-(\w+-\w+)-", re.A), re.compile("罪孽-([^\n\r\u0085\u2028\u2029]+)")
_TIMING, _REWARD = re.compile(r"\[([^\]]+)\]([^\[]*)"), re.compile(r"(?:获得|失去)\s*[^\n，,]+", re.A)


def outer(nodes: DataFrame, test: Column, key: str, name: str) -> DataFrame:
    """The elements that fit as outer ones, with their text and a number (name) of their own."""
    return nodes.filter(test).select(key, F.col("pre").alias("o_pre"), F.col("last").alias("o_last"), F.col("pre").alias(name), F.col("text").alias("o_text"), F.col("start").alias("o_start"))


def stage(text: Column) -> Column:
    """Base value, power (by another word only where there is no base value) and the effects [timing] text of a pane."""
    number = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("int")
    said = F.filter(F.transform(between(text, r"\[([^\]]+)\]", 1), lambda m: F.struct(m["g1"].alias("timing"), F.trim(F.regexp_extract(m["slice"], r"^([^\[]*)", 1)).alias("description"))), lambda e: e["description"] != "")
    base = number(BASE)
    return F.struct(base.alias("base"), F.when(base.isNull(), F.coalesce(number(POWER), number(CHANGE))).otherwise(number(CHANGE)).alias("power"), said.alias("effects"))


def coin_effects(cells: DataFrame, images: DataFrame, key: str) -> DataFrame:
    """(key, cell, effects): of each cell (o_pre, o_last, o_text, o_start, cell) what stands before its first coin (0) and behind each.

    A cell without coins says one thing, of no coin. Texts are cut at the places of the images.
    """
    coin = F.regexp_extract(attr("alt"), r"coin(\d+)", 1)
    found = layout.within(cells.select(key, "o_pre", "o_last", "cell"), images.filter(coin != "").select(key, "pre", "start", coin.cast("int").alias("coin")), key)
    marks = found.groupBy(key, "cell").agg(F.array_sort(F.collect_list(F.struct("pre", "start", "coin"))).alias("coins"))
    j = cells.join(marks, [key, "cell"], "left").withColumn("coins", F.coalesce("coins", F.array().cast("array<struct<pre:int,start:int,coin:int>>")))
    cuts = F.concat(F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("coin"))), F.transform("coins", lambda c: F.struct(F.greatest(c["start"] - F.col("o_start"), F.lit(0)).alias("at"), c["coin"].alias("coin"))))
    ends = F.concat(F.transform(F.slice(cuts, 2, F.size("coins")), lambda c: c["at"]), F.array(F.length("o_text")))
    parts = F.zip_with(cuts, ends, lambda c, e: F.struct(c["coin"].alias("coin"), F.trim(F.substring(F.col("o_text"), c["at"] + 1, F.greatest(e - c["at"], F.lit(0)))).alias("text")))
    return j.select(key, "cell", F.filter(parts, lambda p: p["text"] != "").alias("effects"))


def _skill_html(line: Column, pos: Column) -> Column:
    icon = F.when(line["l_suppkey"] % 3 == 0, "").otherwise(F.when(line["l_suppkey"] % 3 == 1, '<img alt="skill-gloom-slash-1.png">').otherwise('<img alt="x skill-pride-blunt-2.png">'))
    pane = lambda k: F.concat(_text('<div role="tabpanel" class="tab-pane a">', _if(line["l_partkey"] % 4 == 0, F.lit(f"硬币威力：-{k} "), _text("基础值: ", line["q"] + k, " 变动值：+", pos)), " [on] hits ", line["q"], " [off] [end] heals"), F.lit("</div>"))
    panes = F.concat(*(pane(k) for k in range(3)), _if(line["l_suppkey"] % 4 == 0, pane(3)), _if(line["l_suppkey"] % 8 == 0, pane(4)))
    coins = F.concat(F.lit("<td>first "), _if(pos % 2 == 0, F.concat(F.lit('<img alt="coin1.png"> one '), _text("<b>", line["q"], '</b><img alt="coin2.png"><img alt="coin3.png"> three'))), F.lit("</td>"))
    title = _if(line["l_partkey"] % 5 == 0, "守备技能", "skill")
    return F.concat(F.lit('<table class="wikitable"><tr><td>'), title, icon, _if(line["l_suppkey"] % 3 == 0, " 可以闪避"), _if(pos == 3, _text(" 攻击容量：", pos)), F.lit('</td></tr><tr><td><div class="tab-content">'), panes, F.lit("</div></td></tr><tr>"), coins, F.lit("</tr></table>"))


def cut_at_coins(page: Page, cell: Node) -> list[tuple[int, str]]:
    """coin_effects of one cell of a page that is read."""
    text, cuts = page.text(cell), [(0, 0)]
    cuts += [(int(m[1]), max(n.first - cell.first, 0)) for n in onepage.inside(page.tags["img"], cell) if (m := _COIN.search(attr_of(n, "alt")))]
    ends = [at for _, at in cuts[1:]] + [len(text)]
    return [(coin, said) for (coin, at), end in zip(cuts, ends, strict=True) if (said := text[at : max(end, at)].strip(" "))]


def stage_of(text: str) -> tuple[int | None, int | None, list[tuple[str, str]]]:
    """stage of a text in Python."""

    def number(pattern: str) -> int | None:
        m = re.search(pattern, text, re.A)
        return int(m[1]) if m and len(m[1].lstrip("+-0")) <= 10 and -(2**31) <= int(m[1]) < 2**31 else None

    base, power, change = number(BASE), number(POWER), number(CHANGE)
    said = [(m[1], description) for m in _TIMING.finditer(text) if (description := m[2].strip(" "))]
    return base, power if base is None and power is not None else change, said


def skills(page: Page) -> Iterator[tuple]:
    """(skill, sin, damage, guard, capacity, coins, coin_effects, stage, base, power, effects), a row a pane of the tables in the folds below the heading of skills."""
    folds = [n for n in page.having("class", "collapsible") if n.tag == "div"]
    named = {f.pre: f for h, found in onepage.following(page, folds, "技能") if "技能" in page.text(h) for f in found}
    written, skill = [n for n in page.having("class", "wikitable") if n.tag == "table"], -1
    every = [n for n in page.having("role", "tabpanel") if n.tag == "div" and attr_of(n, "role") == "tabpanel"]
    for table in (page.nodes[pre] for pre in sorted({t.pre for f in named.values() for t in onepage.inside(written, f)})):
        panes, cells, whole = onepage.inside(every, table), onepage.inside(page.tags["td"], table), page.text(table)
        if not panes:
            continue
        alts, cell = [attr_of(n, "alt") for n in onepage.inside(page.tags["img"], table)], cells[-1] if cells else None
        skill += 1
        icon = next((m[1] for m in map(_SKILL.search, alts) if m), None)
        sin, damage = icon.split("-") if icon else ("", "")
        guard = "" if icon else next((g for g in GUARDS if g in whole), "")
        capacity = onepage.number(m[1]) if (m := re.search(CAPACITY, whole, re.A)) else None
        coins, said = len({a for a in alts if "coin" in a}), None if cell is None else ";".join(f"{coin}={text}" for coin, text in cut_at_coins(page, cell))
        for k, pane in enumerate(panes):
            base, power, effects = stage_of(page.text(pane))
            yield skill, sin, damage, guard, 1 if capacity is None else capacity, coins, said, STAGES[k] if k < len(STAGES) else str(k + 1), base, power, ";".join(f"{t}={d}" for t, d in effects)


@query(f"""WITH {_LINES}, k AS (SELECT *, unnest(range(3 + CAST(l_suppkey % 4 = 0 AS INTEGER) + CAST(l_suppkey % 8 = 0 AS INTEGER))) AS k FROM ln)
SELECT l_orderkey, pos - 1 AS skill, CASE l_suppkey % 3 WHEN 1 THEN 'gloom' WHEN 2 THEN 'pride' ELSE '' END AS sin, CASE l_suppkey % 3 WHEN 1 THEN 'slash' WHEN 2 THEN 'blunt' ELSE '' END AS damage, CASE WHEN l_suppkey % 3 = 0 THEN '闪避' ELSE '' END AS guard, CASE WHEN pos = 3 THEN 3 ELSE 1 END AS capacity, CASE WHEN pos % 2 = 0 THEN 3 ELSE 0 END AS coins,
 CASE WHEN pos % 2 = 0 THEN '0=first;1=one ' || q || ';3=three' ELSE '0=first' END AS coin_effects, coalesce(['I', 'II', 'III', 'IV'][k + 1], CAST(k + 1 AS VARCHAR)) AS stage, CASE WHEN l_partkey % 4 > 0 THEN q + k END AS base, CAST(CASE WHEN l_partkey % 4 = 0 THEN -k ELSE pos END AS INTEGER) AS power, 'on=hits ' || q || ';end=heals' AS effects FROM k WHERE l_orderkey % 2 = 0""")
def page_skills(read):
    """Skills of a page, a row a stage: kinds from icons or words, values and effects of each pane, effects of coins cut at their images."""
    key = "l_orderkey"
    written = F.transform("lines", lambda line, i: _skill_html(line, i + 1))
    start = F.concat(F.lit('<h2>技能</h2><div class="mw-collapsible">no skills here<table class="wikitable"><tr><td>x</td></tr></table></div><div class="mw-collapsible">'), F.array_join(written, ""), F.lit("</div><h2>end</h2>"))
    other = F.lit('<div class="mw-collapsible"><table class="wikitable"><tr><td><div role="tabpanel" class="tab-pane">基础值：1</div></td></tr></table></div>')
    pages = _lines(read).select(key, F.when(F.col(key) % 2 == 0, F.concat(start, other)).otherwise(F.concat(F.lit("<h2>other</h2>"), other)).alias("html"))
    return found_in(pages, "html", "skill int, sin string, damage string, guard string, capacity int, coins int, coin_effects string, stage string, base int, power int, effects string", skills)


def _option_html(line: Column, pos: Column) -> Column:
    label = lambda color, text: f'<span class="label" style="background: {color}">{text}</span>'
    check = F.when(line["l_suppkey"] % 3 == 0, "").otherwise(F.concat(F.when(line["l_suppkey"] % 3 == 1, GOOD).otherwise(BAD), F.lit(' <img alt="罪孽-gloom"><img alt="罪孽-pride">'), _text(" ", line["q"], " 点")))
    won = F.when(line["l_partkey"] % 3 == 0, F.lit("")).when(line["l_partkey"] % 3 == 1, F.concat(F.lit("<div>" + label(WON, "won") + "<ul><li>gain "), _text(line["q"]), F.lit("<li> <li>rest</ul></div>"))).otherwise(F.concat(F.lit("判定成功 获得 "), _text(line["q"]), F.lit(" 金，失去 2，end")))
    lost = _if(pos % 2 == 0, "<div>" + label(LOST, "lost") + "<ul><li>hurt</li></ul></div>")
    return F.concat(F.lit('<div role="tabpanel" class="tab-pane">' + label("#9A6433", "choice")), _text(" ", pos, "<p>"), check, F.lit("</p>"), won, lost, F.lit("</div>"))


def options(page: Page) -> Iterator[tuple]:
    """(pos, choice, check_type, sin, threshold, won, lost), a row a pane."""
    panes = [n for n in page.having("role", "tabpanel") if n.tag == "div" and attr_of(n, "role") == "tabpanel"]
    labels = [n for n in page.having("class", "label") if n.tag == "span" and "background" in attr_of(n, "style")]
    sins = [n for n in page.tags["img"] if _SIN.match(attr_of(n, "alt"))]
    for pos, pane in enumerate(panes, 1):
        text, shown, boxes = page.text(pane), onepage.inside(labels, pane), {"won": set(), "lost": set()}
        for n in shown:
            style = attr_of(n, "style")
            if WON in style or LOST in style:
                boxes["won" if WON in style else "lost"].add(n.parent)
        items = {side: sorted({n.pre for box in at for n in onepage.inside(page.tags["li"], page.nodes[box])}) for side, at in boxes.items()}
        won, lost = ([said for pre in items[side] if (said := page.text(page.nodes[pre]))] for side in ("won", "lost"))
        if not won:
            won = [r.strip(" ") for r in _REWARD.findall("".join(text.split("判定成功")[1:2])[:300])]
        check = GOOD if GOOD in text else BAD if BAD in text else ""
        threshold = onepage.number(re.split(f"{GOOD}|{BAD}", text)[-1][:100]) if check else None
        image = next(iter(onepage.inside(sins, pane)), None) if check else None
        sin = "" if image is None else _SIN.match(attr_of(image, "alt"))[1]
        yield pos, page.text(shown[0]) if shown else None, check, sin, threshold or 0, ";".join(won), ";".join(lost)


@query(f"""WITH {_LINES} SELECT l_orderkey, pos, 'choice' AS choice, CASE l_suppkey % 3 WHEN 1 THEN '有利判定' WHEN 2 THEN '不利判定' ELSE '' END AS check_type, CASE WHEN l_suppkey % 3 > 0 THEN 'gloom' ELSE '' END AS sin, CASE WHEN l_suppkey % 3 > 0 THEN q ELSE 0 END AS threshold, CASE l_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'gain ' || q || ';rest' ELSE '获得 ' || q || ' 金;失去 2' END AS won, CASE WHEN pos % 2 = 0 THEN 'hurt' ELSE '' END AS lost FROM ln""")
def page_options(read):
    """Choices of an event, a row a pane: label, check with its sin and threshold, what is won and lost by list or by words."""
    key = "l_orderkey"
    pages = _lines(read).select(key, F.concat(F.lit("<h2>event</h2><p>story</p>"), F.array_join(F.transform("lines", lambda line, i: _option_html(line, i + 1)), "")).alias("html"))
    return found_in(pages, "html", "pos int, choice string, check_type string, sin string, threshold int, won string, lost string", options)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '正面' END AS effect_type, CASE WHEN p_partkey % 2 = 0 THEN '暴怒' ELSE '' END AS sin, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' ELSE 'a;' || p_name END AS keywords, 'gives 强度 for 层数（持续回合） ' || p_size || CASE WHEN p_partkey % 2 = 0 THEN ' and more' ELSE '' END AS description FROM part WHERE p_partkey % 5 > 0""")
def page_effects(read):
    """Status effects: the box's rows by their first cell, the paragraphs below the heading of descriptions up to the next one, places of values in words."""
    k = F.col("p_partkey")
    row = lambda name, value: F.concat(F.lit(f"<tr><th>{name}</th><td> "), value, F.lit("</td><td>3</td></tr>"))
    words = F.when(k % 4 == 1, "a、").otherwise(F.concat(F.lit("a, "), F.col("p_name")))
    box = F.concat(F.lit('<table class="infobox"><tr><th>picture</th></tr>'), _if(k % 3 > 0, row("类型", F.lit("正面"))), _if(k % 2 == 0, row("罪孽", F.lit("<b>暴怒</b>"))), _if(k % 4 > 0, row("关键词", words)), F.lit("</table>"))
    told = F.concat(F.when(k % 5 > 0, "<h2>描述</h2>").otherwise("<h2>preview</h2>"), _text("<p>gives {0} for {1} ", F.col("p_size"), "</p><ul><li>no</ul>"), _if(k % 2 == 0, "<h3>sub</h3><div><i>and</i> more</div>"), F.lit("<h2>预览</h2><p>not this</p>"))
    n = int(read("part").sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the table's few files are work for all cores
    pages = read("part").repartition(n, "p_partkey").select("p_partkey", F.concat(box, told).alias("html"))
    nodes = staged(nodes_of(pages, "html", texts=("th", "td", "h2", "p", "div")))
    key = "p_partkey"
    cells = layout.within(outer(nodes, F.col("tag") == "tr", key, "row").select(key, "o_pre", "o_last", "row"), nodes.filter(F.col("tag").isin("th", "td")).select(key, "pre", "text"), key)
    pairs = cells.groupBy(key, "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pre", "text"))), lambda c: c["text"]).alias("c")).filter("size(c) > 1 and c[0] <> '' and c[1] <> ''")
    of = lambda name: F.coalesce(F.max_by(F.when(F.col("c")[0] == name, F.col("c")[1]), F.when(F.col("c")[0] == name, F.col("row"))), F.lit(""))
    facts = pairs.groupBy(key).agg(of("类型").alias("effect_type"), of("罪孽").alias("sin"), of("关键词").alias("words"))
    # the second rank of headings alone ends the description
    heads = nodes.filter("tag = 'h2'").select(key, "parent", "pre", "text").withColumn("until", F.lead("pre").over(Window.partitionBy(key, "parent").orderBy("pre")))
    head = heads.filter(F.col("text").contains("描述")).groupBy(key).agg(F.min(F.struct("pre", "parent", "until")).alias("h")).select(key, F.col("h.pre").alias("from"), F.col("h.parent").alias("parent"), F.col("h.until").alias("until"))
    parts = head.join(nodes.filter(F.col("tag").isin("p", "div") & (F.col("text") != "")).select(key, "parent", "pre", "text"), [key, "parent"]).filter("pre > from and (until is null or pre < until)")
    said = parts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "text"))), lambda p: p["text"]), " ").alias("t"))
    text = F.replace(F.replace("t", F.lit("{0}"), F.lit("强度")), F.lit("{1}"), F.lit("层数（持续回合）"))
    keywords = F.filter(F.transform(F.split(F.coalesce("words", F.lit("")), "[、,，]"), lambda w: F.trim(w)), lambda w: w != "")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return said.join(facts, key, "left").select(key, empty("effect_type"), empty("sin"), F.array_join(keywords, ";").alias("keywords"), text.alias("description"))
