"""Layouts of a page in memory: the same as over node tables, and no join or second shuffle in the queries."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera import registry
from tessera.functions import layout, onepage
from tessera.functions.dom import Page, attr, found_in, nodes_of

TEXTS = ("h2", "h3", "h4", "h5", "td", "th", "tr", "b", "big", "p", "li", "span", "table")


def pages_of(pieces, n=400, most=30):
    chance = random.Random(len(pieces))
    return ["".join(chance.choices(pieces, k=chance.randint(0, most))) for _ in range(n)]


def nodes_and_pages(spark, htmls):
    return nodes_of(spark.createDataFrame(list(enumerate(htmls)), "page int, html string"), "html", TEXTS).cache(), [Page(h) for h in htmls]


@pytest.mark.parametrize("name", ["page_parts", "page_units", "page_skills", "page_grid_maps", "page_icon_counts", "page_options"])
def test_pages_are_not_joined(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and plan.count("Exchange") == 1


def test_what_was_found_goes_on_in_parts(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "<p>" * 30), (None, "<b>x</b>"), (3, None), (4, "<p><p>")], "id int, html string").coalesce(1)
    got = found_in(pages, "html", "tag string, pre int", lambda page: ((n.tag, n.pre) for n in page.nodes)).collect()
    assert sorted((r.id or 0, r.tag, r.pre) for r in got) == sorted([(1, "p", i) for i in range(30)] + [(0, "b", 0), (4, "p", 0), (4, "p", 1)])
    monkeypatch.setattr("tessera.functions.dom.TOGETHER", (7, 1))
    sizes = found_in(pages, "html", "tag string", lambda page: ((n.tag,) for n in page.nodes)).mapInArrow(lambda batches: (b.slice(0, 1).set_column(0, "id", [b.num_rows]) for b in batches), "id long, tag string")
    assert sum(r.id for r in sizes.collect()) == 33


def test_sections_as_over_node_tables(spark):
    pieces = ["<h2>a</h2>", "<h3>b Skills</h3>", "<h4>c</h4>", "<div>", "</div>", "<table>", "</table>", "<tr>", "<td>", "<img alt='stat-life.png'>", "<div class='fold'>", "<p>x", "<center>", "</center>"]
    nodes, pages = nodes_and_pages(spark, pages_of(pieces))
    want = {(r.page, r.head, r.o_pre) for r in layout.next_in_section(nodes, "page", F.col("tag") == "table", attr("alt").contains("stat-life")).collect()}
    got = {(i, h.pre, t.pre) for i, p in enumerate(pages) for h, t in onepage.next_in_section(p, p.tags["table"], p.having("alt", "stat-life"))}
    assert got == want and len(want) > 50
    want = sorted((r.page, r.head, r.pre) for r in layout.following(nodes, "page", attr("class") == "fold", "Skills").collect())
    got = sorted((i, h.pre, t.pre) for i, p in enumerate(pages) for h, found in onepage.following(p, p.having("class", "fold"), "Skills") for t in found)
    assert got == want and len(want) > 50


def test_parts_as_over_node_tables(spark):
    head = "<tr><td colspan=7 style='background:#000000'><img alt='body-x'><b>n</b></td></tr>"
    icons, sin = "<tr><td><img alt='stat-life'><img alt='stat-speed'></td></tr>", "<td><img alt='sin-1'>"
    pieces = [head, head, icons, icons, sin, "<span style='color:red'><b>[×2]</b>", "</span>", "</td>", "<tr><td>plain ×3</td></tr>", "<tr>", "</tr>", "<td>", "<big>5</big>", "<b>b</b>", "<table>", "</table>", "<img alt='deco'>"]
    nodes, pages = nodes_and_pages(spark, ["<table>" + h for h in pages_of(pieces)])
    tables = nodes.filter("tag = 'table' and pre = 0").select("page", F.col("pre").alias("o_pre"), F.col("last").alias("o_last"))
    rows = layout.part_rows(layout.row_facts(tables, nodes, "page"), "page").orderBy("page", "row").collect()
    want, got = defaultdict(list), defaultdict(list)
    for r in rows:
        want[r.page].append((r.part, r.phase, r.text, r.icons, r.bolds, r.bigs, r.colored, r.sin_colored))
    for i, p in enumerate(pages):
        for part, phase, r in onepage.part_rows(p, p.nodes[0], onepage.row_facts(p)):
            got[i].append((part, phase, r.text, r.icon, r.bold, r.big, r.color, r.sin))
    assert got == want and {"head", "icons", "values", "sin_icons", "sin_values", "other"} == {r.phase for r in rows}


def test_parts_that_repeat_go_where_there_are_skills():
    def part(name, hp, sin="×1"):
        icons = "<tr><td><img alt='stat-life'><img alt='stat-speed'></td></tr>"
        return f"<tr><td colspan=7 style='background:#000000'><img alt='body-x'><b>{name}</b></td></tr>{icons}<tr><td><big>{hp}</big><big>2</big><big>3-4</big></td><td>×1. ×2 ×. ×9</td></tr><tr><td><img alt='sin-1'></td></tr><tr><td>{sin}</td></tr>"

    table = "<h3>x</h3><table>" + part("a", 5) + part("a", 6) + part("b", 0) + part("a", 7, "×2") + part("c", "9999999999") + "</table>"
    rows = lambda html: list(onepage.parts(Page(html), 3, 7, "Skills"))
    assert [(r[0], r[1]) for r in rows(table)] == [("a", 5), ("a", 6), ("a", 7)]
    assert [(r[0], r[1]) for r in rows(table + "<h4>Skills</h4><div class=mw-collapsible></div>")] == [("a", 5), ("a", 7)]
    assert rows(table)[0] == ("a", 5, 2, "3-4", None, [1.0, 2.0, None], [1.0], "") and rows("") == rows("<h3>x</h3><table><tr>") == []


def test_grids_and_counts_as_over_node_tables(spark):
    pieces = ["<tr>", "<tr>", "<tr>", "</tr>", "<th>h", "<th>h", "<td>3", "<td>4", "<th>i", "<td>1", "<td>2", "</td>", "<table>", "</table>", "<span>", "</span>", "× 4 ", "<img alt='sin-a.png'>", "<img alt='sin-b'>", "<img alt='x'>"]
    pages = pages_of([*pieces, "<td rowspan=2>r", "<th rowspan=3>s"], most=60) + pages_of([*pieces, "<td colspan=2>c", "<th colspan=3>h", "<td colspan=x>"], most=60)
    nodes, read = nodes_and_pages(spark, ["<table>" + h for h in pages])
    labelled = layout.labelled(layout.grid(nodes, "page"), "page")
    want = {(r.page, r.t_pre, r.row): dict(r["values"]) for r in layout.as_maps(labelled, "page").collect()}
    names = tuple({k for v in want.values() for k in v})
    got = {(i, t, row): {n: v for n, v in zip(names, values) if v is not None} for i, p in enumerate(read) for t, row, *values in onepage.grid_rows(p, names)}
    assert got == want and len(want) > 100
    rows = nodes.filter("tag = 'tr'").select("page", F.col("pre").alias("o_pre"), F.col("last").alias("o_last"), "text")
    want = defaultdict(list)
    for r in layout.icon_values(rows, nodes, "page", r"sin-(\w+)", r"×\s*(\d+)").orderBy("page", "o_pre").collect():
        want[r.page].append(dict(r["values"]))
    got = defaultdict(list)
    for i, p in enumerate(read):
        for pos, keys, counts in onepage.icon_counts(p, re.compile(r"sin-(\w+)", re.A), re.compile(r"×\s*(\d+)", re.A)):
            got[i].append(dict(zip(keys, map(float, counts), strict=True)))
            assert pos == len(got[i]) and keys == sorted(keys)
    assert got == want and len(want) > 50


def test_panes_as_over_node_tables(spark):
    from tessera.plans import panes

    chance = random.Random(8)
    words = ["基础值：4", "基础值: 99999999999", "变动值：+2", "变动值: -", "硬币威力：-3", "[on]", "[off]", "[", "]", "text", " "]
    texts = ["".join(chance.choices(words, k=chance.randint(0, 9))) for _ in range(500)]
    got = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", panes.stage(F.col("t")).alias("s")).orderBy("id").collect()
    assert [(r.s.base, r.s.power, [tuple(e) for e in r.s.effects]) for r in got] == [panes.stage_of(t) for t in texts]
    nodes, read = nodes_and_pages(spark, pages_of(["<table>", "<td>", "</td>", "one", "two <b>", "<img alt='coin1'>", "<img alt='x coin23'>", "<img alt='y'>"]))
    want = {(r.page, r.cell): [tuple(e) for e in r.effects] for r in panes.coin_effects(panes.outer(nodes, F.col("tag") == "td", "page", "cell"), nodes.filter("tag = 'img'"), "page").collect()}
    assert {(i, c.pre): panes.cut_at_coins(p, c) for i, p in enumerate(read) for c in p.tags["td"]} == want and len(want) > 100


def test_options_and_skills_of_odd_pages():
    from tessera.plans import panes

    label = lambda color, text: f"<span class='label' style='background: {color}'>{text}</span>"
    pane = "<div role=tabpanel>"
    page = pane + label("#9A6433", "go") + "不利判定 <img alt='罪孽-lust'> 7 点<div>" + label(panes.WON, "w") + label(panes.WON, "w") + "<li>a<li> <li>b</div>" + label(panes.LOST, "l") + "</div>" + pane + "判定成功 失去 3，x</div>" + pane
    assert list(panes.options(Page(page))) == [(1, "go", panes.BAD, "lust", 7, "a;b", "a;b"), (2, None, "", "", 0, "失去 3", ""), (3, None, "", "", 0, "", "")]
    fold = "<h2>技能</h2><div class=collapsible><table class=wikitable>反击<div role=tabpanel>[a] b</div></table><table class=wikitable><td>x</table></div>"
    assert list(panes.skills(Page(fold))) == [(0, "", "", "反击", 1, 0, None, "I", None, None, "a=b")]
    assert list(panes.skills(Page(fold.replace("技能", "other")))) == list(panes.skills(Page(None))) == list(panes.options(Page(""))) == []
