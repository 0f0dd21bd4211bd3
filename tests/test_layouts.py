"""Node tables, sections, grids and parts on small pages."""

import time

from pyspark.sql import functions as F

from tessera.functions import layout
from tessera.functions.dom import attr, nodes_of, page_nodes

TEXTS = ("h2", "h3", "h4", "h5", "td", "th", "tr", "b", "big", "p", "li")


def shape(html, without=()):
    return [(n["tag"], n["pre"], n["last"], n["parent"], n["text"]) for n in page_nodes(html, frozenset(TEXTS), frozenset(without))]


def test_pages_with_errors():
    assert shape(None) == shape("") == shape("only text") == []
    assert shape("<p>one<p>two<b>x</i></p>y</b>") == [("p", 0, 0, -1, "one"), ("p", 1, 2, -1, "two x"), ("b", 2, 2, 1, "x")]
    assert shape("<ul><li>1<ul><li>2</ul><li>3</ul>")[1:] == [("li", 1, 3, 0, "1 2"), ("ul", 2, 3, 1, None), ("li", 3, 3, 2, "2"), ("li", 4, 4, 0, "3")]
    assert shape("<div><td>a</div><p>b</p>") == [("div", 0, 2, -1, None), ("td", 1, 2, 0, "a b"), ("p", 2, 2, 1, "b")]  # a cell's border is not crossed
    assert shape("<script>if (a<b) '</p>'</script><!-- <p>no --><br/><p/>&lt;x&gt;") == [("script", 0, 0, -1, None), ("br", 1, 1, -1, None), ("p", 2, 2, -1, "")]
    assert shape("<b>burn<span class='a tip'>at the end <b>{0}</b></span> 2</b>", ["tip"]) == [("b", 0, 0, -1, "burn 2")]


def test_deep_pages_take_linear_time():
    start = time.time()
    assert len(page_nodes("<b>x" * 50_000 + "</i>" * 50_000 + "<p>y" * 1000, frozenset())) == 51_000
    assert time.time() - start < 10


def grid_of(spark, html):
    slots = layout.grid(nodes_of(spark.createDataFrame([(1, html)], "page int, html string"), "html", TEXTS), "page").collect()
    return {(r.t_pre, r.row, r.col): r.text for r in slots}


def test_grids(spark):
    got = grid_of(spark, "<table><tr><td rowspan=2>a<td colspan=2>b<tr><td>c<td rowspan=9>d<tr><td>e<td>f</table>")
    assert got == {(0, 0, 0): "a", (0, 1, 0): "a", (0, 0, 1): "b", (0, 0, 2): "b", (0, 1, 1): "c", (0, 1, 2): "d", (0, 2, 2): "d", (0, 2, 0): "e", (0, 2, 1): "f"}
    nested = grid_of(spark, "<table><tr><td>a<table><tr><td>b</table><td colspan=x>c</table>")
    assert nested == {(0, 0, 0): "a b", (3, 0, 0): "b", (0, 0, 1): "c"}
    assert grid_of(spark, "<td>no table</td><table></table>") == {}
    slots = layout.grid(nodes_of(spark.createDataFrame([(1, "<table><tr><th colspan=2>h<tr><th>x<td>1<tr><td>2<td>3</table>")], "page int, html string"), "html", TEXTS), "page")
    assert sorted((r.row, r.col, r.label, r.text) for r in layout.labelled(slots, "page").collect()) == [(1, 1, "h", "1"), (2, 0, "x", "2"), (2, 1, "h", "3")]


STAT = '<table style="w"><tr><td><img alt="stat-life.png"><b>{0}</b></td></tr></table>'
PAGE = (
    "<div><h2>info</h2>" + STAT.format(1) + "<h3>phase one</h3><p>x</p>" + STAT.format(2)
    + "<h3>sanity</h3><p>none</p><h3>phase two</h3><table><tr><td>[elder] talk</td></tr></table><table><tr><td>talk</td></tr></table><center>" + STAT.format(3) + "</center><h4>Skills</h4><div class='mw-collapsible a'>1</div><p>-</p><div class=mw-collapsible>2</div><h4>Voice</h4><div class=mw-collapsible>3</div>"
    "<h2>Support units</h2><h3>friend</h3><center><table><tr><td>first</td></tr></table>" + STAT.format(4) + "</center></div>"
)


def test_sections(spark):
    nodes = nodes_of(spark.createDataFrame([(1, PAGE), (2, ""), (3, None)], "page int, html string"), "html", TEXTS).cache()
    names = {r.pre: r.text for r in nodes.filter(F.col("tag").isin(*layout.HEADS)).collect()}
    tables = layout.next_in_section(nodes, "page", F.col("tag") == "table", attr("alt") == "stat-life.png")
    life = layout.within(tables, nodes.filter("tag = 'b'").select("page", "pre", "text"), "page")
    # a heading without a table does not take the next section's; tables of talk are passed over, but not inside one wrapper
    assert {names[r.head]: r.text for r in life.collect()} == {"info": "1", "phase one": "2", "phase two": "3"}
    blocks = layout.following(nodes, "page", attr("class").contains("mw-collapsible"), "Skills")
    assert sorted(names[r.head] for r in blocks.collect()) == ["Skills", "Skills", "Voice", "phase two", "phase two"]
    side = F.when(F.col("tag") == "h2", F.col("text").contains("Support"))
    friends = layout.last_before(nodes, "page", side).filter("tag = 'h3' and before")
    assert [r.text for r in friends.collect()] == ["friend"]


def test_parts(spark):
    head = '<tr><td colspan="7" style="background:#000000;color:red"><img alt="body-head.png"><b>{0}</b></td></tr>'
    icons, seven = '<tr><td><img alt="stat-life.png"></td><td><img alt="stat-speed.png"></td></tr>', "".join(f'<td><img alt="sin-{i}.png"></td>' for i in range(7))
    html = (
        "<table><tr><td><big>5</big></td></tr>" + head.format("top") + "<tr><td>stray</td></tr>" + icons + "<tr><td><big>120</big><big>-2</big><big>3-5</big></td><td><span style='color:x'><b>[×0.5]</b></span><span style='color:x'><b>none</b></span></td></tr><tr>" + seven
        + "</tr><tr><td><img alt='deco.png'></td></tr><tr><td>×1.5 ×2</td></tr><tr><td>×9</td></tr>" + head.format("legs") + "<tr><td>×7</td></tr>" + icons + icons + "<tr><td><big>7</big></td></tr></table>"
    )
    nodes = nodes_of(spark.createDataFrame([(1, html)], "page int, html string"), "html", TEXTS).cache()
    tables = nodes.filter("tag = 'table'").select("page", F.col("pre").alias("o_pre"), F.col("last").alias("o_last"))
    rows = layout.part_rows(layout.row_facts(tables, nodes, "page"), "page").orderBy("row").collect()
    assert [(r.part, r.phase) for r in rows] == [(0, "other"), (1, "head"), (1, "other"), (1, "icons"), (1, "values"), (1, "sin_icons"), (1, "other"), (1, "sin_values"), (1, "other"), (2, "head"), (2, "other"), (2, "icons"), (2, "icons"), (2, "values")]
    assert rows[4].bigs == ["120", "-2", "3-5"] and rows[4].colored == ["[×0.5]", "none"]
    one = spark.range(1).select(layout.by_position(F.array(F.lit("[×0.5]"), F.lit("no")), F.lit("×9"), ("a", "b")).alias("x"), layout.by_position(F.array().cast("array<string>"), F.lit("×1.5, ×2 ×3"), ("a", "b")).alias("y")).first()
    assert one.x == {"a": 0.5} and one.y == {"a": 1.5, "b": 2.0}


def test_stages_and_coins(spark):
    from tessera.plans import panes

    texts = ["基础值：4 变动值: +2 [使用时] gain 1 [x] [命中时] burn 2", "硬币威力：-3 变动值：1", "", "基础值：7 硬币威力：9"]
    got = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", panes.stage(F.col("t")).alias("s")).orderBy("id").collect()
    assert [(r.s.base, r.s.power, [tuple(e) for e in r.s.effects]) for r in got] == [(4, 2, [("使用时", "gain 1"), ("命中时", "burn 2")]), (None, -3, []), (None, None, []), (7, None, [])]
    html = "<p>before</p><table><tr><td>first <b>part</b><img alt='coin1.png'> one <img alt='other.png'>more<img alt='coin2.png'><img alt='x coin3'> last</td><td>plain</td><td><img alt='coin1'></td></tr></table>"
    nodes = nodes_of(spark.createDataFrame([(1, html)], "page int, html string"), "html", TEXTS).cache()
    cells = panes.outer(nodes, F.col("tag") == "td", "page", "cell")
    got = panes.coin_effects(cells, nodes.filter("tag = 'img'"), "page").orderBy("cell").collect()
    assert [[tuple(e) for e in r.effects] for r in got] == [[(0, "first part"), (1, "one more"), (3, "last")], [(0, "plain")], []]
