"""What larger tables show: sums that depend on order, joins that grow with the square of a page, a message or a table."""

import random

import pyarrow as pa
import pyarrow.parquet as pq

from tessera import registry
from tessera.functions import dom


def test_sums_in_the_order_of_the_table(spark, tmp_path):
    tax, want, folder = [0.07, 0.01, 0.07, 0.04, 0.06, 0.03, 0.02, 0.08], {}, tmp_path / "lineitem.parquet"
    folder.mkdir()
    for i in range(5):  # later files are larger, so Spark reads them first
        chance = random.Random(i)
        rows = [(k, chance.choice(tax), chance.choice(tax), 3.0, "RAN"[i % 3], "O") for k in range(400 + 2000 * i)]
        pq.write_table(pa.table([*zip(*rows, strict=True)], ["l_orderkey", "l_discount", "l_tax", "l_quantity", "l_returnflag", "l_linestatus"]), folder / f"part-{i}.parquet")
        for k, discount, t, q, flag, _ in rows:
            r, a, fixed, add = want.get(k, (0.0, 0.0, 0.0, 0.0))
            want[k] = (r + discount * (flag == "R"), a + t * (flag == "A"), fixed + t * 10, add + q)
    got = registry.QUERIES["damage_parts"](spark, str(tmp_path)).collect()
    assert {r.l_orderkey: (r.multiplier, r.additive, r.fixed) for r in got} == {k: (1 + r + a, float(round(add * 0.75)), float(round(f))) for k, (r, a, f, add) in want.items()}


def test_pages_are_read_tag_by_tag_as_the_parser_reads_them(monkeypatch):
    pieces = ["<p>", "</p>", "<div class='tip'>", "</div>", "<br/>", "<script>'</p>'</script>", "<script>", "</script>", "<title>", "</title>", "text ", " &lt; ", "<!-- c -->", "<!-- <p> -->", "<a title='a>b'>", "</a>", "< b", "<td colspan=2>", "<tr>", "<table>", "</table>", "<", ">", "<script/>", "<li>", "\n"]
    chance = random.Random(3)
    pages = ["".join(chance.choices(pieces, k=chance.randint(1, 8))) for _ in range(3000)]
    read = lambda: [dom.page_nodes(p, frozenset(("p", "div", "td")), frozenset(("tip",))) for p in pages]
    fast, by_tag = read(), sum(dom._steps(p) is not None for p in pages)
    monkeypatch.setattr(dom, "_steps", lambda html: None)
    assert fast == read() and by_tag > 300


def test_nodes_come_in_bounded_batches(spark):
    from pyspark.sql import functions as F

    pages = spark.range(3000).coalesce(1).select("id", F.concat(F.lit("<p>x" * 40), F.col("id").cast("string")).alias("html"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    sizes = dom.nodes_of(pages, "html", ("p",)).mapInArrow(lambda batches: (b.slice(0, 1).set_column(0, "id", [b.num_rows]) for b in batches), "id long, pre int, last int, parent int, level int, start int, tag string, attrs map<string,string>, text string, grid_row int, grid_col int, row_span int, col_span int")
    got = [r.id for r in sizes.collect()]
    assert len(got) > 1 and sum(got) == 120_000


def test_close_pairs_are_those_of_brute_force(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tessera.functions import nearest

    for name, n in (("ROWS", 7), ("QUERIES", 3), ("TOGETHER", (2, 2))):
        monkeypatch.setattr(nearest, name, n)
    chance = random.Random(5)
    some = [[float(chance.randint(-2, 2)) for _ in range(3)] for _ in range(60)]
    some += [some[1], some[2], [0.0] * 3, None, [1.0, None, 2.0], [1.0, 2.0], [], [float("nan"), 1.0, 1.0]]
    v = spark.createDataFrame(list(enumerate(some)), "row long, v array<double>").repartition(3)
    q = v.filter("row % 6 = 0").select(F.col("row").alias("q_row"), F.col("v").alias("q"))
    got = {(r.q_row, r.row) for r in nearest.close_pairs(v, q, 5).collect()}

    def cosine(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return 0.0
        dot = lambda x, y: sum(i * j for i, j in zip(x, y))
        norm = dot(a, a) ** 0.5 * dot(b, b) ** 0.5
        out = dot(a, b) / norm if norm else 0.0
        return float("inf") if out != out else out

    for at in range(0, len(some), 6):
        scores = {i: cosine(some[at], x) for i, x in enumerate(some)}
        least = sorted(scores.values())[-5]
        assert {i for i, s in scores.items() if s >= least - 1e-9} == {i for k, i in got if k == at}


def test_names_that_begin_alike(spark):
    from tessera.functions import names

    chance = random.Random(7)
    word = lambda most: "".join(chance.choices("ab", k=chance.randint(0, most)))
    said, known = [word(12) for _ in range(40)] + ["a", "", None], [word(5) for _ in range(60)] + ["", None]
    texts = spark.createDataFrame(list(enumerate(said)), "id int, said string")
    got = names.contained_by_length(texts, "id", "said", spark.createDataFrame([(n,) for n in known], "name string"), "name").collect()
    assert sorted((r.id, r.name, r.place) for r in got) == sorted((i, n, s.find(n)) for i, s in enumerate(said) if s for n in {*known} if n and n in s)


def test_words_are_shuffled_once_and_pairing_tasks_stay_small(spark, tmp_path, monkeypatch):
    from tessera.plans import records
    from tessera.sources import index

    plans = []
    monkeypatch.setattr("pyspark.sql.readwriter.DataFrameWriter.parquet", lambda self, *a, **k: plans.append(self._df._jdf.queryExecution().executedPlan().toString()))
    docs = spark.createDataFrame([(1, "a b a")], "doc_id long, text string")
    try:
        index.write_terms(docs, str(tmp_path))
    except Exception:  # its own files are not there to be read
        pass
    assert plans[0].count("Exchange") == 2 and "hashpartitioning(word" not in plans[0]
    monkeypatch.undo()
    monkeypatch.setattr(records, "TASK_ROWS", 100)
    spread = registry.QUERIES["skill_attribution"](spark, "/root/testdata/sf0.001")
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert spread.rdd.getNumPartitions() >= lines // 100 > 4
