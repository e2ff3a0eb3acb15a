import os

from pyspark.sql import functions as F

from gridwright.operators import grid as g, nodes as n, profile as p, sample as s
from gridwright.operators.scale import carry_forward, with_position
from gridwright.sources import grids, nodefiles as nf, pvmaps, tables
from gridwright.streaming.stateless import clean_observations, enrich


def test_grid_row_numbers_over_splits(spark, tmp_path):
    for name, size in (("a.csv", 5000), ("b.csv", 37)):
        (tmp_path / name).write_text("".join(f'{i},"x, {i}",z\n' for i in range(1, size + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = grids.read_grid(spark, str(tmp_path / "*.csv"))
        assert got.count() == 5037
        assert got.filter(F.col("row_no") != F.get("cells", F.lit(0)).cast("long")).count() == 0
        assert got.filter((F.size("cells") != 3) | (F.get("cells", F.lit(1)) != F.concat(F.lit("x, "), F.get("cells", F.lit(0))))).count() == 0
        loose = grids.read_grid(spark, str(tmp_path / "*.csv"), exact=False).withColumn("true_no", F.get("cells", F.lit(0)).cast("long"))
        rows = loose.orderBy("file", "true_no").select("file", "row_no").collect()
        assert all(a["file"] != b["file"] or a["row_no"] < b["row_no"] for a, b in zip(rows, rows[1:]))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_quoted_newlines(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,"two\nlines"\nb,c,d\n')
    rows = grids.read_grid(spark, str(tmp_path / "q.csv"), quoted_newlines=True).orderBy("row_no").collect()
    assert [(r["row_no"], r["cells"]) for r in rows] == [(1, ["a", "two\nlines"]), (2, ["b", "c", "d"])]


def test_pv_map_file(spark, tmp_path):
    (tmp_path / "m.csv").write_text("key,property,value,p2,v2\n# a comment\ntotal,populationType,dcs:Person\nman,gender,dcs:Male,age,[18 - Years]\nFR,country/FRA\nman,color,dcs:Red\n")
    rows = {r["key"]: r["props"] for r in pvmaps.load_pv_map(spark, str(tmp_path / "m.csv"), "place").collect()}
    assert rows == {"total": {"populationType": "dcs:Person"}, "man": {"gender": "dcs:Male", "age": "[18 - Years]", "color": "dcs:Red"}, "FR": {"place": "country/FRA"}}


def test_node_files(spark, tmp_path):
    (tmp_path / "n.mcf").write_text('# head\n\nNode: dcid:A\ntypeOf: dcs:Class\nname: "Some, text"\nlist: x, y\n\nNode: B\n# note\ndcid: "ignored"\nsize: 5\n\nNode: dcid:A\nlist: z\n\n')
    tr = nf.read_nodes(spark, str(tmp_path / "n.mcf"))
    merged = {(r["node"], r["prop"], r["value"]) for r in n.merge(tr.filter((F.col("prop") != "#") & F.col("node").isNotNull())).collect()}
    assert {("A", "list", v) for v in "xyz"} <= merged and ("A", "name", '"Some, text"') in merged and ("B", "size", "5") in merged
    out = os.path.join(str(tmp_path), "out")
    nf.write_nodes(n.merge(tr.filter((F.col("prop") != "#") & F.col("node").isNotNull())), out, defaults={"unit": "dcs:One", "size": "9"})
    back = {(r["node"], r["prop"], r["value"]) for r in nf.read_nodes(spark, out).collect()}
    assert {("A", "unit", "dcs:One"), ("B", "unit", "dcs:One"), ("A", "size", "9"), ("B", "size", "5")} <= back and ("B", "size", "9") not in back
    assert n.diff(tr.filter(F.col("prop") != "#"), tr.filter(F.col("prop") != "#")).filter(F.col("status") != "matched").count() == 0


def test_large_node_is_written_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(nf, "BLOCK_LINES", 50)
    tr = spark.range(1000).select(F.lit("hot").alias("node"), F.lit("v").alias("prop"), F.col("id").cast("string").alias("value"), F.lit(0).alias("ord"))
    blocks = nf.node_blocks(tr)
    assert blocks.count() >= 20 and blocks.agg(F.max(F.size(F.split("text", "\n")))).first()[0] < 200
    nf.write_nodes(tr, str(tmp_path / "o"))
    assert nf.read_nodes(spark, str(tmp_path / "o")).select("value").distinct().count() == 1000


def test_template_requires_variables(spark):
    import pytest

    df = spark.createDataFrame([("a", None)], "x string, y string")
    assert nf.fill_template(df, ["n: {x}", "m: {y}"]).first()["text"] == "n: a"
    with pytest.raises(Exception):
        nf.fill_template(df, ["n: {x}", "m: {y}"], ["y"]).collect()


def test_sinks(spark, tmp_path):
    obs = spark.createDataFrame([("2020", "dcid:a", 1.0, "u"), ("2021", "dcid:a", 2.5, "u")], "observationDate string, observationAbout string, value double, unit string")
    text = tables.write_observations(obs, str(tmp_path / "o"), obs.columns)
    assert "observationAbout: dcid:a" in text and "unit: u" in text and "observationDate: C:Table->observationDate" in text
    assert sorted(r["value"] for r in spark.read.csv(str(tmp_path / "o"), header=True).collect()) == ["1", "2.5"]


def test_positions_and_carry(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 3 + 1).alias("w"))
    pos = with_position(df, ["k"]).collect()
    assert all(r["k"] == r["pos"] for r in pos)
    weighted = sorted((r["k"], r["w"], r["at"]) for r in with_position(df, ["k"], "at", "w").collect())
    total = 0
    for _, w, at in weighted:
        assert at == total
        total += w
    marks = spark.range(1000).select(F.lit("f").alias("f"), F.col("id"), F.when(F.col("id").isin(3, 410, 411, 900), F.col("id")).alias("m"))
    got = {r["id"]: r["m"] for r in carry_forward(marks, ["f"], "id", ["m"], bucket=50).collect()}
    last = None
    for i in range(1000):
        last = i if i in (3, 410, 411, 900) else last
        assert got[i] == last


def test_samples(spark):
    df = spark.range(2000).select("id", (F.col("id") % 7).cast("string").alias("a"), F.when(F.col("id") == 1234, "rare").otherwise("usual").alias("b"), (F.col("id") * 1.5).alias("x"))
    one = s.coverage_sample(df, ["id"], ["a", "b"], ["x"], p.numeric_ranges(df, ["x"]))
    assert one.count() == 80 and one.filter("b = 'rare'").count() == 1 and one.select("a").distinct().count() == 7
    assert {r["id"] for r in one.collect()} == {r["id"] for r in s.coverage_sample(df.repartition(13), ["id"], ["a", "b"], ["x"], p.numeric_ranges(df, ["x"])).collect()}
    assert s.coverage_sample(df.limit(30), ["id"], ["a"]).count() == 30
    from gridwright.plans.sampling import sample_table

    rows, labels = sample_table(df, ["id"])
    assert rows.count() >= 40 and {r["column"]: r["label"] for r in labels.collect()}["b"] == "constant"


def test_streams_take_the_same_builders(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("1,200", "3/4/2020", "a"), ("n/a", "2020", "b")], "value string, observationDate string, code string").write.json(str(src))
    codes = spark.createDataFrame([("a", "place/a")], "code string, dcid string")
    stream = spark.readStream.schema("value string, observationDate string, code string").json(str(src))
    q = enrich(clean_observations(stream), codes, "code", "dcid").writeStream.format("memory").queryName("cleaned").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["value"], r["observationDate"], r["dcid"]) for r in spark.table("cleaned").collect()] == [(1200.0, "2020-03-04", "place/a")]


def test_user_hooks(spark):
    """Row hooks are DataFrame functions, row-wise 0..n output a table function, rule functions registered functions, cell kinds a dict."""
    from pyspark.sql.functions import udtf

    grid = spark.createDataFrame([("f", 1, ["a", "2"]), ("f", 2, ["skip", "3"])], "file string, row_no long, cells array<string>")
    assert grid.transform(lambda d: d.filter(F.get("cells", F.lit(0)) != "skip")).count() == 1

    @udtf(returnType="v double")
    class Halves:
        def eval(self, v: float):
            if v > 1:
                yield v / 2,
                yield v / 2,

    spark.udtf.register("halves", Halves)
    spark.createDataFrame([(1.0,), (4.0,)], "value double").createOrReplaceTempView("obs_in")
    assert [r[0] for r in spark.sql("SELECT h.v FROM obs_in, LATERAL halves(value) h").collect()] == [2.0, 2.0]
    spark.udf.register("twice", lambda x: str(int(x) * 2))
    from gridwright.operators.resolve import apply_expressions

    wide = spark.createDataFrame([("21", "double=twice(Number)")], "Number string, `#Eval` string")
    assert apply_expressions(wide, ["double=twice(Number)"]).first()["double"] == "42"
    kinds = p.cell_kinds({"PLACE": ["Oslo"]}, {**p.CELL_KINDS, "CODE": "^[A-Z]{3}$"})
    rows = p.annotate_cells(g.melt(spark.createDataFrame([("f", 1, ["oslo", "NOR", "12", "2020"])], grid.schema)), kinds)
    assert [r["label"] for r in rows.orderBy("col_no").collect()] == ["PLACE", "CODE", "VALUE", "DATE"]
