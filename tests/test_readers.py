"""Readers and closures on inputs that are wide, deep, quoted or oddly parted."""

import csv
import random

from pyspark.sql import functions as F

from gridwright.operators.observe import merge_keyed
from gridwright.operators.places import closure
from gridwright.sources import grids
from gridwright.sources.grids import read_grid
from gridwright.sources.nodefiles import read_nodes, write_nodes
from gridwright.sources.pvmaps import load_pv_map
from gridwright.sources.tables import keyed_table, load_keyed


def cells_of(df):
    return [list(r["cells"]) for r in df.orderBy("file", "row_no").collect()]


def test_wide_quoted_lines_and_all_delimiters(spark, tmp_path):
    rows = [[f"cell {i}, with \"quotes\"" for i in range(2500)], ["x", "a;b", "3"], ["", " y ", "tab\tin it"], ["plain", "5 inch", ""]]
    for name, delimiter in (("comma", ","), ("semicolon", ";"), ("tab", "\t"), ("pipe", "|")):
        path = tmp_path / f"{name}.csv"
        with path.open("w", newline="") as f:
            csv.writer(f, delimiter=delimiter, lineterminator="\n").writerows(rows)
        assert cells_of(read_grid(spark, str(path), delimiter)) == rows
    path = tmp_path / "odd.csv"
    path.write_text('a,5" pipe,c\n')
    assert cells_of(read_grid(spark, str(path))) == [["a", '5" pipe', "c"]]


def test_quoted_line_ends_and_any_number_of_columns(spark, tmp_path):
    rows = [["a", "two\nlines", "c"], [str(i) for i in range(600)], ["last", 'say "no"\n', "x"]]
    path = tmp_path / "whole.csv"
    with path.open("w", newline="") as f:
        csv.writer(f).writerows(rows)
    assert cells_of(read_grid(spark, str(path), quoted_newlines=True)) == rows


def quoted_rows(text):
    """Rows cut at line ends outside quotes, by one walk over the text; with an odd number of quotes, at every line end."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    plain, rows, inside = text.count('"') % 2, [""], False
    for c in text.removesuffix("\n"):
        inside ^= c == '"' and not plain
        if c == "\n" and not inside:
            rows.append("")
        else:
            rows[-1] += c
    return [(i, r) for i, r in enumerate(rows, 1) if r]


def test_quoted_line_ends_over_many_splits(spark, tmp_path):
    """Splits of a few bytes: rows span several, start anywhere, and are numbered as one task would."""
    rnd = random.Random(3)
    for k in range(3):
        rows = [[rnd.choice(["a", "two\nlines", 'a "word"\n\n', "x" * rnd.randrange(60), "", "\n" * rnd.randrange(9)]) for _ in range(3)] for _ in range(120)]
        with (tmp_path / f"f{k}.csv").open("w", newline="") as f:
            csv.writer(f, lineterminator=rnd.choice(["\n", "\r\n"])).writerows(rows)
            if k == 2:
                f.write('odd "\nlast,1\n')
    (tmp_path / "empty.csv").write_text("")
    want = {}
    for path in tmp_path.glob("*.csv"):
        with path.open(newline="") as f:
            want[path.name] = quoted_rows(f.read())
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("97", "1000", "128m"):
            spark.conf.set(key, size)
            lines = spark.read.text(str(tmp_path)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), "value", F.monotonically_increasing_id().alias("_mid"))
            got = {}
            for r in grids._quoted_rows(lines).collect():
                got.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["row_no"], r["line"]))
            assert {n: sorted(r) for n, r in got.items()} == {n: r for n, r in want.items() if r}, size
    finally:
        spark.conf.set(key, before)


def test_map_rows_of_any_length(spark, tmp_path):
    path = tmp_path / "map.csv"
    path.write_text("key,property,value\n# a note\nlong," + ",".join(f"p{i},v{i}" for i in range(40)) + "\nshort,only\n")
    got = {r["key"]: r["props"] for r in load_pv_map(spark, str(path)).collect()}
    assert got == {"long": {f"p{i}": f"v{i}" for i in range(40)}, "short": {"GLOBAL": "only"}}


def test_closure_of_any_depth_and_of_rings(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(12)] + [("r1", "r2"), ("r2", "r1")], "node string, parent string")
    got = {(r["node"], r["ancestor"], r["level"]) for r in closure(edges).collect()}
    assert got == {(f"n{i}", f"n{j}", j - i) for i in range(12) for j in range(i + 1, 13)} | {("r1", "r2", 1), ("r2", "r1", 1), ("r1", "r1", 2), ("r2", "r2", 2)}


def test_node_blocks_with_other_line_ends_and_blank_lines_with_blanks(spark, tmp_path):
    path = tmp_path / "nodes.mcf"
    path.write_bytes(b"Node: dcid:a\r\nsize: 1\r\n\r\nNode: dcid:b\r\nsize: 2\r\n \t\r\nNode: dcid:c\nsize: 3\n\n\nNode: dcid:d\nsize: 4")
    got = {(r["node"], r["prop"], r["value"]) for r in read_nodes(spark, str(path)).collect()}
    assert got == {(n, "size", v) for n, v in zip("abcd", "1234")}


def test_header_once_and_files_by_size(spark, tmp_path):
    triples = spark.createDataFrame([(f"n{i:03}", "text", "x" * 80, 0) for i in range(100)], "node string, prop string, value string, ord int")
    write_nodes(triples, str(tmp_path / "one"), header="# made here")
    lines = [x for p in sorted((tmp_path / "one").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines.count("# made here") == 1 and lines[0] == "# made here"
    write_nodes(triples, str(tmp_path / "many"), bytes_per_file=2000)
    files = list((tmp_path / "many").glob("shard=*/part-*"))
    assert len(files) >= 4 and all(p.stat().st_size <= 2000 + 200 for p in files)
    back = read_nodes(spark, str(tmp_path / "many" / "*"))
    assert back.select("node").distinct().count() == 100


def test_last_goes_by_the_order_of_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,first\n" + "".join(f"x{i},y\n" for i in range(2000)))
    (tmp_path / "b.csv").write_text("k,v\n1,second\n")
    paths = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    last = lambda p: load_keyed(spark, p, ["k"]).filter(F.col("k") == "1").first()["v"]
    assert last(paths) == "second" and last(paths[::-1]) == "first"


def test_a_null_key_keeps_its_lists(spark):
    rows = spark.createDataFrame([(None, "a,b", 1), (None, "b,c", 2), ("k", "d", 3)], "key string, items string, ord int")
    got = {r["key"]: r["items"] for r in merge_keyed(rows, ["key"], {"items": "list"}).collect()}
    assert got == {None: "a,b,c", "k": "d"}


def test_files_combined_by_position_and_by_name(spark, tmp_path):
    texts = {"a.csv": "x,y\n1,2\n3,4\n", "b.csv": "x,y\n5,6\n", "c.csv": "y,z\n7,8\n", "d.csv": "p\n9\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    paths = [str(tmp_path / n) for n in texts]
    got = grids.combine_files(spark, paths)
    assert got.columns == ["x", "y"] and sorted(map(tuple, got.collect()), key=repr) == [("1", "2"), ("3", "4"), ("5", "6"), ("7", "8"), ("9", None)]
    named = grids.combine_files(spark, paths, by_name=True)
    assert sorted((tuple(r[c] for c in "xyzp") for r in named.collect()), key=repr) == [
        ("1", "2", None, None), ("3", "4", None, None), ("5", "6", None, None), (None, "7", "8", None), (None, None, None, "9")]


def test_too_many_names_are_no_columns(spark):
    import pytest

    rows = spark.createDataFrame([(i, {f"p{i}": "v"}) for i in range(20)], "key long, props map<string,string>")
    assert len(keyed_table(rows).columns) == 21 and keyed_table(rows, names=["p3"]).filter("p3 = 'v'").count() == 1
    with pytest.raises(ValueError, match="long form"):
        keyed_table(rows, most=5)
