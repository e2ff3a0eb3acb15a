"""Files written from the tables and read back."""

import os
import uuid

from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import grids as sg, nodefiles as nf, pvmaps as pv, tables as tb
from .nodes import TRIPLES, part_nodes
from .registry import query


def scratch(spark, name):
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


@query("grid_file_scan", """SELECT count(*)::BIGINT AS n_rows, count(*)::BIGINT AS n_numbered, sum(c_custkey)::BIGINT AS key_sum, 4::BIGINT AS width FROM customer""")
def grid_file_scan(t):
    c = t("customer")
    path = scratch(c.sparkSession, "grid")
    c.select("c_custkey", F.concat(F.lit("a, "), "c_name").alias("n"), "c_mktsegment", "c_acctbal").repartition(4).write.csv(path)
    g = sg.read_grid(c.sparkSession, path + "/*.csv")
    ends = g.groupBy("file").agg(F.max("row_no").alias("m"), F.count(F.lit(1)).alias("n"), F.countDistinct("row_no").alias("d"), F.sum(F.get("cells", F.lit(0)).cast("long")).alias("k"), F.max(F.size("cells")).alias("w"))
    ok = F.when((F.col("m") == F.col("n")) & (F.col("d") == F.col("n")), F.col("n"))
    return ends.agg(F.sum("n").alias("n_rows"), F.sum(ok).alias("n_numbered"), F.sum("k").alias("key_sum"), F.max("w").cast("long").alias("width"))


@query("grid_file_quoted", """SELECT doc_id, md5(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS digest FROM documents""")
def grid_file_quoted(t):
    """Whole texts as quoted cells, line ends and quotes inside, written as text and read back by split."""
    d = t("documents")
    path = scratch(d.sparkSession, "quoted")
    d.select(F.concat(F.col("doc_id"), F.lit(',"'), F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')).alias("value")).write.text(path)
    g = sg.read_grid(d.sparkSession, path + "/*.txt", quoted_newlines=True)
    return g.select(F.get("cells", F.lit(0)).cast("long").alias("doc_id"), F.md5(F.get("cells", F.lit(1))).alias("digest"))


@query("keyed_csv_load", "SELECT c_nationkey::BIGINT AS c_nationkey, max(c_acctbal) AS c_acctbal, array_to_string(list_sort(list_distinct(list(c_mktsegment))), ',') AS c_mktsegment FROM customer GROUP BY 1")
def keyed_csv_load(t):
    c = t("customer")
    path = scratch(c.sparkSession, "keyed")
    c.select("c_nationkey", "c_acctbal", "c_mktsegment").write.csv(path, header=True)
    return tb.load_keyed(c.sparkSession, path, ["c_nationkey"], {"c_acctbal": "max", "c_mktsegment": "list"}, schema="c_nationkey long, c_acctbal double, c_mktsegment string")


@query("keyed_table_columns", "SELECT p_partkey, p_brand AS brand, CASE WHEN p_size > 20 THEN p_type END AS kind FROM part")
def keyed_table_columns(t):
    m = F.when(F.col("p_size") > 20, F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("kind"), F.col("p_type"))).otherwise(F.create_map(F.lit("brand"), F.col("p_brand")))
    return tb.keyed_table(t("part").select("p_partkey", m.alias("props")), "props", "p_partkey")


@query("combine_by_position", "SELECT c_custkey::VARCHAR AS key, c_name AS name FROM customer UNION ALL SELECT s_suppkey::VARCHAR, s_name FROM supplier")
def combine_by_position(t):
    spark = t("customer").sparkSession
    a, b = scratch(spark, "a"), scratch(spark, "b")
    t("customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")).write.csv(a, header=True)
    t("supplier").select("s_suppkey", "s_name").write.csv(b, header=True)
    return sg.combine_files(spark, [a, b])


@query("merge_parameters", "SELECT c_nationkey::VARCHAR AS parameter, arg_min(c_mktsegment, c_custkey) AS value FROM customer GROUP BY 1")
def merge_parameters(t):
    first = t("customer").groupBy(F.col("c_nationkey").cast("string").alias("parameter")).agg(F.min_by("c_mktsegment", "c_custkey").alias("value"))
    later = t("supplier").select(F.col("s_nationkey").cast("string").alias("parameter"), F.col("s_name").alias("value"))
    return sg.merge_parameters([first, later])[0]


@query("json_flatten", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS "p.k", event_type AS "e.type", event_type AS "e.list.0", CAST(user_id AS VARCHAR) AS "e.list.1" FROM events""")
def json_flatten(t):
    ev = t("events").select("event_id", F.from_json("props", "k long").alias("p"), F.struct(F.col("event_type").alias("type"), F.array("event_type", F.col("user_id").cast("string")).alias("list")).alias("e"))
    return tb.flatten_records(ev)


@query("json_entries", "SELECT event_id, 'k' AS name, json_extract_string(props, '$.k') AS value FROM events")
def json_entries(t):
    return tb.json_column_pairs(t("events"), ["event_id"], "props")


@query("xml_records", "SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey FROM supplier")
def xml_records(t):
    s = t("supplier").select("s_suppkey", "s_name", F.col("s_nationkey").cast("long").alias("s_nationkey"))
    path = scratch(s.sparkSession, "xml")
    s.write.format("xml").option("rowTag", "supplier").option("rootTag", "suppliers").save(path)
    return tb.read_xml(s.sparkSession, path, "supplier", "s_suppkey long, s_name string, s_nationkey long")


@query("node_file_round_trip", TRIPLES + "SELECT DISTINCT node, prop, value FROM tr")
def node_file_round_trip(t):
    tr = part_nodes(t).groupBy("node", "prop", "value").agg(F.min("ord").alias("ord"))
    path = scratch(tr.sparkSession, "nodes")
    nf.write_nodes(tr, path, header="# made from parts", nodes_per_file=20)
    return nf.read_nodes(tr.sparkSession, path).filter(F.col("prop") != "#").select("node", "prop", "value").distinct()


@query("csv_nodes", "SELECT CAST(s_suppkey AS VARCHAR) AS node, unnest(['s_name', 's_nationkey']) AS prop, unnest([s_name, CAST(s_nationkey AS VARCHAR)]) AS value FROM supplier")
def csv_nodes(t):
    s = t("supplier")
    path = scratch(s.sparkSession, "csvnodes")
    s.select(F.concat(F.lit("dcid:"), "s_suppkey").alias("dcid"), "s_name", "s_nationkey").write.csv(path, header=True)
    return nf.read_csv_nodes(s.sparkSession, path).select("node", "prop", "value")


@query("pv_map_round_trip", "SELECT DISTINCT p_name AS key, 'brand' AS prop, min(p_brand) OVER (PARTITION BY p_name) AS value FROM part UNION ALL SELECT DISTINCT p_name, 'kind', max(p_type) OVER (PARTITION BY p_name) FROM part")
def pv_map_round_trip(t):
    m = t("part").groupBy(F.col("p_name").alias("key")).agg(F.min("p_brand").alias("b"), F.max("p_type").alias("k")).select("key", F.create_map(F.lit("brand"), F.col("b"), F.lit("kind"), F.col("k")).alias("props"))
    path = scratch(m.sparkSession, "pvmap")
    pv.write_pv_map(m, path)
    return pv.compare_form(pv.load_pv_map(m.sparkSession, path))


@query("template_fill", """SELECT p_partkey, 'Node: dcid:part' || p_partkey || CASE WHEN p_size > 25 THEN chr(10) || 'size: ' || p_size || ' of ' || p_type ELSE '' END || chr(10) || 'brand: ' || p_brand AS text FROM part""")
def template_fill(t):
    rows = t("part").select("p_partkey", "p_brand", "p_type", F.when(F.col("p_size") > 25, F.col("p_size")).alias("size"))
    return nf.fill_template(rows, ["Node: dcid:part{p_partkey}", "size: {size} of {p_type}", "brand: {p_brand}"], ["p_partkey"]).select("p_partkey", "text")


@query("sharded_write", "SELECT substr(c_mktsegment, 1, 2) AS shard, count(*)::BIGINT AS n FROM customer GROUP BY 1")
def sharded_write(t):
    c = t("customer")
    path = scratch(c.sparkSession, "shards")
    tb.write_shards(c, path, "c_mktsegment", 2)
    back = c.sparkSession.read.option("header", True).schema("c_custkey string, shard string").csv(path)
    return back.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


@query("observation_sink", "SELECT l_returnflag, count(*)::BIGINT AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1")
def observation_sink(t):
    obs = t("lineitem").select("l_returnflag", F.col("l_quantity").alias("value"), F.lit("dcs:Item").alias("unit"), F.date_format("l_shipdate", "yyyy-MM").alias("observationDate"))
    path = scratch(obs.sparkSession, "obs")
    tb.write_observations(obs, path, ["observationDate", "l_returnflag", "value", "unit"])
    back = obs.sparkSession.read.csv(path, header=True, schema="observationDate string, l_returnflag string, value double")
    return back.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("q"))
