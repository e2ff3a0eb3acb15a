"""User hooks, counters and orders, on the given tables."""

import pandas as pd
from pyspark.sql import functions as F

from ..operators import grid as g, nodes as n, observe, places as pl, profile as p, resolve
from ..operators.scale import with_position
from ..plans.observations import GridOptions, grid_to_observations
from ..sources.grids import grid_of
from ..sources.pvmaps import pv_map_from_dict
from .grids import DOC_GRID_SQL, document_grid
from .registry import query


@query("hook_grid_rows", DOC_GRID_SQL + """
SELECT file, count(*)::BIGINT AS cells, min(c || c) AS first_cell FROM (SELECT file, unnest(cells) AS c FROM grid WHERE len(cells) % 3 <> 1 AND NOT starts_with(trim(cells[1]), 'T')) GROUP BY file""")
def hook_grid_rows(t):
    """A row hook is a function of grids: this one drops some rows and changes the cells of the others."""
    def hook(grid):
        kept = grid.filter((F.size("cells") % 3 != 1) & ~F.trim(F.get("cells", F.lit(0))).startswith("T"))
        return kept.withColumn("cells", F.transform("cells", lambda c: F.concat(c, c)))

    cells = document_grid(t).transform(hook).select("file", F.explode("cells").alias("c"))
    return cells.groupBy("file").agg(F.count(F.lit(1)).alias("cells"), F.min("c").alias("first_cell"))


@query("hook_observations", """
SELECT y AS "observationDate", 'dcid:customer/' || c_custkey AS "observationAbout", c_acctbal / 2 AS value FROM customer, (SELECT unnest(['2021', '2022']) AS y) WHERE c_acctbal >= 0""")
def hook_observations(t):
    """A hook of the grid plan that makes none or two of an observation, before validation."""
    maps = {"GLOBAL": {"key": {"observationAbout": "dcid:customer/{Number}", "observationDate": "2024"}, "balance": {"value": "@Number", "populationType": "dcs:Account"}}}
    grid = grid_of(t("customer").select(F.col("c_custkey").alias("Key"), F.col("c_acctbal").cast("decimal(18,2)").alias("Balance")), ["Key", "Balance"], ["Key"])

    def hook(obs):
        both = obs.filter("value >= 0").withColumn("observationDate", F.explode(F.array(F.lit("2021"), F.lit("2022"))))
        return both.withColumn("value", F.col("value") / 2)

    r = grid_to_observations(grid, pv_map_from_dict(grid.sparkSession, maps), GridOptions(header_rows=1, hook=hook))
    return r.observations.select("observationDate", "observationAbout", "value")


@query("hook_cell_kinds", """
WITH c AS (SELECT 'p_name' AS "column", p_name AS v FROM part UNION ALL SELECT 'p_brand', p_brand FROM part UNION ALL SELECT 'p_type', p_type FROM part UNION ALL SELECT 'p_size', p_size::VARCHAR FROM part)
SELECT "column", CASE WHEN regexp_full_match(v, '(19|20)[0-9]{2}') THEN 'DATE' WHEN regexp_full_match(v, '[0-9]+') THEN 'VALUE' WHEN regexp_full_match(v, 'Brand#[0-9]+') THEN 'BRAND'
  WHEN lower(v) IN ('promo', 'economy') THEN 'LINE' ELSE 'TEXT' END AS label, count(*)::BIGINT AS n FROM c GROUP BY ALL""")
def hook_cell_kinds(t):
    """Kinds of cells are a dict of predicates, to which a user adds patterns and word lists."""
    kinds = p.cell_kinds({"LINE": ["Promo", "Economy"]}, {**p.CELL_KINDS, "BRAND": "^Brand#[0-9]+$"})
    cells = p.long_values(t("part"), ["p_name", "p_brand", "p_type", "p_size"])
    return p.annotate_cells(cells, kinds).groupBy("column", "label").agg(F.count(F.lit(1)).alias("n"))


@query("hook_rule_functions", "SELECT p_partkey, p_partkey || '-' || chr((65 + (p_partkey * 7 + p_size) % 26)::INT) AS code FROM part")
def hook_rule_functions(t):
    """Functions registered with the session are called by name in expression rules."""
    @F.pandas_udf("string")
    def check_letter(key: pd.Series, size: pd.Series) -> pd.Series:
        return ((key.astype("int64") * 7 + size.astype("int64")) % 26 + 65).map(chr)

    part = t("part")
    part.sparkSession.udf.register("check_letter", check_letter)
    rule = "code=concat(Key, '-', check_letter(Key, Size))"
    wide = part.select("p_partkey", F.col("p_partkey").cast("string").alias("Key"), F.col("p_size").cast("string").alias("Size"), F.lit(rule).alias("#Eval"))
    return resolve.apply_expressions(wide, [rule]).select("p_partkey", "code")


@query("hook_area_names", """
WITH p AS (SELECT c_custkey, (c_custkey * 37 % 3600) / 10.0 - 180 + 0.03 AS lon, (c_custkey * 91 % 1800) / 10.0 - 90 + 0.03 AS lat FROM customer),
a AS (SELECT n_name AS area, n_nationkey * 14 - 180 AS x0, n_nationkey * 14 - 155 AS x1, n_regionkey * 30 - 90 AS y0, n_regionkey * 30 - 50 AS y1 FROM nation)
SELECT c_custkey, min(area) AS area FROM p JOIN a ON lon > x0 AND lon < x1 AND lat > y0 AND lat < y1 WHERE contains(area, 'A') GROUP BY c_custkey""")
def hook_area_names(t):
    """A callback on the areas found around each point: here the least name with an A."""
    pts = t("customer").select("c_custkey", ((F.col("c_custkey") * 37 % 3600) / 10.0 - 180 + 0.03).alias("lon"), ((F.col("c_custkey") * 91 % 1800) / 10.0 - 90 + 0.03).alias("lat"))
    x, y = F.col("n_nationkey") * 14 - 180, F.col("n_regionkey") * 30 - 90
    corner = lambda dx, dy: F.struct((x + dx).cast("double").alias("lon"), (y + dy).cast("double").alias("lat"))
    areas = t("nation").select(F.col("n_name").alias("area"), F.array(corner(0, 0), corner(25, 0), corner(25, 40), corner(0, 40)).alias("ring"))
    keep = lambda found: found.filter(F.col("area").contains("A")).groupBy("c_custkey").agg(F.min("area").alias("area"))
    return pl.containing_areas(pts, areas, keep=keep)


@query("sorted_node_order", """
WITH tr AS (SELECT 'part/' || p_partkey AS node, unnest(['size', 'brand', 'name']) AS prop, unnest([p_size::VARCHAR, p_brand, p_name]) AS value FROM part)
SELECT node, prop, value, (row_number() OVER (ORDER BY node, prop) - 1)::BIGINT AS place FROM tr""")
def sorted_node_order(t):
    """Nodes in the order in which they would be written, numbered as they come."""
    pairs = F.array(*[F.struct(F.lit(k).alias("prop"), F.col(c).cast("string").alias("value")) for k, c in (("size", "p_size"), ("brand", "p_brand"), ("name", "p_name"))])
    triples = t("part").select(F.concat(F.lit("part/"), "p_partkey").alias("node"), F.posexplode(pairs).alias("ord", "p")).select("node", "p.prop", "p.value", "ord")
    placed = with_position(n.sorted_nodes(triples).withColumn("_at", F.monotonically_increasing_id()), ["_at"], "place")
    return placed.select("node", "prop", "value", "place")


@query("metadata_columns", """
WITH c AS (SELECT 'url' AS "column", url AS v FROM pages UNION ALL SELECT 'html', html FROM pages UNION ALL SELECT 'page_id', page_id::VARCHAR FROM pages UNION ALL SELECT 'head', substr(html, 1, 80) FROM pages)
SELECT "column", count(*)::BIGINT AS n_rows, count(DISTINCT nullif(trim(v), ''))::BIGINT AS n_distinct FROM c GROUP BY "column"
HAVING avg(len(nullif(trim(v), ''))) >= 50 AND count(DISTINCT nullif(trim(v), '')) / count(*) > 0.9""")
def metadata_columns(t):
    """Columns of long texts that hardly repeat."""
    pages = t("pages").select("url", "html", F.col("page_id").cast("string").alias("page_id"), F.substring("html", 1, 80).alias("head"))
    return p.column_profile(pages).filter(p.is_metadata()).select("column", F.col("rows").alias("n_rows"), "n_distinct")


@query("quality_counters_with_extremes", """
WITH s AS (SELECT o_orderstatus AS stage, CASE WHEN o_totalprice < 1000 THEN 'cheap' WHEN o_orderpriority = '1-URGENT' THEN 'urgent' ELSE 'plain' END AS reason, o_totalprice AS price, o_custkey AS customer FROM orders)
SELECT stage, 'orders-' || reason AS counter, count(*)::DOUBLE AS value FROM s GROUP BY ALL UNION ALL SELECT stage, 'orders-min-price', min(price) FROM s GROUP BY stage UNION ALL SELECT stage, 'orders-max-price', max(price) FROM s GROUP BY stage
UNION ALL SELECT stage, 'orders-min-customer', min(customer) FROM s GROUP BY stage UNION ALL SELECT stage, 'orders-max-customer', max(customer) FROM s GROUP BY stage""")
def quality_counters_with_extremes(t):
    reason = F.when(F.col("o_totalprice") < 1000, "cheap").when(F.col("o_orderpriority") == "1-URGENT", "urgent").otherwise("plain")
    staged = t("orders").select(F.col("o_orderstatus").alias("stage"), reason.alias("reason"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("customer"))
    return observe.all_counters(staged, ["price", "customer"], prefix="orders-")
