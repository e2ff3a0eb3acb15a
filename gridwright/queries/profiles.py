"""Column profiles and samples."""

from pyspark.sql import functions as F

from ..operators import profile as p, sample as s
from .registry import query


def _long(table, columns):
    return " UNION ALL ".join(f"SELECT '{c}' AS col, trim(CAST({c} AS VARCHAR)) AS v FROM {table}" for c in columns)


PART = ["p_name", "p_brand", "p_type"]
PROFILE = """SELECT col AS "column", count(*)::BIGINT AS "rows", count(DISTINCT v)::BIGINT AS n_distinct, 0.0::DOUBLE AS empty_ratio, round(avg(len(v)), 6) AS avg_len,
  round(count(CASE WHEN regexp_matches(v, '^[0-9.+-]') AND try_cast(v AS DOUBLE) IS NOT NULL THEN 1 END) / count(*), 6) AS numeric_share FROM u GROUP BY col"""


@query("column_profile", f"WITH u AS ({_long('part', PART)} UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT 'p_partkey', CAST(p_partkey AS VARCHAR) FROM part) {PROFILE}")
def column_profile(t):
    out = p.column_profile(t("part"), PART + ["p_size", "p_partkey"])
    return out.withColumns({c: F.round(c, 6) for c in ("empty_ratio", "avg_len", "numeric_share")})


WIDE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"]


@query("wide_table_profile", f"WITH u AS ({_long('lineitem', WIDE)}) {PROFILE}")
def wide_table_profile(t):
    out = p.column_profile(t("lineitem"), WIDE)
    return out.withColumns({c: F.round(c, 6) for c in ("empty_ratio", "avg_len", "numeric_share")})


@query("categorical_columns", """
SELECT 'l_returnflag' AS "column", count(DISTINCT l_returnflag)::BIGINT AS n_distinct, count(*)::BIGINT AS "rows" FROM lineitem UNION ALL
SELECT 'l_linestatus', count(DISTINCT l_linestatus), count(*) FROM lineitem UNION ALL SELECT 'l_linenumber', count(DISTINCT l_linenumber), count(*) FROM lineitem""")
def categorical_columns(t):
    return p.categorical_columns(p.column_profile(t("lineitem"), WIDE))


@query("redundant_columns", """SELECT 'c_custkey' AS column_a, 'c_name' AS column_b, count(DISTINCT c_custkey)::BIGINT AS n_distinct FROM customer UNION ALL
SELECT 'nation_no', 'nation', count(DISTINCT c_nationkey) FROM customer""")
def redundant_columns(t):
    c = t("customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("nation_no"), F.concat(F.lit("N"), F.col("c_nationkey")).alias("nation"), "c_mktsegment")
    return p.redundant_pairs(c)


@query("percentage_columns", """SELECT 'share' AS pct_column, 'c_acctbal' AS base_column, round(sum(abs(c_acctbal)) + 1, 0) AS total FROM customer""")
def percentage_columns(t):
    c = t("customer").select(F.abs("c_acctbal").alias("c_acctbal"), "c_nationkey")
    total = c.agg(F.sum("c_acctbal") + 1).first()[0]
    df = c.select("c_acctbal", "c_nationkey", (F.col("c_acctbal") / total * 100).alias("share"))
    return p.percentage_columns(df, ["c_acctbal", "share", "c_nationkey"]).withColumn("total", F.round("total", 0))


def _range(c):
    return f"""SELECT '{c}' AS "column", count(*)::BIGINT AS "rows", min({c}) AS min, list_sort(list({c}))[count(*) // 4 + 1] AS q1, list_sort(list({c}))[count(*) // 2 + 1] AS median,
 list_sort(list({c}))[3 * count(*) // 4 + 1] AS q3, max({c}) AS max FROM lineitem"""


@query("numeric_ranges", " UNION ALL ".join(_range(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def numeric_ranges(t):
    return p.numeric_ranges(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("column_labels", """
SELECT * FROM (VALUES ('c_custkey', 'numeric'), ('c_name', 'redundant'), ('c_nationkey', CASE WHEN (SELECT count(DISTINCT c_nationkey) / count(*) FROM customer) <= 0.01 THEN 'constant' ELSE 'numeric' END),
 ('c_acctbal', 'numeric'), ('c_mktsegment', CASE WHEN (SELECT count(DISTINCT c_mktsegment) / count(*) FROM customer) <= 0.01 THEN 'constant' ELSE 'categorical' END), ('c_acctbal_pct', 'derived')) v("column", label)""")
def column_labels(t):
    c = t("customer").withColumn("c_acctbal_pct", F.col("c_acctbal") / 7)
    return p.classify_columns(c).select("column", "label")


@query("derived_headers", """
WITH s AS (SELECT DISTINCT s_nationkey AS n FROM supplier), c AS (SELECT DISTINCT c_nationkey AS n FROM customer WHERE c_acctbal > 0)
SELECT 'EP_N' || n AS header FROM c WHERE n IN (SELECT n FROM s) UNION ALL SELECT 'N' || n || '_pct' FROM s WHERE n % 5 = 0 UNION ALL SELECT 'RPL_N' || n FROM c WHERE n % 7 = 0""")
def derived_headers(t):
    """Headers named after the nations (25 at most) that have suppliers or customers in credit."""
    s = [r[0] for r in t("supplier").select("s_nationkey").distinct().collect()]
    c = [r[0] for r in t("customer").filter("c_acctbal > 0").select("c_nationkey").distinct().collect()]
    names = [f"E_N{n}" for n in s] + [f"EP_N{n}" for n in c] + [f"N{n}_pct" for n in s if n % 5 == 0] + [f"RPL_N{n}" for n in c if n % 7 == 0]
    derived = p.derived_by_name(names)
    wide = t("customer").select(*[F.col("c_custkey").alias(n) for n in derived])
    return p.long_values(wide, derived).select(F.col("column").alias("header")).distinct()


@query("cell_kinds", """
SELECT 'o_orderdate' AS "column", 'DATE' AS label, count(*)::BIGINT AS n FROM orders UNION ALL SELECT 'o_totalprice', 'VALUE', count(*) FROM orders
UNION ALL SELECT 'o_orderstatus', 'TEXT', count(*) FROM orders UNION ALL SELECT 'o_orderpriority', label, n FROM (
  SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'LEVEL' WHEN o_orderpriority = '2-HIGH' THEN 'LEVEL' ELSE 'TEXT' END AS label, count(*)::BIGINT AS n FROM orders GROUP BY 1 ORDER BY n DESC, label LIMIT 1)""")
def cell_kinds(t):
    o = t("orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"), "o_orderstatus", "o_orderpriority")
    return p.column_kinds(p.annotate_cells(p.long_values(o), p.cell_kinds({"LEVEL": ["5-low", "2-HIGH"]})))


@query("map_skeleton", """SELECT 'o_orderdate' AS key, 'observationDate={Data}' AS entry UNION ALL SELECT 'o_totalprice', 'value={Number}'""")
def map_skeleton(t):
    o = t("orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"), "o_orderstatus")
    kinds = p.column_kinds(p.annotate_cells(p.long_values(o), p.cell_kinds()))
    e = F.get(F.map_entries("props"), F.lit(0))
    return p.map_skeleton(kinds).select("key", F.concat_ws("=", e["key"], e["value"]).alias("entry"))


@query("first_data_row", """SELECT o_custkey::VARCHAR AS file, min(o_orderkey) AS first_row FROM orders WHERE o_totalprice >= 100000 GROUP BY 1""")
def first_data_row(t):
    cells = t("orders").select(F.col("o_custkey").cast("string").alias("file"), F.col("o_orderkey").alias("row_no"),
                               F.when(F.col("o_totalprice") >= 100000, F.col("o_totalprice").cast("decimal(18,2)").cast("string")).otherwise(F.lit("low")).alias("value"))
    return p.first_value_row(p.annotate_cells(cells, p.cell_kinds()))


SAMPLE_COLUMNS = ["o_orderstatus", "o_orderpriority"]


@query("coverage_of_sample", """
SELECT 'o_orderstatus' AS "column", count(DISTINCT o_orderstatus)::BIGINT AS total_values, count(DISTINCT o_orderstatus)::BIGINT AS covered, 0::BIGINT AS uncovered FROM orders UNION ALL
SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), count(DISTINCT o_orderpriority), 0 FROM orders""")
def coverage_of_sample(t):
    o = t("orders")
    return s.coverage_report(o, s.coverage_sample(o, ["o_orderkey"], SAMPLE_COLUMNS, ["o_totalprice"], p.numeric_ranges(o, ["o_totalprice"])), SAMPLE_COLUMNS)


@query("coverage_sample", """
WITH o AS (SELECT *, md5('42|' || o_orderkey) AS h FROM orders),
r AS (SELECT v[1] AS lo, v[len(v) // 4 + 1] AS q1, v[len(v) // 2 + 1] AS q2, v[len(v) * 3 // 4 + 1] AS q3, v[len(v)] AS hi FROM (SELECT list_sort(list(o_totalprice)) AS v FROM orders)),
g AS (SELECT o_orderkey, h, 's' AS c, o_orderstatus AS v FROM o UNION ALL SELECT o_orderkey, h, 'p', o_orderpriority FROM o UNION ALL
  SELECT o_orderkey, h, 't', CASE WHEN abs(o_totalprice - lo) < 0.001 THEN 'min' WHEN abs(o_totalprice - hi) < 0.001 THEN 'max' WHEN o_totalprice <= q1 THEN 'q1'
    WHEN o_totalprice <= q2 THEN 'q2' WHEN o_totalprice <= q3 THEN 'q3' ELSE 'q4' END FROM o, r),
c AS (SELECT DISTINCT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY c, v ORDER BY h, o_orderkey) AS i FROM g) WHERE i = 1),
f AS (SELECT o_orderkey FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM c) ORDER BY h LIMIT (SELECT greatest(80 - count(*), 0) FROM c))
SELECT * FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM c UNION ALL SELECT o_orderkey FROM f)""")
def coverage_sample(t):
    o = t("orders")
    return s.coverage_sample(o, ["o_orderkey"], SAMPLE_COLUMNS, ["o_totalprice"], p.numeric_ranges(o, ["o_totalprice"]))


@query("capped_rows", """
WITH u AS (SELECT o_orderkey, 'p' AS c, o_orderpriority AS v FROM orders UNION ALL SELECT o_orderkey, 'k', CAST(o_custkey AS VARCHAR) FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY c, v ORDER BY o_orderkey) AS i FROM u),
f AS (SELECT c, v, row_number() OVER (PARTITION BY c ORDER BY min(o_orderkey), v) AS r FROM u GROUP BY c, v)
SELECT DISTINCT o_orderkey FROM k JOIN f USING (c, v) WHERE i <= 3 AND r <= 40""")
def capped_rows(t):
    return s.capped_rows(t("orders"), ["o_orderkey"], ["o_orderpriority", "o_custkey"], 3, 40, order=F.col("o_orderkey")).select("o_orderkey")


@query("one_per_pattern", "SELECT o_orderstatus, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2")
def one_per_pattern(t):
    return s.one_per_pattern(t("orders").select("o_orderkey", *SAMPLE_COLUMNS), SAMPLE_COLUMNS, ["o_orderkey"]).select(*SAMPLE_COLUMNS, "o_orderkey")


@query("hash_sample", """
SELECT * FROM lineitem WHERE ('0x' || substr(md5('42|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey), 1, 8))::BIGINT < 42949672""")
def hash_sample(t):
    return s.sample_fraction(t("lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], 0.01)


@query("limit_total_rows", """
SELECT doc_id FROM documents WHERE NOT regexp_matches(lower(source), '1') UNION ALL (SELECT doc_id FROM documents WHERE regexp_matches(lower(source), '1') ORDER BY doc_id LIMIT 2)""")
def limit_total_rows(t):
    return s.limit_total_rows(t("documents").select("doc_id", "source"), ["source"], ["doc_id"], 2, ["1"]).select("doc_id")


@query("diverse_nodes", """
WITH tr AS (SELECT p_partkey AS node, 'brand' AS prop, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part),
v AS (SELECT *, row_number() OVER (PARTITION BY prop, value ORDER BY node) AS a FROM tr),
q AS (SELECT *, row_number() OVER (PARTITION BY prop ORDER BY node) AS b FROM v WHERE a <= 2)
SELECT node FROM q WHERE b <= 10 GROUP BY node HAVING count(*) = 2 ORDER BY node LIMIT 100""")
def diverse_nodes(t):
    tr = t("part").select(F.col("p_partkey").alias("node"), F.explode(F.array(F.struct(F.lit("brand").alias("prop"), F.col("p_brand").alias("value")),
                                                                              F.struct(F.lit("type").alias("prop"), F.col("p_type").alias("value")))).alias("x")).select("node", "x.*")
    return s.diverse_nodes(tr)
