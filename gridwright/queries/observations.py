"""From tables and grids to observations."""

from pyspark.sql import functions as F

from ..functions import ids
from ..functions.text import add_namespace
from ..operators import observe, series
from ..plans.observations import GridOptions, grid_to_observations
from ..sources.grids import grid_of
from ..sources.pvmaps import pv_map_from_dict
from .registry import query

MEASURES = {"l_quantity": ("quantity", "Unit"), "l_extendedprice": ("extendedPrice", "USDollar"), "l_discount": ("discount", "USDollar"), "l_tax": ("tax", "USDollar")}


@query("wide_to_long", """
WITH u AS (
  SELECT l_shipdate, l_returnflag, l_linestatus, 'Quantity' AS m, 'Unit' AS unit, l_quantity AS v FROM lineitem UNION ALL
  SELECT l_shipdate, l_returnflag, l_linestatus, 'ExtendedPrice', 'USDollar', l_extendedprice FROM lineitem UNION ALL
  SELECT l_shipdate, l_returnflag, l_linestatus, 'Discount', 'USDollar', l_discount FROM lineitem UNION ALL
  SELECT l_shipdate, l_returnflag, l_linestatus, 'Tax', 'USDollar', l_tax FROM lineitem)
SELECT strftime(l_shipdate, '%Y-%m') AS "observationDate", 'dcid:Warehouse' AS "observationAbout",
       'dcid:' || m || '_LineItem_' || l_linestatus || '_' || l_returnflag AS "variableMeasured", unit, round(sum(v), 2) AS value, count(*)::BIGINT AS n_rows
FROM u GROUP BY ALL""")
def wide_to_long(t):
    """Sums are taken per month and flag before the columns turn into rows, so the rows that multiply are few."""
    spark = t("lineitem").sparkSession
    maps = {"GLOBAL": {h: {"measuredProperty": f"dcs:{p}", "unit": u, "populationType": "dcs:LineItem"} for h, (p, u) in MEASURES.items()}}
    table = pv_map_from_dict(spark, maps)
    grouped = t("lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("observationDate"), "l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.sum(m).alias(m) for m in MEASURES])
    cells = grouped.unpivot(["observationDate", "l_returnflag", "l_linestatus", "n_rows"], list(MEASURES), "key", "value")
    mapped = cells.join(F.broadcast(table.select("key", "props")), "key")
    p = F.col("props")
    variable = ids.variable_id({"measuredProperty": p["measuredProperty"], "populationType": p["populationType"], "statType": F.lit("dcs:measuredValue"),
                                "linestatus": F.col("l_linestatus"), "returnflag": F.col("l_returnflag")})
    return mapped.select("observationDate", F.lit("dcid:Warehouse").alias("observationAbout"), add_namespace(variable).alias("variableMeasured"),
                         p["unit"].alias("unit"), F.round("value", 2).alias("value"), "n_rows")


CUSTOMER_MAP = {"GLOBAL": {
    "c_custkey": {"observationAbout": "dcid:customer/{Number}", "observationDate": "2024"},
    "c_nationkey": {"nation": "dcs:Nation{Number}"},
    "c_acctbal": {"value": "@Number", "populationType": "dcs:Account", "measuredProperty": "dcs:balance"},
    "building": {"segment": "dcs:Building"}, "MACHINERY": {"segment": "dcs:Machinery"}}}


@query("grid_with_fixed_headers", """
SELECT 'dcid:customer/' || c_custkey AS "observationAbout", '2024' AS "observationDate",
  'dcid:Balance_Account_Nation' || c_nationkey || CASE c_mktsegment WHEN 'BUILDING' THEN '_Building' WHEN 'MACHINERY' THEN '_Machinery' ELSE '' END AS "variableMeasured", c_acctbal AS value
FROM customer""")
def grid_with_fixed_headers(t):
    grid = grid_of(t("customer"), ["c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"], ["c_custkey"])
    r = grid_to_observations(grid, pv_map_from_dict(grid.sparkSession, CUSTOMER_MAP), GridOptions(header_rows=1))
    return r.observations.select("observationAbout", "observationDate", "variableMeasured", "value")


SECTION_MAP = {"GLOBAL": {
    "order key": {"observationAbout": "dcid:order/{Number}"}, "ordered": {"#Regex": "(?P<Year>[0-9]{4})-(?P<Month>[0-9]{2})", "observationDate": "{Year}-{Month}"},
    "price": {"value": "@Number", "populationType": "dcs:Order", "measuredProperty": "dcs:price"},
    "1-URGENT": {"priority": "dcs:Urgent"}, "2-HIGH": {"priority": "dcs:High"}, "3-MEDIUM": {"priority": "dcs:Medium"}, "4-NOT": {"priority": "dcs:None"}, "5-LOW": {"priority": "dcs:Low"}}}


@query("grid_with_sections", """
SELECT 'dcid:order/' || o_orderkey AS "observationAbout", strftime(o_orderdate, '%Y-%m') AS "observationDate",
  'dcid:Price_Order_' || CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgent' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium' WHEN '5-LOW' THEN 'Low' ELSE 'None' END AS "variableMeasured",
  o_totalprice AS value FROM orders""")
def grid_with_sections(t):
    """One sheet per order status, a section row before each priority, header rows found by content."""
    from ..operators.scale import with_position

    o = t("orders")
    body = o.select("o_orderstatus", "o_orderpriority", "o_orderkey", F.array(
        F.lit("row"), F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("cells"))
    sections = o.select("o_orderstatus", "o_orderpriority").distinct().select(
        "o_orderstatus", "o_orderpriority", F.lit(-1).cast("long").alias("o_orderkey"), F.array(F.concat(F.lit("All of "), "o_orderpriority"), *[F.lit("")] * 3).alias("cells"))
    head = o.select("o_orderstatus").distinct().select(
        "o_orderstatus", F.lit("").alias("o_orderpriority"), F.lit(-2).cast("long").alias("o_orderkey"), F.array(*[F.lit(x) for x in ("what", "Order Key", "Ordered", "Price")]).alias("cells"))
    grid = with_position(body.unionByName(sections).unionByName(head), ["o_orderstatus", "o_orderpriority", "o_orderkey"], "pos").select(
        F.col("o_orderstatus").alias("file"), (F.col("pos") + 1).alias("row_no"), "cells")
    r = grid_to_observations(grid, pv_map_from_dict(o.sparkSession, SECTION_MAP), GridOptions())
    return r.observations.select("observationAbout", "observationDate", "variableMeasured", "value")


IMPORT_MAP = {"GLOBAL": {
    "nation": {"observationAbout": "dcid:nation/{Number}", "observationDate": "2024"}, "balance": {"value": "@Number", "populationType": "dcs:Account", "measuredProperty": "dcs:balance"},
    **{f"{s}.csv": {"segment": f"dcs:{s.title()}", **({"#Aggregate": how} if how else {})}
       for s, how in (("BUILDING", "sum"), ("MACHINERY", "mean"), ("AUTOMOBILE", "list"), ("FURNITURE", "max"), ("HOUSEHOLD", ""))}}}


@query("grid_import_full", """
WITH c AS (SELECT c_mktsegment AS s, 'dcid:nation/' || c_nationkey AS about, upper(c_mktsegment[1]) || lower(substr(c_mktsegment, 2)) AS name, c_acctbal AS v FROM customer),
g AS (SELECT s, about, name, count(*) AS n, sum(v) AS total, avg(v) AS mean, max(v) AS most, min(v) AS least FROM c GROUP BY ALL),
o AS (SELECT about, name, CASE s WHEN 'BUILDING' THEN total WHEN 'MACHINERY' THEN mean WHEN 'FURNITURE' THEN most ELSE least END AS v,
        CASE WHEN n > 1 AND s <> 'HOUSEHOLD' THEN 'dcs:Aggregate' END AS method, CASE WHEN n > 1 AND s = 'MACHINERY' THEN 'dcs:meanValue' END AS stat FROM g WHERE s <> 'AUTOMOBILE' AND (s <> 'HOUSEHOLD' OR least = most)
      UNION ALL SELECT c.about, c.name, c.v, CASE WHEN n > 1 THEN 'dcs:Aggregate' END, NULL FROM c JOIN g USING (s, about) WHERE s = 'AUTOMOBILE')
SELECT 'observation' AS kind, about, CASE name WHEN 'Building' THEN 'dcid:BuildingBalance' ELSE 'dcid:Balance_Account_' || name END AS what, round(v, 2) AS value, method, stat AS stat_type FROM o
UNION ALL SELECT 'reject', 'duplicates', 'different values', sum(n)::DOUBLE, NULL, NULL FROM g WHERE s = 'HOUSEHOLD' AND least <> most HAVING count(*) > 0
UNION ALL SELECT 'variable', NULL, CASE name WHEN 'Building' THEN 'BuildingBalance' ELSE 'Balance_Account_' || name END, NULL, NULL, NULL FROM (SELECT DISTINCT name FROM o)""")
def grid_import_full(t):
    """A sheet for each market segment, whose name says how repeats are combined: sums, means, lists, maxima, or not at all."""
    c = t("customer")
    grid = grid_of(c.select("c_custkey", F.concat("c_mktsegment", F.lit(".csv")).alias("sheet"), F.lit("row").alias("what"), F.col("c_nationkey").alias("Nation"),
                            F.col("c_acctbal").cast("decimal(18,2)").alias("Balance")), ["what", "Nation", "Balance"], ["c_custkey"], "sheet")
    known = c.sparkSession.createDataFrame([("BuildingBalance", {"typeOf": "dcs:StatisticalVariable", "statType": "dcs:measuredValue", "measuredProperty": "dcs:balance",
                                                                 "populationType": "dcs:Account", "segment": "dcs:Building"})], "node string, props map<string,string>")
    r = grid_to_observations(grid, pv_map_from_dict(c.sparkSession, IMPORT_MAP), GridOptions(), known_variables=known)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    obs = r.observations.select(F.lit("observation").alias("kind"), F.col("observationAbout").alias("about"), F.col("variableMeasured").alias("what"), F.round("value", 2).alias("value"),
                                F.col("measurementMethod").alias("method"), F.col("statType").alias("stat_type"))
    lost = r.counters().select(F.lit("reject"), F.col("stage"), F.col("reason"), F.col("n").cast("double"), none("string", "method"), none("string", "stat_type"))
    return obs.union(lost).union(r.variables.select(F.lit("variable"), none("string", "about"), F.col("dcid"), none("double", "value"), none("string", "method"), none("string", "stat_type")))


PLACE_MAP = {"GLOBAL": {"place": {"observationAbout": "{Data}", "observationDate": "2024"}, "key": {"customer": "dcs:C{Number}"},
                        "balance": {"value": "@Number", "populationType": "dcs:Account"}}}


@query("grid_import_places", """
SELECT 'dcid:country/' || n_name AS "observationAbout", 'dcid:Count_Account_C' || c_custkey AS "variableMeasured", c_acctbal AS value FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 5 <> 4""")
def grid_import_places(t):
    """Names resolved by a table, and those it lacks by likeness to a gazetteer's full names; unknown ones are left out."""
    from .matching import gazetteer

    n = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    turn = F.col("c_custkey") % 5
    loose = F.lower(F.concat_ws("   ", "n_name", "r_name"))
    name = F.when(turn < 2, F.concat(F.lit("Land of "), "n_name")).when(turn < 4, loose).otherwise("no such place at all")
    c = t("customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("Key"), name.alias("Place"), F.col("c_acctbal").cast("decimal(18,2)").alias("Balance"))
    known = n.select(F.concat(F.lit("Land of "), "n_name").alias("name"), F.concat(F.lit("country/"), "n_name").alias("dcid"))
    grid = grid_of(c, ["Place", "Key", "Balance"], ["Key"])
    r = grid_to_observations(grid, pv_map_from_dict(grid.sparkSession, PLACE_MAP), GridOptions(header_rows=1), places=known, gazetteer=gazetteer(t))
    return r.observations.select("observationAbout", "variableMeasured", "value")


KEY = ["l_partkey", "l_returnflag"]


def line_obs(t, key=KEY):
    return t("lineitem").select(F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice").alias("ord"), *key, F.col("l_quantity").alias("value"),
                                F.when(F.col("l_linestatus") == "O", F.lit("dcs:Survey")).otherwise(F.lit("")).alias("measurementMethod"))


@query("dedupe_observations", """
SELECT l_partkey, l_returnflag, l_linestatus, l_suppkey, min(l_quantity) AS value, count(*)::BIGINT AS n_rows FROM lineitem GROUP BY ALL HAVING min(l_quantity) = max(l_quantity)""")
def dedupe_observations(t):
    key = ["l_partkey", "l_returnflag", "l_linestatus", "l_suppkey"]
    obs = t("lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("ord"), *key, F.col("l_quantity").alias("value"))
    good, _ = observe.dedupe(obs, key)
    return good.select(*key, "value", "n_rows")


@query("conflicting_observations", """
SELECT l_partkey, l_returnflag, l_linestatus, l_suppkey, count(*)::BIGINT AS n_rows, min(l_quantity) AS min_value, max(l_quantity) AS max_value FROM lineitem GROUP BY ALL HAVING min(l_quantity) <> max(l_quantity)""")
def conflicting_observations(t):
    key = ["l_partkey", "l_returnflag", "l_linestatus", "l_suppkey"]
    obs = t("lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("ord"), *key, F.col("l_quantity").alias("value"))
    return observe.dedupe(obs, key)[1].select(*key, "n_rows", "min_value", "max_value")


@query("drop_conflicting_variables", """
SELECT DISTINCT l_partkey::VARCHAR AS dcid FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem GROUP BY l_partkey, l_orderkey HAVING min(l_quantity) <> max(l_quantity))""")
def drop_conflicting_variables(t):
    obs = t("lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("ord"), F.col("l_partkey").cast("string").alias("variableMeasured"), "l_orderkey", F.col("l_quantity").alias("value"))
    conflicts = observe.dedupe(obs, ["variableMeasured", "l_orderkey"])[1]
    return observe.drop_flagged(obs.select(F.col("variableMeasured").alias("dcid")).distinct(), conflicts)


for _how, _sql in {"sum": "sum(l_quantity)", "min": "min(l_quantity)", "max": "max(l_quantity)", "mean": "avg(l_quantity)",
                   "first": "arg_min(l_quantity, row(l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice))",
                   "last": "arg_max(l_quantity, row(l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice))"}.items():
    def _aggregate(t, how=_how):
        out = observe.aggregate_duplicates(line_obs(t), KEY, how)
        return out.select(*KEY, F.round("value", 6).alias("value"), "n_rows", F.coalesce("measurementMethod", F.lit("")).alias("method"))

    _marked = ("CASE WHEN count(*) = 1 OR ('{h}' IN ('first','last') AND arg_min(l_linestatus, row(l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice)) = 'O') THEN "
               "CASE WHEN arg_min(l_linestatus, row(l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice)) = 'O' THEN 'dcs:Survey' ELSE '' END "
               "WHEN arg_min(l_linestatus, row(l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice)) = 'O' THEN 'dcs:dcAggregate/Survey' ELSE 'dcs:Aggregate' END").format(h=_how)
    query(f"aggregate_{_how}", f"SELECT l_partkey, l_returnflag, round({_sql}, 6) AS value, count(*)::BIGINT AS n_rows, {_marked} AS method FROM lineitem GROUP BY ALL")(_aggregate)


@query("aggregate_list", """
SELECT l_partkey, l_returnflag, string_agg(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), ',' ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS value FROM lineitem GROUP BY ALL""")
def aggregate_list(t):
    return observe.list_text(observe.aggregate_duplicates(line_obs(t), KEY, "list"), KEY)


@query("keyed_merge", """
SELECT p_brand, sum(p_size)::BIGINT AS p_size, round(avg(p_retailprice), 6) AS p_retailprice, array_to_string(list_sort(list_distinct(list(p_type))), ',') AS p_type,
  arg_min(p_name, p_partkey) AS p_name FROM part GROUP BY p_brand""")
def keyed_merge(t):
    rows = t("part").select("p_brand", F.col("p_size").cast("long").alias("p_size"), "p_retailprice", "p_type", "p_name", F.col("p_partkey").alias("ord"))
    out = observe.merge_keyed(rows, ["p_brand"], {"p_retailprice": "mean", "p_name": "first"})
    return out.withColumn("p_retailprice", F.round("p_retailprice", 6))


@query("weighted_mean_merge", "SELECT o_custkey, round(sum(floor(o_totalprice) * (o_orderkey % 5 + 1)) / sum(o_orderkey % 5 + 1), 4) AS price FROM orders GROUP BY 1")
def weighted_mean_merge(t):
    rows = t("orders").select("o_custkey", F.floor("o_totalprice").alias("price"), (F.col("o_orderkey") % 5 + 1).alias("weight"), F.col("o_orderkey").alias("ord"))
    return observe.merge_keyed(rows, ["o_custkey"], {"price": "mean"}, count_of={"price": "weight"}).withColumn("price", F.round("price", 4))


@query("required_columns", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'status' ELSE '' END || CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN ',' ELSE '' END || CASE WHEN o_orderpriority = '5-LOW' THEN 'priority' ELSE '' END AS missing FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '5-LOW'")
def required_columns(t):
    rows = t("orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).otherwise("").alias("priority"))
    return observe.validate(rows, ["status", "priority"])[1].select("o_orderkey", F.array_join("missing", ",").alias("missing"))


@query("prune_variables", "SELECT c_custkey::VARCHAR AS dcid FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def prune_variables(t):
    variables = t("customer").select(F.col("c_custkey").cast("string").alias("dcid"))
    obs = t("orders").select(F.concat(F.lit("dcid:"), F.col("o_custkey").cast("string")).alias("variableMeasured"))
    return observe.prune_variables(variables, obs)


@query("prune_observations", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def prune_observations(t):
    known = t("customer").filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").cast("string").alias("dcid"))
    obs = t("orders").select("o_orderkey", F.concat(F.lit("dcid:"), F.col("o_custkey").cast("string")).alias("variableMeasured"))
    return observe.prune_observations(obs, known).select("o_orderkey")


CONSTANTS = {"o_orderkey": "o_orderkey", "o_orderstatus": "o_orderstatus", "century": "cast(year(o_orderdate) AS int) - year(o_orderdate) % 100", "wide": "cast(length(o_orderpriority) > 3 AS string)",
             "priced": "CASE WHEN o_totalprice >= 0 THEN 'yes' ELSE 'no' END", "sparse": "CASE WHEN o_orderstatus = 'O' THEN 'x' END", "rank": "cast(cast(substr(o_orderpriority, 1, 1) AS int) > 0 AS string)"}


@query("constant_columns", " UNION ALL ".join(
    f"SELECT '{name}' AS \"column\", min(v)::VARCHAR AS value FROM (SELECT {expr.replace(' AS string)', ' AS VARCHAR)')} AS v FROM orders) HAVING min(v) = max(v) AND count(v) = count(*)" for name, expr in CONSTANTS.items()))
def constant_columns(t):
    return observe.constant_columns(t("orders").select(*[F.expr(expr).alias(name) for name, expr in CONSTANTS.items()]))


@query("distinct_per_column", """
SELECT 'l_quantity' AS "column", count(DISTINCT l_quantity)::BIGINT AS n_distinct FROM lineitem UNION ALL SELECT 'l_shipdate', count(DISTINCT l_shipdate) FROM lineitem
UNION ALL SELECT 'l_partkey', count(DISTINCT l_partkey) FROM lineitem""")
def distinct_per_column(t):
    return observe.distinct_per_column(t("lineitem"), ["l_quantity", "l_shipdate", "l_partkey"])


@query("output_text", """SELECT p_partkey::VARCHAR AS p_partkey, '"' || p_name || '"' AS p_name, p_brand, CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE
  regexp_replace(regexp_replace(CAST(CAST(p_retailprice AS DECIMAL(38,5)) AS VARCHAR), '0+$', ''), '\\.$', '') END AS p_retailprice FROM part""")
def output_text(t):
    return observe.output_text(t("part"), ["p_partkey", "p_name", "p_brand", "p_retailprice"])


@query("quality_counters", "SELECT 'orders' AS stage, CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'done' END AS reason, count(*)::BIGINT AS n FROM orders GROUP BY ALL")
def quality_counters(t):
    return observe.count_reasons(t("orders").select(F.lit("orders").alias("stage"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done").alias("reason")))


@query("split_properties", """
SELECT p_partkey, 'unit=' || p_type AS obs, 'brand=' || p_brand AS variable FROM part""")
def split_properties(t):
    wide = t("part").select("p_partkey", F.col("p_type").alias("unit"), F.col("p_brand").alias("brand"), F.col("p_name").alias("Data"), F.lit("k").alias("Key"))
    obs, var = observe.split_properties([c for c in wide.columns if c != "p_partkey"])
    return wide.select("p_partkey", ids.series_key(obs).alias("obs"), ids.series_key(var).alias("variable"))


def daily(t):
    return t("events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("user_id").alias("user")).agg(F.round(F.sum("value"), 2).alias("value"))


@query("series_bounds_filter", """
SELECT event_type, day, "user", value FROM (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, user_id AS "user", round(sum(value), 2) AS value FROM events GROUP BY ALL) WHERE NOT value < 5 AND NOT value > 80""")
def series_bounds_filter(t):
    return series.filter_outliers(daily(t), ["event_type", "user"], "day", min_value=5, max_value=80)


@query("series_change_filter", """
WITH RECURSIVE d AS (SELECT user_id AS "user", strftime(ts, '%Y-%m-%d') AS day, round(sum(value), 2) AS value FROM events GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY day DESC) AS k FROM d),
w AS (SELECT "user", day, value, k, value <= 900 AND value >= 1 AS keep, CASE WHEN value <= 900 AND value >= 1 THEN value END AS last FROM n WHERE k = 1
  UNION ALL
  SELECT n."user", n.day, n.value, n.k, n.value <= 900 AND n.value >= 1 AND (w.last IS NULL OR abs(w.last - n.value) / least(abs(w.last), abs(n.value)) <= 3.0),
    CASE WHEN n.value <= 900 AND n.value >= 1 AND (w.last IS NULL OR abs(w.last - n.value) / least(abs(w.last), abs(n.value)) <= 3.0) THEN n.value ELSE w.last END
  FROM w JOIN n ON n."user" = w."user" AND n.k = w.k + 1)
SELECT "user", day, value FROM w WHERE keep""")
def series_change_filter(t):
    d = t("events").groupBy(F.col("user_id").alias("user"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.sum("value"), 2).alias("value"))
    return series.filter_outliers(d, ["user"], "day", min_value=1, max_value=900, max_change_ratio=3.0)


@query("series_yearly_filter", """
WITH RECURSIVE d AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, last_day(o_orderdate) AS dt, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY month) AS k FROM d),
w AS (SELECT o_custkey, month, value, k, true AS keep, value AS last, dt AS ldt FROM n WHERE k = 1
  UNION ALL
  SELECT o_custkey, month, value, k, ok, CASE WHEN ok THEN value ELSE last END, CASE WHEN ok THEN dt ELSE ldt END FROM (
    SELECT n.o_custkey, n.month, n.value, n.k, n.dt, w.last, w.ldt,
      abs(w.last - n.value) / least(abs(w.last), abs(n.value)) <= 50 AND abs(w.last - n.value) / least(abs(w.last), abs(n.value)) / (abs(n.dt - w.ldt) / 365.0) <= 20 AS ok
    FROM w JOIN n ON n.o_custkey = w.o_custkey AND n.k = w.k + 1))
SELECT o_custkey, month, value FROM w WHERE keep""")
def series_yearly_filter(t):
    d = t("orders").groupBy("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    return series.filter_outliers(d, ["o_custkey"], "month", max_change_ratio=50, max_yearly_change=20, keep_recent=False)


@query("series_keys", """SELECT o_orderkey, 'o_orderpriority=' || o_orderpriority || ';o_orderstatus=' || o_orderstatus AS series, strftime(o_orderdate, '%Y-%m-%d') AS date, round(o_totalprice, 2) AS value FROM orders""")
def series_keys(t):
    o = t("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.lit("").alias("date1"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date2"),
                           F.lit(None).cast("double").alias("v1"), F.col("o_totalprice").alias("v2"))
    cols = series.series_columns(o, ["date1", "date2"], ["v1", "v2", "o_orderkey"])
    return o.select("o_orderkey", ids.series_key(cols).alias("series"), series.first_present(["date1", "date2"]).alias("date"), F.round(F.coalesce("v1", "v2"), 2).alias("value"))
