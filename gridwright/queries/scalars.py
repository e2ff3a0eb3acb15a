"""Column builders."""

from pyspark.sql import functions as F

from ..functions import dates, ids, numbers, props, text
from ..operators.scale import spread
from .registry import query


def part_map():
    """Property map of a part as a variable."""
    return F.create_map(
        F.lit("typeOf"), F.lit("dcs:StatisticalVariable"), F.lit("statType"), F.lit("dcs:medianValue"), F.lit("measuredProperty"), F.lit("dcs:retailPrice"),
        F.lit("populationType"), F.lit("dcs:Part"), F.lit("partType"), F.concat(F.lit("dcs:"), F.initcap("p_type")),
        F.lit("size"), F.concat(F.lit("["), F.col("p_size").cast("string"), F.lit(" - Inch]")),
        F.lit("Brand"), F.regexp_replace("p_brand", "#", ""))


@query("number_parse", """
SELECT o_orderkey, round(o_totalprice, 2) AS value, CAST(NULL AS DOUBLE) AS not_number,
       CAST(o_orderkey AS DOUBLE) * 1000 + 234 AS thousands FROM orders""")
def number_parse(t):
    return t("orders").select(
        "o_orderkey", F.round(numbers.parse_number(F.concat(F.lit(" "), F.format_number("o_totalprice", 2), F.lit(" $"))), 2).alias("value"),
        numbers.parse_number(F.col("o_orderpriority").substr(3, 20)).alias("not_number"),
        numbers.parse_number(F.concat(F.col("o_orderkey").cast("string"), F.lit(".234.")), ).alias("thousands"))


@query("number_format", """
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*)::BIGINT AS n,
       min(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)) AS whole,
       min(CASE WHEN l_extendedprice = floor(l_extendedprice) THEN CAST(CAST(l_extendedprice AS BIGINT) AS VARCHAR)
           ELSE regexp_replace(regexp_replace(CAST(CAST(round(l_extendedprice, 5) AS DECIMAL(38,5)) AS VARCHAR), '0+$', ''), '\\.$', '') END) AS price
FROM lineitem GROUP BY ALL""")
def number_format(t):
    return t("lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber")).agg(
        F.count(F.lit(1)).alias("n"), F.min(numbers.number_text(F.col("l_quantity"))).alias("whole"), F.min(numbers.number_text(F.col("l_extendedprice"))).alias("price"))


@query("scale_values", "SELECT l_orderkey, round(sum(l_extendedprice * 100 * 1.0), 2) AS cents, round(sum(l_quantity), 2) AS plain FROM lineitem GROUP BY 1")
def scale_values(t):
    return t("lineitem").groupBy("l_orderkey").agg(
        F.round(F.sum(numbers.scaled(F.col("l_extendedprice"), F.lit("100"))), 2).alias("cents"),
        F.round(F.sum(numbers.scaled(F.col("l_quantity"), F.lit(None).cast("string"))), 2).alias("plain"))


@query("namespace_forms", """
SELECT p_partkey, 'dcid:' || replace(p_name, ' ', '_') AS added, replace(p_name, ' ', '_') AS stripped, CAST(p_size AS VARCHAR) AS number_kept,
       true AS has_ns, 'dcid:a_' || p_size || ',dcid:b_' || p_size AS listed,
       p_brand NOT LIKE '%#%' AS schema_like
FROM part""")
def namespace_forms(t):
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    size = F.col("p_size").cast("string")
    return t("part").select(
        "p_partkey", text.add_namespace(name).alias("added"), text.strip_namespace(F.concat(F.lit("dcs:"), name)).alias("stripped"),
        text.add_namespace(size).alias("number_kept"), text.has_namespace(text.add_namespace(name)).alias("has_ns"),
        text.add_namespace(F.concat(F.lit("a_"), size, F.lit(",b_"), size)).alias("listed"), text.is_schema_node(F.col("p_brand")).alias("schema_like"))


@query("value_normal_forms", """
SELECT p_partkey, '[' || p_size || ' ' || (p_size + 10) || ' Inch]' AS range_text, p_size::DOUBLE AS lo, (p_size + 10)::DOUBLE AS hi, 'Inch' AS unit,
       CASE WHEN p_brand < p_type THEN 'dcid:' || p_brand || ',dcid:' || p_type ELSE 'dcid:' || p_type || ',dcid:' || p_brand END AS list_text,
       '"' || p_name || '"' AS quoted, CAST(p_size AS VARCHAR) AS number
FROM part""")
def value_normal_forms(t):
    size = F.col("p_size").cast("string")
    rng = F.concat(F.lit("[Inch "), size, F.lit("  "), (F.col("p_size") + 10).cast("string"), F.lit("]"))
    parts = text.range_parts(rng)
    return t("part").select(
        "p_partkey", text.normalize_value(rng).alias("range_text"), parts["lo"].alias("lo"), parts["hi"].alias("hi"), parts["unit"].alias("unit"),
        text.normalize_value(F.concat_ws(", ", F.col("p_type"), F.col("p_brand"), F.col("p_type"))).alias("list_text"),
        text.normalize_value(F.col("p_name")).alias("quoted"), text.normalize_value(F.concat(size, F.lit(".0"))).alias("number"))


@query("date_resolution", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS slashed, strftime(o_orderdate, '%Y-%m') AS monthly, strftime(o_orderdate, '%Y') AS yearly,
       strftime(o_orderdate, '%Y-%m-%d') AS worded, 'P1M' AS period, CAST(NULL AS VARCHAR) AS none,
       strftime(last_day(o_orderdate), '%Y-%m-%d') AS month_end
FROM orders""")
def date_resolution(t):
    d = F.col("o_orderdate")
    month = dates.resolve_date(F.date_format(d, "yyyy/M"))
    return t("orders").select(
        "o_orderkey", dates.resolve_date(F.date_format(d, "MM/dd/yyyy")).alias("slashed"), month.alias("monthly"),
        dates.resolve_date(F.date_format(d, "yyyy")).alias("yearly"), dates.resolve_date(F.date_format(d, "d MMM yyyy")).alias("worded"),
        dates.period_of(F.date_format(d, "yyyy-MM")).alias("period"), dates.resolve_date(F.col("o_orderpriority")).alias("none"),
        F.date_format(dates.period_end(F.date_format(d, "yyyy-MM")), "yyyy-MM-dd").alias("month_end"))


@query("name_forms", """
SELECT p_partkey, upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) || upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2) AS camel,
       upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2) AS spaced,
       upper(p_name[1]) || substr(p_name, 2) AS capital
FROM part""")
def name_forms(t):
    camel = text.camel_case(F.col("p_name"))
    return t("part").select("p_partkey", camel.alias("camel"), text.camel_to_words(camel).alias("spaced"), text.capitalize_first(F.col("p_name")).alias("capital"))


@query("place_id_test", """
SELECT c_custkey, true AS path, true AS prefixed, c_name NOT LIKE '%#%' AND c_name LIKE '%/%' AS plain FROM customer""")
def place_id_test(t):
    return t("customer").select(
        "c_custkey", text.is_place_id(F.concat(F.lit("country/N"), F.col("c_nationkey").cast("string"))).alias("path"),
        text.is_place_id(F.concat(F.lit("dcid:"), F.col("c_name"))).alias("prefixed"), text.is_place_id(F.col("c_name")).alias("plain"))


@query("match_normal_form", r"""
SELECT doc_id, md5(regexp_replace(trim(regexp_replace(lower(strip_accents(text)), ' +', ' ', 'g'), ' '), '[^\p{L}\p{N} ]', '', 'g')) AS form FROM documents""")
def match_normal_form(t):
    return spread(t("documents").select("doc_id", "text"), "doc_id").select("doc_id", F.md5(text.match_form(F.col("text"))).alias("form"))


@query("word_split", "SELECT doc_id, len(list_filter(string_split_regex(text, '[ \n]'), lambda x: x <> ''))::BIGINT AS n_words FROM documents")
def word_split(t):
    return t("documents").select("doc_id", F.size(text.words(F.col("text"), "[ \n]")).cast("long").alias("n_words"))


@query("node_fingerprint", """
SELECT p_partkey, md5('Brand:dcid:' || replace(p_brand, '#', '') || ';measuredProperty:dcid:retailPrice;partType:dcid:' || upper(p_type[1]) || lower(substr(p_type, 2))
  || ';populationType:dcid:Part;size:[' || p_size || ' - Inch];statType:dcid:medianValue;typeOf:dcid:StatisticalVariable') AS fp FROM part""")
def node_fingerprint(t):
    return t("part").select("p_partkey", F.md5(props.fingerprint(part_map())).alias("fp"))


@query("property_predicates", """
SELECT p_partkey, 6::BIGINT AS valid_props, 7::BIGINT AS schemaless_props, true AS any_present, false AS all_present, 'unit' AS missing FROM part""")
def property_predicates(t):
    m = props.overlay(part_map(), F.create_map(F.lit("open"), F.lit("{Ref}")))
    return t("part").select(
        "p_partkey", F.size(props.valid_pvs(m)).cast("long").alias("valid_props"), F.size(props.valid_pvs(m, True)).cast("long").alias("schemaless_props"),
        props.has_any(m, ["unit", "size"]).alias("any_present"), props.has_all(m, ["unit", "size"]).alias("all_present"),
        F.array_join(props.missing(m, ["size", "unit"]), ",").alias("missing"))


@query("default_fill", """
SELECT p_partkey, CASE WHEN p_size > 25 THEN 'Inch' ELSE 'Centimeter' END AS unit, 'dcs:count' AS measured, 2::BIGINT AS n FROM part""")
def default_fill(t):
    base = F.when(F.col("p_size") > 25, F.create_map(F.lit("unit"), F.lit("Inch"))).otherwise(F.create_map(F.lit("measuredProperty"), F.lit("dcs:count")))
    filled = props.fill_defaults(base, {"unit": "Centimeter", "measuredProperty": "dcs:count", "description": ""})
    return t("part").select("p_partkey", filled["unit"].alias("unit"), filled["measuredProperty"].alias("measured"), F.size(filled).cast("long").alias("n"))


@query("multi_value_update", """
SELECT p_partkey, CASE WHEN p_type < p_brand THEN p_type || ',' || p_brand ELSE p_brand || ',' || p_type END AS name, p_type AS kind FROM part""")
def multi_value_update(t):
    a = F.create_map(F.lit("name"), F.col("p_brand"), F.lit("kind"), F.col("p_brand"))
    b = F.create_map(F.lit("name"), F.col("p_type"), F.lit("kind"), F.col("p_type"))
    m = props.update(a, b, ["name"])
    return t("part").select("p_partkey", m["name"].alias("name"), m["kind"].alias("kind"))


@query("rename_in_maps", """
SELECT p_partkey, upper(p_type[1]) || lower(substr(p_type, 2)) AS kind, 'schema:Part' AS pop, 'dcs:meanValue' AS stat FROM part""")
def rename_in_maps(t):
    m = props.rename_props(part_map(), {"partType": "kind"})
    m = props.rename_value(m, "statType", "dcs:medianValue", "dcs:meanValue")
    p = props.rename_namespace(m, "dcs", "schema")
    return t("part").select("p_partkey", text.strip_namespace(m["kind"]).alias("kind"), p["populationType"].alias("pop"), m["statType"].alias("stat"))


@query("pv_text_round_trip", """
SELECT p_partkey, p_name || ' --> brand:' || p_brand || ', size:' || p_size AS line, p_name AS name, p_brand AS brand, CAST(p_size AS VARCHAR) AS size FROM part""")
def pv_text_round_trip(t):
    line = props.to_text(F.col("p_name"), F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand")))
    back = props.from_text(F.col("line"))
    return t("part").select("p_partkey", line.alias("line")).select(
        "p_partkey", "line", back["name"].alias("name"), back["props"]["brand"].alias("brand"), back["props"]["size"].alias("size"))


@query("variable_ids", """
SELECT p_partkey, 'Median_RetailPrice_Part_' || replace(p_brand, '#', '') || '_' || upper(p_type[1]) || lower(substr(p_type, 2)) || '_' || p_size || 'OrMoreInch' AS from_map,
       'Count_Part_' || p_size || 'To' || (p_size + 5) || 'Inch_' || upper(p_type[1]) || lower(substr(p_type, 2)) || '_PerArea' AS from_columns FROM part""")
def variable_ids(t):
    size = F.concat(F.lit("["), F.col("p_size").cast("string"), F.lit(" "), (F.col("p_size") + 5).cast("string"), F.lit(" Inch]"))
    flat = ids.variable_id({"measuredProperty": F.lit("dcs:count"), "populationType": F.lit("dcs:Part"), "statType": F.lit("measuredValue"),
                            "width": F.concat(F.lit("dcs:"), F.initcap("p_type")), "length": size, "measurementDenominator": F.lit("area"), "unit": F.lit("x")})
    return t("part").select("p_partkey", ids.variable_id_from_map(part_map()).alias("from_map"), flat.alias("from_columns"))


@query("variable_fallback_ids", """
SELECT p_partkey, 'MedianValue_RetailPrice_Part_Brand_' || replace(p_brand, '#', '') || '_' || upper(p_type[1]) || lower(substr(p_type, 2)) || '_' || p_size || 'OrMoreInch' AS id FROM part""")
def variable_fallback_ids(t):
    return t("part").select("p_partkey", ids.fallback_id(part_map()).alias("id"))


@query("variable_titles", """
SELECT p_partkey, 'Median Retail Price Part: Kind ' || upper(p_type[1]) || lower(substr(p_type, 2)) AS title FROM part""")
def variable_titles(t):
    m = F.create_map(*[x for kv in {"statType": F.lit("dcs:medianValue"), "measuredProperty": F.lit("dcs:retailPrice"), "populationType": F.lit("dcs:Part"),
                                    "kind": F.initcap("p_type")}.items() for x in (F.lit(kv[0]), kv[1])])
    return t("part").select("p_partkey", ids.variable_title(m).alias("title"))


@query("code_terms", """
SELECT p_partkey, 'NAICS' || CASE WHEN p_size % 2 = 0 THEN 'InformationFinance' ELSE 'Information' END AS term FROM part""")
def code_terms(t):
    names = F.create_map(F.lit("51"), F.lit("Information"), F.lit("52"), F.lit("Finance"))
    v = F.when(F.col("p_size") % 2 == 0, F.lit("dcid:NAICS/51-52")).otherwise(F.lit("NAICS/51"))
    return t("part").select("p_partkey", ids.code_term(v, names, "NAICS").alias("term"))


@query("schemaless_conversion", """
SELECT p_partkey, '# Brand' AS commented, 'v' || p_partkey AS measured FROM part""")
def schemaless_conversion(t):
    out = props.capitalise_to_comment(part_map(), F.concat(F.lit("v"), F.col("p_partkey").cast("string")))
    return t("part").select("p_partkey", F.array_join(F.filter(F.map_keys(out), lambda k: k.startswith("#")), ",").alias("commented"), out["measuredProperty"].alias("measured"))


@query("composite_keys", """
SELECT c_custkey, 'c_mktsegment=' || c_mktsegment || ';c_nationkey=' || c_nationkey AS series, c_name || ',' || printf('%.6f', c_acctbal) || ',' || printf('%.6f', CAST(c_nationkey AS DOUBLE)) AS cache FROM customer""")
def composite_keys(t):
    return t("customer").select("c_custkey", ids.series_key(["c_nationkey", "c_mktsegment"]).alias("series"),
                                ids.place_cache_key(F.col("c_name"), F.col("c_acctbal"), F.col("c_nationkey").cast("double")).alias("cache"))
