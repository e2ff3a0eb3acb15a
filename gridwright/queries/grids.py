"""Grids: rows, cells, headers, lookups and rules."""

from pyspark.sql import functions as F

from ..operators import grid as g, lookup as l, observe, resolve
from ..operators.scale import settle, spread
from ..plans.observations import ignored_reason, positional_fallback
from ..sources.grids import grid_of
from ..sources.pvmaps import pv_map_from_dict
from .registry import query


def document_grid(t):
    """Each document is a sheet: its lines are rows, its words cells."""
    lines = spread(t("documents").select("doc_id", "text"), "doc_id").select(F.col("doc_id").cast("string").alias("file"), F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return lines.select("file", (F.col("p") + 1).cast("long").alias("row_no"), F.split("line", " ").alias("cells"))


DOC_GRID_SQL = """WITH grid AS (
  SELECT CAST(doc_id AS VARCHAR) AS file, CAST(i AS BIGINT) AS row_no, string_split(ls[i], ' ') AS cells
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i))
"""


@query("melt_cells", DOC_GRID_SQL + """
SELECT file, count(*)::BIGINT AS cells, sum(len(trim(c)))::BIGINT AS chars, max(row_no)::BIGINT AS row_count, max(n)::BIGINT AS widest
FROM (SELECT file, row_no, len(cells) AS n, unnest(cells) AS c FROM grid) GROUP BY file""")
def melt_cells(t):
    c = g.melt(document_grid(t))
    return c.groupBy("file").agg(F.count(F.lit(1)).alias("cells"), F.sum(F.length("value")).alias("chars"), F.max("row_no").alias("row_count"),
                                 F.max("col_no").cast("long").alias("widest"))


@query("select_rows", DOC_GRID_SQL + """
SELECT file, row_no, len(cells[1:6])::BIGINT AS width FROM grid WHERE row_no > 1 AND len(cells) >= 4 AND row_no <> 3 AND row_no <= 200""")
def select_rows(t):
    out = g.select_rows(document_grid(t), skip=1, ignore=[3], min_columns=4, max_rows=200, max_columns=6)
    return out.select("file", "row_no", F.size("cells").cast("long").alias("width"))


@query("table_preview", DOC_GRID_SQL + "SELECT file, row_no, array_to_string(cells, ' ') AS line FROM grid WHERE row_no <= 2")
def table_preview(t):
    return g.preview(document_grid(t), 2).select("file", "row_no", F.array_join("cells", " ").alias("line"))


@query("header_row_counts", DOC_GRID_SQL + r"""
, flagged AS (SELECT file, row_no, (len(cells) - len(list_filter(cells, lambda c: trim(c) <> ''))) / len(cells) > 0.5
   OR len(list_filter(['table','figure','year:','note','source','(number','unnamed:'], lambda w: contains(lower(trim(cells[1])), w))) > 0
   OR len(list_filter(cells, lambda c: try_cast(trim(replace(replace(c, ',', ''), '%', '')) AS DOUBLE) IS NOT NULL)) / len(cells) < 0.1 AS h
   FROM grid WHERE row_no <= 5)
SELECT file, greatest(coalesce(min(CASE WHEN NOT h THEN row_no END), max(row_no) + 1) - 1, 1)::BIGINT AS header_rows FROM flagged GROUP BY file""")
def header_row_counts(t):
    return g.header_row_count(document_grid(t)).select("file", F.col("header_rows").cast("long").alias("header_rows"))


@query("footer_starts", DOC_GRID_SQL + """
, sized AS (SELECT *, len(list_filter(cells, lambda c: trim(c) <> '')) AS f FROM grid),
ends AS (SELECT file, max(row_no) AS n FROM sized GROUP BY file),
means AS (SELECT file, avg(f) AS m FROM sized JOIN ends USING (file) WHERE row_no <= n - 20 GROUP BY file)
SELECT file, min(row_no)::BIGINT AS footer_row FROM sized JOIN ends USING (file) LEFT JOIN means USING (file)
WHERE row_no > n - 20 AND (f < coalesce(m, 0) * 0.3 OR regexp_matches(lower(trim(cells[1])), 'source|note|data from|footnote|[*]|†|‡')) GROUP BY file""")
def footer_starts(t):
    return g.footer_start(document_grid(t))


@query("total_rows", DOC_GRID_SQL + """
SELECT file, row_no FROM (SELECT file, row_no, row_number() OVER (PARTITION BY file ORDER BY row_no) AS k FROM grid
  WHERE len(list_filter(cells[1:5], lambda c: len(list_filter(['total','all','sum','overall','national','combined','whole','entire','grand'], lambda w: contains(lower(c), w))) > 0)) > 0) WHERE k <= 2""")
def total_rows(t):
    return g.total_rows(document_grid(t)).select("file", "row_no")


@query("candidate_keys", DOC_GRID_SQL + r"""
SELECT DISTINCT trim(c) AS value FROM (SELECT unnest(cells) AS c FROM grid WHERE row_no <= 100)
WHERE trim(c) <> '' AND len(trim(c)) < 80 AND NOT regexp_matches(trim(c), '^[0-9.+\-][0-9., $%]*$')""")
def candidate_keys(t):
    return g.candidate_keys(document_grid(t), 100)


def part_words(t):
    maps = {"GLOBAL": {
        "small": {"size": "dcs:Small"}, "Large": {"size": "dcs:Large"}, "ring": {"form": "dcs:Ring"}, "red ring": {"form": "dcs:RedRing", "color": "dcs:Red"},
        "bolt promo": {"form": "dcs:PromoBolt"}, "economy": {"line": "dcs:Economy"}, "red": {"color": "dcs:Red"}, "PROMO": {"line": "dcs:Promo"}}}
    return pv_map_from_dict(t("part").sparkSession, maps)


@query("exact_lookup", """
SELECT p_type AS value, CASE p_type WHEN 'ECONOMY' THEN 'dcs:Economy' WHEN 'PROMO' THEN 'dcs:Promo' END AS line, CASE p_type WHEN 'PROMO' THEN 'PROMO' ELSE lower(p_type) END AS matched
FROM (SELECT DISTINCT p_type FROM part) WHERE p_type IN ('ECONOMY', 'PROMO', 'SMALL')""")
def exact_lookup(t):
    m = part_words(t)
    strings = t("part").select(F.col("p_type").alias("value")).distinct().withColumn("header", F.lit(None).cast("string"))
    return l.exact_lookup(strings, m, l.pv_schema(m), ["value"]).select("value", F.col("props")["line"].alias("line"), "matched")


@query("phrase_lookup", """
WITH s AS (SELECT DISTINCT p_name || ' ' || p_type AS value, p_name, p_type FROM part),
h AS (SELECT value,
  CASE WHEN p_name = 'red ring' THEN 'dcs:RedRing' WHEN p_name LIKE '% bolt' AND p_type = 'PROMO' THEN 'dcs:PromoBolt' WHEN p_name LIKE '% ring' THEN 'dcs:Ring' END AS form,
  CASE WHEN p_name LIKE 'red %' THEN 'dcs:Red' END AS color,
  CASE WHEN p_name LIKE 'small %' OR p_type = 'SMALL' THEN 'dcs:Small' END AS size,
  CASE WHEN p_type = 'ECONOMY' THEN 'dcs:Economy' WHEN p_type = 'PROMO' AND p_name NOT LIKE '% bolt' THEN 'dcs:Promo' END AS line FROM s)
SELECT * FROM h WHERE form IS NOT NULL OR color IS NOT NULL OR size IS NOT NULL OR line IS NOT NULL""")
def phrase_lookup(t):
    m = part_words(t)
    strings = t("part").select(F.concat_ws(" ", "p_name", "p_type").alias("value")).distinct().withColumn("header", F.lit(None).cast("string"))
    hits = l.find_properties(strings, m, l.pv_schema(m), ["value"])
    p = F.col("props")
    return hits.select("value", *[p[c].alias(c) for c in ("form", "color", "size", "line")])


@query("substring_lookup", """
SELECT value, CASE WHEN value LIKE '%ring%' THEN 'dcs:Ring' WHEN value LIKE '%in%' THEN 'dcs:In' END AS a, CASE WHEN value LIKE '%old%' THEN 'dcs:Old' END AS b
FROM (SELECT DISTINCT p_name AS value FROM part) WHERE value LIKE '%ring%' OR value LIKE '%old%' OR value LIKE '%in%'""")
def substring_lookup(t):
    m = pv_map_from_dict(t("part").sparkSession, {"GLOBAL": {"in": {"a": "dcs:In"}, "ring": {"a": "dcs:Ring"}, "old": {"b": "dcs:Old"}}})
    hits = l.substring_lookup(t("part").select(F.col("p_name").alias("value")).distinct(), m, ["value"], word_boundary=False)
    return hits.select("value", F.col("props")["a"].alias("a"), F.col("props")["b"].alias("b"))


@query("substring_lookup_documents", r"""
SELECT doc_id, nullif(CASE WHEN regexp_matches(text, '(^|[^\p{L}])the($|[^\p{L}])') THEN 'T' ELSE '' END || CASE WHEN regexp_matches(text, '(^|[^\p{L}])of($|[^\p{L}])') THEN 'O' ELSE '' END, '') AS found
FROM documents WHERE regexp_matches(text, '(^|[^\p{L}])(the|of)($|[^\p{L}])')""")
def substring_lookup_documents(t):
    m = pv_map_from_dict(t("part").sparkSession, {"GLOBAL": {"the": {"t": "T"}, "of": {"o": "O"}}})
    hits = l.substring_lookup(t("documents").select("doc_id", F.col("text").alias("value")), m, ["doc_id"])
    return hits.select("doc_id", F.concat(F.coalesce(F.col("props")["t"], F.lit("")), F.coalesce(F.col("props")["o"], F.lit(""))).alias("found"))


@query("substring_lookup_passages", """
WITH k AS (SELECT DISTINCT array_to_string(string_split(text, ' ')[1:4], ' ') AS key FROM benchmark UNION SELECT DISTINCT c_name FROM customer UNION SELECT DISTINCT o_orderkey || '-' || o_custkey FROM orders)
SELECT doc_id, count(*)::BIGINT AS n_keys, min(key) AS first_key FROM documents JOIN k ON contains(text, key) GROUP BY doc_id""")
def substring_lookup_passages(t):
    """Heads of the benchmark's passages in whole documents, among very many keys that no text holds."""
    b = t("benchmark").select(F.array_join(F.slice(F.split("text", " "), 1, 4), " ").alias("key"))
    others = t("customer").select(F.col("c_name").alias("key")).union(t("orders").select(F.concat_ws("-", "o_orderkey", "o_custkey").alias("key")))
    m = b.unionByName(others).distinct().select("key", F.create_map(F.lit("key"), F.col("key")).alias("props"), F.lit(0).alias("ord"))
    hits = l.substring_lookup(t("documents").select("doc_id", F.col("text").alias("value")), m, ["doc_id"], word_boundary=False)
    return hits.select("doc_id", F.size("matched").cast("long").alias("n_keys"), F.array_min("matched").alias("first_key"))


@query("positional_lookup", """
SELECT o_orderkey, CASE WHEN o_orderkey = 7 THEN 'cell' ELSE 'column' END AS kind FROM orders""")
def positional_lookup(t):
    m = pv_map_from_dict(t("orders").sparkSession, {"GLOBAL": {"Cell:7:2": {"kind": "cell"}, "Column:2": {"kind": "column"}, "Row:7": {"kind": "row"}}})
    cells = t("orders").select("o_orderkey", F.col("o_orderkey").alias("row_no"), F.lit(2).alias("col_no"), F.lit(None).cast("map<string,string>").alias("_p"), F.lit(True).alias("_want"))
    hit = positional_fallback(cells, l.with_default_namespace(m))
    return hit.select("o_orderkey", F.col("_p")["kind"].alias("kind"))


@query("id_remap", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Construction' ELSE c_mktsegment END AS segment FROM customer")
def id_remap(t):
    spark = t("customer").sparkSession
    table = spark.createDataFrame([("BUILDING", "Construction"), ("NONE", "Nothing")], "old string, new string")
    return l.remap(t("customer").select("c_custkey", F.col("c_mktsegment").alias("segment")), "segment", table, "old", "new")


@query("running_headers", """
WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'signup' THEN 'sign' || event_id END AS a, CASE WHEN event_type = 'error' THEN 'err' || event_id END AS b FROM events)
SELECT event_id, last_value(a IGNORE NULLS) OVER w AS a, last_value(b IGNORE NULLS) OVER w AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def running_headers(t):
    mark = lambda kind, p: F.when(F.col("event_type") == kind, F.concat(F.lit(p), F.col("event_id").cast("string")))
    cells = t("events").select(F.col("user_id").alias("file"), F.lit(1).alias("col_no"), F.col("event_id").alias("row_no"), mark("signup", "sign").alias("a"), mark("error", "err").alias("b"))
    return g.attach_running_headers(cells, ["a", "b"], bucket=1000).select(F.col("row_no").alias("event_id"), "a", "b")


@query("merged_header_cells", """
SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'F' || o_orderkey ELSE
   CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - last_value(CASE WHEN o_orderstatus = 'F' THEN rn END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) <= 2
   THEN last_value(CASE WHEN o_orderstatus = 'F' THEN 'F' || o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) END END AS head
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)""")
def merged_header_cells(t):
    from pyspark.sql import Window

    full = F.col("o_orderstatus") == "F"
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    cells = t("orders").select(
        F.lit("f").alias("file"), F.col("o_custkey").alias("row_no"), F.row_number().over(w).alias("col_no"), "o_orderkey",
        F.when(full, F.lit("x")).otherwise(F.lit("")).alias("value"),
        F.when(full, F.create_map(F.lit("h"), F.concat(F.lit("F"), F.col("o_orderkey").cast("string")))).alias("props"))
    out = g.fill_merged(cells, default=2)
    return out.select(F.col("row_no").alias("o_custkey"), "o_orderkey", F.col("props")["h"].alias("head"))


@query("row_carry", """
SELECT l_orderkey, k AS col_no, coalesce(own, lft, rgt) AS tag FROM (
  SELECT l_orderkey, k, own, last_value(own IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lft,
    last_value(own IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS rgt
  FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k,
    CASE WHEN l_returnflag = 'R' THEN 'R' || l_linenumber END AS own FROM lineitem))""")
def row_carry(t):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    cells = t("lineitem").select(F.lit("f").alias("file"), F.col("l_orderkey").alias("row_no"), F.row_number().over(w).cast("long").alias("col_no"),
                                 F.when(F.col("l_returnflag") == "R", F.concat(F.lit("R"), F.col("l_linenumber").cast("string"))).alias("tag"))
    return g.carry_row(cells, ["tag"], F.lit(True)).select(F.col("row_no").alias("l_orderkey"), "col_no", "tag")


RULES = {"GLOBAL": {"x": {
    "#Regex": "(?P<Word>[A-Za-z]+)#(?P<No>[0-9]+)", "#Format": "code={Word}-{No:03d}", "#Eval": "twice=cast(No as int) * 2", "#Filter": "cast(No as int) > 5",
    "brand": "dcs:{@Word}{@No}", "label": "@brand of {Kind}"}}}


@query("resolve_rules", """
SELECT p_partkey, regexp_extract(p_brand, '([A-Za-z]+)', 1) AS "Word", 'dcs:' || replace(p_brand, '#', '') AS brand, 'dcs:' || replace(p_brand, '#', '') || ' of ' || p_type AS label,
  'Brand-' || lpad(regexp_extract(p_brand, '([0-9]+)', 1), 3, '0') AS code, CAST(2 * CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS VARCHAR) AS twice
FROM part WHERE CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) > 5""")
def resolve_rules(t):
    spark = t("part").sparkSession
    schema = l.pv_schema(pv_map_from_dict(spark, RULES))
    row = RULES["GLOBAL"]["x"]
    wide = t("part").select("p_partkey", F.col("p_brand").alias("Data"), F.col("p_type").alias("Kind"), *[F.lit(v).alias(k) for k, v in row.items()])
    wide = resolve.substitute(settle(resolve.process(wide, schema)), schema.references)
    return resolve.apply_filters(wide, schema.rules).select("p_partkey", "Word", "brand", "label", "code", "twice")


@query("multi_value_expand", """
SELECT p_partkey, a, b FROM (SELECT p_partkey, unnest([p_brand, p_type]) AS a, p_name FROM part), LATERAL (SELECT unnest(string_split(p_name, ' ')) AS b)""")
def multi_value_expand(t):
    wide = t("part").select("p_partkey", F.concat_ws(", ", "p_brand", "p_type").alias("a"), F.replace("p_name", F.lit(" "), F.lit(",")).alias("b"))
    return observe.expand_values(wide, ["a", "b"])


@query("list_flatten", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def list_flatten(t):
    return observe.flatten_lists(t("part").select("p_partkey", F.split("p_name", " ").alias("word")), ["word"])


@query("file_name_properties", """
SELECT DISTINCT url AS file, regexp_replace(list_last(string_split(url, '/')), '[^A-Za-z0-9_.\\-]', ' ', 'g') AS value FROM pages""")
def file_name_properties(t):
    return g.file_properties(t("pages").select(F.col("url").alias("file"))).select("file", "value")


@query("ignore_rows_and_cells", "SELECT o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderstatus <> 'P'")
def ignore_rows_and_cells(t):
    tagged = t("orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", F.lit("1")).alias("#ignore"), (F.col("o_orderpriority") == "5-LOW").cast("string").alias("#IgnoreRow"))
    return tagged.filter(ignored_reason(tagged).isNull()).select("o_orderkey")


@query("table_as_grid", """
SELECT c_mktsegment AS file, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) + 1 AS BIGINT) AS row_no, c_name || '|' || c_nationkey AS line FROM customer
UNION ALL SELECT DISTINCT c_mktsegment, CAST(1 AS BIGINT), 'c_name|c_nationkey' FROM customer""")
def table_as_grid(t):
    return grid_of(t("customer"), ["c_name", "c_nationkey"], ["c_custkey"], "c_mktsegment").select("file", "row_no", F.array_join("cells", "|").alias("line"))


@query("mapped_cell_predicate", DOC_GRID_SQL + """
SELECT file, row_no, count(*)::BIGINT AS mapped FROM (SELECT file, row_no, unnest(range(1, len(cells) + 1)) AS col_no FROM grid) WHERE row_no <= 2 OR col_no IN (1, 4) GROUP BY 1, 2""")
def mapped_cell_predicate(t):
    cells = g.melt(document_grid(t)).filter(g.mapped_cells(mapped_rows=2, mapped_columns=[1, 4]))
    return cells.groupBy("file", "row_no").agg(F.count(F.lit(1)).alias("mapped"))


@query("dependent_variable_selection", """
SELECT p_partkey, 'Count_Part_' || upper(p_type[1]) || lower(substr(p_type, 2)) || '_Big' AS chosen, 'Count_Part_' || upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) AS rest_only FROM part""")
def dependent_variable_selection(t):
    from ..functions import ids

    cols = {"measuredProperty": F.lit("count"), "populationType": F.lit("Part"), "kind": F.initcap("p_type"), "word": F.split("p_name", " ")[0]}
    def made(rule):
        names, fixed = resolve.selection(rule, list(cols))
        return ids.variable_id({n: cols[n] for n in names} | {n: F.lit(v) for n, v in fixed.items()})
    return t("part").select("p_partkey", made("measuredProperty,populationType,kind,+size=Big").alias("chosen"), made("-kind").alias("rest_only"))
