"""Node tables."""

from pyspark.sql import functions as F

from ..functions import props
from ..operators import mapping, nodes as n, quality
from .registry import query
from .scalars import part_map


def part_nodes(t):
    """Triples of parts keyed by name, so that parts with the same name are one node."""
    pairs = F.array(F.struct(F.lit("brand").alias("prop"), F.concat(F.lit("dcs:"), F.regexp_replace("p_brand", "#", "")).alias("value")),
                    F.struct(F.lit("kind").alias("prop"), F.concat(F.lit("dcs:"), F.initcap("p_type")).alias("value")),
                    F.struct(F.lit("size").alias("prop"), F.col("p_size").cast("string").alias("value")))
    return t("part").select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("node"), "p_partkey", F.posexplode(pairs).alias("ord", "x")).select("node", "p_partkey", "ord", "x.prop", "x.value")


TRIPLES = """WITH tr AS (
 SELECT replace(p_name, ' ', '_') AS node, p_partkey, 'brand' AS prop, 'dcs:' || replace(p_brand, '#', '') AS value FROM part UNION ALL
 SELECT replace(p_name, ' ', '_'), p_partkey, 'kind', 'dcs:' || upper(p_type[1]) || lower(substr(p_type, 2)) FROM part UNION ALL
 SELECT replace(p_name, ' ', '_'), p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part)
"""


@query("node_merge", TRIPLES + "SELECT DISTINCT node, prop, value FROM tr")
def node_merge(t):
    return n.merge(part_nodes(t)).select("node", "prop", "value")


@query("node_value_text", TRIPLES + "SELECT node, prop, string_agg(DISTINCT value, ',' ORDER BY value) AS value FROM tr GROUP BY 1, 2")
def node_value_text(t):
    return n.value_text(part_nodes(t)).select("node", "prop", "value")


@query("mergeable_blocks", TRIPLES + """
, b AS (SELECT node, p_partkey, string_agg(prop || '=' || value, ';' ORDER BY prop) AS fp FROM tr GROUP BY 1, 2),
f AS (SELECT node, arg_min(fp, p_partkey) AS ffp, min(p_partkey) AS b0 FROM b GROUP BY 1)
SELECT node, p_partkey AS block FROM b JOIN f USING (node) WHERE p_partkey = b0 OR fp = ffp""")
def mergeable_blocks(t):
    tr = part_nodes(t).withColumnRenamed("p_partkey", "block")
    typed = tr.select("node", "block").distinct().select("node", "block", F.lit(-1).alias("ord"), F.lit("typeOf").alias("prop"), F.lit("dcs:StatisticalVariable").alias("value"))
    return n.mergeable_blocks(tr.unionByName(typed))[0].select("node", "block").distinct()


@query("filter_nodes", TRIPLES + """
SELECT DISTINCT node, prop, value FROM tr WHERE node IN (SELECT node FROM tr WHERE prop = 'brand' AND value = 'dcs:Brand7') AND node NOT IN (SELECT node FROM tr WHERE prop = 'size' AND value = '13') AND node LIKE 'red%'""")
def filter_nodes(t):
    tr = part_nodes(t)
    keep = tr.filter(F.col("node").startswith("red")).select("node").distinct()
    return n.filter_nodes(tr, keep, ["brand:Brand7"], ["size:13"]).select("node", "prop", "value").distinct()


@query("ids_with_properties", "SELECT 's' || s_suppkey AS node FROM supplier WHERE s_acctbal > 0 AND s_nationkey < 13")
def ids_with_properties(t):
    rows = t("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.explode(F.array_compact(F.array(
        F.when(F.col("s_acctbal") > 0, F.lit("credit")), F.when(F.col("s_nationkey") < 13, F.lit("near")), F.lit("name")))).alias("prop"))
    return n.ids_with_all(rows, ["credit", "near"])


@query("rename_triples", TRIPLES + """SELECT p_partkey, CASE WHEN prop = 'kind' THEN 'type' ELSE prop END AS prop, CASE WHEN prop = 'kind' AND value = 'dcs:Promo' THEN 'dcid:Promotion' ELSE replace(value, 'dcs:', 'dcid:') END AS value FROM tr""")
def rename_triples(t):
    return n.rename(part_nodes(t), {"kind": "type"}, {("kind", "dcs:Promo"): "dcs:Promotion"}, {"dcs": "dcid"}).select("p_partkey", "prop", "value")


@query("drop_undefined", TRIPLES + "SELECT p_partkey, prop, value FROM tr WHERE prop IN ('brand', 'size') AND value NOT IN (SELECT value FROM tr WHERE prop = 'brand' AND value LIKE 'dcs:Brand1%')")
def drop_undefined(t):
    tr = part_nodes(t)
    defined = tr.filter((F.col("prop") == "brand") & ~F.col("value").startswith("dcs:Brand1")).select("value").distinct()
    schema = defined.unionByName(tr.filter(F.col("prop") != "kind").select(F.col("prop").alias("value")).distinct())
    return n.drop_undefined(tr, schema).select("p_partkey", "prop", "value")


@query("drop_known_nodes", TRIPLES + "SELECT DISTINCT node, prop, value FROM tr WHERE node NOT IN (SELECT node FROM tr WHERE prop = 'kind' AND value = 'dcs:Promo')")
def drop_known_nodes(t):
    tr = part_nodes(t)
    return n.drop_known(tr, tr.filter((F.col("prop") == "kind") & (F.col("value") == "dcs:Promo"))).select("node", "prop", "value").distinct()


@query("keep_additions", TRIPLES + "SELECT DISTINCT node, prop, value FROM tr WHERE value <> 'dcs:Promo'")
def keep_additions(t):
    tr = part_nodes(t)
    return n.drop_known(tr, tr.filter(F.col("value") == "dcs:Promo"), True).select("node", "prop", "value").distinct()


@query("existence_flags", 'SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS "exists" FROM customer')
def existence_flags(t):
    return n.existence(t("customer").select(F.col("c_custkey").alias("node")), t("orders").select(F.col("o_custkey").alias("node"))).select(F.col("node").alias("c_custkey"), "exists")


def versions(t):
    """Two versions of customer nodes: everything now, and only what customers with finished orders had."""
    def triples(df, *cols):
        return df.select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.explode(F.array(*[F.struct(F.lit(p).alias("prop"), v.cast("string").alias("value")) for p, v in cols])).alias("x")).select("node", "x.*")

    c = t("customer")
    done = t("orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("c_custkey")).distinct()
    new = triples(c, ("segment", F.col("c_mktsegment")), ("nation", F.concat(F.lit("dcs:N"), "c_nationkey")))
    seg = F.when(F.col("c_acctbal") < 0, F.lit("NONE")).otherwise(F.col("c_mktsegment"))
    old = triples(c.join(done, "c_custkey", "left_semi"), ("segment", F.concat(F.lit("dcs:"), seg)), ("level", F.lit("1")))
    return old, new


DIFF = """WITH done AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'),
a AS (SELECT 'c' || c_custkey AS node, 'segment' AS prop, CASE WHEN c_acctbal < 0 THEN 'NONE' ELSE c_mktsegment END AS old FROM customer JOIN done ON k = c_custkey UNION ALL SELECT 'c' || k, 'level', '1' FROM done),
b AS (SELECT 'c' || c_custkey AS node, 'segment' AS prop, c_mktsegment AS new FROM customer UNION ALL SELECT 'c' || c_custkey, 'nation', 'N' || c_nationkey FROM customer),
d AS (SELECT coalesce(a.node, b.node) AS node, coalesce(a.prop, b.prop) AS prop, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'deleted' WHEN old = new THEN 'matched' ELSE 'modified' END AS status
  FROM a FULL JOIN b ON a.node = b.node AND a.prop = b.prop)
"""


@query("node_diff", DIFF + "SELECT * FROM d")
def node_diff(t):
    return n.diff(*versions(t)).select("node", "prop", "status")


@query("node_diff_summary", DIFF + """
SELECT node, count_if(status = 'added')::BIGINT AS added, count_if(status = 'deleted')::BIGINT AS deleted, count_if(status = 'modified')::BIGINT AS modified, count_if(status = 'matched')::BIGINT AS matched,
 CASE WHEN count_if(status = 'added') = count(*) THEN 'added' ELSE 'modified' END AS node_status FROM d GROUP BY node""")
def node_diff_summary(t):
    return n.diff_nodes(n.diff(*versions(t)))


@query("missing_ids", DIFF + """SELECT DISTINCT node, 'right' AS side FROM b WHERE old_only = 0 AND node NOT IN (SELECT node FROM a)
UNION ALL SELECT DISTINCT node, 'left' FROM a WHERE node NOT IN (SELECT node FROM b WHERE old_only = 0)""".replace("old_only = 0", "right(node, 1) <> '7'"))
def missing_ids(t):
    left, right = versions(t)
    return n.missing_ids(left, right.filter(~F.col("node").endswith("7")))


@query("fingerprint_diff", """
WITH a AS (SELECT min(s_suppkey) AS l, s_nationkey AS n, floor(s_acctbal / 1000)::BIGINT AS k FROM supplier GROUP BY 2, 3), b AS (SELECT min(c_custkey) AS r, c_nationkey AS n, floor(c_acctbal / 1000)::BIGINT AS k FROM customer GROUP BY 2, 3)
SELECT coalesce(l, -1) AS left_node, coalesce(r, -1) AS right_node, CASE WHEN l IS NULL THEN 'added' WHEN r IS NULL THEN 'deleted' ELSE 'matched' END AS status FROM a FULL JOIN b ON a.n = b.n AND a.k = b.k""")
def fingerprint_diff(t):
    side = lambda df, k, nat, bal: df.select(F.col(k).alias("node"), F.create_map(F.lit("nation"), F.concat(F.lit("N"), nat), F.lit("band"), F.concat(F.lit("B"), F.floor(F.col(bal) / 1000).cast("string")), F.lit("dcid"), F.col(k).cast("string")).alias("props"))
    a = side(t("supplier"), "s_suppkey", "s_nationkey", "s_acctbal")
    return n.diff_by_fingerprint(a, side(t("customer"), "c_custkey", "c_nationkey", "c_acctbal")).select(*[F.coalesce(c, F.lit(-1)).alias(c) for c in ("left_node", "right_node")], "status")


@query("reuse_existing", "SELECT p_partkey, (SELECT min('part' || lpad(CAST(q.p_partkey AS VARCHAR), 9, '0')) FROM part q WHERE q.p_brand = part.p_brand AND q.p_type = part.p_type AND q.p_size = part.p_size) AS node FROM part")
def reuse_existing(t):
    rows = t("part").select("p_partkey", F.concat(F.lit("part"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("node"), part_map().alias("props"))
    return n.reuse_existing(rows, rows).select("p_partkey", "node")


@query("resolve_partial_nodes", "SELECT 'x' || s_suppkey AS node, 's' || s_suppkey AS resolved, 'title' AS by_prop FROM supplier")
def resolve_partial_nodes(t):
    s = t("supplier")
    full = s.select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.explode(F.array(F.struct(F.lit("title").alias("prop"), F.col("s_name").alias("value")),
                    F.struct(F.lit("nation").alias("prop"), F.col("s_nationkey").cast("string").alias("value")))).alias("x")).select("node", "x.*")
    return n.resolve_partial(full.withColumn("node", F.regexp_replace("node", "^s", "x")), full)


@query("sorted_node_maps", TRIPLES + "SELECT node, count(DISTINCT prop)::BIGINT AS n_props, min(CASE WHEN prop = 'brand' THEN value END) AS first_brand FROM tr GROUP BY node")
def sorted_node_maps(t):
    merged = part_nodes(t).groupBy("node", "prop").agg(F.min("value").alias("value"))
    return n.to_maps(merged).select("node", F.size("props").cast("long").alias("n_props"), F.col("props")["brand"].alias("first_brand"))


@query("node_filter_by_map", "SELECT p_partkey FROM part WHERE p_size >= 25")
def node_filter_by_map(t):
    m = F.when(F.col("p_size") >= 25, F.create_map(F.lit("big"), F.lit("1"), F.lit("name"), F.col("p_name"))).otherwise(F.create_map(F.lit("name"), F.col("p_name")))
    return t("part").select("p_partkey", m.alias("m")).filter(props.has_all(F.col("m"), ["big", "name"])).select("p_partkey")


DICT = r"""WITH d AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(string_split_regex(regexp_replace(text, '[^A-Za-z]', ' ', 'g'), ' +')) AS w FROM benchmark))
, u AS (SELECT doc_id AS node, lower(w) AS word FROM (SELECT doc_id, unnest(string_split_regex(regexp_replace(regexp_replace(text, '[^A-Za-z]', ' ', 'g'), '([a-z])([A-Z])', '\1 \2', 'g'), ' +')) AS w
   FROM documents WHERE NOT regexp_matches(text, 'https?://') AND NOT regexp_matches(text, '^\s*[{\[]')) WHERE len(w) >= 2 AND NOT regexp_matches(w, '^[A-Z]{2}'))
"""


def word_table(t):
    return t("benchmark").select(F.explode(F.split(F.regexp_replace("text", "[^A-Za-z]", " "), " +")).alias("word"))


def document_triples(t):
    return t("documents").select(F.col("doc_id").alias("node"), F.lit("x").alias("prop"), F.col("text").alias("value"))


@query("spell_check", DICT + "SELECT node, word, count(*)::BIGINT AS n FROM u WHERE word NOT IN (SELECT w FROM d) GROUP BY 1, 2")
def spell_check(t):
    return quality.misspelled(document_triples(t), word_table(t)).select("node", "word", "n")


URLS = "WITH u AS (SELECT page_id, url FROM pages WHERE regexp_matches(url, 'https?://'))"


@query("url_extraction", r"SELECT page_id, regexp_extract(url, '(https?://[^\s\"''<>,)]+)', 1) AS url FROM pages WHERE regexp_matches(url, 'https?://')")
def url_extraction(t):
    return quality.urls(t("pages").select("page_id", F.concat_ws(" ", F.lit("see"), "url", F.lit("now")).alias("text")), ["page_id"], "text")


@query("disallowed_urls", URLS + " SELECT page_id, url FROM u WHERE url NOT LIKE 'https://m.%' AND url NOT LIKE 'http://th%'")
def disallowed_urls(t):
    found = quality.urls(t("pages"), ["page_id"], "url")
    allowed = found.sparkSession.createDataFrame([("https://m.",), ("http://th",)], "prefix string")
    return quality.disallowed_urls(found, allowed)


@query("quality_report", DICT + """SELECT CAST(node AS VARCHAR) AS node, 'spelling' AS problem, word AS detail FROM u WHERE word NOT IN (SELECT w FROM d) GROUP BY 1, 3
UNION ALL SELECT 'p' || page_id, 'url', url FROM pages WHERE url NOT LIKE 'https://%'""")
def quality_report(t):
    pages = t("pages").select(F.concat(F.lit("p"), "page_id").alias("node"), F.lit("url").alias("prop"), F.col("url").alias("value"))
    tr = document_triples(t).withColumn("node", F.col("node").cast("string")).unionByName(pages)
    allowed = tr.sparkSession.createDataFrame([("https://",)], "prefix string")
    return quality.quality_report(tr, word_table(t), allowed).select("node", "problem", "detail")


@query("new_schema_nodes", """
WITH b AS (SELECT DISTINCT replace(p_brand, '#', '') AS v FROM part WHERE replace(p_brand, '#', '') NOT LIKE 'Brand1%')
SELECT v AS node, 'typeOf' AS prop, 'dcs:BrandEnum' AS value FROM b UNION ALL SELECT v, 'isProvisional', 'dcs:True' FROM b
UNION ALL SELECT v, 'name', '"' || regexp_replace(v, '([a-z])([0-9])', '\\1 \\2') || '"' FROM (SELECT CASE WHEN len(v) = 7 THEN substr(v, 1, 5) || ' ' || substr(v, 6, 1) || ' ' || substr(v, 7) ELSE v END AS w, v FROM b) WHERE len(v) = 6
UNION ALL SELECT v, 'name', '"Brand ' || substr(v, 6, 1) || ' ' || substr(v, 7) || '"' FROM b WHERE len(v) = 7
UNION ALL SELECT * FROM (VALUES ('brand', 'typeOf', 'schema:Property'), ('brand', 'name', '"brand"'), ('brand', 'domainIncludes', 'dcs:Part'), ('brand', 'rangeIncludes', 'dcs:BrandEnum'), ('brand', 'isProvisional', 'dcs:True'),
  ('BrandEnum', 'typeOf', 'schema:Class'), ('BrandEnum', 'name', '"BrandEnum"'), ('BrandEnum', 'subClassOf', 'schema:Enumeration'), ('BrandEnum', 'isProvisional', 'dcs:True'))""")
def new_schema_nodes(t):
    tr = part_nodes(t).select(F.col("p_partkey").alias("node"), "prop", "value")
    pop = t("part").select(F.col("p_partkey").alias("node"), F.lit("populationType").alias("prop"), F.lit("dcs:Part").alias("value"))
    known = tr.filter(F.col("value").startswith("dcs:Brand1") | ~F.col("prop").isin("brand", "size")).select("value").distinct().unionByName(
        tr.sparkSession.createDataFrame([(x,) for x in ("size", "SizeEnum", "kind", "KindEnum", "populationType", "Part", "PopulationTypeEnum")], "value string"))
    return quality.new_schema_nodes(tr.unionByName(pop), known)


def maps_to_compare(t):
    old, new = versions(t)
    rename = lambda d: d.withColumnRenamed("node", "key")
    return rename(old.withColumn("value", F.regexp_replace("value", "^dcs:", ""))), rename(new.withColumn("value", F.regexp_replace("value", "^dcs:", "")))


@query("map_comparison", DIFF + "SELECT node AS key, prop, status FROM d")
def map_comparison(t):
    return mapping.compare_maps(*maps_to_compare(t)).select("key", "prop", "status")


@query("mapping_metrics", DIFF + """
, k AS (SELECT node, count_if(status = 'matched') AS m, count_if(status = 'modified') AS o, count_if(status = 'added') AS a, count_if(status = 'deleted') AS dl FROM d GROUP BY node),
f AS (SELECT *, m + o + dl > 0 AS it, m + o + a > 0 AS ig FROM k),
s AS (SELECT count_if(it) AS nt, count_if(ig) AS ng, count_if(it AND ig AND o + a + dl = 0) AS nm, count_if(it AND ig AND o + a + dl > 0) AS nd, count_if(NOT ig) AS nmiss, count_if(NOT it) AS nx, sum(m) AS m, sum(o) AS o, sum(a) AS a, sum(dl) AS dl FROM f)
SELECT nt::BIGINT AS nodes_truth, ng::BIGINT AS nodes_generated, nm::BIGINT AS nodes_matched, nd::BIGINT AS nodes_with_diff, nmiss::BIGINT AS nodes_missing, nx::BIGINT AS nodes_extra,
 m::BIGINT AS pvs_matched, o::BIGINT AS pvs_modified, a::BIGINT AS pvs_added, dl::BIGINT AS pvs_deleted, round(nm / nt * 100, 1) AS node_accuracy, round((nm + nd) / nt * 100, 1) AS node_coverage,
 round(m / (m + o + dl) * 100, 1) AS pv_accuracy, round((m + o) / (m + o + a) * 100, 1) AS "precision", round(m / (m + o + dl) * 100, 1) AS recall FROM s""")
def mapping_metrics(t):
    return mapping.mapping_metrics(mapping.compare_maps(*maps_to_compare(t)))


def runs(t):
    li = t("lineitem").withColumn("name", F.concat(F.lit("S"), "l_suppkey"))
    q = lambda flag: li.filter(F.col("l_linestatus") == flag).groupBy("name").agg(F.round(F.avg("l_quantity"), 4).alias("pv_accuracy"))
    old, new = q("F"), q("O")
    same = new.select("name", F.col("name").alias("match"))
    return old, mapping.compare_runs(old, new, same)


RUNS = """WITH r AS (SELECT 'S' || l_suppkey AS name, l_linestatus AS s, round(avg(l_quantity), 4) AS v FROM lineitem GROUP BY ALL),
c AS (SELECT a.name, a.v AS old_value, b.v AS new_value, b.v - a.v AS delta FROM r a JOIN r b ON a.name = b.name AND a.s = 'F' AND b.s = 'O')
"""


@query("compare_runs", RUNS + "SELECT name, old_value, new_value, round(delta, 4) AS delta FROM c")
def compare_runs(t):
    return runs(t)[1].select("name", "old_value", "new_value", F.round("delta", 4).alias("delta"))


@query("run_summary", RUNS + """SELECT count(*)::BIGINT AS runs, count_if(delta > 0.1)::BIGINT AS improved, count_if(delta < -0.1)::BIGINT AS declined, round(avg(old_value), 4) AS mean_old, round(avg(delta), 4) AS mean_delta,
 arg_max(name, row(delta, name)) AS best_run, arg_min(name, row(delta, name)) AS worst_run FROM c""")
def run_summary(t):
    out = mapping.run_summary(runs(t)[1])
    return out.select("runs", "improved", "declined", F.round("mean_old", 4).alias("mean_old"), F.round("mean_delta", 4).alias("mean_delta"), "best_run", "worst_run")


@query("most_improved_runs", RUNS + "SELECT name FROM c WHERE delta > 0 ORDER BY round(delta, 4) DESC, name LIMIT 15")
def most_improved_runs(t):
    return mapping.extremes(runs(t)[1].withColumn("delta", F.round("delta", 4))).select("name")


@query("run_name_overlap", "SELECT coalesce(c, s) AS name, CASE WHEN c IS NOT NULL AND s IS NOT NULL THEN 'both' WHEN c IS NOT NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT DISTINCT c_nationkey || '/' || floor(c_acctbal / 100)::BIGINT AS c FROM customer) FULL JOIN (SELECT DISTINCT s_nationkey || '/' || floor(s_acctbal / 100)::BIGINT AS s FROM supplier) ON c = s")
def run_name_overlap(t):
    named = lambda df, p: df.select(F.concat_ws("/", f"{p}_nationkey", F.floor(F.col(f"{p}_acctbal") / 100).cast("string")).alias("name"))
    return mapping.name_overlap(named(t("customer"), "c"), named(t("supplier"), "s"), "name")


@query("match_run_names", """
WITH r AS (SELECT DISTINCT replace(p_name, ' ', '_') || '_' || p_size AS name FROM part), b AS (SELECT DISTINCT replace(p_name, ' ', '') || p_size AS match FROM part),
p AS (SELECT name, match, replace(replace(lower(name), '_', ''), '-', '') AS x, replace(replace(lower(match), '_', ''), '-', '') AS y FROM r, b),
s AS (SELECT name, match, CASE WHEN contains(x, y) OR contains(y, x) THEN CASE WHEN least(len(x), len(y)) / greatest(len(x), len(y)) < 0.5 THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END
  ELSE 1 - levenshtein(x, y) / greatest(len(x), len(y)) END AS score, list_has_any(string_split(lower(name), '_'), string_split(lower(match), '_')) AS shared FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, match) AS i FROM s)
SELECT name, match, round(score, 6) AS score FROM k WHERE i = 1 AND score >= 0.6 AND (shared OR score >= 0.75)""")
def match_run_names(t):
    sized = lambda joiner: F.concat(F.replace("p_name", F.lit(" "), F.lit(joiner)), F.lit(joiner), F.col("p_size"))
    found = mapping.match_run_names(t("part").select(sized("_").alias("name")), t("part").select(sized("").alias("match")))
    return found.withColumn("score", F.round("score", 6))
