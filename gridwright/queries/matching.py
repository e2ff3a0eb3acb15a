"""Fuzzy, vector and place matching."""

from pyspark.sql import functions as F

from ..operators import match as m, places as pl
from ..operators.scale import bounded
from .registry import query

GRAMS = r"""
q AS (SELECT DISTINCT p_name || ' item' AS query, p_name || ' item' AS qn FROM part),
c AS (SELECT DISTINCT p_name || ' ' || p_type AS key, lower(p_name || ' ' || p_type) AS cn FROM part),
cg AS (SELECT DISTINCT cn, g FROM (SELECT cn, unnest(list_concat(string_split(cn, ' '), list_transform(range(1, greatest(len(cn) - 4, 0) + 2), lambda i: substr(cn, i, 4)))) AS g FROM c)),
df AS (SELECT g, count(*) AS df FROM cg GROUP BY g),
ql AS (SELECT qn, list_concat(string_split(qn, ' '), list_filter(list_distinct(list_transform(range(1, greatest(len(qn) - 4, 0) + 2), lambda i: substr(qn, i, 4))), lambda s: NOT list_contains(string_split(qn, ' '), s))) AS gs FROM q),
qg AS (SELECT qn, len(gs) AS n, unnest(gs) AS g FROM ql),
s AS (SELECT qn, cn, n, count(*) AS hits, sum(1.0 / df) AS rare, min(instr(cn, g) - 1) AS pos FROM qg JOIN df USING (g) JOIN cg USING (g) GROUP BY qn, cn, n),
r AS (SELECT qn, cn, hits, pos, rare + (len(qn) - pos) * 10000 + hits * 100 AS score FROM s WHERE hits >= greatest(1, n * {f}))
"""


GRAM_TAIL = GRAMS[GRAMS.index("cg AS"):]


def gram_sides(t):
    q = t("part").select(F.concat(F.col("p_name"), F.lit(" item")).alias("query")).distinct()
    c = t("part").select(F.concat_ws(" ", "p_name", "p_type").alias("key")).distinct().withColumn("id", F.col("key"))
    return q, c


@query("gram_match", "WITH " + GRAMS.format(f="0.6") + """SELECT query, key, hits::DOUBLE AS hits, pos::BIGINT AS position, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, key)::BIGINT AS rank
FROM r JOIN q USING (qn) JOIN c USING (cn) QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, key) <= 3""")
def gram_match(t):
    q, c = gram_sides(t)
    out = m.gram_match(q, c, min_fraction=0.6, k=3)
    return out.select("query", "key", "hits", F.col("position").cast("long").alias("position"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("vector_top_k", """
WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
q AS (SELECT label, i, avg(x) AS x FROM e GROUP BY 1, 2), qn AS (SELECT label, sqrt(sum(x * x)) AS n FROM q GROUP BY 1), en AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM e GROUP BY 1),
s AS (SELECT q.label, e.vec_id, sum(q.x * e.x) AS d FROM q JOIN e ON q.i = e.i GROUP BY 1, 2)
SELECT s.label::BIGINT AS query_id, s.vec_id AS id, round(d / qn.n / en.n, 6) AS score, row_number() OVER (PARTITION BY s.label ORDER BY d / qn.n / en.n DESC, s.vec_id)::BIGINT AS rank
FROM s JOIN qn ON qn.label = s.label JOIN en ON en.vec_id = s.vec_id QUALIFY row_number() OVER (PARTITION BY s.label ORDER BY d / qn.n / en.n DESC, s.vec_id) <= 5""")
def vector_top_k(t):
    e = t("embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centre = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding")).select(F.col("label").alias("query_id"), "embedding")
    out = m.vector_top_k(centre, e, 5, "query_id", "vec_id")
    return out.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def gazetteer(t):
    """Nations in regions in the world."""
    n, r = t("nation"), t("region")
    nations = n.select(F.concat(F.lit("country/"), "n_name").alias("dcid"), F.lit("Country").alias("typeOf"), F.col("n_name").alias("name"),
                       F.concat(F.lit("N"), "n_nationkey").alias("alternate_name"), F.array(F.concat(F.lit("region/"), "n_regionkey")).alias("containedInPlace"))
    regions = r.select(F.concat(F.lit("region/"), "r_regionkey").alias("dcid"), F.lit("Continent").alias("typeOf"), F.col("r_name").alias("name"), F.lit("").alias("alternate_name"),
                       F.array(F.lit("world/all")).alias("containedInPlace"))
    return nations.unionByName(regions)


@query("containment_closure", """
WITH RECURSIVE e AS (SELECT 'country/' || n_name AS node, 'region/' || n_regionkey AS parent FROM nation UNION ALL SELECT 'region/' || r_regionkey, 'world/all' FROM region),
c AS (SELECT node, parent AS ancestor, 1 AS level FROM e UNION ALL SELECT c.node, e.parent, level + 1 FROM c JOIN e ON e.node = c.ancestor)
SELECT node, ancestor, min(level)::BIGINT AS level FROM c GROUP BY 1, 2""")
def containment_closure(t):
    return pl.closure(pl.contained_edges(gazetteer(t))).withColumn("level", F.col("level").cast("long"))


@query("ranked_parents", """SELECT 'c' || c_custkey AS node, p AS parent, ty AS type, row_number() OVER (PARTITION BY c_custkey ORDER BY CASE ty WHEN 'Country' THEN 1 WHEN 'Continent' THEN 2 ELSE 3 END, p)::BIGINT AS parent_rank
FROM customer JOIN nation ON n_nationkey = c_nationkey, LATERAL (SELECT unnest(['country/' || n_name, 'region/' || n_regionkey, 'segment/' || c_mktsegment]) AS p, unnest(['Country', 'Continent', NULL]) AS ty)""")
def ranked_parents(t):
    c = t("customer").join(bounded(t("nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    edges = c.select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.explode(F.array(F.concat(F.lit("segment/"), "c_mktsegment"), F.concat(F.lit("region/"), "n_regionkey"), F.concat(F.lit("country/"), "n_name"))).alias("parent"))
    out = pl.ranked_parents(edges, gazetteer(t).select(F.col("dcid").alias("node"), F.col("typeOf").alias("type")), ["Country", "Continent"])
    return out.withColumn("parent_rank", F.col("parent_rank").cast("long"))


@query("resolve_places", """
WITH s AS (SELECT DISTINCT CASE WHEN c_mktsegment = 'BUILDING' THEN 'dcid:country/N' || c_nationkey WHEN c_mktsegment = 'MACHINERY' THEN 'mapped ' || c_nationkey WHEN c_mktsegment = 'FURNITURE' THEN 'NATION_' || c_nationkey ELSE 'nowhere ' || c_custkey END AS name FROM customer)
SELECT name, CASE WHEN name LIKE 'dcid:%' THEN name WHEN name LIKE 'mapped %' THEN 'dcid:country/M' || split_part(name, ' ', 2) ELSE 'dcid:country/' || name END AS dcid,
 CASE WHEN name LIKE 'dcid:%' THEN 'id' WHEN name LIKE 'mapped %' THEN 'map' ELSE 'table' END AS step FROM s WHERE name NOT LIKE 'nowhere%'""")
def resolve_places(t):
    seg, nat = F.col("c_mktsegment"), F.col("c_nationkey").cast("string")
    names = t("customer").select(F.when(seg == "BUILDING", F.concat(F.lit("dcid:country/N"), nat)).when(seg == "MACHINERY", F.concat(F.lit("mapped "), nat))
                                 .when(seg == "FURNITURE", F.concat(F.lit("NATION_"), nat)).otherwise(F.concat(F.lit("nowhere "), F.col("c_custkey").cast("string"))).alias("place"))
    n = t("nation")
    mapped = n.select(F.concat(F.lit("mapped "), "n_nationkey").alias("name"), F.concat(F.lit("country/M"), "n_nationkey").alias("dcid"))
    table = n.select(F.col("n_name").alias("name"), F.concat(F.lit("country/"), "n_name").alias("dcid"))
    return pl.resolve_places(names, "place", mapped, table)[0]


NORMAL = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}} ]', '', 'g')"


@query("place_name_match", f"""
WITH n AS (SELECT 'country/' || n_name AS dcid, n_name, 'N' || n_nationkey AS alt, r_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey),
f AS (SELECT dcid, n_name AS key FROM n UNION SELECT dcid, alt FROM n UNION SELECT dcid, n_name || ' ' || r_name FROM n UNION SELECT dcid, alt || ' ' || r_name FROM n),
c AS (SELECT dcid, key, {NORMAL.format('key')} AS cn FROM f),
q AS (SELECT DISTINCT n_name || ' ' || r_name AS query, {NORMAL.format("n_name || ' ' || r_name")} AS qn FROM customer JOIN n ON c_nationkey = n_nationkey),
""" + GRAM_TAIL.format(f="0.1") + """,
h AS (SELECT query, dcid, key, score FROM r JOIN q USING (qn) JOIN c USING (cn)),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query, dcid ORDER BY round(score, 9) DESC, key DESC) = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, dcid) AS rank FROM b)
SELECT query, dcid, round(score, 6) AS score, key AS matched_name, rank FROM k WHERE rank <= 3""")
def place_name_match(t):
    names = t("customer").join(bounded(t("nation").join(bounded(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))), F.col("c_nationkey") == F.col("n_nationkey"))
    queries = names.select(F.concat_ws(" ", "n_name", "r_name").alias("query")).distinct()
    return pl.match_names(queries, gazetteer(t), k=3, types=["Country"]).withColumn("score", F.round("score", 6))


@query("place_matches_wide", """
SELECT n_name || ' ' || r_name AS query, 'country/' || n_name AS dcid_1 FROM nation JOIN region ON n_regionkey = r_regionkey""")
def place_matches_wide(t):
    n = t("nation").join(bounded(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    exact = n.select(F.concat_ws(" ", "n_name", "r_name").alias("query"))
    hits = pl.match_names(exact, gazetteer(t), k=1, types=["Country"], min_fraction=1.0)
    return pl.wide_matches(hits, 1)


@query("filter_resolved_places", "SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR c_nationkey < 5")
def filter_resolved_places(t):
    rows = t("customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.array(F.col("c_nationkey").cast("string"))).otherwise(F.array().cast("array<string>")).alias("within"))
    return pl.filter_resolved(rows, {"within": ["0", "1", "2", "3", "4"]}).select("c_custkey")


@query("code_list_join", "SELECT c_custkey, 'country/' || n_name AS dcid FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3")
def code_list_join(t):
    codes = t("nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("code"), F.concat(F.lit("country/"), "n_name").alias("dcid"))
    return pl.by_code(t("customer"), "c_nationkey", codes).select("c_custkey", "dcid")


@query("containing_areas", """
WITH p AS (SELECT c_custkey, (c_custkey * 37 % 3600) / 10.0 - 180 + 0.03 AS lon, (c_custkey * 91 % 1800) / 10.0 - 90 + 0.03 AS lat FROM customer),
a AS (SELECT n_name AS area, n_nationkey * 14 - 180 AS x0, n_nationkey * 14 - 155 AS x1, n_regionkey * 30 - 90 AS y0, n_regionkey * 30 - 50 AS y1 FROM nation)
SELECT c_custkey, area FROM p JOIN a ON lon > x0 AND lon < x1 AND lat > y0 AND lat < y1""")
def containing_areas(t):
    pts = t("customer").select("c_custkey", ((F.col("c_custkey") * 37 % 3600) / 10.0 - 180 + 0.03).alias("lon"), ((F.col("c_custkey") * 91 % 1800) / 10.0 - 90 + 0.03).alias("lat"))
    x, y = F.col("n_nationkey") * 14 - 180, F.col("n_regionkey") * 30 - 90
    corner = lambda dx, dy: F.struct((x + dx).cast("double").alias("lon"), (y + dy).cast("double").alias("lat"))
    areas = t("nation").select(F.col("n_name").alias("area"), F.array(corner(0, 0), corner(25, 0), corner(25, 40), corner(0, 40)).alias("ring"))
    return pl.containing_areas(pts, areas).select("c_custkey", "area")


@query("merge_entities", """
WITH RECURSIVE k AS (SELECT c_custkey AS e, 'a' || c_nationkey || '-' || floor(c_acctbal / 20) AS k FROM customer UNION ALL SELECT c_custkey, 'b' || c_mktsegment || '-' || floor((c_acctbal + 10) / 20) FROM customer),
r AS (SELECT DISTINCT e, e AS f FROM k UNION SELECT r.e, b.e FROM r JOIN k a ON a.e = r.f JOIN k b ON a.k = b.k)
SELECT e AS entity, min(f) AS component FROM r GROUP BY e""")
def merge_entities(t):
    b = lambda shift: F.floor((F.col("c_acctbal") + shift) / 20)
    rows = t("customer").select("c_custkey", F.concat_ws(" ", F.lit("a"), "c_nationkey", b(0)).alias("key_a"), F.concat_ws(" ", F.lit("b"), "c_mktsegment", b(10)).alias("key_b"))
    edges = rows.select("c_custkey", F.explode(F.array("key_a", "key_b")).alias("k"))
    return m.components(edges, "c_custkey", "k")


@query("merged_entity_values", "SELECT count(*)::BIGINT AS n_rows, count(DISTINCT p_brand)::BIGINT AS n_components FROM (SELECT DISTINCT p_brand, p_name FROM part UNION ALL SELECT DISTINCT p_brand, 'b' || p_brand FROM part)")
def merged_entity_values(t):
    rows = t("part").select("p_partkey", F.replace("p_brand", F.lit("#"), F.lit("")).alias("brand"), F.col("p_name").alias("name"))
    out = m.merge_entities(rows, "p_partkey", ["brand"])
    return out.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("component").alias("n_components"))


@query("schema_search", """
WITH p AS (SELECT p_name, p_partkey, p_name || ' ' || p_type AS key, upper(p_type[1]) || lower(substr(p_type, 2)) AS kind FROM part),
q AS (SELECT DISTINCT p_name AS query, lower(p_name) AS qn FROM p),
c AS (SELECT key, lower(key) AS cn, min(p_partkey) AS id, min(kind) AS kind FROM p GROUP BY 1, 2 HAVING min(kind) IN ('Small', 'Medium', 'Large')),
""" + GRAM_TAIL.format(f="0.7") + """,
k AS (SELECT query, id, kind, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank FROM r JOIN q USING (qn) JOIN c USING (cn))
SELECT query, id, kind AS "typeOf", 'is' || kind AS prop, round(score, 6) AS score, rank FROM k WHERE rank <= 3""")
def schema_search(t):
    p = t("part")
    nodes = p.groupBy(F.concat_ws(" ", "p_name", "p_type").alias("text")).agg(F.min("p_partkey").alias("id"), F.min(F.initcap("p_type")).alias("typeOf"))
    sub = p.select(F.initcap("p_type").alias("child"), F.when(F.col("p_type").isin("SMALL", "LARGE", "MEDIUM"), F.lit("Sized")).otherwise(F.lit("Other")).alias("parent")).distinct()
    rng = p.select(F.concat(F.lit("is"), F.initcap("p_type")).alias("prop"), F.initcap("p_type").alias("type")).distinct()
    return m.schema_search(p.select(F.col("p_name").alias("query")).distinct(), nodes, ["Sized"], sub, rng, k=3).withColumn("score", F.round("score", 6))
