"""The registered queries of this package with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import quality_fm, quality_rules
from ..session import materialise
from .common import bounded_batches, fresh_dir, located
from .exact import exact_dedup
from .hardneg import hard_negatives
from .mixture import curriculum
from .packing import pack
from .periodic import periodic_runs, planted
from .secrets import ALPHABET, CANDIDATE_LEAST, KINDS, LEAST, MARGIN, PATTERNS, STATES, find_secrets, standard
from .shards import shard
from .simhash import near_duplicates
from .substrings import remove_repeats
from .toolcalls import declared_tools, events_of, link
from .warc import deduplicate, read_archives, records_of, resolve, write_archives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(t)``, where ``t("documents")`` reads a table, under a name with its SQL."""
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_simhash")
def op1_simhash(t):
    return near_duplicates(t("documents")).select("doc_id", "fingerprint", "component_id")


@query("op3_quality_fm")
def op3_quality_fm(t):
    model = quality_fm.learn(t("documents"), t("labels"))
    return quality_fm.score(t("documents"), model)


@query("op9_quality_rules")
def op9_quality_rules(t):
    model = quality_rules.learn(t("documents"), t("labels"))
    return quality_rules.judge(t("documents"), model)


def _secret_matches() -> str:
    kinds = [*((i, PATTERNS[k], 2 if k == "assign" else 0, LEAST[k]) for i, k in enumerate(KINDS)), (3, "[A-Za-z0-9_-]+", 0, CANDIDATE_LEAST)]
    return " UNION ALL ".join(
        f"SELECT doc_id, {i} AS kind, {least} AS least, regexp_extract_all(t, {p}, 0) AS w, regexp_extract_all(t, {p}, {group}) AS v, string_split_regex(t, {p}) AS g FROM d"
        for i, pattern, group, least in kinds for p in ["'" + pattern.replace("'", "''") + "'"])


@query("op2_secrets", f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    m AS ({_secret_matches()}),
    e AS (SELECT doc_id, kind, least, i, len(g[i]) AS gap, len(w[i]) AS long, v[i] AS value FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM m)),
    s AS (SELECT doc_id, kind, value, least, long, (gap + coalesce(sum(gap + long) OVER (PARTITION BY doc_id, kind ORDER BY i
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS a FROM e),
    f AS (SELECT doc_id, kind, value, a, a + long AS z FROM s WHERE len(value) >= least),
    l AS (SELECT unnest(range({STATES * STATES})) AS pair, unnest({list(standard())}) AS llr),
    c AS (SELECT doc_id, a, z, instr('{ALPHABET}', substr(value, i, 1)) * {STATES} + instr('{ALPHABET}', substr(value, i + 1, 1)) AS pair
          FROM (SELECT *, unnest(range(1, len(value))) AS i FROM f WHERE kind = 3)),
    k AS (SELECT doc_id, a, z FROM c JOIN l USING (pair) GROUP BY 1, 2, 3 HAVING sum(llr - {MARGIN}) > 0),
    y AS (SELECT doc_id, kind, a, z FROM f WHERE kind < 3 UNION ALL
          SELECT doc_id, 3, a, z FROM k WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = k.doc_id AND f.kind < 3 AND f.a < k.z AND k.a < f.z)),
    o AS (SELECT doc_id, kind, ['assign', 'access', 'hex', 'markov'][kind + 1] || ':' || a || ':' || z AS txt, a FROM y)
    SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
      count(*) FILTER (kind = 3) AS n_markov, sha256(coalesce(string_agg(txt, ',' ORDER BY a, kind) FILTER (kind < 3), '')) AS base_sha256,
      coalesce(string_agg(txt, ',' ORDER BY a, kind), '') AS spans
    FROM d LEFT JOIN o USING (doc_id) GROUP BY doc_id""")
def op2_secrets(t):
    return find_secrets(t("documents"))


@query("op4_shards")
def op4_shards(t):
    out = shard(t("documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


SOURCE_KEY = "CASE WHEN source IS NULL THEN '1' ELSE '0' || source END"
WORD_COUNT = "len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))"


@query("op5_mixture", f"""
    WITH d AS (SELECT doc_id, {SOURCE_KEY} AS k, {WORD_COUNT}::BIGINT AS size, md5(doc_id::VARCHAR) AS o FROM documents),
    s AS (SELECT k, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY k) - 1 AS rank FROM d GROUP BY k),
    w AS (SELECT *, rank % 3 + 1 AS weight, 3 * source_size AS cap, (3 * source_size)::DOUBLE / (rank % 3 + 1) AS fills_at FROM s),
    b AS (SELECT *, coalesce(sum(cap) OVER prior, 0)::BIGINT AS caps_before, coalesce(sum(weight) OVER prior, 0)::BIGINT AS weights_before,
            sum(source_size) OVER ()::BIGINT AS total, sum(weight) OVER ()::BIGINT AS shares
          FROM w WINDOW prior AS (ORDER BY fills_at, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l AS (SELECT max((total - caps_before)::DOUBLE / (shares - weights_before)::DOUBLE) AS level FROM b),
    g AS (SELECT k, source_size, least(cap::DOUBLE, level * weight) AS target, [-0.8, 0.0, 0.8][rank % 3 + 1]::DOUBLE AS slope FROM b, l),
    p AS (SELECT doc_id, size, source_size, target, slope, coalesce(sum(size) OVER (PARTITION BY k ORDER BY o, size, doc_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + size / 2.0::DOUBLE AS first FROM d JOIN g USING (k)),
    q AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE (first <= target)::INT + (first + source_size <= target)::INT
            + (first + 2 * source_size <= target)::INT END AS copies, first / target AS share FROM p)
    SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::INT AS copies,
      CASE WHEN copies > 0 THEN 2.0::DOUBLE * share / ((1.0::DOUBLE - slope) + sqrt((1.0::DOUBLE - slope) * (1.0::DOUBLE - slope) + 4.0::DOUBLE * slope * share)) END AS position
    FROM q""")
def op5_mixture(t):
    mixed = curriculum(t("documents"))
    return (mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", F.get("positions", F.lit(0)).alias("position"))
            .orderBy(F.col("position").asc_nulls_last(), "doc_id"))


@query("op6_exact_dedup", """
    WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
    SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
    FROM n WINDOW g AS (PARTITION BY text_sha256)""")
def op6_exact_dedup(t):
    out = exact_dedup(t("documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@query("op7_tool_calls", """
    WITH a AS (SELECT conv_id AS conv, turn, 'c' || conv_id || '-' || turn AS id, ['search', 'fetch', 'convert'][len(text) % 3 + 1] AS name, len(text) AS n,
            'c' || conv_id || '-' || (turn // 2) AS need, text FROM conversations WHERE role = 'assistant'),
    r AS (SELECT conv_id AS conv, turn, 'c' || conv_id || '-' || (turn - 1) AS id, text FROM conversations WHERE role = 'user' AND turn > 0),
    l0 AS (SELECT id, need FROM a WHERE turn // 2 < turn),
    e AS (SELECT l0.id, l0.need FROM l0 JOIN a ON a.id = l0.need),
    l AS (WITH RECURSIVE w(id, level) AS (SELECT id, 0 FROM a WHERE id NOT IN (SELECT id FROM e) UNION ALL
            SELECT e.id, w.level + 1 FROM e JOIN w ON e.need = w.id) SELECT id, max(level) AS level FROM w GROUP BY id),
    c AS (SELECT conv, turn, id, 'call' AS event, '{"arguments":{' || CASE WHEN n % 11 = 0 THEN '"Extra":{"a":null,"b":true},' ELSE '' END || '"after":["' || need || '"],'
            || CASE WHEN n % 7 = 0 THEN '' WHEN n % 5 = 0 THEN '"limit":"' || (n % 50) || '",' ELSE '"limit":' || (n % 50) || ',' END
            || '"query":' || to_json(substr(text, 1, 60))::VARCHAR || '},"id":"' || id || '","name":"' || name || '","type":"call"}' AS json,
            CASE name WHEN 'convert' THEN 'unknown tool' ELSE array_to_string(list_sort(list_filter([
              CASE WHEN n % 7 = 0 AND name = 'fetch' THEN 'missing limit' END, CASE WHEN n % 7 <> 0 AND n % 5 = 0 THEN 'type of limit' END,
              CASE WHEN n % 11 = 0 AND name = 'search' THEN 'unknown Extra' END], lambda x: x IS NOT NULL)), ',') END AS problems FROM a),
    v AS (SELECT conv, turn, id, event, json, problems, id IN (SELECT id FROM r) AS linked FROM c UNION ALL
          SELECT conv, turn, id, 'result', '{"content":' || to_json(text)::VARCHAR || ',"id":"' || id || '","type":"result"}',
            CASE WHEN id IN (SELECT id FROM a) THEN '' ELSE 'no call' END, id IN (SELECT id FROM a) FROM r)
    SELECT conv, id, event, row_number() OVER (PARTITION BY conv ORDER BY coalesce(level, 1048576), turn, event, id, json) - 1 AS position, coalesce(level, -1) AS level, linked, problems, json
    FROM v LEFT JOIN l USING (id)""")
def op7_tool_calls(t):
    talks = t("conversations")
    linked = link(*events_of(talks), declared_tools(talks.sparkSession))
    return linked.withColumn("level", F.coalesce("level", F.lit(-1)))


@query("tool_calls_whole_texts", """
    WITH a AS (SELECT conv_id AS conv, turn, 'c' || conv_id || '-' || turn AS id, ['search', 'fetch', 'convert'][len(text) % 3 + 1] AS name, len(text) AS n,
            'c' || conv_id || '-' || (turn // 2) AS need, text FROM conversations WHERE role = 'assistant'),
    r AS (SELECT conv_id AS conv, turn, CASE role WHEN 'user' THEN 'c' || conv_id || '-' || (turn - 1) END AS id, text FROM conversations WHERE role IS DISTINCT FROM 'assistant'),
    l0 AS (SELECT id, need FROM a WHERE turn // 2 < turn),
    e AS (SELECT l0.id, l0.need FROM l0 JOIN a ON a.id = l0.need),
    l AS (WITH RECURSIVE w(id, level) AS (SELECT id, 0 FROM a WHERE id NOT IN (SELECT id FROM e) UNION ALL
            SELECT e.id, w.level + 1 FROM e JOIN w ON e.need = w.id) SELECT id, max(level) AS level FROM w GROUP BY id),
    c AS (SELECT conv, turn, id, 'call' AS event, '{"arguments":{' || CASE WHEN n % 11 = 0 THEN '"Extra":{"a":null,"b":true},' ELSE '' END || '"after":["' || need || '"],'
            || CASE WHEN n % 7 = 0 THEN '' WHEN n % 5 = 0 THEN '"limit":"' || (n % 50) || '",' ELSE '"limit":' || (n % 50) || ',' END
            || '"query":' || to_json(text)::VARCHAR || '},"id":"' || id || '","name":"' || name || '","type":"call"}' AS json,
            CASE name WHEN 'convert' THEN 'unknown tool' ELSE array_to_string(list_sort(list_filter([
              CASE WHEN n % 7 = 0 AND name = 'fetch' THEN 'missing limit' END, CASE WHEN n % 7 <> 0 AND n % 5 = 0 THEN 'type of limit' END,
              CASE WHEN n % 11 = 0 AND name = 'search' THEN 'unknown Extra' END], lambda x: x IS NOT NULL)), ',') END AS problems FROM a),
    v AS (SELECT conv, turn, id, event, json, problems, coalesce(id IN (SELECT id FROM r), false) AS linked FROM c UNION ALL
          SELECT conv, turn, id, 'result', '{"content":' || to_json(text)::VARCHAR || ',"id":' || coalesce('"' || id || '"', 'null') || ',"type":"result"}',
            CASE WHEN id IN (SELECT id FROM a) THEN '' ELSE 'no call' END, coalesce(id IN (SELECT id FROM a), false) FROM r)
    SELECT conv, id, event, row_number() OVER (PARTITION BY conv ORDER BY coalesce(level, 1048576), turn, event, id, json) - 1 AS position, coalesce(level, -1) AS level, linked, problems, json
    FROM v LEFT JOIN l USING (id)""")
def tool_calls_whole_texts(t):
    """As ``op7_tool_calls``, with every turn an event."""
    talks = t("conversations")
    linked = link(*events_of(talks, whole=True), declared_tools(talks.sparkSession))
    return linked.withColumn("level", F.coalesce("level", F.lit(-1)))


def _packing_sql(buckets: int = 16, budget: int = 65_536) -> str:
    """The dynamic programme with one CTE per bucket: layer k has the least cost of the first j cells in k buckets."""
    layers = ["l0 AS (SELECT 0::BIGINT AS j, 0::BIGINT AS cost, 0::BIGINT AS cut)"]
    for k in range(1, buckets + 1):
        layers.append(f"""l{k} AS MATERIALIZED (SELECT j, least.cost AS cost, least.a AS cut FROM (
            SELECT c.j, min({{'cost': p.cost + c.cell * (c.docs - q.docs) - (c.tokens - q.tokens), 'a': p.j}}) AS least
            FROM c JOIN l{k - 1} p ON p.j < c.j JOIN z q ON q.j = p.j GROUP BY c.j))""")
    back = [f"b{buckets} AS (SELECT j, cut FROM l{buckets} WHERE j = (SELECT max(j) FROM c))"]
    back += [f"b{k} AS (SELECT l{k}.j, l{k}.cut FROM l{k} JOIN b{k + 1} ON l{k}.j = b{k + 1}.cut)" for k in range(buckets - 1, 0, -1)]
    edges = " UNION ALL ".join(f"SELECT {k - 1} AS bucket, cell AS e FROM b{k} JOIN c USING (j)" for k in range(1, buckets + 1))
    step = "pow(2, greatest(0, ceil(log2(greatest(n, 1))) - 12))"
    return f"""WITH d AS (SELECT doc_id, {WORD_COUNT}::BIGINT AS n, md5(doc_id::VARCHAR) AS o FROM documents),
    h AS (SELECT CASE WHEN n <= 4096 THEN n ELSE (ceil(n / {step}) * {step})::BIGINT END AS cell, count(*) AS docs, sum(n)::BIGINT AS tokens FROM d GROUP BY 1),
    c AS MATERIALIZED (SELECT row_number() OVER w AS j, cell, (sum(docs) OVER w)::BIGINT AS docs, (sum(tokens) OVER w)::BIGINT AS tokens FROM h WINDOW w AS (ORDER BY cell)),
    z AS MATERIALIZED (SELECT j, docs, tokens FROM c UNION ALL SELECT 0, 0, 0), {", ".join(layers)}, {", ".join(back)}, e AS ({edges}),
    a AS (SELECT doc_id, n, o, min(bucket) AS bucket, min(e) AS e FROM d JOIN e ON n <= e.e GROUP BY 1, 2, 3),
    i AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY o, doc_id, n) - 1 AS pos, greatest(1, {budget} // greatest(1, e)) AS per FROM a)
    SELECT doc_id, n AS n_tokens, bucket, e AS bucket_len, pos // per AS batch, pos % per AS slot, e - n AS padding FROM i"""


@query("op8_packing", _packing_sql())
def op8_packing(t):
    return pack(t("documents"))


@query("op10_substring_dedup")
def op10_substring_dedup(t):
    out = remove_repeats(t("documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op11_warc_revisits", """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
    g AS (SELECT *, payload_bytes >= 1000 AND page_id < max(page_id) OVER (PARTITION BY h) AS again, max(page_id) OVER (PARTITION BY h) AS last FROM p)
    SELECT page_id, payload_bytes, sha1(h) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN again THEN last END AS refers_to FROM g""")
def op11_warc_revisits(t):
    pages = t("pages")
    path = fresh_dir(pages.sparkSession, "warc")
    write_archives(deduplicate(records_of(located(pages))), path)
    found = resolve(read_archives(pages.sparkSession, path, payloads=False))
    return found.select(F.col("key").alias("page_id"), "payload_bytes", F.col("sha1").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers_key").alias("refers_to"))


@query("op12_periodic_runs")
def op12_periodic_runs(t):
    docs = t("documents")
    found = periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("text")))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    length, period = best["length"], -best["period"]
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-best["start"]).alias("start"), length.alias("length"), period.alias("period"),
                       F.floor(1000 * length / period).cast("long").alias("exponent_milli"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
                       F.sha2("collapsed", 256).alias("collapsed_sha256"))
    with bounded_batches(docs.sparkSession):
        return materialise(out)


@query("op13_hard_negatives", """
    WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    a AS (SELECT vec_id AS anchor_id, label AS anchor_label, v AS anchor FROM r WHERE vec_id % 100 = 0),
    s AS (SELECT anchor_id, vec_id, label = anchor_label AS same, list_dot_product(anchor, v)::BIGINT AS score FROM a, r),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND vec_id <> anchor_id
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER w AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10""")
def op13_hard_negatives(t):
    rows = t("embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    found = hard_negatives(rows, F.col("vec_id") % 100 == 0)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
