"""Fuzzy and vector matching, and merging of entities that share a key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import match_form
from ..session import materialise
from .scale import bounded, top_k


def grams(norm: Column, size: int = 4) -> Column:
    """Words of a normalised text (repeats kept) and its substrings of ``size`` that are no word."""
    ws = F.split(norm, " ")
    subs = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.length(norm) - size, F.lit(0))), lambda i: F.substr(norm, i + 1, F.lit(size))))
    return F.concat(ws, F.array_except(subs, ws))


def gram_match(queries: DataFrame, corpus: DataFrame, query: str = "query", key: str = "key", order: str = "id", min_fraction: float = 0.8,
               k: int | None = None, size: int = 4, fold_accents: bool = True) -> DataFrame:
    """Corpus keys that share at least ``min_fraction`` of a query's grams, best first.

    Score: sum of 1/df over shared grams, 100 per shared gram, 10000 per character that the first
    shared gram lies before the query's length. ``order`` breaks ties.

    Both sides are reduced to distinct normal forms first, so copies cost nothing. A match must
    share a gram outside the most frequent ones that together stay below the threshold; only those
    rarer grams generate candidates (an exact filter), each candidate is then verified on its whole
    gram lists. Returns ``query, key, <order>, score, hits, position, rank``.
    """
    norm = lambda c: match_form(F.col(c), fold_accents)
    q = queries.select(F.col(query).alias("query")).distinct().withColumn("qn", norm("query"))
    c = corpus.select(F.col(key).alias("key"), F.col(order).alias("ord")).withColumn("cn", norm("key"))
    forms = c.groupBy("cn").agg(F.count(F.lit(1)).alias("m")).withColumn("g", F.array_distinct(grams(F.col("cn"), size)))
    index = forms.select("cn", "m", F.explode("g").alias("gram"))
    df = index.groupBy("gram").agg(F.sum("m").alias("df"))

    qforms = q.select("qn").distinct().withColumn("g", grams(F.col("qn"), size))
    qgrams = qforms.select("qn", F.size("g").alias("n"), F.explode("g").alias("gram")).groupBy("qn", "n", "gram").agg(F.count(F.lit(1)).alias("mult"))
    known = qgrams.join(df, "gram")
    need = F.ceil(F.greatest(F.lit(1.0), F.col("n") * F.lit(min_fraction)))
    frequent_first = Window.partitionBy("qn").orderBy(F.col("df").desc(), "gram").rowsBetween(Window.unboundedPreceding, 0)
    probes = known.withColumn("_cum", F.sum("mult").over(frequent_first)).filter(F.col("_cum") >= need)
    pairs = probes.join(index.select("gram", "cn"), "gram").select("qn", "cn").distinct()

    lists = known.groupBy("qn", "n").agg(F.collect_list(F.struct("gram", "mult", "df")).alias("qg"))
    verified = pairs.join(lists, "qn").join(forms.select("cn", "g"), "cn")
    shared = verified.withColumn("s", F.filter("qg", lambda x: F.array_contains(F.col("g"), x["gram"])))
    total = lambda f: F.aggregate("s", F.lit(0.0), lambda a, x: a + f(x))
    scored = shared.select("qn", "cn", "n", total(lambda x: x["mult"].cast("double")).alias("hits"),
                           total(lambda x: x["mult"] / x["df"]).alias("rare"),
                           F.array_min(F.transform("s", lambda x: F.position(x["gram"], F.col("cn")) - 1)).alias("position"))
    good = scored.filter(F.col("hits") >= F.greatest(F.lit(1.0), F.col("n") * F.lit(min_fraction))).withColumn(
        "score", F.col("rare") + (F.length("qn") - F.col("position")) * 10000 + F.col("hits") * 100)
    members = c
    if k is not None:
        # ties keep corpus order, so no more than k members of one form can be in a result
        members = top_k(c, ["cn"], [F.col("ord")], k, "_mr").drop("_mr")
    found = good.join(members, "cn")
    w = Window.partitionBy("qn").orderBy(F.col("score").desc(), "ord")
    ranked = found.withColumn("rank", F.row_number().over(w))
    if k is not None:
        ranked = ranked.filter(F.col("rank") <= k)
    return q.join(ranked, "qn").select("query", "key", F.col("ord").alias(order), "score", "hits", "position", "rank")


MOST_CELLS, CELL_ROWS = 1024, 4096  # cells of a corpus, and rows of a cell that are compared at once
ZERO = -1  # the cell of vectors without length


def _unit_rows(column: pa.Array) -> np.ndarray:
    """Rows of a list column at length one; those without length stay zero."""
    rows = np.array(column.to_pylist(), dtype=float).reshape(len(column), -1)
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def _batch(rows: Sequence[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def vector_cells(corpus: DataFrame, corpus_id: str, vector: str, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, list]:
    """Unit vectors by cell (``cell``, ``piece``, ``id``, ``v``), stored; and per cell its middle, radius and number of rows.

    The middles are a sample of the corpus, one for about ``cell_rows`` rows, ``MOST_CELLS`` at most; a row belongs to the nearest.
    Large cells are dealt into pieces by a hash of the id.
    """
    rows = corpus.select(F.col(corpus_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    n = rows.count()
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(max(1, min(MOST_CELLS, -(-n // cell_rows)))).toArrow()
    middles = _unit_rows(chosen["v"].combine_chunks()) if n else np.zeros((0, 0))
    schema = pa.schema([("cell", pa.int32()), ("id", pa.int64()), ("v", pa.list_(pa.float64())), ("far", pa.float64())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _unit_rows(batch.column(1))
            if not len(v):
                continue
            dots = v @ middles.T
            cell = dots.argmax(axis=1).astype(np.int32)
            far = np.linalg.norm(v - middles[cell], axis=1)
            cell[~v.any(axis=1)] = ZERO
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(0), pa.array(v.tolist(), schema.types[2]), pa.array(far)], schema=schema)

    laid = materialise(rows.mapInArrow(assign, "cell int, id long, v array<double>, far double"))
    sizes = laid.groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).collect()
    cells = [(r["cell"], None if r["cell"] == ZERO else middles[r["cell"]], r["radius"], r["n"], max(1, -(-r["n"] // cell_rows))) for r in sizes]
    pieces = dict((c, p) for c, _, _, _, p in cells if p > 1)
    split = F.lit(1)
    for c, p in pieces.items():
        split = F.when(F.col("cell") == c, F.lit(p)).otherwise(split)
    return laid.select("cell", F.pmod(F.xxhash64("id"), split).alias("piece"), "id", "v"), cells


def near_cells(queries: DataFrame, cells: list, k: int) -> DataFrame:
    """Each unit query (``id``, ``v``) once for every piece of the cells that may hold one of its ``k`` nearest: ``cell, piece, id, v``.

    The nearest cells with ``k`` rows between them bound the kth distance; by the triangle inequality a cell whose
    middle is farther off than that and its radius together has none. Vectors without length are always met.
    """
    solid = [c for c in cells if c[0] != ZERO]
    middles = np.array([c[1] for c in solid])
    radius, counts = np.array([c[2] for c in solid]), np.array([c[3] for c in solid])
    always = [(c[0], piece) for c in cells if c[0] == ZERO for piece in range(c[4])]
    schema = pa.schema([("cell", pa.int32()), ("piece", pa.int64()), ("id", pa.int64()), ("v", pa.list_(pa.float64()))])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, q in zip(batch.column(0).to_pylist(), _unit_rows(batch.column(1)), strict=True):
                to = list(always)
                if len(solid):
                    far = np.linalg.norm(middles - q, axis=1)
                    order = np.argsort(far + radius, kind="stable")
                    enough = np.searchsorted(np.cumsum(counts[order]), k)
                    limit = np.inf if enough >= len(order) or not q.any() else (far + radius)[order[enough]]
                    to += [(solid[i][0], piece) for i in np.flatnonzero(far - radius <= limit + 1e-9).tolist() for piece in range(solid[i][4])]
                if to:
                    yield _batch([(c, piece, number, q.tolist()) for c, piece in to], schema)

    return queries.mapInArrow(route, "cell int, piece long, id long, v array<double>")


def vector_top_k(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", corpus_id: str = "id", vector: str = "embedding",
                 cell_rows: int = CELL_ROWS) -> DataFrame:
    """Exact cosine top-k: ``query_id, id, score, rank``; equal scores by id.

    The corpus lies in cells with a middle and a radius; a query is sent, as a row, to the cells that may hold one of its
    best, and streams past each. Only the sampled middles (``MOST_CELLS`` at most) pass through the driver. Vectors without
    length score 0. Null vectors are left out; ids are longs.
    """
    laid, cells = vector_cells(corpus, corpus_id, vector, cell_rows)
    asked = queries.select(F.col(query_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    routed = near_cells(asked, cells, k)
    both = laid.withColumn("kind", F.lit(0)).unionByName(routed.withColumn("kind", F.lit(1)))
    parts = max(1, min(sum(c[4] for c in cells), 10_000))
    stream = both.repartition(parts, "cell", "piece").sortWithinPartitions("cell", "piece", "kind").select("cell", "piece", "kind", "id", "v")
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, rows, ids = None, [], None, None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            found: list[tuple] = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if tuple(keys[a, :2]) != now:
                    now, held, rows = tuple(keys[a, :2]), [], None
                number = batch.column(3).slice(a, b - a).to_numpy()
                v = np.array(batch.column(4).slice(a, b - a).to_pylist(), dtype=float).reshape(b - a, -1)
                if keys[a, 2] == 0:
                    held.append((number, v))
                    continue
                if rows is None and held:
                    ids, rows, held = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), []
                for q, one in zip(number.tolist(), v, strict=True):
                    if rows is not None:
                        scores = np.einsum("ij,j->i", rows, one)  # the same for equal rows wherever they lie
                        best = np.lexsort((ids, -scores))[:k]
                        found += [(q, int(ids[i]), float(scores[i])) for i in best.tolist()]
            if found:
                yield _batch(found, schema)

    best = stream.mapInArrow(compare, "query_id long, id long, score double")
    return top_k(best, ["query_id"], [F.col("score").desc(), F.col("id")], k)


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Connected components of a two-sided graph (entity, key value): ``entity, component``.

    Every round, entities hear the smallest label of their keys, the whole group of a label joins
    the smallest label any of its members heard, and labels jump to the label of their label, so
    rounds grow with the logarithm of the group size even on long chains. All steps are minima
    combined on the map side or joins against one row per key; each round is cut into a table, and rounds go on until no label moves.
    """
    links = materialise(edges.select(F.col(left).alias("e"), F.col(right).alias("k")).distinct())
    labels = materialise(links.groupBy("e").agg(F.min("e").alias("label")))
    while True:
        at_key = links.join(labels, "e").groupBy("k").agg(F.min("label").alias("m"))
        heard = links.join(at_key, "k").groupBy("e").agg(F.min("m").alias("m"))
        step = labels.join(heard, "e")
        hook = step.groupBy("label").agg(F.min("m").alias("h"))
        moved = step.join(hook, "label").select("e", F.col("label").alias("old"), F.least("m", "h").alias("new"))
        up = moved.select(F.col("e").alias("_e"), F.col("new").alias("_up"))
        nxt = materialise(moved.join(up, F.col("new") == F.col("_e"), "left").select("e", "old", F.least("new", "_up").alias("label")))
        labels = nxt.select("e", "label")
        if not nxt.filter(F.col("old") != F.col("label")).head(1):
            break
    return labels.select(F.col("e").alias("entity"), F.col("label").alias("component"))


def merge_entities(entities: DataFrame, id_column: str, key_columns: Sequence[str], fold_accents: bool = True) -> DataFrame:
    """Entities that share any key value (in normal form) are one: long ``component, prop, value`` rows.

    Sharing is transitive. Values stay in long form, so a merged entity of any size needs no single row.
    """
    pairs = [F.struct(F.lit(c).alias("prop"), F.col(f"`{c}`").cast("string").alias("value")) for c in entities.columns if c != id_column]
    long = entities.select(F.col(id_column).alias("entity"), F.explode(F.array(*pairs)).alias("p")).select("entity", "p.prop", F.explode(F.split("p.value", ",")).alias("value"))
    long = long.filter(F.trim("value") != "").withColumn("value", F.trim("value"))
    keys = long.filter(F.col("prop").isin(*key_columns)).select("entity", F.concat_ws(":", "prop", match_form(F.col("value"), fold_accents)).alias("key"))
    comp = components(keys, "entity", "key")
    alone = F.coalesce("component", "entity")
    return long.join(comp, "entity", "left").select(alone.alias("component"), "prop", "value").distinct()


def schema_search(queries: DataFrame, nodes: DataFrame, types: Sequence[str], subclass: DataFrame, range_of: DataFrame, query: str = "query",
                  min_fraction: float = 0.7, k: int = 10) -> DataFrame:
    """Schema nodes whose text matches a query, restricted to some types and their subclasses, as ``prop: node``.

    ``nodes``: id, typeOf, text. ``subclass``: child, parent. ``range_of``: prop, type.
    """
    from .places import closure

    spark = nodes.sparkSession
    wanted = spark.createDataFrame([(t,) for t in types], "type string")
    below = closure(subclass.select(F.col("child").alias("node"), F.col("parent").alias("parent")))
    allowed = wanted.unionByName(below.join(F.broadcast(wanted), F.col("ancestor") == F.col("type")).select(F.col("node").alias("type"))).distinct()
    usable = nodes.join(bounded(allowed), F.col("typeOf") == F.col("type"), "left_semi")
    hits = gram_match(queries, usable, query, "text", "id", min_fraction, k)
    typed = hits.join(usable.select("id", "typeOf"), "id")
    props = bounded(range_of.groupBy("type").agg(F.min("prop").alias("prop")))
    return typed.join(props, F.col("typeOf") == F.col("type"), "left").select("query", "id", "typeOf", F.coalesce("prop", "typeOf").alias("prop"), "score", "rank")
