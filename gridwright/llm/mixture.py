"""Mixing sources to target weights along a curriculum that changes over the training run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators.scale import with_position
from ..session import materialise
from .common import chunk_bits, hex_bits, in_chunks, text_of, word_count


def source_targets(sizes: DataFrame, weights: Sequence[int], most_repeats: int) -> DataFrame:
    """Targets per source: one row of ``key`` (sortable), ``size`` in, ``weight``, ``target`` added.

    All sizes together are shared out by weight; a source takes at most ``most_repeats`` times its
    size and the excess goes to the others by weight. Sorted by the level at which they fill up,
    the filled sources are a prefix, and the final level is the largest of the levels that each
    prefix would leave. Exact, and without a single task that sees all sources.
    """
    ranked = with_position(sizes, ["key"], "rank")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    filled = (ranked.withColumn("weight", weight).withColumn("cap", F.col("size") * most_repeats)
              .withColumn("fills_at", F.col("cap") / F.col("weight")))
    before = with_position(with_position(filled, ["fills_at", "key"], "caps_before", "cap"), ["fills_at", "key"], "weights_before", "weight")
    stored = materialise(before)
    sums = stored.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    total, shares = sums["size"] or 0, sums["weight"] or 1
    level = (F.lit(total) - F.col("caps_before")).cast("double") / (F.lit(shares) - F.col("weights_before")).cast("double")
    top = stored.agg(F.max(level).alias("level")).first()["level"] or 0.0
    return stored.select("key", "size", "weight", "rank",
                         F.least(F.col("cap").cast("double"), F.lit(float(top)) * F.col("weight")).alias("target"))


def curriculum(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), slopes: Sequence[float] = (-0.8, 0.0, 0.8), most_repeats: int = 3,
               id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: Sequence[str] = ()) -> DataFrame:
    """Decide how often each document is taken and where in training.

    The size of a document is its number of words. Sources in code-point order, null last, take
    ``weights`` in turn. A source's weight over the run, time 0 to 1, is ``1 + slope * (2t - 1)``
    with ``slopes`` in turn; its integral is the share of the target used up by time t, and solving
    that quadratic for t places a document whose words lie in the middle of that share. Within a
    source documents stand in the order of an md5 of their id, pass after pass, and one is taken if
    its middle word lies within the target: every source ends within half a document of its target.

    Returns the id, ``size``, ``source_size``, ``target``, ``copies``, ``taken`` and ``positions``
    (one training position per copy), and the columns of ``keep``. Null text and text without words
    have size 0 and are never taken. Repeated rows count separately. Empty table: no rows.
    """
    text = text_of(text_col)
    key = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col)))
    rows = materialise(docs.select(
        F.col(id_col).alias("__id"), key.alias("__key"), word_count(text).alias("__size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("__order"),
        *[F.col(c).alias(f"__keep_{c}") for c in keep]))
    per_source = rows.groupBy(F.col("__key").alias("key")).agg(F.sum("__size").alias("size"))
    targets = source_targets(per_source, weights, most_repeats)
    chunked = rows.withColumn("__chunk", hex_bits(F.col("__order"), chunk_bits(rows.count())))
    placed = in_chunks(chunked, ["__key"], "__chunk", ["__order", "__size", "__id"], {"__before": "__size"})
    # one row per source; a hot source on the other side is split by adaptive execution
    joined = placed.join(targets.select(F.col("key").alias("__key"), F.col("size").alias("source_size"), "target", "rank"), "__key")
    slope = F.element_at(F.array(*[F.lit(float(s)) for s in slopes]), (F.col("rank") % len(slopes) + 1).cast("int"))
    first = F.col("__before") + F.col("__size") / 2.0

    def position(turn):
        share = (first + turn * F.col("source_size")) / F.col("target")
        return 2.0 * share / ((1.0 - slope) + F.sqrt((1.0 - slope) * (1.0 - slope) + 4.0 * slope * share))

    taken = F.filter(F.sequence(F.lit(0), F.lit(most_repeats - 1)),
                     lambda turn: (F.col("__size") > 0) & (first + turn * F.col("source_size") <= F.col("target")))
    out = joined.withColumn("__turns", taken)
    return out.select(
        F.col("__id").alias(id_col), F.col("__size").alias("size"), "source_size", "target", F.size("__turns").alias("copies"),
        (F.size("__turns") * F.col("__size")).cast("long").alias("taken"), F.transform("__turns", position).alias("positions"),
        *[F.col(f"__keep_{c}").alias(c) for c in keep])


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per copy, range-sorted by training position (ties by id): files in that order are the run."""
    copies = mixed.select("*", F.posexplode("positions").alias("copy", "position")).drop("positions")
    return copies.orderBy("position", copies.columns[0], "copy")
