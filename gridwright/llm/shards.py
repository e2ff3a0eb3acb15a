"""Sharding by sampled splitters: shards of near equal bytes, equal texts side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise
from .common import literal_array, text_of

LOWEST = -(1 << 63)


def _range_of(splitters: list[tuple[int, int]]) -> Column:
    """Number of splitters at or before ``(key, sub)``: a binary search in two constant arrays."""
    n = len(splitters)
    if not n:
        return F.lit(0)
    keys, subs = literal_array([s[0] for s in splitters]), literal_array([s[1] for s in splitters])
    steps = literal_array([1 << b for b in range(n.bit_length() - 1, -1, -1)], "int")

    def step(low: Column, width: Column) -> Column:
        at = low + width
        key = F.get(keys, at - 1)
        below = (key < F.col("key")) | ((key == F.col("key")) & (F.get(subs, at - 1) <= F.col("sub")))
        return F.when((at <= n) & below, at).otherwise(low)

    return F.aggregate(steps, F.lit(0), step)


def _draw(rows: DataFrame, wanted: int) -> list[tuple[int, int]]:
    """At most ``wanted`` keys, drawn with chances in proportion to size: the smallest of
    ``-ln(u) / size``, with ``u`` from a hash of the row, so that a rerun draws the same."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit("draw"), "key", "sub", "size"), 11) + 0.5) / F.lit(float(1 << 53))
    return [(r["key"], r["sub"]) for r in rows.select("key", "sub", (-F.log(u) / F.col("size")).alias("at"))
            .orderBy("at", "key", "sub").limit(wanted).select("key", "sub").collect()]


def _boundaries(sample: list[tuple[int, int]], wanted: int) -> set[tuple[int, int]]:
    """Quantiles of the sample. A key met once is cut before its first row, so small groups stay whole."""
    sample = sorted(sample)
    picked = sorted({sample[i * len(sample) // wanted] for i in range(1, wanted)}) if sample else []
    met: dict[int, int] = {}
    for k, _ in picked:
        met[k] = met.get(k, 0) + 1
    return {(k, s if met[k] > 1 else LOWEST) for k, s in picked}


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 50_000,
          most_ranges: int = 16_384, whole_share: int = 20) -> DataFrame:
    """Deal every document to one of ``shards`` shards of near equal bytes.

    Size-weighted key samples give quantile boundaries of many small ranges; each range is measured
    exactly and one over four times the mean is divided again by a sample of its own. The measured
    ranges give every row its exact byte offset, and that gives its shard. The key is a hash of
    the text, then a hash of the identifier, so equal texts are neighbours and a hot text is cut by
    identifiers. A group of equal texts of at most ``1 / whole_share`` of a shard stays in one shard.
    At most ``4 * most_ranges`` sampled keys and ``most_ranges`` measured ranges (and their
    divisions) come to the driver, however large the table.

    Returns id, ``size`` (UTF-8 bytes + 16), ``text_crc32``, ``shard``, ``slot`` (0, 1, ... in a shard).
    Null text: no bytes. Null ids and repeated rows are placed like others; empty table: no rows.
    Only the two named columns are read, so other columns can't clash.
    """
    text = text_of(text_col)
    rows = materialise(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("sub")))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("total")).first()
    total, wanted = max(1, seen["total"]), max(8 * shards, min(most_ranges, seen["n"] // rows_per_range))
    splitters = sorted(_boundaries(_draw(rows, 4 * wanted), wanted))
    while True:
        ranged = rows.withColumn("range", _range_of(splitters))
        measured = {r["range"]: r for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()}
        over = [r for r, m in measured.items() if m["bytes"] > 4 * total / wanted and m["n"] > 1]
        more: set[tuple[int, int]] = set()
        if over:
            inside = ranged.filter(F.array_contains(literal_array(over, "int"), F.col("range")))
            more = {(k, s) for k, s in _draw(inside, 16 * len(over))} - set(splitters)
        if not more:
            break
        splitters = sorted({*splitters, *more})
    bytes_before, rows_before, b, n = [], [], 0, 0
    for r in range(len(splitters) + 1):
        bytes_before.append(b)
        rows_before.append(n)
        if r in measured:
            b, n = b + measured[r]["bytes"], n + measured[r]["n"]

    upto = Window.partitionBy("range").orderBy("key", "sub", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy("range", "key")
    placed = (ranged.withColumn("before", F.coalesce(F.sum("size").over(upto), F.lit(0)))
              .withColumn("row", F.count(F.lit(1)).over(upto))
              .withColumn("group_bytes", F.sum("size").over(group)).withColumn("group_before", F.min("before").over(group)))
    whole = F.col("group_bytes") * (shards * whole_share) <= total
    twice = F.when(whole, 2 * F.col("group_before") + F.col("group_bytes")).otherwise(2 * F.col("before") + F.col("size"))
    middle = 2 * F.get(literal_array(bytes_before), F.col("range")) + twice
    numbered = materialise(placed.select(
        "id", "size", "text_crc32", (F.get(literal_array(rows_before), F.col("range")) + F.col("row")).alias("at"),
        F.least(F.lit(shards - 1), F.floor(middle.cast("decimal(38,0)") * shards / (2 * total))).cast("int").alias("shard")))
    firsts = numbered.groupBy("shard").agg(F.min("at").alias("first"))  # one row per shard
    return (numbered.join(F.broadcast(firsts), "shard")
            .select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot")))
