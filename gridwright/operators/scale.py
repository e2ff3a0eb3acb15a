"""Building blocks that keep every operator distributed: checked broadcasts, exact global
positions, two-level carries and top-k per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Count the rows of ``df`` and their text size; every task sends one row of counts."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))).alias("b")).first()
    return row["n"] <= max_rows and (row["b"] or 0) <= max_bytes


def bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it was measured to be small, else unchanged.

    Measuring evaluates ``df``: use it for stored tables, not for results of long jobs.

    Unchanged means a shuffled join, whose hot keys adaptive execution splits because the lookup
    side holds one row per key.
    """
    return F.broadcast(df) if fits(df, max_rows, max_bytes) else df


def localised(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A measured-small table evaluated once and kept as a broadcast relation; larger ones are written out once.

    The small one is a single partition, so that further work on it needs no exchange.
    """
    if fits(df, max_rows, max_bytes):
        return F.broadcast(df.sparkSession.createDataFrame(df.toArrow()).coalesce(1))
    return materialise(df)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows evenly before costly row-wise work such as tokenising long texts: few pieces become
    many, and adaptive execution chooses how many. No job runs while the plan is built."""
    return df.repartition(*keys) if keys else df.hint("rebalance")


def settle(df: DataFrame) -> DataFrame:
    """Keep the computed columns as they are below this point.

    Filters pushed down through long derived columns copy those expressions into every reference,
    which makes plans of generated columns grow without bound. A partition-id column that the
    filter uses stops that; it costs no data movement.
    """
    return df.withColumn("_settled", F.spark_partition_id()).filter(F.col("_settled") >= 0).drop("_settled")


def with_position(df: DataFrame, order: Sequence[str | Column], name: str = "pos", weight: str | None = None) -> DataFrame:
    """Exact 0-based position of each row in the global order, without a single-task window.

    Range-partition and sort once, keep that layout as a table, then add per-partition offsets
    (as many rows as there are partitions). With ``weight`` the position is the sum of the weights
    of all rows before. The order should be close to unique so that ranges can split hot keys.
    """
    laid_out = (df.repartitionByRange(*order).sortWithinPartitions(*order)
                .withColumn("_mid", F.monotonically_increasing_id()))
    cut = materialise(laid_out).withColumn("_part", F.shiftright("_mid", 33))
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (cut.groupBy("_part").agg(size.alias("_n"))
               .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    if weight is None:
        local = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
        out = cut.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + local)
    else:
        inside = Window.partitionBy("_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
        out = (cut.withColumn("_local", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
               .join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_local")).drop("_local"))
    return out.drop("_mid", "_part", "_offset")


def carry_forward(df: DataFrame, by: Sequence[str], order: str, columns: Sequence[str], bucket: int = 20_000,
                  include_current: bool = True) -> DataFrame:
    """Replace each column by its last non-null value up to this row of the group.

    ``order`` is a long. The group is cut into buckets of the order value: one window inside the
    buckets, one over the bucket tails, so a group holding a third of all rows is still spread.
    """
    keyed = df.withColumn("_bucket", F.floor(F.col(order) / bucket))
    upto = Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    tails = keyed.groupBy(*by, "_bucket").agg(*[
        F.max_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.col(order))).alias(f"_t{i}") for i, c in enumerate(columns)])
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(*by, "_bucket", *[F.last(f"_t{i}", True).over(earlier).alias(f"_c{i}") for i in range(len(columns))])
    local = keyed.select("*", *[F.last(F.col(f"`{c}`"), True).over(upto).alias(f"_l{i}") for i, c in enumerate(columns)])
    joined = local.join(carried, [*by, "_bucket"], "left")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return joined.select(*kept, *[F.coalesce(f"_l{i}", f"_c{i}").alias(c) for i, c in enumerate(columns)])


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group; the filter on row_number lets Spark cut each task's share first."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def first_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Global first ``n`` rows (a distributed take-ordered)."""
    return df.orderBy(*order).limit(n)
