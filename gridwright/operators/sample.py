"""Samples that keep every value of the categorical columns, seeded and repeatable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise
from .grid import TOTAL_WORDS
from .profile import long_values
from .scale import bounded, first_rows


def row_hash(ids: Sequence[str], seed: int = 42) -> Column:
    """Repeatable random order of rows: an md5 of the seed and the ids, in hex."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(f"`{i}`").cast("string") for i in ids]))


def range_bucket(v: Column, lo: Column, q1: Column, med: Column, q3: Column, hi: Column, near: float = 0.001) -> Column:
    """Quartile bucket of a number; values at the minimum or maximum have their own."""
    return (F.when(F.abs(v - lo) < near, "min").when(F.abs(v - hi) < near, "max").when(v <= q1, "q1").when(v <= med, "q2").when(v <= q3, "q3").otherwise("q4"))


def _bucketed(df: DataFrame, ids: Sequence[str], ranges: DataFrame, columns: Sequence[str]) -> DataFrame:
    numbers = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns]))
    rows = df.select(*ids, numbers.alias("r")).select(*ids, "r.*").filter(F.col("v").isNotNull())
    joined = rows.join(F.broadcast(ranges.select("column", "min", "q1", "median", "q3", "max")), "column")
    bucket = range_bucket(F.col("v"), F.col("min"), F.col("q1"), F.col("median"), F.col("q3"), F.col("max"))
    return joined.select(*ids, "column", F.concat(F.lit("range:"), bucket).alias("value"))


def covering_rows(df: DataFrame, ids: Sequence[str], categorical: Sequence[str], numeric: Sequence[str] = (), ranges: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """Ids of one row per value of the categorical columns and per range bucket of the numeric ones.

    The chosen row is the one with the smallest hash: a minimum, combined on the map side.
    """
    goals = long_values(df, categorical, ids)
    if numeric and ranges is not None:
        goals = goals.unionByName(_bucketed(df, ids, ranges, numeric).select(*goals.columns))
    pick = F.min(F.struct(row_hash(ids, seed).alias("h"), *[F.col(i) for i in ids]))
    return goals.groupBy("column", "value").agg(pick.alias("p")).select(*[F.col(f"p.{i}").alias(i) for i in ids]).distinct()


def coverage_sample(df: DataFrame, ids: Sequence[str], categorical: Sequence[str], numeric: Sequence[str] = (), ranges: DataFrame | None = None,
                    whole_below: int | None = None, fill_to: int = 80, seed: int = 42) -> DataFrame:
    """A row for every categorical value and numeric range, filled up at random to ``fill_to`` rows.

    With ``whole_below``, tables of at most that many rows are returned whole.
    """
    if whole_below is not None and df.limit(whole_below + 1).count() <= whole_below:
        return df
    chosen = materialise(covering_rows(df, ids, categorical, numeric, ranges, seed))
    covered = df.join(bounded(chosen), list(ids), "left_semi")
    have = chosen.limit(fill_to).count()
    if have >= fill_to:
        return covered
    fill = first_rows(df.join(bounded(chosen), list(ids), "left_anti"), [row_hash(ids, seed)], fill_to - have)
    return covered.unionByName(fill)


def capped_rows(df: DataFrame, ids: Sequence[str], columns: Sequence[str], per_value: int = 3, per_column: int = 50, seed: int = 42,
                order: Column | None = None) -> DataFrame:
    """Rows wanted by any tracked column: the first ``per_value`` rows of its first ``per_column`` values.

    First means by ``order`` over the id columns, or by hash.
    """
    rows = long_values(df, columns, ids).withColumn("_h", row_hash(ids, seed) if order is None else order)
    best = Window.partitionBy("column", "value").orderBy("_h")
    few = rows.withColumn("_k", F.row_number().over(best)).filter(F.col("_k") <= per_value)
    firsts = rows.groupBy("column", "value").agg(F.min("_h").alias("_first"))
    ranked = firsts.withColumn("_u", F.row_number().over(Window.partitionBy("column").orderBy("_first", "value"))).filter(F.col("_u") <= per_column)
    wanted = few.join(F.broadcast(ranked.select("column", "value")) if per_column * len(columns) <= 100_000 else ranked.select("column", "value"), ["column", "value"], "left_semi")
    return df.join(wanted.select(*ids).distinct(), list(ids), "left_semi")


def diverse_nodes(triples: DataFrame, per_value: int = 2, per_prop: int = 10, n: int = 100) -> DataFrame:
    """Up to ``n`` nodes of which every property and every property value is among the first few seen."""
    by_value = Window.partitionBy("prop", "value").orderBy("node")
    by_prop = Window.partitionBy("prop").orderBy("node")
    # only the first rows of each group are numbered in full; the rest fail by absence
    first = triples.withColumn("_v", F.row_number().over(by_value)).filter(F.col("_v") <= per_value)
    passed = first.withColumn("_p", F.row_number().over(by_prop)).filter(F.col("_p") <= per_prop).groupBy("node").agg(F.count(F.lit(1)).alias("_ok"))
    sizes = triples.join(passed, "node", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("_all"))
    good = passed.join(sizes, "node").filter(F.col("_ok") == F.col("_all")).select("node")
    return first_rows(good, [F.col("node")], n)


def one_per_pattern(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each combination of the signature columns (the first five columns without any)."""
    sig = list(columns or df.columns[:5])
    rest = [c for c in df.columns if c not in sig]
    return df.groupBy(*sig).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*sig, *[F.col(f"_r.`{c}`").alias(c) for c in rest]).select(*df.columns)


def sample_fraction(df: DataFrame, ids: Sequence[str], fraction: float, seed: int = 42) -> DataFrame:
    """Hash-threshold sample: the same rows on every run and any partitioning."""
    return df.filter(F.conv(F.substring(row_hash(ids, seed), 1, 8), 16, 10).cast("long") < int(fraction * (1 << 32)))


def coverage_report(df: DataFrame, sample: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values per column in the table, of them in the sample, and missing ones."""
    have = long_values(sample, columns).distinct().withColumn("_in", F.lit(1))
    every = long_values(df, columns).distinct()
    return every.join(have, ["column", "value"], "left").groupBy("column").agg(
        F.count(F.lit(1)).alias("total_values"), F.count("_in").alias("covered"), F.count_if(F.col("_in").isNull()).alias("uncovered"))


def limit_total_rows(df: DataFrame, text_columns: Sequence[str], order: Sequence[str], keep: int = 2, keywords: Sequence[str] = TOTAL_WORDS) -> DataFrame:
    """Keep only the first ``keep`` rows that look like totals."""
    hit = F.lit(False)
    for c in text_columns:
        for w in keywords:
            hit = hit | F.lower(F.col(c)).contains(w)
    first = first_rows(df.filter(hit), [F.col(o) for o in order], keep)
    return df.filter(~F.coalesce(hit, F.lit(False))).unionByName(first)
