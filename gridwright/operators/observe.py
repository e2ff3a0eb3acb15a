"""Observations: splitting, expansion, validation, de-duplication, aggregation, output columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import number_text
from ..functions.text import add_namespace, normalize_value, strip_namespace

# Properties of an observation and defaults of variables and observations.
OBS_PROPS = ("typeOf", "observationDate", "observationAbout", "value", "observationPeriod", "measurementMethod", "unit",
             "scalingFactor", "variableMeasured", "measurementResult", "#Aggregate")
INTERNAL_PROPS = ("Data", "Number", "Key")
VARIABLE_DEFAULTS = {"typeOf": "dcs:StatisticalVariable", "statType": "dcs:measuredValue", "measuredProperty": "dcs:count"}
REQUIRED_VARIABLE = ("measuredProperty", "populationType")
REQUIRED_OBS = ("variableMeasured", "observationAbout", "observationDate", "value")
KEY_IGNORED = ("value", "measurementResult")
AGGREGATES = ("sum", "min", "max", "mean", "first", "last")


def split_properties(props: Sequence[str], output_columns: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Observation properties and variable properties among the given names."""
    valid = [p for p in props if p == "#Aggregate" or (p[:1].isalpha() and p[:1].islower())]
    obs = [p for p in valid if p in OBS_PROPS or p in output_columns]
    return obs, [p for p in valid if p not in obs and p not in INTERNAL_PROPS]


def expand_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with comma lists in the given columns become the product of their values."""
    for c in columns:
        df = df.withColumn(c, F.explode_outer(F.transform(F.split(F.col(f"`{c}`"), ","), lambda x: F.trim(x))))
    return df


def flatten_lists(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Array columns to one row per combination; empty arrays keep the row."""
    for c in columns:
        df = df.withColumn(c, F.explode_outer(c))
    return df


def obs_key_columns(df: DataFrame, extra_ignored: Sequence[str] = ()) -> list[str]:
    skip = set(KEY_IGNORED) | set(extra_ignored) | {"ord", "value_raw"}
    return [c for c in df.columns if c not in skip and not c.startswith("_")]


def dedupe(obs: DataFrame, key: Sequence[str] | None = None, value: str = "value", order: Sequence[str] = ("ord",)) -> tuple[DataFrame, DataFrame]:
    """Equal repeats collapse to the first row; keys with different values go to the second result.

    One aggregate with map-side combine: minimum and maximum of the comparable value tell whether
    a key conflicts, so no distinct count and no list per key is built.
    """
    key = list(key or obs_key_columns(obs))
    others = [c for c in obs.columns if c not in key]
    plain = dict(obs.dtypes)[value] in ("double", "bigint", "int", "float")
    comparable = F.col(value) if plain else normalize_value(F.col(value).cast("string"))
    grouped = obs.groupBy(*key).agg(
        F.min_by(F.struct(*others), F.struct(*order)).alias("_first"), F.min(comparable).alias("_lo"), F.max(comparable).alias("_hi"),
        F.count(F.lit(1)).alias("n_rows"))
    same = F.col("_lo").eqNullSafe(F.col("_hi"))
    good = grouped.filter(same).select(*key, *[F.col(f"_first.`{c}`").alias(c) for c in others], "n_rows")
    bad = grouped.filter(~same).select(*key, "n_rows", F.col("_lo").alias("min_value"), F.col("_hi").alias("max_value"))
    return good, bad


def conflict_rows(obs: DataFrame, conflicts: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rejected rows behind the conflicting keys."""
    return obs.join(conflicts.select(*key), list(key), "left_semi")


def drop_flagged(variables: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Variables that have a conflicting observation are dropped."""
    flagged = conflicts.select(strip_namespace(F.col("variableMeasured")).alias("dcid")).distinct()
    return variables.join(flagged, "dcid", "left_anti")


def aggregate_method(method: Column, how: Column, merged: Column, default_method: str = "Aggregate", method_prefix: str = "dcAggregate/") -> Column:
    """Measurement method of a combined value: its own, marked if several rows were merged."""
    bare = strip_namespace(method)
    return (F.when(~merged, F.nullif(method, F.lit(""))).when(bare == "", F.lit(f"dcs:{default_method}"))
            .when(bare.startswith(method_prefix) | (bare == default_method) | how.isin("first", "last"), method)
            .otherwise(F.concat(F.lit(f"dcs:{method_prefix}"), bare)))


def aggregate_duplicates(obs: DataFrame, key: Sequence[str], how: str, value: str = "value", order: Sequence[str] = ("ord",),
                         method: str = "measurementMethod", default_method: str = "Aggregate", method_prefix: str = "dcAggregate/") -> DataFrame:
    """Sum, min, max, mean, first, last or list of the values per key, marking keys that merged rows.

    ``list`` returns one row per listed value with its place (``value_no``) instead of one cell
    that grows with the group; :func:`list_text` joins them where the lists are known to be short.
    """
    how = how.lower()
    has_method = method in obs.columns and method not in key
    if how == "list":
        return obs.select(*key, F.struct(*order).alias("value_no"), F.col(value).alias(value))
    pick = {"sum": F.sum(value), "min": F.min(value), "max": F.max(value), "mean": F.avg(value),
            "first": F.min_by(value, F.struct(*order)), "last": F.max_by(value, F.struct(*order))}[how]
    aggs = [pick.alias(value), F.count(F.lit(1)).alias("n_rows")]
    if has_method:
        aggs.append(F.min_by(F.coalesce(F.col(method), F.lit("")), F.struct(*order)).alias("_m"))
    out = obs.groupBy(*key).agg(*aggs)
    merged = F.col("n_rows") > 1
    marked = aggregate_method(F.col("_m") if has_method else F.lit(""), F.lit(how), merged, default_method, method_prefix)
    if method not in key:
        out = out.withColumn(method, marked)
    if how == "mean":
        out = out.withColumn("statType", F.when(merged, F.lit("dcs:meanValue")))
    return out.drop("_m")


def list_text(listed: DataFrame, key: Sequence[str], value: str = "value") -> DataFrame:
    """Comma text of the lists, one cell per key; the long form that goes in suits keys with very many values."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("value_no", F.col(value).alias("v")))), lambda s: number_text(s["v"], 10)), ",")
    return listed.groupBy(*key).agg(text.alias(value))


def merge_keyed(rows: DataFrame, key: Sequence[str], how: dict[str, str], default: str = "sum", order: Sequence[str] = ("ord",),
                count_of: dict[str, str] | None = None) -> DataFrame:
    """Per-column merge of rows with the same key. Text columns turn sum and mean into a list.

    ``count_of`` names the weight column of a mean. Lists are sorted unique values joined by
    commas, made distinct in each task first, in the one aggregate that merges all columns. :func:`listed_values` is their long form.
    """
    types = dict(rows.dtypes)
    aggs: list[Column] = []
    merged = [c for c in rows.columns if c not in key and c not in order and c not in (count_of or {}).values()]
    for c in merged:
        mode = how.get(c, default)
        if types[c] == "string" and mode in ("sum", "mean"):
            mode = "list"
        col = F.col(f"`{c}`")
        if mode in ("list", "set"):
            parts = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split(col.cast("string"), ",")))))
            parts = F.when(F.count(col) > 0, parts)
            aggs.append((F.array_join(parts, ",") if mode == "list" else parts).alias(c))
            continue
        if mode == "mean" and count_of and c in count_of:
            weight = F.coalesce(F.col(count_of[c]), F.lit(1))
            expr = F.sum(col * weight) / F.sum(F.when(col.isNotNull(), weight))
        else:
            expr = {"sum": lambda: F.sum(col), "min": lambda: F.min(col), "max": lambda: F.max(col), "mean": lambda: F.avg(col),
                    "first": lambda: F.min_by(col, F.when(col.isNotNull(), F.struct(*order))),
                    "last": lambda: F.max_by(col, F.when(col.isNotNull(), F.struct(*order)))}[mode]()
        aggs.append(expr.alias(c))
    out = rows.groupBy(*key).agg(*aggs) if aggs else rows.select(*key).distinct()
    return out.select(*key, *merged)


def listed_values(rows: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """Distinct listed values per key in long form (``key…, item``), for groups of any size."""
    return rows.select(*key, F.explode(F.split(F.col(f"`{column}`").cast("string"), ",")).alias("item")).distinct()


def missing_columns(required: Sequence[str]) -> Column:
    """Names of required columns that are empty in a row."""
    return F.array_compact(F.array(*[F.when(F.coalesce(F.col(f"`{r}`").cast("string"), F.lit("")) == "", F.lit(r)) for r in required]))


def validate(df: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with all required columns, and the rest with the names of what is missing."""
    tagged = df.withColumn("missing", missing_columns(required))
    return tagged.filter(F.size("missing") == 0).drop("missing"), tagged.filter(F.size("missing") > 0)


def prune_variables(variables: DataFrame, obs: DataFrame) -> DataFrame:
    """Variables that have at least one observation."""
    used = obs.select(strip_namespace(F.col("variableMeasured")).alias("dcid")).distinct()
    return variables.join(used, "dcid", "left_semi")


def prune_observations(obs: DataFrame, variables: DataFrame) -> DataFrame:
    """Strict mode: observations whose variable is known."""
    known = variables.select(F.col("dcid").alias("_id")).distinct()
    return obs.join(known, strip_namespace(F.col("variableMeasured")) == F.col("_id"), "left_semi")


def column_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One pass: smallest, largest and number of filled rows of every column, in long form."""
    aggs = []
    for i, c in enumerate(columns):
        text = F.nullif(F.col(f"`{c}`").cast("string"), F.lit(""))
        aggs += [F.min(text).alias(f"lo{i}"), F.max(text).alias(f"hi{i}"), F.count(text).alias(f"n{i}")]
    one = df.agg(*aggs, F.count(F.lit(1)).alias("rows"))
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi"), F.col(f"n{i}").alias("n"))
                     for i, c in enumerate(columns)])
    return one.select("rows", F.explode(rows).alias("r")).select("r.column", "r.lo", "r.hi", "r.n", "rows")


def constant_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns with one value in every row, and that value."""
    r = column_ranges(df, list(columns or df.columns))
    return r.filter((F.col("n") == F.col("rows")) & (F.col("lo") == F.col("hi"))).select("column", F.col("lo").alias("value"))


def drop_constant_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Output columns that vary, and the constants that move to the template. Reads one row per column."""
    constants = {r["column"]: r["value"] for r in constant_columns(df).collect()}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in constants]), constants


def distinct_per_column(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct values of every output column."""
    if approximate:
        one = df.agg(*[F.approx_count_distinct(f"`{c}`").alias(c) for c in columns])
        return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("n_distinct")) for c in columns])).alias("r")).select("r.*")
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])).alias("r")).select("r.*")
    return values.filter(F.col("v").isNotNull()).distinct().groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))


def output_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values as written to files: plain numbers, quotes around text with spaces or commas."""
    types = dict(df.dtypes)
    def text(c: str) -> Column:
        col = F.col(f"`{c}`")
        if types[c] in ("double", "float", "int", "bigint"):
            return number_text(col.cast("double"))
        return F.when(col.rlike("[ ,]") & ~col.startswith('"'), F.concat(F.lit('"'), col, F.lit('"'))).otherwise(col)
    return df.select(*[text(c).alias(c) for c in columns])


def reference_id(column: str) -> Column:
    return add_namespace(F.col(column))


def count_reasons(df: DataFrame, stage: str = "stage", reason: str = "reason") -> DataFrame:
    """Named counts per stage."""
    return df.groupBy(stage, reason).agg(F.count(F.lit(1)).alias("n"))


def extreme_counters(df: DataFrame, columns: Sequence[str], stage: str = "stage") -> DataFrame:
    """Minimum and maximum counters: the least and greatest number seen per stage, in long form, one pass."""
    names = [c for c in columns]
    aggs = [f(F.col(f"`{c}`").cast("double")).alias(f"{kind}{i}") for i, c in enumerate(names) for kind, f in (("min", F.min), ("max", F.max))]
    rows = F.array(*[F.struct(F.lit(f"{kind}-{c}").alias("counter"), F.col(f"{kind}{i}").alias("value")) for i, c in enumerate(names) for kind in ("min", "max")])
    return df.groupBy(stage).agg(*aggs).select(stage, F.explode(rows).alias("r")).select(stage, "r.counter", "r.value").filter(F.col("value").isNotNull())


def all_counters(df: DataFrame, columns: Sequence[str], stage: str = "stage", reason: str = "reason", prefix: str = "") -> DataFrame:
    """Counts per stage and reason, and the extremes of ``columns``, as ``stage, counter, value``."""
    counts = count_reasons(df, stage, reason).select(stage, F.col(reason).alias("counter"), F.col("n").cast("double").alias("value"))
    return counts.unionByName(extreme_counters(df, columns, stage)).withColumn("counter", F.concat(F.lit(prefix), F.col("counter")))
