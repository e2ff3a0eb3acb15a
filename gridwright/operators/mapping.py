"""Comparing PV maps with a reference map, and runs with a benchmark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import normalize_value
from .scale import bounded, first_rows


def compare_maps(truth: DataFrame, generated: DataFrame, normalise: bool = False, ignore_directives: bool = False) -> DataFrame:
    """Status of each (key, prop) of two long maps: matched, modified, added, deleted."""
    def side(d: DataFrame, name: str) -> DataFrame:
        d = d.filter(~F.col("prop").startswith("#")) if ignore_directives else d
        value = normalize_value(F.col("value")) if normalise else F.col("value")
        return d.select("key", "prop", value.alias(name))

    a, b = side(truth, "truth"), side(generated, "generated")
    status = (F.when(F.col("truth").isNull(), F.lit("added")).when(F.col("generated").isNull(), F.lit("deleted"))
              .when(F.col("truth") == F.col("generated"), F.lit("matched")).otherwise(F.lit("modified")))
    return a.join(b, ["key", "prop"], "full_outer").withColumn("status", status)


def mapping_metrics(compared: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Node accuracy and coverage over the keys of the truth, and property accuracy, precision, recall (percent).

    Precision counts modified properties as right, recall equals property accuracy.
    """
    n = lambda s: F.sum((F.col("status") == s).cast("long"))
    keys = compared.groupBy(*by, "key").agg(
        n("matched").alias("m"), n("modified").alias("o"), n("added").alias("a"), n("deleted").alias("d"),
        F.max(F.col("truth").isNotNull().cast("int")).alias("in_truth"), F.max(F.col("generated").isNotNull().cast("int")).alias("in_generated"))
    both = (F.col("in_truth") == 1) & (F.col("in_generated") == 1)
    same = both & (F.col("o") + F.col("a") + F.col("d") == 0)
    c = lambda cond: F.sum(cond.cast("long"))
    t = keys.groupBy(*by).agg(
        F.sum("in_truth").alias("nodes_truth"), F.sum("in_generated").alias("nodes_generated"), c(same).alias("nodes_matched"), c(both & ~same).alias("nodes_with_diff"),
        c((F.col("in_generated") == 0)).alias("nodes_missing"), c((F.col("in_truth") == 0)).alias("nodes_extra"),
        F.sum("m").alias("pvs_matched"), F.sum("o").alias("pvs_modified"), F.sum("a").alias("pvs_added"), F.sum("d").alias("pvs_deleted"))
    pct = lambda num, den: F.coalesce(F.round(num / F.nullif(den, F.lit(0)) * 100, 1), F.lit(0.0))
    m, o, a, d = (F.col(f"pvs_{x}") for x in ("matched", "modified", "added", "deleted"))
    return t.withColumns({
        "node_accuracy": pct(F.col("nodes_matched"), F.col("nodes_truth")), "node_coverage": pct(F.col("nodes_matched") + F.col("nodes_with_diff"), F.col("nodes_truth")),
        "pv_accuracy": pct(m, m + o + d), "precision": pct(m + o, m + o + a), "recall": pct(m, m + o + d)})


def _squeeze(name: str) -> Column:
    return F.translate(F.lower(F.col(name)), "_-", "")


def match_run_names(names: DataFrame, benchmark: DataFrame, overrides: DataFrame | None = None, excluded: DataFrame | None = None,
                    threshold: float = 0.6, without_shared_word: float = 0.75) -> DataFrame:
    """Best benchmark name per run name: ``name, match, score``.

    Overrides come first and excluded names are left out. Names are compared in lower case without
    ``_`` and ``-``: one inside the other scores 0.9 (0.5 if under half as long), others one less their edit
    distance over the longer length. The best match (least name on ties) must reach ``threshold``, and
    ``without_shared_word`` where no ``_``-separated word is shared. Pairs meet by pairs of letters: at
    a threshold of one half or more, likely names always share enough of them, so no pair is lost.
    """
    if threshold < 0.5:
        raise ValueError("threshold must be at least 0.5")
    todo = names.select(F.col(names.columns[0]).alias("name")).distinct()
    if excluded is not None:
        todo = todo.join(bounded(excluded.select(F.col(excluded.columns[0]).alias("name"))), "name", "left_anti")
    bench = benchmark.select(F.col(benchmark.columns[0]).alias("match")).distinct()
    fixed = None
    if overrides is not None:
        fixed = todo.join(bounded(overrides.select(F.col(overrides.columns[0]).alias("name"), F.col(overrides.columns[1]).alias("match"))), "name").join(
            bench, "match", "left_semi").select("name", "match", F.lit(1.0).alias("score"))
        todo = todo.join(fixed.select("name"), "name", "left_anti")

    def grams(df: DataFrame, name: str, form: str) -> DataFrame:
        padded = F.concat(F.lit("^"), F.col(form), F.lit("$"))
        pairs = F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substr(padded, i, F.lit(2)))
        return df.withColumn(form, _squeeze(name)).filter(F.length(form) > 0).select(name, form, F.explode(F.array_distinct(pairs)).alias("gram"))

    met = grams(todo, "name", "a").join(grams(bench, "match", "b"), "gram").select("name", "match", "a", "b").distinct()
    shorter, longer = F.least(F.length("a"), F.length("b")), F.greatest(F.length("a"), F.length("b"))
    inside = F.col("a").contains(F.col("b")) | F.col("b").contains(F.col("a"))
    score = F.when(inside, F.when(shorter / longer < 0.5, 0.5).otherwise(0.9)).otherwise(1 - F.levenshtein("a", "b") / longer)
    shared = F.arrays_overlap(F.split(F.lower("name"), "_"), F.split(F.lower("match"), "_"))
    best = met.select("name", F.struct((-score).alias("s"), "match", shared.alias("shared")).alias("x")).groupBy("name").agg(F.min("x").alias("x"))
    found = best.select("name", "x.match", (-F.col("x.s")).alias("score"), "x.shared").filter(
        (F.col("score") >= threshold) & (F.col("shared") | (F.col("score") >= without_shared_word))).drop("shared")
    return found if fixed is None else found.unionByName(fixed)


def compare_runs(benchmark: DataFrame, runs: DataFrame, mapping: DataFrame, metric: str = "pv_accuracy", name: str = "name") -> DataFrame:
    """Benchmark and new value of a metric per matched run, and their difference."""
    new = runs.select(F.col(name).alias("name"), F.col(metric).alias("new_value"))
    old = benchmark.select(F.col(name).alias("match"), F.col(metric).alias("old_value"))
    return new.join(bounded(mapping.select("name", "match")), "name").join(bounded(old), "match").withColumn("delta", F.col("new_value") - F.col("old_value"))


def run_summary(compared: DataFrame, band: float = 0.1) -> DataFrame:
    """Improved, declined and unchanged runs, mean values and the best and worst run."""
    d = F.col("delta")
    return compared.agg(F.count(F.lit(1)).alias("runs"), F.count_if(d > band).alias("improved"), F.count_if(d < -band).alias("declined"),
                        F.count_if(F.abs(d) <= band).alias("unchanged"), F.avg("old_value").alias("mean_old"), F.avg("new_value").alias("mean_new"),
                        F.avg(d).alias("mean_delta"), F.max_by("name", F.struct(d, F.col("name"))).alias("best_run"), F.min_by("name", F.struct(d, F.col("name"))).alias("worst_run"))


def extremes(compared: DataFrame, n: int = 15, improved: bool = True) -> DataFrame:
    """The ``n`` most improved (or declined) runs."""
    side = compared.filter(F.col("delta") > 0) if improved else compared.filter(F.col("delta") < 0)
    order = [F.col("delta").desc() if improved else F.col("delta").asc(), F.col("name")]
    return first_rows(side, order, n)


def name_overlap(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Where each name occurs: both, left or right."""
    a = left.select(column).distinct().withColumn("_a", F.lit(1))
    b = right.select(column).distinct().withColumn("_b", F.lit(1))
    where: Column = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "both").when(F.col("_a").isNotNull(), "left").otherwise("right")
    return a.join(b, column, "full_outer").select(column, where.alias("side"))
