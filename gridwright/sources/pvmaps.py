"""PV maps: ``key, property, value, property, value, …`` tables in and out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.props import overlay_all, sort_by
from ..functions.text import words
from ..operators.scale import with_position
from .grids import read_grid

PV_SCHEMA = "namespace string, key string, props map<string,string>, n_words int, ord long"


def _finish(entries: DataFrame, delimiter: str = " ") -> DataFrame:
    """Merge repeated keys in arrival order and add key width."""
    merged = entries.groupBy("namespace", "key").agg(
        overlay_all(F.transform(sort_by(F.collect_list(F.struct("ord", "props")), "ord"), lambda s: s["props"])).alias("props"),
        F.min("ord").alias("ord"))
    return merged.select("namespace", "key", "props", F.size(words(F.col("key"), delimiter)).alias("n_words"), "ord")


def pv_map_from_dict(spark: SparkSession, maps: Mapping[str, Mapping[str, Mapping[str, str]]], delimiter: str = " ") -> DataFrame:
    """``{namespace: {key: {prop: value}}}`` to the PV map table."""
    rows = [(ns, key, dict(props), i) for ns, keys in maps.items() for i, (key, props) in enumerate(keys.items())]
    return _finish(spark.createDataFrame(rows, "namespace string, key string, props map<string,string>, ord long"), delimiter)


def load_pv_map(spark: SparkSession, path: str, namespace: str = "GLOBAL", delimiter: str = " ") -> DataFrame:
    """Read ragged CSV rows. A key with a single value gets the namespace as its property; ``#`` rows are comments."""
    raw = read_grid(spark, path).filter(~F.trim(F.get("cells", F.lit(0))).startswith("#"))
    cells = F.transform("cells", lambda c: F.nullif(F.trim(c), F.lit("")))
    lines = raw.select(F.struct("file", "row_no").alias("_at"), cells.alias("cells"))
    keyed = lines.select("_at", F.get("cells", F.lit(0)).alias("c0"), F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))).alias("rest"))
    filled = with_position(keyed.filter(F.col("c0").isNotNull() & (F.lower("c0") != "key")), ["_at"], "ord")
    pairs = F.transform(F.sequence(F.lit(0), F.ceil(F.size("rest") / 2).cast("int")), lambda i: F.struct(
        F.get("rest", i * 2).alias("key"), F.get("rest", i * 2 + 1).alias("value")))
    used = F.filter(pairs, lambda p: p["key"].isNotNull() & p["value"].isNotNull())
    # the last of repeated properties on one row wins
    latest = F.filter(F.transform(used, lambda p: p), lambda p: F.element_at(F.filter(used, lambda q: q["key"] == p["key"]), -1)["value"] == p["value"])
    first, second = F.get("rest", F.lit(0)), F.get("rest", F.lit(1))
    single = first.isNotNull() & second.isNull()
    props = F.when(single, F.create_map(F.lit(namespace), first)).otherwise(F.map_from_entries(F.array_distinct(latest)))
    return _finish(filled.select(F.lit(namespace).alias("namespace"), F.col("c0").alias("key"), props.alias("props"), "ord").filter(F.size("props") > 0), delimiter)


def config_rows(pv_map: DataFrame) -> DataFrame:
    """Options given inside the map under a key starting with ``config:``."""
    return pv_map.filter(F.lower(F.col("key")).startswith("config:")).select(F.explode("props").alias("option", "value"))


def pv_map_rows(pv_map: DataFrame, width: int | None = None) -> DataFrame:
    """One wide text row per key: ``key, p1, v1, p2, v2, …``. The width is the largest entry, read from the map."""
    if width is None:
        width = pv_map.agg(F.max(F.size("props"))).first()[0] or 0
    entries = F.array_sort(F.map_entries("props"))
    flat = F.flatten(F.transform(entries, lambda e: F.array(e["key"], e["value"])))
    return pv_map.select("key", *[F.get(flat, F.lit(i)).alias(f"{'prop' if i % 2 == 0 else 'value'}{i // 2 + 1}") for i in range(2 * width)])


def write_pv_map(pv_map: DataFrame, path: str, mode: str = "errorifexists") -> None:
    pv_map_rows(pv_map).write.mode(mode).csv(path, header=True)


def compare_form(pv_map: DataFrame) -> DataFrame:
    """Long ``key, prop, value`` rows for comparison."""
    return pv_map.select("key", F.explode("props").alias("prop", "value"))
