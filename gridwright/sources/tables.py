"""Keyed CSV tables, JSON and XML records, and sinks for observations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.observe import drop_constant_columns, merge_keyed, output_text


def load_keyed(spark: SparkSession, paths: str | Sequence[str], key: Sequence[str], how: Mapping[str, str] | None = None, default: str = "last",
               delimiter: str = ",", schema: str | None = None) -> DataFrame:
    """A CSV table with one row per key; repeated keys merge column by column.

    First and last go by the order of ``paths``, then by file name, place in the file and row.
    """
    given = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read.option("sep", delimiter).option("header", True)
    reader = reader.schema(schema if schema else reader.option("inferSchema", True).csv(given).schema)
    rows = None
    for i, path in enumerate(given):
        at = F.struct(F.lit(i).alias("path"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                      F.monotonically_increasing_id().alias("row"))
        part = reader.csv(path).select("*", at.alias("ord"))
        rows = part if rows is None else rows.unionByName(part)
    return merge_keyed(rows, key, dict(how or {}), default)


def keyed_table(rows: DataFrame, props: str = "props", key: str = "key", names: Sequence[str] | None = None, most: int = 5_000) -> DataFrame:
    """Property maps to a wide table whose columns are ``names``, or all properties seen.

    No more than ``most`` names are gathered: a table with more has no use as columns, so that is an error; its
    long form is ``rows.select(key, F.explode(props))``.
    """
    if names is None:
        found = rows.select(F.explode(F.map_keys(props)).alias("name")).distinct().limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"more than {most} properties; pass names or keep the long form")
        names = sorted(r["name"] for r in found)
    return rows.select(key, *[F.col(props)[n].alias(n) for n in names])


def write_keyed(rows: DataFrame, path: str, props: str = "props", key: str = "key", mode: str = "errorifexists") -> None:
    keyed_table(rows, props, key).write.mode(mode).csv(path, header=True)


def _leaves(schema: T.StructType, path: str = "", name: str = "") -> list[tuple[str, str, T.DataType]]:
    out = []
    for f in schema.fields:
        full, label = (f"{path}.`{f.name}`" if path else f"`{f.name}`"), (f"{name}.{f.name}" if name else f.name)
        out += _leaves(f.dataType, full, label) if isinstance(f.dataType, T.StructType) else [(full, label, f.dataType)]
    return out


def flatten_records(df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), explode_lists: bool = False) -> DataFrame:
    """Nested records to dotted columns, newlines in text to spaces.

    Lists become one column per position (``a.0``, ``a.1``, as many as the longest list, found by
    one aggregate) or one row per item with ``explode_lists``.
    """
    while True:
        lists = [(p, n, t) for p, n, t in _leaves(df.schema) if isinstance(t, T.ArrayType)]
        flat = df.select(*[F.col(p).alias(n) for p, n, _ in _leaves(df.schema)])
        if not lists:
            break
        if explode_lists:
            for _, n, _ in lists:
                flat = flat.withColumn(n, F.explode_outer(F.col(f"`{n}`")))
        else:
            sizes = flat.agg(*[F.max(F.size(F.col(f"`{n}`"))).alias(f"s{i}") for i, (_, n, _) in enumerate(lists)]).first()
            for i, (_, n, _) in enumerate(lists):
                size = max(sizes[i] or 0, 0)
                flat = flat.select(*[F.col(f"`{c}`") for c in flat.columns if c != n], *[F.get(F.col(f"`{n}`"), F.lit(j)).alias(f"{n}.{j}") for j in range(size)])
        df = flat
    def clean(c: str, t: str) -> Column:
        return F.regexp_replace(F.col(f"`{c}`"), r"\s*\n\s*", " ").alias(c) if t == "string" else F.col(f"`{c}`")
    wanted = [c for c in flat.columns if (not include or any(c == i or c.startswith(i + ".") for i in include)) and not any(c == e or c.startswith(e + ".") for e in exclude)]
    types = dict(flat.dtypes)
    return flat.select(*[clean(c, types[c]) for c in wanted])


def read_json_flat(spark: SparkSession, paths: str | Sequence[str], multiline: bool = False, **kw) -> DataFrame:
    return flatten_records(spark.read.option("multiLine", multiline).json(paths if isinstance(paths, str) else list(paths)), **kw)


def json_column_pairs(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Top-level entries of a JSON text column as ``name, value`` rows."""
    return df.select(*keys, F.explode(F.from_json(F.col(column), "map<string,string>")).alias("name", "value"))


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str | None = None) -> DataFrame:
    """Repeated XML elements as records."""
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


def write_observations(obs: DataFrame, path: str, columns: Sequence[str], constant_to_template: bool = True, mode: str = "errorifexists") -> str:
    """Observation CSV, and the column template that describes it (constants are named there, not written per row)."""
    out, constants = drop_constant_columns(obs.select(*columns)) if constant_to_template else (obs.select(*columns), {})
    output_text(out, out.columns).write.mode(mode).csv(path, header=True, quote='"', escape='"')
    return template_text(out.columns, constants)


def template_text(columns: Sequence[str], constants: Mapping[str, str], table: str = "Table") -> str:
    lines = [f"Node: E:{table}->E0", "typeOf: dcs:StatVarObservation"]
    lines += [f"{c}: C:{table}->{c}" for c in columns if c != "typeOf"]
    lines += [f"{p}: {v}" for p, v in constants.items() if p != "typeOf"]
    return "\n".join(lines) + "\n"


def write_shards(df: DataFrame, path: str, column: str, prefix: int = 0, mode: str = "errorifexists") -> None:
    """One folder per value (or value prefix) of a column. Rebalancing splits large shards over several files."""
    shard = F.substring(column, 1, prefix) if prefix else F.col(column).cast("string")
    tagged = df.withColumn("shard", shard).hint("rebalance", "shard")
    tagged.write.mode(mode).partitionBy("shard").option("header", True).csv(path)
