"""Helpers that several operators share: words, literal lookup tables, running sums over hot groups, row locators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise, shared_dir

# Fixed value: words are runs of anything but the ASCII blanks.
BLANKS = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"

# Rows of longs that may be broadcast: 16 bytes each, 16 MB in all. Above it joins are shuffled.
BROADCAST_IDS = 1_000_000


def text_of(column: str) -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words of a text that is not null."""
    squeezed = F.regexp_replace(text, BLANKS, " ")
    inner = F.trim(squeezed)
    return F.when(inner == "", F.lit(0)).otherwise(F.length(inner) - F.length(F.translate(inner, " ", "")) + 1).cast("long")


def literal_array(values: Sequence[int | float], kind: str = "bigint") -> Column:
    """A constant array that the optimiser folds into one literal; for tables of bounded length."""
    if not values:
        return F.array().cast(f"array<{kind}>")
    return F.split(F.lit(",".join(repr(v) for v in values)), ",").cast(f"array<{kind}>")


def in_chunks(df: DataFrame, by: Sequence[str], chunk: str, order: Sequence[str], sums: Mapping[str, str]) -> DataFrame:
    """Running sums *before* each row within ``by``, for groups of any size.

    ``chunk`` is a column that rises with ``order`` and cuts every group into pieces that fit a
    task. Sums run inside the chunks; what lies before a chunk comes from one row per chunk. A
    group that holds a third of all rows is spread like any other. ``by`` and ``chunk`` hold no
    nulls; ``df`` is read twice, so pass a stored table. ``sums`` maps new names to measures.
    """
    keys = [*by, chunk]
    totals = df.groupBy(*keys).agg(*[F.sum(m).alias(n) for n, m in sums.items()])
    earlier = Window.partitionBy(*by).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*keys, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"__base_{n}") for n in sums])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.select("*", *[F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(n) for n, m in sums.items()])
    joined = local.join(base, keys)
    return joined.select(*df.columns, *[(F.col(n) + F.col(f"__base_{n}")).alias(n) for n in sums])


def chunk_bits(rows: int, per_chunk: int = 20_000, least: int = 8, most: int = 22) -> int:
    """Bits of a hash that cut ``rows`` rows into chunks of about ``per_chunk``."""
    return max(least, min(most, (rows // per_chunk).bit_length()))


def hex_bits(digest: Column, bits: int) -> Column:
    """The leading bits of a hex digest, rising with the digest's own order."""
    return F.shiftright(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), 32 - bits)


def located(df: DataFrame) -> DataFrame:
    """``df`` with ``__file`` and ``__row``, where each row's content lies.

    A table read from files is left there; any other is written to the shared folder first. One
    that has both columns is returned as it is.
    """
    if {"__file", "__row"} <= set(df.columns):
        return df
    try:
        return df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        stored = materialise(df)
        return stored.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))


def small_batches(spark, rows: int = 1000) -> None:
    """Let Arrow batches hold at most ``rows`` rows: whole texts are long, and a worker holds a batch at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


@contextmanager
def bounded_batches(spark, size: int = 32 << 20) -> Iterator[None]:
    """Arrow batches of at most ``size`` bytes in the jobs run inside; the session's setting is put back after."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fresh_dir(spark, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def at_row() -> list[Column]:
    """A located row's file and number as two longs, for joins."""
    return [F.xxhash64("__file").alias("__f"), F.col("__row").alias("__r")]


def without_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Located ``docs`` without the rows that ``dropped`` names by ``__file`` and ``__row``; gives back the plain columns.

    The dropped rows are stored and counted: up to ``BROADCAST_IDS`` they are broadcast, else both sides are shuffled.
    """
    side = materialise(dropped.select(*at_row()))
    side = F.broadcast(side) if side.count() <= BROADCAST_IDS else side
    plain = [c for c in docs.columns if c not in ("__file", "__row")]
    return docs.select("*", *at_row()).join(side, ["__f", "__r"], "left_anti").select(*[F.col(f"`{c}`") for c in plain])
