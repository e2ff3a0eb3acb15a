"""Delimited text files as grids of positional cells with exact row numbers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.text import split_quoted, unquoted
from ..operators.scale import bounded, fits, with_position
from ..session import materialise


def _split_csv(line: str, delimiter: str):
    return F.transform(split_quoted(F.col(line), delimiter), unquoted)


def read_grid(spark: SparkSession, paths: str | Sequence[str], delimiter: str = ",", quoted_newlines: bool = False, exact: bool = True) -> DataFrame:
    """``file, row_no, cells`` of headerless files; globs and lists are allowed, row numbers start at 1 per file.

    Text splits are read in parallel; a row's number is its place in the split plus the rows of the
    file's earlier splits (one small row per split), which takes a counting pass. With
    ``exact=False`` that pass is saved: numbers rise within a file but jump at split borders (the
    byte offset of a split is at least the number of rows before it). With ``quoted_newlines`` line ends
    inside double quotes end no row; a file with an odd number of quotes has none (:func:`_quoted_rows`).
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.col("value"),
        F.monotonically_increasing_id().alias("_mid"))
    if quoted_newlines:
        return _quoted_rows(lines).select("file", "row_no", _split_csv("line", delimiter).alias("cells"))
    if not exact:
        local = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
        return lines.select("file", (F.col("_start") + local + 1).alias("row_no"), _split_csv("value", delimiter).alias("cells"))
    blocks = lines.groupBy("file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("file", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    numbered = lines.join(bounded(materialise(offsets)), ["file", "_start"])
    return numbered.select("file", (F.col("_offset") + F.col("_mid") - F.col("_first") + 1).alias("row_no"), _split_csv("value", delimiter).alias("cells"))


_STATE = "file string, start long, n long, odd boolean, starts long"


def _quote_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each split's effect on the quote state, a function of two states: whether it turns them round (``odd``), and how
    many of its ``n`` lines start outside quotes if it is entered outside them (the others do if it is entered inside)."""
    rows, at = [], None
    for batch in batches:
        quotes = [v.count('"') & 1 for v in batch.column(2).to_pylist()]
        for file, start, odd in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), quotes, strict=True):
            if at is None or at[0] != file or at[1] != start:
                if at:
                    rows.append(tuple(at))
                at = [file, start, 0, False, 0]
            at[2] += 1
            at[4] += not at[3]
            at[3] ^= bool(odd)
    if at:
        rows.append(tuple(at))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["file", "start", "n", "odd", "starts"])


def _joined_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each split's lines in order: ``file, row_no, start, whole, line``.

    A row that goes on in the next split, or comes from the one before, is a piece (not ``whole``).
    """
    schema = pa.schema([("file", pa.string()), ("row_no", pa.int64()), ("start", pa.int64()), ("whole", pa.bool_()), ("line", pa.string())])
    split, inside, number, open_, entered = None, False, 0, None, False
    out: list[tuple] = []

    def close(ends_inside: bool) -> None:
        """The open row, as it is at its end or at the end of its split."""
        if open_ is not None:
            out.append((split[0], number, split[1], not (entered or ends_inside), "\n".join(open_)))

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(6)]
        for file, start, value, enters, offset, plain in zip(*columns, strict=True):
            if split != (file, start):
                close(inside)
                split, inside, number, open_, entered = (file, start), enters and not plain, offset, None, False
            if not inside:
                close(False)
                open_, entered, number = [value], False, number + 1
            elif open_ is None:
                open_, entered = [value], True
            else:
                open_.append(value)
            inside ^= bool(value.count('"') & 1) and not plain
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
            out.clear()
    close(inside)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)


def _quoted_rows(lines: DataFrame) -> DataFrame:
    """``file, row_no, line`` where line ends inside double quotes don't end a row; empty rows are left out.

    Splits are read in parallel, twice. The first pass gives each split's effect on the quote state (one small row), the
    composition of those before it the state in which it is entered and the number of rows before it. The second joins
    lines as they stream by, one row at a time; only rows cut by a split border, two pieces a split at
    most, are put together afterwards.
    """
    plain_lines = lines.select("file", "_start", "value")
    states = materialise(plain_lines.mapInArrow(_quote_states, _STATE).withColumnRenamed("start", "_start"))
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    number = F.col("odd").cast("long")
    entered = states.withColumns({
        "_enters": F.coalesce(F.sum(number).over(before), F.lit(0)) % 2 == 1,
        "_plain": F.sum(number).over(Window.partitionBy("file")) % 2 == 1})
    begun = F.when(F.col("_plain"), F.col("n")).when(F.col("_enters"), F.col("n") - F.col("starts")).otherwise(F.col("starts"))
    known = materialise(entered.withColumn("_offset", F.coalesce(F.sum(begun).over(before), F.lit(0))).select("file", "_start", "_enters", "_offset", "_plain"))
    met = lines.join(bounded(known), ["file", "_start"])
    if not fits(known):  # a shuffled join takes the lines of a split apart
        met = met.repartition("file", "_start").sortWithinPartitions("file", "_start", "_mid")
    pieces = met.select("file", "_start", "value", "_enters", "_offset", "_plain").mapInArrow(_joined_lines, "file string, row_no long, start long, whole boolean, line string")
    stored = materialise(pieces)
    cut = stored.filter("NOT whole").groupBy("file", "row_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "line"))), lambda x: x["line"]), "\n").alias("line"))
    return stored.filter("whole").select("file", "row_no", "line").unionByName(cut).filter("line <> ''")


def grid_of(df: DataFrame, columns: Sequence[str], order: Sequence[str], file: str | None = None) -> DataFrame:
    """A table as a grid: its header as row 1, then its rows in order. ``file`` is a column naming the sheet.

    Row numbers come from a distributed prefix sum, not from one window per sheet.
    """
    name = F.col(file) if file else F.lit("table")
    text = F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns])
    rows = with_position(df.select(name.cast("string").alias("file"), text.alias("cells"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)]),
                         ["file", *[f"_o{i}" for i in range(len(order))]], "_pos")
    firsts = materialise(rows.groupBy("file").agg(F.min("_pos").alias("_first")))
    body = rows.join(bounded(firsts), "file").select("file", (F.col("_pos") - F.col("_first") + 2).alias("row_no"), "cells")
    head = firsts.select("file", F.lit(1).cast("long").alias("row_no"), F.array(*[F.lit(c) for c in columns]).alias("cells"))
    return body.unionByName(head)


def combine_files(spark: SparkSession, paths: Sequence[str], by_name: bool = False) -> DataFrame:
    """Rows of several CSV files under the header of the first (by position), or under all headers (by name).

    By position all files are one scan. By name it is one scan for each different header, however many files share it.
    """
    def headed(files: Sequence[str]) -> DataFrame:
        return spark.read.schema(spark.read.csv(files[0], header=True).schema).csv(list(files), header=True)

    if not by_name:
        return headed(paths)
    first = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), "value", F.monotonically_increasing_id().alias("_mid"))
    heads = first.filter("_start = 0").groupBy("file").agg(F.min_by("value", "_mid").alias("head")).groupBy("head").agg(F.sort_array(F.collect_list("file")).alias("files"))
    out = None
    for r in sorted(heads.collect(), key=lambda r: r["files"]):
        t = headed(r["files"])
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def merge_parameters(tables: Sequence[DataFrame], key: str = "parameter", value: str = "value") -> tuple[DataFrame, DataFrame]:
    """First value of each parameter over the tables in order, and the parameters whose values differ."""
    rows = None
    for i, t in enumerate(tables):
        part = t.select(F.col(key).alias(key), F.col(value).alias(value), F.lit(i).alias("_o"))
        rows = part if rows is None else rows.unionByName(part)
    grouped = rows.groupBy(key).agg(F.min_by(value, "_o").alias(value), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return grouped.select(key, value), grouped.filter(F.col("_lo") != F.col("_hi")).select(key, F.col(value).alias("kept"), F.col("_lo").alias("low"), F.col("_hi").alias("high"))
