"""Grids of text to cells: row selection, melting, header attachment, merged cells, row carry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import parse_number
from ..functions.props import overlay_all, sort_by
from ..functions.text import words
from ..session import materialise
from .scale import bounded, carry_forward


def select_rows(grid: DataFrame, skip: int = 0, only: Sequence[int] = (), ignore: Sequence[int] = (), min_columns: int = 2,
                max_rows: int | None = None, max_columns: int | None = None) -> DataFrame:
    """Row and column limits of a grid (``file, row_no, cells``); row numbers start at 1."""
    keep = (F.size("cells") >= min_columns) & (F.col("row_no") > skip)
    if only:
        keep = keep & F.col("row_no").isin(*only)
    if ignore:
        keep = keep & ~F.col("row_no").isin(*ignore)
    if max_rows:
        keep = keep & (F.col("row_no") <= max_rows)
    out = grid.filter(keep)
    return out.withColumn("cells", F.slice("cells", 1, max_columns)) if max_columns else out


def melt(grid: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per cell: ``file, row_no``, the columns of ``keep``, ``col_no`` (from 1) and the trimmed text."""
    cell = F.trim(F.translate("value", "\n", " "))
    return grid.select("file", "row_no", *keep, F.posexplode("cells").alias("p", "value")).select(
        "file", "row_no", *keep, (F.col("p") + 1).alias("col_no"), F.coalesce(cell, F.lit("")).alias("value"))


def dealt(grid: DataFrame, bucket: int = 2_000) -> DataFrame:
    """Rows, still whole, dealt out by file and ``_bucket`` (of row numbers).

    Cells melted from them stay in their task: work by row needs no exchange of cells. The number of tasks is
    given, for adaptive execution would weigh the rows as they travel, not the cells and properties that come of them.
    """
    tasks = int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return grid.withColumn("_bucket", F.floor(F.col("row_no") / bucket)).repartition(tasks, "file", "_bucket")


def mapped_cells(header_rows: int = 0, header_columns: int = 0, mapped_rows: Sequence[int] | int = 0,
                 mapped_columns: Sequence[int] | int = 0, namespaces: Sequence[str] = (), header: str | None = None) -> Column:
    """Predicate on ``row_no, col_no``: is the cell looked up in the PV map."""
    def within(c: str, spec: Sequence[int] | int) -> Column:
        if isinstance(spec, int):
            return (F.col(c) <= spec) if spec > 0 else F.lit(False)
        return F.col(c).isin(*spec) if spec else F.lit(False)

    if not mapped_rows and not mapped_columns:
        return F.lit(True)
    hit = within("row_no", header_rows) | within("col_no", header_columns) | within("row_no", mapped_rows) | within("col_no", mapped_columns)
    if header and namespaces:
        hit = hit | F.coalesce(F.col(header).isin(*namespaces), F.lit(False))
    return hit


def fill_merged(cells: DataFrame, props: str = "props", default: int | None = None) -> DataFrame:
    """Empty header cells without properties take those of the nearest cell to the left.

    ``#MergedCell`` on that cell, or ``default``, limits how far; a non-number means no limit.
    """
    w = Window.partitionBy("file", "row_no").orderBy("col_no").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when((F.col("value") != "") | F.col(props).isNotNull(), F.struct(F.col("col_no").alias("c"), F.col(props).alias("p")))
    source = F.last(own, ignorenulls=True).over(w)
    rule = F.coalesce(source["p"]["#MergedCell"], F.lit(str(default)) if default is not None else F.lit(None).cast("string"))
    limit = F.when(parse_number(rule) > 0, parse_number(rule)).when(F.lower(rule).isin("true", "yes"), F.lit(1e9)).otherwise(F.lit(0.0))
    empty = (F.col("value") == "") & F.col(props).isNull()
    return cells.withColumn("_src", source).withColumn(
        props, F.when(empty & (F.col("col_no") - F.col("_src.c") <= limit), F.col("_src.p")).otherwise(F.col(props))).drop("_src")


def fold_headers(header_cells: DataFrame, props: str = "props") -> DataFrame:
    """Stacked header rows to one map per file and column, later rows win; also the last header text."""
    rows = sort_by(F.collect_list(F.struct("row_no", F.col("value").alias("t"), F.col(props).alias("p"))), "row_no")
    return header_cells.groupBy("file", "col_no").agg(rows.alias("_r")).select(
        "file", "col_no", F.element_at("_r", -1)["t"].alias("header"),
        overlay_all(F.transform(F.filter("_r", lambda r: r["p"].isNotNull()), lambda r: r["p"])).alias("header_props"))


def attach_fixed_headers(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Join the folded headers; broadcast when there are few files."""
    return cells.join(bounded(headers), ["file", "col_no"], "left")


def attach_running_headers(cells: DataFrame, header_columns: Sequence[str], bucket: int = 20_000) -> DataFrame:
    """Carry header properties (one column each) down their column, newer header rows overlaying older ones."""
    return carry_forward(cells, ["file", "col_no"], "row_no", header_columns, bucket)


def header_states(cells: DataFrame, columns: Sequence[str], bucket: int = 20_000) -> DataFrame:
    """What holds in each column from a header row on: ``file, row_no, head, state``, the interval table of a file.

    ``cells`` are those of header rows only (``file, row_no, col_no, head`` and ``columns``); ``state`` is an array with
    one struct of ``columns`` per column of the file. Newer header rows overlay older ones.
    """
    widest = cells.groupBy("file").agg(F.max("col_no").alias("_w"))
    rows = cells.select("file", "row_no", "head").distinct().join(bounded(widest), "file")
    every = rows.select("file", "row_no", "head", F.explode(F.sequence(F.lit(1), "_w")).alias("col_no"))  # a short row ends no column
    padded = materialise(every.join(cells.drop("head"), ["file", "row_no", "col_no"], "left"))
    carried = attach_running_headers(padded, columns, bucket)
    own = F.struct("col_no", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("s"))
    return carried.groupBy("file", "row_no").agg(F.max("head").alias("head"), F.array_sort(F.collect_list(own)).alias("_a")).select(
        "file", "row_no", "head", F.transform("_a", lambda x: x["s"]).alias("state"))


def with_header_state(grid: DataFrame, states: DataFrame, bucket: int = 20_000) -> DataFrame:
    """Body rows with the ``state`` of the last header row at or above them, dealt out as by :func:`dealt`.

    Rows and states travel once, as they are, and meet in one ordered pass over each bucket; a bucket
    starts with the last state of those before it. Header rows (``head``) themselves are left out.
    """
    at = F.floor(F.col("row_no") / bucket)
    kind = states.schema["state"].dataType
    tails = states.groupBy("file", at.alias("_bucket")).agg(F.max_by("state", "row_no").alias("state"))
    buckets = grid.select("file", at.alias("_bucket")).distinct()
    earlier = Window.partitionBy("file").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    either = buckets.withColumn("state", F.lit(None).cast(kind)).unionByName(tails).groupBy("file", "_bucket").agg(F.max_by("state", F.col("state").isNotNull()).alias("state"))
    starts = either.select("file", "_bucket", F.last("state", True).over(earlier).alias("state")).filter(F.col("state").isNotNull())
    none = F.lit(None).cast("array<string>").alias("cells")
    united = (grid.select("file", "row_no", "cells", F.lit(None).cast(kind).alias("state"), F.lit(False).alias("head"), F.lit(2).alias("_kind"))
              .unionByName(states.select("file", "row_no", none, "state", F.col("head").cast("boolean").alias("head"), F.lit(1).alias("_kind")))
              .unionByName(starts.select("file", (F.col("_bucket") * bucket).alias("row_no"), none, "state", F.lit(False).alias("head"), F.lit(0).alias("_kind"))))
    upto = Window.partitionBy("file", "_bucket").orderBy("row_no", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    met = dealt(united, bucket).withColumns({"state": F.last("state", True).over(upto), "_head_at": F.last(F.when(F.col("head"), F.col("row_no")), True).over(upto)})
    body = met.filter((F.col("_kind") == 2) & ~F.col("_head_at").eqNullSafe(F.col("row_no")))
    return body.select("file", "_bucket", "row_no", "cells", "state")


def carry_row(cells: DataFrame, props: Sequence[str], flows: Column, row: Sequence[str] = ("file", "row_no")) -> DataFrame:
    """Properties of cells where ``flows`` holds reach every cell of the row.

    A cell keeps its own value, else takes the nearest one to its left, else the last one to its right. ``row`` may name
    further columns that cells were dealt out by.
    """
    before = Window.partitionBy(*row).orderBy("col_no").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*row).orderBy("col_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = cells.withColumns({f"_f:{p}": F.when(flows, F.col(f"`{p}`")) for p in props})
    carried = {p: F.coalesce(F.col(f"`{p}`"), F.last(F.col(f"`_f:{p}`"), True).over(before), F.last(F.col(f"`_f:{p}`"), True).over(whole)) for p in props}
    return out.withColumns(carried).drop(*[f"_f:{p}" for p in props])


def fold_row(cells: DataFrame, row: Sequence[str], shared: Sequence[str], flows: Column, wanted: Column, flowing: dict[str, Column]) -> DataFrame:
    """The row's own carry as a fold over its few flowing cells; only ``wanted`` cells come out.

    As :func:`carry_row`: a cell keeps its own ``shared`` properties, else takes the nearest to its left, else the last of
    the row; ``flowing`` are the values that flow where they differ from the cell's own. What is carried is also given alone,
    as ``_c:<prop>``, for those. Cells must lie together by ``row`` (:func:`dealt`); then nothing is exchanged.
    """
    width = len(shared)
    own = F.array(*[F.col(f"`{p}`") for p in shared]).cast("array<string>")
    sent = F.array(*[flowing.get(p, F.col(f"`{p}`")) for p in shared]).cast("array<string>")
    others = [c for c in cells.columns if c not in shared and c not in row and c != "col_no"]
    whole_cell = F.struct("col_no", own.alias("v"), *[F.col(f"`{c}`").alias(c) for c in others])
    rows = cells.groupBy(*row).agg(F.collect_list(F.when(flows, F.struct("col_no", sent.alias("v")))).alias("_flows"), F.collect_list(F.when(wanted, whole_cell)).alias("_cells"))
    rows = rows.filter(F.size("_cells") > 0).withColumn("_flows", F.array_sort("_flows"))
    nothing = F.array_repeat(F.lit(None).cast("string"), width)
    newest = lambda cs: F.aggregate(cs, nothing, lambda acc, c: F.zip_with(acc, c["v"], lambda a, b: F.coalesce(b, a)))
    first = lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(x, y))
    apart = rows.withColumn("_all", newest(F.col("_flows"))).select(*row, "_flows", "_all", F.explode("_cells").alias("_c"))
    left = newest(F.filter("_flows", lambda c: c["col_no"] < F.col("_c.col_no")))
    met = apart.select(*row, "_c", first(left, F.col("_all")).alias("_t"))
    met = met.withColumn("_v", first(F.col("_c.v"), F.col("_t")))
    return met.select(*row, "_c.col_no", *[F.get("_v", F.lit(i)).alias(p) for i, p in enumerate(shared)], *[F.col(f"_c.`{c}`").alias(c) for c in others],
                      *[F.get("_t", F.lit(i)).alias(f"_c:{p}") for i, p in enumerate(shared) if p in flowing])


def candidate_keys(grid: DataFrame, first_rows: int = 100, max_length: int = 80) -> DataFrame:
    """Distinct short, non-numeric texts of the first rows: the strings a PV map should cover."""
    cells = melt(grid.filter(F.col("row_no") <= first_rows))
    return cells.filter((F.col("value") != "") & (F.length("value") < max_length) & parse_number(F.col("value")).isNull()).select("value").distinct()


def file_properties(grid: DataFrame, delimiter: str = " ") -> DataFrame:
    """Distinct file names as lookup strings: base name with odd characters as word breaks."""
    base = F.element_at(F.split("file", "/"), -1)
    return grid.select("file").distinct().select("file", F.regexp_replace(base, r"[^A-Za-z0-9_.\-]", delimiter).alias("value"),
                                                  F.lit(None).cast("string").alias("header"))


# Words that mark summary rows and table notes.
TOTAL_WORDS = ("total", "all", "sum", "overall", "national", "combined", "whole", "entire", "grand")
NOTE_WORDS = ("table", "figure", "year:", "note", "source", "(number", "unnamed:")
FOOTER_MARKS = ("source", "note", "data from", "footnote", "*", "†", "‡")


def _has_word(text: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.lower(text).contains(w.lower())
    return hit


def is_total_row(cells: Column, keywords: Sequence[str] = TOTAL_WORDS, first_cells: int = 5) -> Column:
    return F.exists(F.slice(cells, 1, first_cells), lambda c: _has_word(c, keywords))


def total_rows(grid: DataFrame, keywords: Sequence[str] = TOTAL_WORDS, first_cells: int = 5, keep: int = 2) -> DataFrame:
    """Rows that summarise others (keyword in the first cells), the first ``keep`` per file."""
    w = Window.partitionBy("file").orderBy("row_no")
    hit = grid.filter(is_total_row(F.col("cells"), keywords, first_cells))
    return hit.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep).drop("_n")


def _filled(cells: Column) -> Column:
    return F.size(F.filter(cells, lambda c: F.trim(c) != ""))


def header_row_count(grid: DataFrame, most: int = 5, notes: Sequence[str] = NOTE_WORDS) -> DataFrame:
    """Leading header rows per file: mostly empty, a note word in the first cell, or hardly any numbers."""
    size = F.greatest(F.size("cells"), F.lit(1))
    numbers = F.size(F.filter("cells", lambda c: F.trim(F.translate(c, ",%", "")).try_cast("double").isNotNull()))
    header = ((size - _filled(F.col("cells"))) / size > 0.5) | _has_word(F.trim(F.get("cells", F.lit(0))), notes) | (numbers / size < 0.1)
    head = grid.filter(F.col("row_no") <= most)
    first_body = F.coalesce(F.min(F.when(~header, F.col("row_no"))), F.max("row_no") + 1)
    return head.groupBy("file").agg(F.greatest(first_body - 1, F.lit(1)).alias("header_rows"))


def footer_start(grid: DataFrame, last: int = 20, keywords: Sequence[str] = FOOTER_MARKS, share: float = 0.3, header_rows: int = 0) -> DataFrame:
    """First footer row among the last rows of each file: a mark in the first cell, or far fewer filled cells
    than the mean of the rows between the header and those last rows."""
    sized = grid.withColumn("_f", _filled(F.col("cells")))
    ends = sized.groupBy("file").agg(F.max("row_no").alias("_n"))
    body = sized.join(ends, "file").filter((F.col("row_no") > header_rows) & (F.col("row_no") <= F.col("_n") - last))
    stats = ends.join(body.groupBy("file").agg(F.avg("_f").alias("_m")), "file", "left").withColumn("_m", F.coalesce("_m", F.lit(0.0)))
    word = _has_word(F.trim(F.get("cells", F.lit(0))), keywords)
    tail = sized.join(stats, "file").filter((F.col("row_no") > F.col("_n") - last) & (F.col("row_no") > header_rows))
    return tail.filter(word | (F.col("_f") < F.col("_m") * share)).groupBy("file").agg(F.min("row_no").alias("footer_row"))


def preview(grid: DataFrame, rows: int = 5) -> DataFrame:
    """First rows of every table."""
    return grid.filter(F.col("row_no") <= rows)
