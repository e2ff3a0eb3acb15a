"""Column profiles: counts, kinds of columns, ranges and relations between columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import parse_number
from ..session import materialise
from .scale import bounded, with_position

# Header patterns of derived columns, with the header start their base column has.
DERIVED_HEADERS = (("^EP_", "E_"), ("^MP_", "M_"), ("^EPL_", "EP_"), ("^RPL_", None), ("^SPL_", None), ("^F_", "E_"),
                   ("_pct$", None), ("_percent$", None), ("_rate$", None), ("_moe$", None))


def long_values(df: DataFrame, columns: Sequence[str] | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """``column, value`` rows of a wide table (values as trimmed text, empty for null)."""
    pairs = [F.struct(F.lit(c).alias("column"), F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")).alias("value"))
             for c in (columns or [c for c in df.columns if c not in carry])]
    return df.select(*carry, F.explode(F.array(*pairs)).alias("p")).select(*carry, "p.column", "p.value")


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows per (column, value): the pre-aggregated base of all profiles."""
    return long_values(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows, distinct values, empty share, mean length and numeric share of every column."""
    n, filled = F.col("n"), F.col("value") != ""
    numeric = parse_number(F.col("value")).isNotNull()
    return value_counts(df, columns).groupBy("column").agg(
        F.sum(n).alias("rows"), F.count_if(filled).alias("n_distinct"),
        (F.sum(F.when(filled, F.lit(0)).otherwise(n)) / F.sum(n)).alias("empty_ratio"),
        F.coalesce(F.sum(F.when(filled, n * F.length("value"))) / F.sum(F.when(filled, n)), F.lit(0.0)).alias("avg_len"),
        F.coalesce(F.sum(F.when(filled & numeric, n).otherwise(0)) / F.sum(F.when(filled, n)), F.lit(0.0)).alias("numeric_share"))


def is_constant(threshold: float = 0.01) -> Column:
    return ((F.col("n_distinct") / F.col("rows") <= threshold) | (F.col("n_distinct") <= 1) | (F.col("empty_ratio") > 0.95)
            | (F.trim(F.col("column")) == ""))


def is_metadata(min_length: float = 50.0, unique: float = 0.9) -> Column:
    return (F.col("avg_len") >= min_length) & (F.col("n_distinct") / F.col("rows") > unique)


def adaptive_threshold(rows: Column) -> Column:
    """Largest distinct share of a categorical column, by table size."""
    return F.when(rows < 500, 0.20).when(rows < 2000, 0.10).otherwise(0.05)


def is_id_name(c: Column, marks: Sequence[str] = ("ID", "CODE", "FIPS", "KEY")) -> Column:
    """Names that contain an identifier mark."""
    hit = F.lit(False)
    for m in marks:
        hit = hit | F.upper(c).contains(m)
    return hit


def categorical_columns(profile: DataFrame) -> DataFrame:
    """Columns with few distinct values for their table size, ids excluded."""
    few = F.col("n_distinct") / F.col("rows") <= adaptive_threshold(F.col("rows"))
    return profile.filter(few & (F.col("n_distinct") > 1) & ~is_id_name(F.col("column"))).select("column", "n_distinct", "rows")


def column_signatures(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column (``i``, its place) a hash of how its values divide the rows, whatever the values are; and ``n_distinct``.

    A value's rows are summed up as 32-bit pieces of two hashes of the row, which doesn't depend on their order; the
    sums of all values of a column give its signature ``g0`` to ``g3``. Work grows with the number of columns.
    """
    text = lambda c: F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))

    def pieces(name: str, *parts: Column) -> list[Column]:
        both = [F.xxhash64(*parts, F.lit(salt)) for salt in (1, 2)]
        halves = [h for b in both for h in (b.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(b, 32))]
        return [h.alias(f"{name}{k}") for k, h in enumerate(halves)]

    values = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), text(c).alias("v")) for i, c in enumerate(columns)]))
    rows = df.select(*pieces("q", *[text(c) for c in columns]), values.alias("x")).select("q0", "q1", "q2", "q3", "x.*")
    classes = rows.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"q{k}").alias(f"s{k}") for k in range(4)])
    each = classes.select("i", "v", *pieces("p", "n", "s0", "s1", "s2", "s3"))
    return each.groupBy("i").agg(F.count_if(F.col("v") != "").alias("n_distinct"), *[F.sum(f"p{k}").alias(f"g{k}") for k in range(4)])


def redundant_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Column pairs in 1:1 correspondence: those whose values divide the rows alike, empty ones included."""
    columns = list(columns or df.columns)
    # one row for each column
    signed = materialise(column_signatures(df, columns).filter("n_distinct > 1"))
    other = signed.withColumnRenamed("i", "j")
    pairs = signed.join(other, ["n_distinct", "g0", "g1", "g2", "g3"]).filter("i < j")
    name = lambda place: F.get(F.array(*[F.lit(c) for c in columns]), F.col(place))
    return pairs.select(name("i").alias("column_a"), name("j").alias("column_b"), "n_distinct")


def derived_by_name(headers: Sequence[str]) -> list[str]:
    """Headers that follow a derived-column pattern (and whose base column exists where one is needed)."""
    known = set(headers)
    out = []
    for h in headers:
        for pattern, base in DERIVED_HEADERS:
            if re.search(pattern, h, re.IGNORECASE) and (base is None or re.sub(pattern, base, h, flags=re.IGNORECASE) in known):
                out.append(h)
                break
    return out


def percentage_columns(df: DataFrame, columns: Sequence[str], tolerance: float = 0.01) -> DataFrame:
    """Columns that are a percentage of another: base / (pct / 100) is nearly constant over all rows."""
    num = lambda c: F.col(f"`{c}`").cast("double")
    ends = df.agg(*[F.min(num(c)).alias(f"lo{i}") for i, c in enumerate(columns)], *[F.max(num(c)).alias(f"hi{i}") for i, c in enumerate(columns)]).first()
    pct = [c for i, c in enumerate(columns) if ends[f"lo{i}"] is not None and ends[f"lo{i}"] >= 0 and ends[f"hi{i}"] <= 100]
    pairs = [(p, b) for p in pct for b in columns if b != p]
    if not pairs:
        return df.sparkSession.createDataFrame([], "pct_column string, base_column string, total double")
    aggs = []
    for i, (p, b) in enumerate(pairs):
        total = F.when(num(p) > 0, num(b) / (num(p) / 100))
        aggs += [F.avg(total).alias(f"a{i}"), F.min(total).alias(f"l{i}"), F.max(total).alias(f"h{i}")]
    one = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("pct_column"), F.lit(b).alias("base_column"), F.col(f"a{i}").alias("total"),
                                        F.col(f"l{i}").alias("l"), F.col(f"h{i}").alias("h")) for i, (p, b) in enumerate(pairs)]))
    spread = F.greatest(F.col("h") - F.col("total"), F.col("total") - F.col("l")) / F.col("total")
    return one.select(rows.alias("r")).select("r.*").filter((F.col("total") != 0) & (spread <= tolerance)).select("pct_column", "base_column", "total")


def numeric_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact min, quartiles and max: the values at sorted places n/4, n/2 and 3n/4.

    Values are counted first, then placed by a distributed prefix sum, so neither a popular value
    nor a long column ends up in one task.
    """
    numbers = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns]))
    counts = (df.select(numbers.alias("r")).select("r.*").filter(F.col("v").isNotNull()).groupBy("column", "v").agg(F.count(F.lit(1)).alias("n")))
    placed = with_position(counts, ["column", "v"], "pos", "n")
    base = placed.groupBy("column").agg(F.min("pos").alias("_p0"), F.sum("n").alias("rows"), F.min("v").alias("min"), F.max("v").alias("max"))
    at = placed.join(F.broadcast(base), "column").withColumn("_s", F.col("pos") - F.col("_p0"))
    n = F.col("rows")
    spot = lambda k: F.max(F.when((F.col("_s") <= k) & (k < F.col("_s") + F.col("n")), F.col("v")))
    out = at.groupBy("column").agg(F.first("rows").alias("rows"), F.first("min").alias("min"), F.first("max").alias("max"),
                                   spot(F.floor(n / 4)).alias("q1"), spot(F.floor(n / 2)).alias("median"), spot(F.floor(n * 3 / 4)).alias("q3"))
    return out.select("column", "rows", "min", F.when(F.col("rows") >= 4, F.col("q1")).otherwise(F.col("min")).alias("q1"), "median",
                      F.when(F.col("rows") >= 4, F.col("q3")).otherwise(F.col("max")).alias("q3"), "max")


def classify_columns(df: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """One label per column: constant, derived, metadata, redundant, numeric, categorical or text."""
    profile = materialise(column_profile(df) if profile is None else profile)
    pairs = materialise(redundant_pairs(df).select(F.col("column_b").alias("column")).distinct().withColumn("_red", F.lit(True)))
    numeric = [r["column"] for r in profile.filter(F.col("numeric_share") > 0.8).select("column").collect()]
    by_name = derived_by_name(df.columns)
    by_share = materialise(percentage_columns(df, numeric).select(F.col("pct_column").alias("column")).distinct().withColumn("_pct", F.lit(True)))
    labelled = profile.join(bounded(pairs), "column", "left").join(bounded(by_share), "column", "left")
    derived = F.coalesce(F.col("_pct"), F.lit(False)) | (F.col("column").isin(*by_name) if by_name else F.lit(False))
    label = (F.when(is_constant(), "constant").when(derived, "derived").when(is_metadata(), "metadata").when(F.col("_red"), "redundant")
             .when(F.col("numeric_share") > 0.8, "numeric").when(F.col("n_distinct") / F.col("rows") < 0.1, "categorical").otherwise("text"))
    return labelled.select("column", "rows", "n_distinct", "empty_ratio", "avg_len", "numeric_share", label.alias("label"))


def skip_columns(classified: DataFrame) -> DataFrame:
    """Columns that add nothing to a sample."""
    return classified.filter(F.col("label").isin("constant", "derived", "metadata", "redundant")).select("column", "label")


# Cell kinds and the texts that show them.
CELL_KINDS = {
    "DATE": r"^(19|20)\d{2}([-/](0?[1-9]|1[0-2])([-/](0?[1-9]|[12]\d|3[01]))?)?$",
    "VALUE": r"^[-+]?[$]?[0-9][0-9,]*(\.[0-9]+)?%?$",
}


def cell_kinds(words: dict[str, Sequence[str]] | None = None, patterns: dict[str, str] | None = None) -> dict[str, Column]:
    """Named predicates on ``value``: patterns and word lists; callers may add their own."""
    kinds = {k: F.col("value").rlike(p) for k, p in (patterns or CELL_KINDS).items()}
    for k, ws in (words or {}).items():
        kinds[k] = F.lower("value").isin(*[w.lower() for w in ws])
    return kinds


def annotate_cells(cells: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """Label of every cell: the first kind that fits, else TEXT; empty cells have none."""
    label = F.when(F.col("value") == "", F.lit(None).cast("string"))
    for name, cond in kinds.items():
        label = label.when(cond, F.lit(name))
    return cells.withColumn("label", label.otherwise(F.lit("TEXT")))


def column_kinds(annotated: DataFrame, by: Sequence[str] = ("column",)) -> DataFrame:
    """Majority label per column (alphabetical on ties)."""
    counts = annotated.filter(F.col("label").isNotNull()).groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.min_by(F.struct("label", "n"), F.struct(-F.col("n"), "label")).alias("b")).select(*by, "b.label", "b.n")


def first_value_row(annotated: DataFrame, kind: str = "VALUE", by: Sequence[str] = ("file",), row: str = "row_no") -> DataFrame:
    """First row that holds data; rows above are headers."""
    return annotated.filter(F.col("label") == kind).groupBy(*by).agg(F.min(row).alias("first_row"))


def map_skeleton(kinds: DataFrame, column: str = "column") -> DataFrame:
    """Starting PV map of a table: one key per column with the property its kind suggests."""
    prop = F.when(F.col("label") == "DATE", "observationDate").when(F.col("label") == "PLACE", "observationAbout").when(F.col("label") == "VALUE", "value").otherwise(F.lit(None))
    text = F.when(F.col("label") == "VALUE", "{Number}").otherwise("{Data}")
    return kinds.select(F.lit("GLOBAL").alias("namespace"), F.col(column).alias("key"), F.when(prop.isNotNull(), F.create_map(prop, text)).alias("props")).filter(F.col("props").isNotNull())
