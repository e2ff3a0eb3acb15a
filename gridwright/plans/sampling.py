"""Profile a table and draw a sample that shows all of its variety."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators import profile as p, sample as s
from ..session import materialise


def sample_table(df: DataFrame, ids: Sequence[str], fill_to: int = 80, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The sample and the column labels. Two passes: one profile, one selection."""
    columns = [c for c in df.columns if c not in ids]
    prof = materialise(p.column_profile(df, columns))
    labels = materialise(p.classify_columns(df.select(*columns), prof))
    kept = {r["column"]: r["label"] for r in labels.select("column", "label").collect()}
    few = [r["column"] for r in p.categorical_columns(prof).collect() if kept[r["column"]] in ("categorical", "numeric", "text")]
    numeric = [c for c, label in kept.items() if label == "numeric" and c not in few]
    ranges = p.numeric_ranges(df, numeric) if numeric else None
    return s.coverage_sample(df, ids, few, numeric, ranges, fill_to=fill_to, seed=seed), labels

