"""Row-wise operators and small-table lookups on streams.

The library has no stateful stream operators; these wrappers show that column builders and lookups
work unchanged on a streaming DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import resolve_date
from ..functions.numbers import parse_number


def clean_observations(stream: DataFrame, value: str = "value", date: str = "observationDate") -> DataFrame:
    """Parse values and dates of arriving observations, dropping what does not parse."""
    out = stream.withColumns({value: parse_number(F.col(value)), date: resolve_date(F.col(date))})
    return out.filter(F.col(value).isNotNull() & F.col(date).isNotNull())


def enrich(stream: DataFrame, table: DataFrame, key: str, out: str) -> DataFrame:
    """Left join a static code table (``key, out``) to a stream."""
    return stream.join(table.select(key, out).dropDuplicates([key]), key, "left")
