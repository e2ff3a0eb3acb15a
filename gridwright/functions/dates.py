"""Dates at year, month or day grain, kept as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Output patterns per grain, and the free-form patterns with the shapes of the texts they read:
# 9 is a digit, @ three letters, # more letters.
GRAIN_PATTERNS = ("yyyy", "yyyy-MM", "yyyy-MM-dd")
FREE_PATTERNS = {
    "yyyyMMdd": ("99999999",), "M/d/yyyy": ("9/9/9999", "99/9/9999", "9/99/9999", "99/99/9999"), "d MMM yyyy": ("9 @ 9999", "99 @ 9999"), "d MMMM yyyy": ("9 # 9999", "99 # 9999"),
    "MMM d yyyy": ("@ 9 9999", "@ 99 9999"), "MMMM d yyyy": ("# 9 9999", "# 99 9999"), "MMM d, yyyy": ("@ 9, 9999", "@ 99, 9999"), "MMMM d, yyyy": ("# 9, 9999", "# 99, 9999"),
    "dd-MM-yyyy": ("99-99-9999",), "yyyy-MM-dd HH:mm:ss": ("9999-99-99 99:99:99",),
}
MONTH_PATTERNS = {"MMM yyyy": ("@ 9999",), "MMMM yyyy": ("# 9999",), "MM/yyyy": ("99/9999",), "yyyy MMM": ("9999 @",), "yyyy MMMM": ("9999 #",)}
OWN_PATTERNS = {"yyyy": ("9999",), "yyyy-M": ("9999-9", "9999-99"), "yyyy-M-d": ("9999-9-9", "9999-9-99", "9999-99-9", "9999-99-99")}


def _dashes(v: Column) -> Column:
    return F.length(v) - F.length(F.replace(v, F.lit("-"), F.lit("")))


def date_grain_format(v: Column) -> Column:
    """Pattern for the grain of a date text, by its number of dashes."""
    n = _dashes(v)
    return F.when(n == 0, F.lit("yyyy")).when(n == 1, F.lit("yyyy-MM")).otherwise(F.lit("yyyy-MM-dd"))


def period_of(v: Column, default: str = "") -> Column:
    """ISO period of a date text: P1Y, P1M or P1D."""
    n = _dashes(v)
    return F.when(n == 0, F.lit("P1Y")).when(n == 1, F.lit("P1M")).when(n == 2, F.lit("P1D")).otherwise(F.lit(default))


def _parsed(v: Column, pattern: str) -> Column:
    return F.try_to_timestamp(v, F.lit(pattern))


def resolve_date(v: Column, input_format: Column | str | None = None, output_format: str | None = None) -> Column:
    """Text to ``yyyy``, ``yyyy-MM`` or ``yyyy-MM-dd``; null when nothing parses.

    Order: the text itself at its own grain, then ``input_format``, then the free-form patterns. The text's shape picks
    one pattern, so each way costs one attempt at most and texts that are no dates cost none.
    """
    t = F.trim(v)
    digits = F.translate(t, "0123456789", "9999999999")

    def read(text: Column, shape: Column, tables: Sequence[tuple[dict[str, tuple[str, ...]], str | None]]) -> Column:
        """The text by the one pattern that its shape picks; the shape is worked out once."""
        def pick(s: Column) -> Column:
            out = F.lit(None).cast("string")
            for patterns, grain in tables:
                for pattern, shapes in patterns.items():
                    out = F.when(s.isin(*shapes), F.date_format(_parsed(text, pattern), output_format or grain or GRAIN_PATTERNS[pattern.count("-")])).otherwise(out)
            return out

        return F.get(F.transform(F.array(shape), pick), F.lit(0))

    options = [read(F.regexp_replace(t, "[^A-Za-z0-9]+", "-"), F.regexp_replace(digits, "[^A-Za-z0-9]+", "-"), [(OWN_PATTERNS, None)])]
    if isinstance(input_format, str):
        grain = "yyyy-MM-dd" if "d" in input_format else "yyyy-MM" if "M" in input_format else "yyyy"
        options.append(F.date_format(_parsed(t, input_format), output_format or grain))
    elif input_format is not None:
        options.append(F.date_format(F.try_to_timestamp(t, input_format), output_format or "yyyy-MM-dd"))
    lettered = F.regexp_replace(F.regexp_replace(digits, "[A-Za-z]{4,}", "#"), "[A-Za-z]{3}", "@")
    options.append(read(t, lettered, [(MONTH_PATTERNS, "yyyy-MM"), (FREE_PATTERNS, "yyyy-MM-dd")]))
    return F.coalesce(*options)


def period_end(v: Column) -> Column:
    """Last day of the year, month or day that a date text names."""
    year = F.substring(v, 1, 4).try_cast("int")
    month = F.when(_dashes(v) >= 1, F.substring(v, 6, 2).try_cast("int")).otherwise(F.lit(12))
    day = F.when(_dashes(v) >= 2, F.to_date(F.try_to_timestamp(F.substring(v, 1, 10), F.lit("yyyy-MM-dd"))))
    return F.coalesce(day, F.last_day(F.to_date(F.try_to_timestamp(
        F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lit("01")), F.lit("yyyy-MM-dd")))))


def years_between(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b)) / F.lit(365.0)
