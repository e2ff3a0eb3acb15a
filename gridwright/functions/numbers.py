"""Numbers written the way people write them, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _count(c: Column, char: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def parse_number(c: Column, decimal: str = ".", separators: str = " ,$%") -> Column:
    """Lenient number text to double; null when it is not a number.

    The first character must be a digit, sign or point; separators are dropped; with more than one
    point in the text all points are thousands marks.
    """
    text = F.trim(c.cast("string"))
    starts = text.rlike(r"^[0-9.+\-]")
    plain = F.translate(text, separators, "") if separators else text
    if decimal != ".":
        plain = F.replace(plain, F.lit(decimal), F.lit("."))
    plain = F.when(_count(c.cast("string"), ".") > 1, F.replace(plain, F.lit("."), F.lit(""))).otherwise(plain)
    number = plain.rlike(r"^[+-]?([0-9]+|([0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)$")
    return F.when(starts & number, plain.try_cast("double"))


def number_text(v: Column, digits: int = 5) -> Column:
    """Whole numbers without a fraction, others rounded to ``digits`` places."""
    whole = (v == F.floor(v)) & (F.abs(v) < F.lit(9.0e15))
    rounded = F.round(v, digits).cast(f"decimal(38,{digits})").cast("string")
    trimmed = F.regexp_replace(F.regexp_replace(rounded, "0+$", ""), r"\.$", "")
    return F.when(whole, v.cast("bigint").cast("string")).otherwise(trimmed)


def scaled(value: Column, factor: Column) -> Column:
    """``#Multiply``: the value times its factor, unchanged without one."""
    return value * F.coalesce(parse_number(factor), F.lit(1.0))
