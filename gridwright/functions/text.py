"""Text helpers as Column builders: namespaces, words, letter case, normal forms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def strip_namespace(v: Column) -> Column:
    """``dcs:Person`` -> ``Person``; quoted text is left alone."""
    stripped = F.trim(F.regexp_replace(v, r"^\p{L}*:", ""))
    return F.when(v.contains('"') | ~v.rlike(r"^\p{L}*:"), v).otherwise(stripped)


def _prefix_one(v: Column, namespace: str) -> Column:
    needs = v.rlike(r"^[\p{L}0-9]") & v.rlike(r"[\p{L}_/]") & ~v.contains(":")
    return F.when(needs, F.concat(F.lit(f"{namespace}:"), v)).otherwise(v)


def add_namespace(v: Column, namespace: str = "dcid") -> Column:
    """Prefix references; numbers, quoted text and prefixed values stay as they are."""
    many = F.array_join(
        F.transform(F.split(v, ","), lambda x: _prefix_one(F.trim(x), namespace)), ","
    )
    return F.when(v.rlike(r"^[\p{L}0-9]") & v.contains(","), many).otherwise(_prefix_one(v, namespace))


def strip_value(v: Column) -> Column:
    """Trim outside and keep a surrounding pair of quotes."""
    return F.trim(v)


def has_namespace(v: Column) -> Column:
    return F.coalesce(v.rlike(r"^\p{L}*:"), F.lit(False))


def is_schema_node(v: Column) -> Column:
    bare = strip_namespace(v)
    return F.coalesce(v.rlike(r"^[\p{L}\[]") & bare.rlike(r"^[\p{L}\p{N}_/\[\].]*$"), F.lit(False))


def is_place_id(v: Column) -> Column:
    """Looks like a resolved place id."""
    prefixed = v.startswith("dcid:") | v.startswith("dcs:")
    path = v.contains("/") & v.rlike(r"^[\p{L}\p{N}_/]+$")
    return F.coalesce(prefixed | path, F.lit(False))


def words(v: Column, delimiter: str = " ") -> Column:
    """Non-empty pieces between matches of the delimiter regex."""
    return F.filter(F.split(v, delimiter), lambda w: w != "")


def delimiter_char(delimiter: str) -> str:
    """The text that joins words again for a delimiter regex."""
    if not delimiter:
        return " "
    if "|" in delimiter:
        return delimiter.split("|")[0]
    return delimiter[1] if delimiter[0] == "[" and len(delimiter) > 1 else " "


def capitalize_first(v: Column) -> Column:
    return F.concat(F.upper(F.substring(v, 1, 1)), F.substr(v, F.lit(2)))


def camel_case(v: Column) -> Column:
    """Words to CamelCase, characters other than letters and digits act as spaces."""
    parts = F.filter(F.split(v, r"[^A-Za-z0-9]+"), lambda w: w != "")
    return F.array_join(F.transform(parts, capitalize_first), "")


def camel_to_words(v: Column) -> Column:
    """``personAge`` -> ``person Age``."""
    return F.regexp_replace(v, r"(?<=[^A-Z])(?=[A-Z0-9])", " ")


@pandas_udf(StringType())
def _nfkd(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


def match_form(v: Column, fold_accents: bool = True, keep_symbols: bool = False) -> Column:
    """Form used for fuzzy equality: decomposed, lower case, single spaces, letters and digits only.

    Pure ASCII needs no decomposition and isn't sent to Python; with ``fold_accents=False`` the whole expression stays in
    the JVM and composed letters are kept.
    """
    base = F.coalesce(_nfkd(F.when(v.rlike(r"[^\x00-\x7F]"), v)), v) if fold_accents else v
    squeezed = F.trim(F.regexp_replace(F.lower(base), " +", " "))
    return squeezed if keep_symbols else F.regexp_replace(squeezed, r"[^\p{L}\p{N} ]", "")


def quoted(v: Column) -> Column:
    """Quote text that holds a space or comma."""
    bare = F.trim(F.regexp_replace(v, r'^"+|"+$', ""))
    return F.when(bare.rlike(r"[ ,]") & ~bare.rlike(r"^\[.*\]$"), F.concat(F.lit('"'), bare, F.lit('"'))).otherwise(bare)


# stands for a delimiter while quoted text is set apart; a real one is read as a replacement character
_CUT = "\x01"


def split_quoted(v: Column, delimiter: str = ",") -> Column:
    """Split at delimiters outside double quotes, in time linear in the text; quotes stay.

    Every second piece between quotes is quoted text. With an odd number of quotes they are plain characters.
    """
    parts = F.split(F.translate(v, _CUT, "\ufffd"), '"')
    cut = F.array_join(F.transform(parts, lambda s, i: F.when(i % 2 == 0, F.replace(s, F.lit(delimiter), F.lit(_CUT))).otherwise(s)), '"')
    loose = F.replace(F.translate(v, _CUT, "\ufffd"), F.lit(delimiter), F.lit(_CUT))
    return F.split(F.when(F.size(parts) % 2 == 1, cut).otherwise(loose), _CUT)


def unquoted(cell: Column) -> Column:
    """A wholly quoted cell without its quotes, doubled quotes as one."""
    bare = F.replace(F.regexp_replace(F.regexp_replace(cell, r'^\s*"', ""), r'"\s*$', ""), F.lit('""'), F.lit('"'))
    return F.when(F.trim(cell).startswith('"') & F.trim(cell).endswith('"') & (F.length(F.trim(cell)) > 1), bare).otherwise(cell)


def value_list(v: Column) -> Column:
    """Comma list to array; commas inside double quotes do not split."""
    return F.transform(split_quoted(v), lambda x: F.trim(x))


def sorted_list_text(v: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(value_list(v))), ",")


_RANGE = r"\[ *([A-Z][A-Za-z0-9_/]*)? *([0-9.]+|-)? *([0-9.]+|-)? *([A-Z][A-Za-z0-9_]*)? *\]"


def range_parts(v: Column) -> Column:
    """``[lo hi Unit]`` as struct; ``-`` and missing bounds become null."""
    unit = F.coalesce(F.nullif(F.regexp_extract(v, _RANGE, 4), F.lit("")), F.nullif(F.regexp_extract(v, _RANGE, 1), F.lit("")))
    lo, hi = F.regexp_extract(v, _RANGE, 2), F.regexp_extract(v, _RANGE, 3)
    return F.struct(lo.try_cast("double").alias("lo"), hi.try_cast("double").alias("hi"), unit.alias("unit"))


def normalize_range(v: Column) -> Column:
    """Unit last, single spaces: ``[Years 5 10]`` -> ``[5 10 Years]``."""
    lo, hi = F.regexp_extract(v, _RANGE, 2), F.regexp_extract(v, _RANGE, 3)
    unit = range_parts(v)["unit"]
    body = F.concat_ws(" ", F.nullif(lo, F.lit("")), F.nullif(hi, F.lit("")), F.coalesce(unit, F.lit("")))
    return F.when(v.rlike(_RANGE), F.concat(F.lit("["), body, F.lit("]"))).otherwise(v)


def _normal_single(v: Column) -> Column:
    from .numbers import number_text, parse_number

    number = parse_number(v)
    multi = F.array_join(F.array_sort(F.split(strip_namespace(v), "__")), "__")
    reference = add_namespace(F.when(v.contains("__"), multi).otherwise(strip_namespace(v)))
    return (
        F.when(v.startswith("["), normalize_range(v))
        .when(number.isNotNull() & (number != 0), number_text(number, 10))
        .when(v.rlike(r"[ ,]"), quoted(v))
        .otherwise(reference)
    )


def normalize_value(v: Column) -> Column:
    """Comparable text of a property value: one namespace, sorted lists, plain numbers and ranges."""
    t = F.trim(v)
    long_text = t.rlike('^".*"$') & (F.length(t) > 100)
    listed = F.array_join(
        F.transform(F.array_sort(F.array_distinct(value_list(t))), _normal_single), ","
    )
    return F.when(t == "", t).when(long_text, t).when(t.contains(","), listed).otherwise(_normal_single(t))
