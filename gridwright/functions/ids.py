"""Identifiers and titles of statistical variables, from property columns or property maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .text import camel_to_words, capitalize_first, strip_namespace

# Properties that never enter an id, id order, boolean properties and id affixes.
IGNORED_PROPS = ("unit", "Node", "memberOf", "typeOf", "constraintProperties", "name", "nameWithLanguage",
                 "description", "descriptionUrl", "label", "url", "alternateName", "scalingFactor")
LEADING_PROPS = ("measurementQualifier", "statType", "measuredProperty", "populationType")
DENOMINATOR = "measurementDenominator"

_NUM = r"(-|-?[0-9]+(?:\.[0-9]+)?)"
_UNIT = r"([A-Za-z_/0-9]+)"
_RANGE_LAST = rf"^\[{_NUM} {_NUM} {_UNIT}\]"
_RANGE_FIRST = rf"^\[{_UNIT} {_NUM} {_NUM}\]"
_ONE_LAST = rf"^\[{_NUM} {_UNIT}\]"
_ONE_FIRST = rf"^\[{_UNIT} {_NUM}\]"


def id_word(v: Column) -> Column:
    """Value text as an id term: no namespace, alternatives joined by ``Or``, capitalised parts."""
    bare = F.regexp_replace(v, "^[^:]*:", "")
    parts = F.transform(
        F.split(bare, "__|&"),
        lambda w: F.regexp_replace(w, "^(?:USC|CDC|DAD|BLS|NCES|ACSED|UCR)([A-Z_])", "$1"))
    joined = F.replace(F.array_join(parts, "Or"), F.lit("_"), F.lit(""))
    hyphened = F.regexp_replace(joined, "(?<=[0-9])/+(?=[0-9])", "-")
    return F.array_join(
        F.transform(F.filter(F.split(hyphened, "/"), lambda t: t != ""), capitalize_first), "")


def _range_term(lo: Column, hi: Column, unit: Column) -> Column:
    unit = id_word(unit)
    more = F.when(unit == "Date", F.lit("OrLater")).otherwise(F.lit("OrMore"))
    less = F.when(unit == "Date", F.lit("OrEarlier")).otherwise(F.lit("OrLess"))
    return (F.when(hi == "-", F.concat(lo, more, unit))
            .when(lo == "-", F.concat(hi, less, unit))
            .otherwise(F.concat(lo, F.lit("To"), hi, unit)))


def quantity_term(v: Column) -> Column:
    """``[10 20 Years]`` -> ``10To20Years``; null when the text is no quantity."""
    g = lambda p, i: F.regexp_extract(v, p, i)
    return (
        F.when(v.rlike(_RANGE_LAST), _range_term(g(_RANGE_LAST, 1), g(_RANGE_LAST, 2), g(_RANGE_LAST, 3)))
        .when(v.rlike(_RANGE_FIRST), _range_term(g(_RANGE_FIRST, 2), g(_RANGE_FIRST, 3), g(_RANGE_FIRST, 1)))
        .when(v.rlike(_ONE_LAST), F.concat(g(_ONE_LAST, 1), id_word(g(_ONE_LAST, 2))))
        .when(v.rlike(_ONE_FIRST), F.concat(g(_ONE_FIRST, 2), id_word(g(_ONE_FIRST, 1))))
    )


def boolean_term(prop: Column, v: Column) -> Column:
    """``isX`` / ``hasX`` with True or False -> IsX, NotX, HasX, NoX."""
    has = F.when(v == "True", F.lit("Has")).otherwise(F.lit("No"))
    is_ = F.when(v == "True", F.lit("Is")).otherwise(F.lit("Not"))
    return F.when(v.isin("True", "False"),
                  F.when(prop.startswith("has"), F.concat(has, F.substr(prop, F.lit(4))))
                  .when(prop.startswith("is"), F.concat(is_, F.substr(prop, F.lit(3)))))


def code_term(v: Column, names: Column, prefix: str) -> Column:
    """``NAICS/51`` style codes by a code -> name map column; ranges ``44-45`` and lists ``51_52`` are spelled out."""
    bare = F.replace(F.regexp_replace(v, "^[^:]*:", ""), F.lit(f"{prefix}/"), F.lit(""))
    pieces = F.regexp_extract_all(bare, F.lit(r"(\d+-\d+|\d+)"), F.lit(1))

    def spelled(p: Column) -> Column:
        codes = F.when(p.contains("-"), F.transform(
            F.sequence(F.split_part(p, F.lit("-"), F.lit(1)).cast("int"), F.split_part(p, F.lit("-"), F.lit(2)).cast("int")),
            lambda c: c.cast("string"))).otherwise(F.array(p))
        return F.array_join(F.array_distinct(F.filter(F.transform(codes, lambda c: names[c]), lambda n: n.isNotNull())), "")

    return F.concat(F.lit(prefix), F.array_join(F.transform(pieces, spelled), ""))


def constraint_term(prop: Column, v: Column, boolean_props: Sequence[str] = ()) -> Column:
    named = F.when(prop.isin(*boolean_props), boolean_term(prop, v)) if boolean_props else F.lit(None).cast("string")
    return F.coalesce(named, quantity_term(v), id_word(v))


def affixed(term: Column, rule: dict[str, str]) -> Column:
    """Replace, prepend (unless already there) and append text of one property's rule."""
    if rule.get("replace"):
        term = F.replace(term, F.lit(rule["replace"]), F.lit(rule.get("replacement", "")))
    if rule.get("prepend"):
        p = rule["prepend"]
        term = F.when(F.lower(term).startswith(p.lower()), term).otherwise(F.concat(F.lit(p), term))
    return F.concat(term, F.lit(rule["append"])) if rule.get("append") else term


def denominator_term(v: Column) -> Column:
    bare = F.regexp_replace(v, "^[^:]*:", "")
    return (F.when(bare == "PerCapita", F.lit("PerCapita"))
            .when(bare.rlike(r"^\p{Ll}"), F.concat(F.lit("Per"), id_word(bare)))
            .otherwise(F.concat(F.lit("AsAFractionOf_"), bare)))


def _stat_type_term(v: Column) -> Column:
    return F.when(v.isNotNull() & ~v.contains("measuredValue"), id_word(F.replace(v, F.lit("Value"), F.lit(""))))


def _clean(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z_0-9/.\-]+", "_")


def variable_id(columns: dict[str, Column], ignore: Sequence[str] = (), boolean_props: Sequence[str] = (),
                affixes: dict[str, dict[str, str]] | None = None) -> Column:
    """Variable id from one column per property. Null properties drop out of the id.

    The set and order of the constraint properties are known when the plan is built, so the id is
    one flat expression.
    """
    skip = set(ignore) | set(IGNORED_PROPS) | set(LEADING_PROPS) | {DENOMINATOR}
    blank = lambda name: F.nullif(columns[name], F.lit("")) if name in columns else F.lit(None).cast("string")
    terms = [id_word(blank("measurementQualifier")), _stat_type_term(blank("statType")),
             id_word(blank("measuredProperty")), id_word(blank("populationType"))]
    for prop in sorted((p for p in columns if p not in skip), key=str.casefold):
        terms.append(affixed(constraint_term(F.lit(prop), blank(prop), boolean_props), (affixes or {}).get(prop, {})))
    terms.append(denominator_term(blank(DENOMINATOR)))
    return _clean(F.concat_ws("_", *terms))


def variable_id_from_map(pvs: Column, ignore: Sequence[str] = (), boolean_props: Sequence[str] = (),
                         affixes: dict[str, dict[str, str]] | None = None) -> Column:
    """Same id for an open property map."""
    skip = tuple(set(ignore) | set(IGNORED_PROPS) | set(LEADING_PROPS) | {DENOMINATOR})
    kept = F.map_filter(pvs, lambda k, v: ~k.isin(*skip) & ~k.startswith("#") & (v != ""))
    ordered = F.array_sort(F.transform(F.map_entries(kept), lambda e: F.struct(
        F.lower(e["key"]).alias("fold"), e["key"].alias("key"), e["value"].alias("value"))))

    def term(e: Column) -> Column:
        plain = constraint_term(e["key"], e["value"], boolean_props)
        out = plain
        for prop, rule in (affixes or {}).items():
            out = F.when(e["key"] == prop, affixed(plain, rule)).otherwise(out)
        return out

    blank = lambda name: F.nullif(pvs[name], F.lit(""))
    return _clean(F.concat_ws(
        "_", id_word(blank("measurementQualifier")), _stat_type_term(blank("statType")),
        id_word(blank("measuredProperty")), id_word(blank("populationType")),
        F.nullif(F.array_join(F.transform(ordered, term), "_"), F.lit("")), denominator_term(blank(DENOMINATOR))))


def fallback_id(pvs: Column, leading: Sequence[str] = ("measurementQualifier", "statType", "measuredProperty", "populationType"),
                ignore: Sequence[str] = ("description", "name", "nameWithLanguage", "descriptionUrl", "alternateName", "typeOf"),
                ignore_values: Sequence[str] = ("measuredValue", "StatisticalVariable")) -> Column:
    """Id of a schemaless variable: capitalised property names enter in front of their value."""
    skip = tuple(ignore) + tuple(leading) + (DENOMINATOR, "Node", "dcid")
    kept = F.map_filter(pvs, lambda k, v: ~k.isin(*skip) & k.rlike(r"^\p{L}") & (v != ""))
    ordered = F.array_sort(F.transform(F.map_entries(kept), lambda e: F.struct(
        F.lower(e["key"]).alias("fold"), e["key"].alias("key"), e["value"].alias("value"))))

    def value_term(v: Column) -> Column:
        return F.coalesce(quantity_term(v), capitalize_first(strip_namespace(v)))

    def term(e: Column) -> Column:
        named = e["key"].rlike(r"^\p{Lu}") & (e["key"] != strip_namespace(e["value"]))
        return F.when(named, F.concat(e["key"], F.lit("_"), value_term(e["value"]))).otherwise(value_term(e["value"]))

    heads = [F.when(~strip_namespace(pvs[p]).isin(*ignore_values), value_term(F.nullif(pvs[p], F.lit("")))) for p in leading]
    tail = F.when(pvs[DENOMINATOR].isNotNull(), F.concat(F.lit("AsAFractionOf_"), strip_namespace(pvs[DENOMINATOR])))
    text = F.concat_ws("_", *heads, F.nullif(F.array_join(F.transform(ordered, term), "_"), F.lit("")), tail)
    return F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z_0-9/\-]+", "_"), "_$", "")


def variable_title(pvs: Column, ignore: Sequence[str] = IGNORED_PROPS) -> Column:
    """``Count Person: Age 10 To 20 Years, Gender Male``; a given name wins."""
    spaced = lambda v: camel_to_words(strip_namespace(v))
    stat = F.nullif(F.replace(F.replace(strip_namespace(pvs["statType"]), F.lit("measuredValue"), F.lit("")),
                              F.lit("Value"), F.lit("")), F.lit(""))
    head = F.concat_ws(" ", spaced(stat), spaced(pvs["measurementQualifier"]), spaced(pvs["measuredProperty"]),
                       spaced(pvs["populationType"]))
    kept = F.map_filter(pvs, lambda k, v: ~k.isin(*(tuple(ignore) + LEADING_PROPS)) & k.rlike(r"^\p{L}"))
    tail = F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(
        camel_to_words(e["key"]), F.lit(" "), spaced(F.coalesce(quantity_term(e["value"]), e["value"])))), ", ")
    title = F.initcap(F.concat_ws(": ", F.nullif(head, F.lit("")), F.nullif(tail, F.lit(""))))
    return F.coalesce(F.nullif(pvs["name"], F.lit("")), title)


def series_key(columns: Sequence[str]) -> Column:
    """``prop=value`` text of the non-empty columns, sorted by name."""
    return F.concat_ws(";", *[
        F.when(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) != "",
               F.concat(F.lit(f"{c}="), F.col(f"`{c}`").cast("string"))) for c in sorted(columns)])


def place_cache_key(name: Column, lat: Column, lng: Column) -> Column:
    """Composite key of a named point, coordinates with six digits."""
    return F.concat_ws(",", name, F.format_string("%.6f", lat), F.format_string("%.6f", lng))
