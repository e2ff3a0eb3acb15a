"""Property maps (``map<string,string>``) as Column builders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .text import normalize_value


def overlay(base: Column, top: Column) -> Column:
    """All entries of both maps; ``top`` wins. Independent of the session's map policy."""
    return F.map_zip_with(base, top, lambda k, a, b: F.coalesce(b, a))


def overlay_all(maps: Column) -> Column:
    """Fold an array of maps from first to last, later entries win."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.aggregate(maps, empty, overlay)


def sort_by(items: Column, *fields: str) -> Column:
    """Sort an array of structs by some fields; the others (maps, say) need no order."""
    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for f in reversed(fields):
            out = F.when(a[f] < b[f], F.lit(-1)).when(a[f] > b[f], F.lit(1)).otherwise(out)
        return out

    return F.array_sort(items, compare)


def update(base: Column, new: Column, multi: Sequence[str] = ()) -> Column:
    """Overlay, but the listed properties collect their values as a sorted comma list."""
    if not multi:
        return overlay(base, new)

    def pick(k: Column, a: Column, b: Column) -> Column:
        both = F.array_join(F.array_sort(F.array_distinct(F.concat(F.split(a, ","), F.split(b, ",")))), ",")
        return F.when(k.isin(*multi) & a.isNotNull() & b.isNotNull(), both).otherwise(F.coalesce(b, a))

    return F.map_zip_with(base, new, pick)


def fill_defaults(pvs: Column, defaults: dict[str, str]) -> Column:
    """Add the non-empty defaults for properties that are missing."""
    usable = {k: v for k, v in defaults.items() if v and k[:1].islower()}
    if not usable:
        return pvs
    return overlay(F.create_map(*[F.lit(x) for kv in usable.items() for x in kv]), pvs)


def valid_property(k: Column, schemaless: bool = False) -> Column:
    return k.rlike(r"^\p{L}") if schemaless else k.rlike(r"^\p{Ll}")


def valid_value(v: Column) -> Column:
    """Not empty and without open references; a language tag may follow ``@``."""
    open_at = v.contains("@") & ~v.rlike('@[a-z]{2}"$')
    return v.isNotNull() & (v != "") & (v != '""') & ~open_at & ~(v.contains("{") & v.contains("}"))


def valid_sql(name: str) -> str:
    """:func:`valid_value` of a named column as SQL text."""
    c = f"`{name}`"
    return (f"({c} IS NOT NULL AND {c} NOT IN ('', '\"\"') AND NOT (contains({c}, '@') AND NOT {c} RLIKE '@[a-z]{{2}}\"$') "
            f"AND NOT (contains({c}, '{{') AND contains({c}, '}}')))")


def valid_column(name: str) -> Column:
    return F.expr(valid_sql(name))


def valid_pvs(pvs: Column, schemaless: bool = False) -> Column:
    return F.map_filter(pvs, lambda k, v: valid_property(k, schemaless) & valid_value(v))


def keep_props(pvs: Column, names: Sequence[str]) -> Column:
    return F.map_filter(pvs, lambda k, v: k.isin(*names))


def drop_props(pvs: Column, names: Sequence[str]) -> Column:
    return F.map_filter(pvs, lambda k, v: ~k.isin(*names))


def has_any(pvs: Column, names: Sequence[str]) -> Column:
    return F.exists(F.array(*[F.lit(n) for n in names]), lambda n: F.coalesce(pvs[n], F.lit("")) != "")


def has_all(pvs: Column, names: Sequence[str]) -> Column:
    return F.forall(F.array(*[F.lit(n) for n in names]), lambda n: F.coalesce(pvs[n], F.lit("")) != "")


def missing(pvs: Column, required: Sequence[str]) -> Column:
    return F.filter(F.array(*[F.lit(r) for r in required]), lambda r: F.coalesce(pvs[r], F.lit("")) == "")


def fingerprint(pvs: Column, ignore: Sequence[str] = ("Node", "dcid", "value"), only: Sequence[str] | None = None) -> Column:
    """Sorted ``prop:value`` text of the normalised entries."""
    kept = F.map_filter(pvs, lambda k, v: ~k.isin(*ignore) & ~k.startswith("#") & (v != ""))
    if only is not None:
        kept = keep_props(kept, only)
    pairs = F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit(":"), normalize_value(e["value"])))
    return F.array_join(F.array_sort(pairs), ";")


def rename_props(pvs: Column, names: dict[str, str]) -> Column:
    def renamed(k: Column, v: Column) -> Column:
        out = k
        for old, new in names.items():
            out = F.when(k == old, F.lit(new)).otherwise(out)
        return out

    return F.transform_keys(pvs, renamed) if names else pvs


def rename_value(pvs: Column, prop: str, old: str, new: str) -> Column:
    return F.transform_values(pvs, lambda k, v: F.when((k == prop) & (v == old), F.lit(new)).otherwise(v))


def rename_namespace(pvs: Column, old: str, new: str) -> Column:
    return F.transform_values(pvs, lambda k, v: F.regexp_replace(v, f"^{old}:", f"{new}:"))


def to_text(name: Column, pvs: Column) -> Column:
    """``name --> p:v, p:v`` with sorted properties."""
    pairs = F.transform(F.array_sort(F.map_entries(pvs)), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return F.concat(name, F.lit(" --> "), F.array_join(pairs, ", "))


def from_text(line: Column) -> Column:
    """Inverse of :func:`to_text` as struct of name and map."""
    return F.struct(
        F.trim(F.regexp_extract(line, "^(.*?) -->", 1)).alias("name"),
        F.str_to_map(F.regexp_extract(line, "--> *(.*)$", 1), F.lit(", "), F.lit(":")).alias("props"),
    )


def capitalise_to_comment(pvs: Column, node_id: Column | None = None) -> Column:
    """Schemaless variables: capitalised properties become comments, the measured property its own id."""
    caps = F.exists(F.map_keys(pvs), lambda k: k.rlike(r"^\p{Lu}") & (k != "Node"))
    commented = F.transform_keys(
        pvs, lambda k, v: F.when(k.rlike(r"^\p{Lu}") & (k != "Node"), F.concat(F.lit("# "), k)).otherwise(k))
    if node_id is not None:
        commented = overlay(commented, F.create_map(F.lit("measuredProperty"), node_id))
    return F.when(caps, commented).otherwise(pvs)
