"""Places: containment, names to ids, points to areas, code lists."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import add_namespace, is_place_id, strip_namespace
from .match import gram_match
from .scale import bounded
from ..session import materialise


def contained_edges(places: DataFrame) -> DataFrame:
    """``node, parent`` rows of a gazetteer with a ``containedInPlace`` array."""
    return places.select(strip_namespace(F.col("dcid")).alias("node"), F.explode("containedInPlace").alias("parent")).select(
        "node", strip_namespace(F.col("parent")).alias("parent")).distinct()


def closure(edges: DataFrame) -> DataFrame:
    """All ancestors: ``node, ancestor, level`` with the smallest level.

    Each round adds the pairs one level further up that aren't known yet, until there are none, so
    any depth and any cycle is closed. A round ends in a stored table.
    """
    pairs = materialise(edges.select("node", F.col("parent").alias("ancestor")).distinct())
    up = pairs.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("_next"))
    out, step, level = pairs.withColumn("level", F.lit(1)), pairs, 1
    while step.head(1):
        level += 1
        further = step.join(up, "ancestor").select("node", F.col("_next").alias("ancestor")).distinct()
        step = materialise(further.join(out, ["node", "ancestor"], "left_anti"))
        out = out.unionByName(step.withColumn("level", F.lit(level)))
    return out


def ranked_parents(edges: DataFrame, types: DataFrame, order: Sequence[str]) -> DataFrame:
    """Direct parents with their type, ordered by the position of the type in ``order``."""
    spot = F.array_position(F.array(*[F.lit(o) for o in order]), F.col("type"))
    place = F.when(spot > 0, spot).otherwise(F.lit(len(order) + 1))
    joined = edges.join(types.select(F.col("node").alias("parent"), "type"), "parent", "left").withColumn("_o", place)
    w = Window.partitionBy("node").orderBy("_o", "parent")
    return joined.select("node", "parent", "type", F.row_number().over(w).alias("parent_rank"))


def full_names(places: DataFrame) -> DataFrame:
    """Every name of a place alone and followed by the name of each direct parent: ``dcid, full_name``."""
    alt = F.filter(F.split(F.coalesce("alternate_name", F.lit("")), ","), lambda a: F.trim(a) != "")
    names = places.select("dcid", F.explode(F.array_distinct(F.concat(F.array("name"), F.transform(alt, lambda x: F.trim(x))))).alias("name"))
    parents = contained_edges(places).join(places.select(strip_namespace(F.col("dcid")).alias("parent"), F.col("name").alias("pname")), "parent")
    joined = names.join(parents.select(F.col("node"), "pname"), strip_namespace(F.col("dcid")) == F.col("node"))
    return names.select("dcid", F.col("name").alias("full_name")).unionByName(joined.select("dcid", F.concat_ws(" ", "name", "pname").alias("full_name"))).distinct()


def match_names(queries: DataFrame, places: DataFrame, query: str = "query", k: int = 3, min_fraction: float = 0.1, types: Sequence[str] = (),
                within: Sequence[str] = (), mode: str = "any") -> DataFrame:
    """Best places per name: gram match on full names, filtered by type or parent, first hit per place."""
    wanted = places
    if types or within:
        by_type = F.col("typeOf").isin(*types) if types else F.lit(mode == "all")
        by_parent = F.exists("containedInPlace", lambda p: strip_namespace(p).isin(*within)) if within else F.lit(mode == "all")
        if types and within:
            wanted = places.filter((by_type & by_parent) if mode == "all" else (by_type | by_parent))
        else:
            wanted = places.filter(by_type if types else by_parent)
    names = full_names(places).join(wanted.select("dcid"), "dcid", "left_semi").withColumn("id", F.concat_ws("|", "dcid", "full_name"))
    # several names of one place may hit, so the ranking is per place before the cut
    hits = gram_match(queries, names, query, "full_name", "id", min_fraction, None)
    best = hits.withColumn("dcid", F.substring_index("id", "|", 1)).groupBy("query", "dcid").agg(
        F.max("score").alias("score"), F.max_by("key", F.struct("score", "key")).alias("matched_name"))
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "dcid")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def wide_matches(matches: DataFrame, k: int = 3) -> DataFrame:
    """``query, dcid_1, dcid_2, …``."""
    return matches.groupBy("query").pivot("rank", list(range(1, k + 1))).agg(F.first("dcid")).select(
        F.col("query"), *[F.col(f"`{i}`").alias(f"dcid_{i}") for i in range(1, k + 1)])


def lookup_name(name: Column, country: Column | None = None) -> Column:
    """Text to look a place up by: the name, with the country added when it is not in it."""
    if country is None:
        return F.trim(name)
    add = (F.length(country) > 2) & ~F.lower(name).contains(F.lower(country))
    return F.trim(F.when(add, F.concat(name, F.lit(" "), country)).otherwise(name))


def resolve_places(names: DataFrame, column: str, mapped: DataFrame | None = None, resolved: DataFrame | None = None, gazetteer: DataFrame | None = None,
                   min_fraction: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Cascade on the distinct names: an id as it is, then a PV map, a resolved table, the gazetteer.

    Tables are ``name, dcid``; the gazetteer has the place columns. Returns ``name, dcid, step`` and the unresolved names.
    """
    todo = names.select(F.col(column).alias("name")).filter(F.trim("name") != "").distinct()
    out = todo.withColumns({"dcid": F.when(is_place_id(F.col("name")), F.col("name")), "step": F.when(is_place_id(F.col("name")), F.lit("id"))})
    for label, table in (("map", mapped), ("table", resolved)):
        if table is not None:
            side = bounded(table.groupBy("name").agg(F.min("dcid").alias("_d")))
            out = out.join(side, "name", "left").select("name", F.coalesce("dcid", add_namespace(F.col("_d"))).alias("dcid"),
                                                        F.when(F.col("dcid").isNull() & F.col("_d").isNotNull(), label).otherwise(F.col("step")).alias("step"))
    if gazetteer is not None:
        hits = match_names(out.filter(F.col("dcid").isNull()).select("name"), gazetteer, "name", 1, min_fraction).select(
            F.col("query").alias("name"), F.col("dcid").alias("_d"))
        out = out.join(hits, "name", "left").select("name", F.coalesce("dcid", add_namespace(F.col("_d"))).alias("dcid"),
                                                    F.when(F.col("dcid").isNull() & F.col("_d").isNotNull(), "name").otherwise(F.col("step")).alias("step"))
    return out.filter(F.col("dcid").isNotNull()), out.filter(F.col("dcid").isNull()).select("name")


def filter_resolved(places: DataFrame, allowed: dict[str, Sequence[str]]) -> DataFrame:
    """Places whose array properties meet the allowed values; a place without the property passes."""
    keep = F.lit(True)
    for prop, values in allowed.items():
        keep = keep & (F.coalesce(F.size(prop), F.lit(0)).isin(0, -1) | F.arrays_overlap(F.col(prop), F.array(*[F.lit(v) for v in values])))
    return places.filter(keep)


def by_code(df: DataFrame, column: str, codes: DataFrame, code: str = "code", out: str = "dcid") -> DataFrame:
    """Left join of a user's code list (country codes, counties, industry or occupation codes, …)."""
    side = bounded(codes.select(F.col(code).alias("_code"), F.col(out)).dropDuplicates(["_code"]))
    return df.join(side, F.col(column) == F.col("_code"), "left").drop("_code")


def _box(ring: str) -> list[Column]:
    lon, lat = F.transform(ring, lambda p: p["lon"]), F.transform(ring, lambda p: p["lat"])
    return [F.array_min(lon).alias("x0"), F.array_max(lon).alias("x1"), F.array_min(lat).alias("y0"), F.array_max(lat).alias("y1")]


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd test of a point against a ring of ``{lon, lat}`` vertices."""
    n = F.size(ring)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        F.get(ring, i).alias("a"), F.get(ring, F.pmod(i + n - 1, n)).alias("b")))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        # a level edge never spans, the divisor is only read when it is not zero
        x = (b["lon"] - a["lon"]) * (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + a["lon"]
        return F.coalesce(spans & (lon < x), F.lit(False))

    return F.pmod(F.size(F.filter(edges, crosses)), F.lit(2)) == 1


def containing_areas(points: DataFrame, polygons: DataFrame, lon: str = "lon", lat: str = "lat", cell: float = 5.0,
                     keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Areas (``area, ring``) around each point. ``keep`` filters the found rows (a user's own rule for areas).

    Polygons are listed under every grid cell their box touches and met by the point's cell in an
    equi-join; the ring test runs on those candidates only.
    """
    boxes = polygons.select("*", *_box("ring"))
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    cells = boxes.select("*", F.explode(span("x0", "x1")).alias("_cx")).select("*", F.explode(span("y0", "y1")).alias("_cy"))
    located = points.withColumns({"_cx": F.floor(F.col(lon) / cell), "_cy": F.floor(F.col(lat) / cell)})
    near = located.join(bounded(cells), ["_cx", "_cy"])
    inside = (F.col(lon) >= F.col("x0")) & (F.col(lon) <= F.col("x1")) & (F.col(lat) >= F.col("y0")) & (F.col(lat) <= F.col("y1"))
    hit = near.filter(inside & in_ring(F.col(lon), F.col(lat), F.col("ring")))
    found = hit.select(*[c for c in points.columns], "area")
    return keep(found) if keep else found
