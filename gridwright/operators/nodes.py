"""Node tables as triples ``(node, prop, value, ord)``: merge, filter, diff, resolve."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.props import fingerprint
from ..functions.text import add_namespace, normalize_value, strip_namespace
from .scale import bounded

# Properties that name a node without defining it.
NAME_PROPS = ("Node", "dcid", "name", "alternateName", "nameWithLanguage", "description", "descriptionUrl")


def to_triples(nodes: DataFrame, node: str = "dcid", props: str = "props") -> DataFrame:
    """Map form to triples; comma lists become one row per value, ``ord`` keeps the property order."""
    rows = nodes.select(F.col(node).alias("node"), F.posexplode(F.map_entries(props)).alias("ord", "e"))
    return rows.select("node", F.col("e.key").alias("prop"), F.col("e.value").alias("value"), "ord")


def split_lists(triples: DataFrame) -> DataFrame:
    """One row per listed value; quoted text stays whole."""
    many = F.col("value").contains(",") & ~F.col("value").contains('"')
    pieces = F.when(many, F.split("value", r"\s*,\s*")).otherwise(F.array("value"))
    return triples.withColumn("value", F.explode(pieces))


def to_maps(triples: DataFrame) -> DataFrame:
    """Triples to one map per node. A node's properties form one row; values must already be merged text."""
    pairs = F.array_sort(F.collect_list(F.struct("prop", "value")))
    return triples.groupBy("node").agg(F.map_from_entries(pairs).alias("props"))


def merge(triples: DataFrame) -> DataFrame:
    """Union of the values of each node and property, one row per distinct value.

    The long form has no list that grows with a popular node; the distinct combines on the map side.
    """
    return split_lists(triples).groupBy("node", "prop", "value").agg(F.min("ord").alias("ord"))


def value_text(triples: DataFrame, most: int = 100_000) -> DataFrame:
    """Sorted unique values of each (node, prop) as comma text; raises beyond ``most`` values.

    Sizes are checked on distinct rows before anything is collected.
    """
    rows = triples.groupBy("node", "prop", "value").agg(F.min("ord").alias("ord"))
    sizes = rows.groupBy("node", "prop").agg(F.count(F.lit(1)).alias("_n"))
    ok = F.when(F.col("_n") <= most, F.lit(True)).otherwise(F.raise_error(F.lit("too many values for one cell; use the long form")).cast("boolean"))
    checked = rows.join(sizes, ["node", "prop"]).filter(ok)
    return checked.groupBy("node", "prop").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("value"), F.min("ord").alias("ord"))


def mergeable_blocks(triples: DataFrame, variable_type: str = "StatisticalVariable") -> tuple[DataFrame, DataFrame]:
    """Split blocks (``block`` numbers repeated definitions of a node) into mergeable and rejected.

    Later blocks of a statistical variable must define exactly the properties of its first block.
    """
    defining = ~F.col("prop").isin(*NAME_PROPS) & ~F.col("prop").startswith("#")
    pair = F.when(defining, F.concat_ws("=", "prop", normalize_value(F.col("value"))))
    blocks = triples.groupBy("node", "block").agg(
        F.array_join(F.array_sort(F.collect_set(pair)), ";").alias("_fp"),
        F.max(((F.col("prop") == "typeOf") & (strip_namespace(F.col("value")) == variable_type)).cast("int")).alias("_sv"),
        F.max((defining & F.col("value").contains(",")).cast("int")).alias("_multi"))
    first = blocks.groupBy("node").agg(F.min_by("_fp", "block").alias("_first"), F.min("block").alias("_b0"), F.max("_sv").alias("_any"))
    judged = blocks.join(first, "node").select("node", "block", (
        (F.col("_any") == 0) | (F.col("block") == F.col("_b0")) | ((F.col("_fp") == F.col("_first")) & (F.col("_multi") == 0))).alias("ok"))
    tagged = triples.join(judged, ["node", "block"])
    return tagged.filter("ok").drop("ok"), tagged.filter("not ok").drop("ok")


def filter_nodes(triples: DataFrame, keep_ids: DataFrame | None = None, keep_with: Sequence[str] = (), drop_with: Sequence[str] = ()) -> DataFrame:
    """Whole nodes by id list, by presence and by absence of ``prop`` or ``prop:value``."""
    def hits(specs: Sequence[str]) -> Column:
        cond = F.lit(False)
        for s in specs:
            p, _, v = s.partition(":")
            cond = cond | ((F.col("prop") == p) & ((strip_namespace(F.col("value")) == v) if v else F.lit(True)))
        return cond

    out = triples
    if keep_ids is not None:
        out = out.join(bounded(keep_ids.select(F.col(keep_ids.columns[0]).alias("node")).distinct()), "node", "left_semi")
    if keep_with:
        out = out.join(triples.filter(hits(keep_with)).select("node").distinct(), "node", "left_semi")
    if drop_with:
        out = out.join(triples.filter(hits(drop_with)).select("node").distinct(), "node", "left_anti")
    return out


def ids_with_all(triples: DataFrame, props: Sequence[str]) -> DataFrame:
    """Ids of the nodes that have all the properties."""
    found = triples.filter(F.col("prop").isin(*props)).groupBy("node").agg(*[
        F.max((F.col("prop") == p).cast("int")).alias(f"_h{i}") for i, p in enumerate(props)])
    cond = F.lit(True)
    for i in range(len(props)):
        cond = cond & (F.col(f"_h{i}") == 1)
    return found.filter(cond).select("node")


def rename(triples: DataFrame, props: dict[str, str] | None = None, values: dict[tuple[str, str], str] | None = None,
           namespaces: dict[str, str] | None = None) -> DataFrame:
    """Rename properties, single property values and namespaces."""
    p, v = F.col("prop"), F.col("value")
    for (name, old), new in (values or {}).items():
        v = F.when((F.col("prop") == name) & (F.col("value") == old), F.lit(new)).otherwise(v)
    for old, new in (namespaces or {}).items():
        v = F.regexp_replace(v, f"^{old}:", f"{new}:")
    for old, new in (props or {}).items():
        p = F.when(F.col("prop") == old, F.lit(new)).otherwise(p)
    return triples.withColumns({"prop": p, "value": v})


def drop_undefined(triples: DataFrame, schema_ids: DataFrame, keep: Sequence[str] = (), comment: bool = False) -> DataFrame:
    """Drop (or comment out) properties, and references, that the schema table does not define."""
    defined = bounded(schema_ids.select(strip_namespace(F.col(schema_ids.columns[0])).alias("_d")).distinct())
    ref = F.col("value").rlike(r"^(dcid|dcs|schema):")
    by_prop = triples.join(defined, F.col("prop") == F.col("_d"), "left").withColumn("_pok", F.col("_d").isNotNull() | F.col("prop").isin(*(tuple(keep) + NAME_PROPS))).drop("_d")
    by_value = by_prop.join(defined, strip_namespace(F.col("value")) == F.col("_d"), "left").withColumn("_vok", F.col("_d").isNotNull() | ~ref | F.col("prop").isin(*(tuple(keep) + NAME_PROPS))).drop("_d")
    ok = F.col("_pok") & F.col("_vok")
    if comment:
        return by_value.withColumn("prop", F.when(ok, F.col("prop")).otherwise(F.concat(F.lit("# "), F.col("prop")))).drop("_pok", "_vok")
    return by_value.filter(ok).drop("_pok", "_vok")


def drop_known(triples: DataFrame, known: DataFrame, keep_additions: bool = False) -> DataFrame:
    """Nodes whose id is unknown; with ``keep_additions`` also the new values of known nodes."""
    if not keep_additions:
        return triples.join(known.select("node").distinct(), "node", "left_anti")
    norm = lambda d: d.withColumn("_v", normalize_value(F.col("value")))
    left = norm(triples)
    have = norm(known).select("node", "prop", "_v").distinct()
    return left.join(have, ["node", "prop", "_v"], "left_anti").drop("_v")


def existence(ids: DataFrame, known: DataFrame, node: str = "node") -> DataFrame:
    """Flag ids that are present in another node table."""
    side = known.select(F.col("node").alias(node)).distinct().withColumn("_k", F.lit(1))
    return ids.join(side, node, "left").withColumn("exists", F.col("_k").isNotNull()).drop("_k")


def normalised(triples: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Comparable distinct triples: comments and listed properties dropped, lists split, values in normal form."""
    kept = triples.filter(~F.col("prop").startswith("#") & ~F.col("prop").isin(*(("Node", "dcid") + tuple(ignore))) & (F.col("value") != ""))
    clean = split_lists(kept.select("node", "prop", "value"))
    return clean.select(strip_namespace(F.col("node")).alias("node"), "prop", normalize_value(F.col("value")).alias("value"))


def diff_values(left: DataFrame, right: DataFrame, ignore: Sequence[str] = (), only: Sequence[str] | None = None) -> DataFrame:
    """``node, prop, value`` of both tables with flags for the sides a value is on. One union and one aggregate, no join."""
    sides = normalised(left, ignore).withColumns({"l": F.lit(1), "r": F.lit(0)}).unionByName(normalised(right, ignore).withColumns({"l": F.lit(0), "r": F.lit(1)}))
    if only is not None:
        sides = sides.filter(F.col("prop").isin(*only))
    return sides.groupBy("node", "prop", "value").agg(F.max("l").alias("in_left"), F.max("r").alias("in_right"))


def diff(left: DataFrame, right: DataFrame, ignore: Sequence[str] = (), only: Sequence[str] | None = None) -> DataFrame:
    """Status of every (node, prop) of two node tables: matched, modified, added, deleted.

    Value sets are compared by counting values that are on one side only, so a property with any
    number of values never becomes one row.
    """
    out = diff_values(left, right, ignore, only).groupBy("node", "prop").agg(
        F.sum("in_left").alias("n_left"), F.sum("in_right").alias("n_right"), F.count_if(F.col("in_left") != F.col("in_right")).alias("n_differ"))
    status = (F.when(F.col("n_left") == 0, F.lit("added")).when(F.col("n_right") == 0, F.lit("deleted"))
              .when(F.col("n_differ") == 0, F.lit("matched")).otherwise(F.lit("modified")))
    return out.withColumn("status", status)


def diff_nodes(diffs: DataFrame) -> DataFrame:
    """Counts per node; a node with only added (deleted) properties is missing on the left (right)."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = diffs.groupBy("node").agg(n("added").alias("added"), n("deleted").alias("deleted"), n("modified").alias("modified"), n("matched").alias("matched"))
    rest = F.col("modified") + F.col("matched")
    return out.withColumn("node_status", F.when((F.col("deleted") == 0) & (rest == 0), F.lit("added")).when((F.col("added") == 0) & (rest == 0), F.lit("deleted"))
                          .when((F.col("added") + F.col("deleted") + F.col("modified")) == 0, F.lit("matched")).otherwise(F.lit("modified")))


def diff_by_fingerprint(left: DataFrame, right: DataFrame, ignore: Sequence[str] = ("Node", "dcid", "value")) -> DataFrame:
    """Compare nodes (``node, props``) by content: fingerprints on either side only, or on both."""
    fp = lambda d, n: d.groupBy(fingerprint(F.col("props"), ignore).alias("fingerprint")).agg(F.min("node").alias(n))
    joined = fp(left, "left_node").join(fp(right, "right_node"), "fingerprint", "full_outer")
    return joined.withColumn("status", F.when(F.col("left_node").isNull(), F.lit("added")).when(F.col("right_node").isNull(), F.lit("deleted")).otherwise(F.lit("matched")))


def missing_ids(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ids on one side only, and which side."""
    a, b = left.select("node").distinct(), right.select("node").distinct()
    return (a.join(b, "node", "left_anti").withColumn("side", F.lit("left"))
            .unionByName(b.join(a, "node", "left_anti").withColumn("side", F.lit("right"))))


def reuse_existing(nodes: DataFrame, existing: DataFrame, ignore: Sequence[str] = NAME_PROPS) -> DataFrame:
    """Give nodes (``node, props``) the id of an existing node with the same defining properties."""
    fp = lambda d: d.withColumn("_fp", fingerprint(F.col("props"), ignore))
    known = fp(existing).groupBy("_fp").agg(F.min("node").alias("existing"))
    return fp(nodes).join(known, "_fp", "left").withColumn("node", F.coalesce("existing", "node")).drop("_fp")


def resolve_partial(inputs: DataFrame, schema: DataFrame, ignore: Sequence[str] = ("typeOf",)) -> DataFrame:
    """Find the schema node of partial nodes by a property whose values are unique across the schema.

    A property with any repeated value identifies nothing and is disqualified. The first property
    in name order that hits decides.
    """
    usable = ~F.col("prop").isin(*ignore)
    values = schema.filter(usable).groupBy("prop", "value").agg(F.min("node").alias("resolved"), F.max("node").alias("_hi"))
    bad = values.filter(F.col("resolved") != F.col("_hi")).select("prop").distinct()
    index = values.join(bad, "prop", "left_anti").drop("_hi")
    hit = inputs.filter(usable).join(index, ["prop", "value"]).groupBy("node").agg(F.min_by(F.struct("resolved", "prop"), "prop").alias("_r"))
    return hit.select("node", F.col("_r.resolved").alias("resolved"), F.col("_r.prop").alias("by_prop"))


def sorted_nodes(triples: DataFrame) -> DataFrame:
    """By id, then property name."""
    return triples.orderBy("node", "prop", "ord")


def with_id(triples: DataFrame) -> DataFrame:
    return triples.withColumn("node", add_namespace(F.col("node")))
