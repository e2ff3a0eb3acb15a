"""Checks on node tables: spelling, URLs, undefined schema, and one report over all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import camel_to_words, capitalize_first, strip_namespace
from .scale import bounded, localised, spread

URL = r"(https?://[^\s\"'<>,)]+)"
# Properties whose values are not prose.
UNSPELLED_PROPS = ("Node", "dcid", "descriptionUrl", "url")


def text_words(text: Column, least: int = 2) -> Column:
    """Words of names and prose: letters only, camel case split, short words and initialisms dropped."""
    letters = F.regexp_replace(camel_to_words(F.regexp_replace(text, "[^A-Za-z]", " ")), " +", " ")
    return F.filter(F.split(letters, " "), lambda w: (F.length(w) >= least) & ~w.rlike("^[A-Z]{2}"))


def unspelled(prop: Column, value: Column, ignored: Sequence[str] = UNSPELLED_PROPS) -> Column:
    """Values that are not spell-checked: listed properties, URLs, JSON."""
    return prop.isin(*ignored) | value.rlike(r"https?://") | value.rlike(r"^\s*[{\[]") | prop.startswith("#")


def misspelled(triples: DataFrame, dictionary: DataFrame, word: str = "word", ignored: Sequence[str] = UNSPELLED_PROPS) -> DataFrame:
    """Words of properties and values that are in no dictionary: ``node, prop, word, n``.

    Words meet the dictionary as they are found, so only the bad ones are grouped.
    """
    checked = triples.filter(~unspelled(F.col("prop"), F.col("value"), ignored))
    spoken = spread(checked, "node").select("node", "prop", F.explode(F.concat(text_words(F.col("prop")), text_words(strip_namespace(F.col("value"))))).alias("w"))
    known = localised(dictionary.select(F.lower(F.col(word)).alias("word")).filter("word IS NOT NULL").distinct())
    bad = spoken.select("node", "prop", F.lower("w").alias("word")).join(known, "word", "left_anti")
    return bad.groupBy("node", "prop", "word").agg(F.count(F.lit(1)).alias("n"))


def urls(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Every URL in a text column."""
    return df.select(*keys, F.explode(F.regexp_extract_all(F.col(text), F.lit(URL), F.lit(1))).alias("url"))


def disallowed_urls(found: DataFrame, allowed: DataFrame, prefix: str = "prefix") -> DataFrame:
    """URLs that start with none of the allowed prefixes.

    The URL is cut to the lengths that occur among the prefixes, so the test is an equi-join.
    """
    table = allowed.select(F.col(prefix).alias("_p")).distinct()
    lens = [r["n"] for r in table.select(F.length("_p").alias("n")).distinct().collect()]
    distinct = found.select("url").distinct()
    if not lens:
        return found
    starts = distinct.select("url", F.explode(F.array_distinct(F.array(*[F.substring("url", 1, n) for n in lens]))).alias("_p"))
    good = starts.join(bounded(table), "_p", "left_semi").select("url").distinct()
    return found.join(good, "url", "left_anti")


_PLAIN = r'^(\[.*\]|[-+]?[0-9][0-9.,]*|".*")$'


def value_type(prop: Column) -> Column:
    """Range of a property without a known one: ``<Prop>Enum``."""
    return F.concat(capitalize_first(prop), F.lit("Enum"))


def new_schema_nodes(triples: DataFrame, schema_ids: DataFrame, provisional: bool = True) -> DataFrame:
    """Triples for properties, enum classes and enum values that are used but not defined.

    A new property gets the population type of the using node as domain and an enum as range; a
    new value gets that enum as type and a spaced name. Ranges, numbers and quoted text define nothing.
    """
    defined = bounded(schema_ids.select(strip_namespace(F.col(schema_ids.columns[0])).alias("_d")).distinct())
    skip = ("typeOf", "Node", "dcid", "name", "description", "descriptionUrl", "alternateName", "nameWithLanguage")
    used = triples.filter(~F.col("prop").isin(*skip) & ~F.col("prop").startswith("#") & F.col("prop").rlike("^[a-z]"))
    domains = triples.filter(F.col("prop") == "populationType").select("node", strip_namespace(F.col("value")).alias("domain"))
    props = used.select("node", "prop").distinct().join(domains, "node", "left").groupBy("prop").agg(F.min("domain").alias("domain"))
    new_props = props.join(defined, F.col("prop") == F.col("_d"), "left_anti")
    values = used.filter(~F.col("value").rlike(_PLAIN)).select("prop", strip_namespace(F.col("value")).alias("v")).groupBy("v").agg(F.min("prop").alias("prop"))
    new_values = values.join(defined, F.col("v") == F.col("_d"), "left_anti").filter(F.col("v").rlike("^[A-Za-z]"))
    classes = new_props.select(value_type(F.col("prop")).alias("c")).unionByName(new_values.select(value_type(F.col("prop")).alias("c"))).distinct()
    new_classes = classes.join(defined, F.col("c") == F.col("_d"), "left_anti")

    def rows(df: DataFrame, node: Column, pairs: dict[str, Column]) -> DataFrame:
        if provisional:
            pairs = pairs | {"isProvisional": F.lit("dcs:True")}
        items = F.array(*[F.struct(F.lit(p).alias("prop"), v.alias("value")) for p, v in pairs.items()])
        return df.select(node.alias("node"), F.explode(items).alias("p")).select("node", "p.prop", "p.value").filter(F.col("value").isNotNull())

    ns = lambda c: F.concat(F.lit("dcs:"), c)
    return (rows(new_props, F.col("prop"), {"typeOf": F.lit("schema:Property"), "name": F.concat(F.lit('"'), F.col("prop"), F.lit('"')),
                                            "domainIncludes": ns(F.col("domain")), "rangeIncludes": ns(value_type(F.col("prop")))})
            .unionByName(rows(new_values, F.col("v"), {"typeOf": ns(value_type(F.col("prop"))), "name": F.concat(F.lit('"'), camel_to_words(F.col("v")), F.lit('"'))}))
            .unionByName(rows(new_classes, F.col("c"), {"typeOf": F.lit("schema:Class"), "name": F.concat(F.lit('"'), F.col("c"), F.lit('"')),
                                                        "subClassOf": F.lit("schema:Enumeration")})))


def quality_report(triples: DataFrame, dictionary: DataFrame, allowed_urls: DataFrame) -> DataFrame:
    """Spelling and URL errors per node and property in one table."""
    spell = misspelled(triples, dictionary).select("node", "prop", F.lit("spelling").alias("problem"), F.col("word").alias("detail"))
    links = disallowed_urls(urls(triples, ["node", "prop"], "value"), allowed_urls).select("node", "prop", F.lit("url").alias("problem"), F.col("url").alias("detail"))
    return spell.unionByName(links)
