"""Secrets in text: fixed patterns, and character Markov models of random strings against identifiers."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping
from functools import cache

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise
from .common import literal_array, text_of
from .identifiers import labelled, parted


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


# Kinds in their order, patterns, and the least length of the value that counts.
KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": "(" + _either_case("password|passwd|secret|token|api_?key") + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
}
LEAST = {"assign": 12, "access": 18, "hex": 16}

CANDIDATE = "[A-Za-z0-9_-]+"
CANDIDATE_LEAST = 16
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
STATES = len(ALPHABET) + 1
LEAN = 8
MARGIN = 800  # thousandths of a nat per character that the random model must lead by: keeps precision and recall over 0.99 on held-out strings


def _codes(text: Column) -> Column:
    """Characters as positions in the alphabet, 0 for others."""
    return F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def _long_runs(kind: str) -> str:
    """The pattern with the least length inside, where a run is matched whole or not at all."""
    if kind == "hex":
        return f"[0-9a-f]{{{LEAST[kind]},}}"
    return f"[A-Za-z0-9_-]{{{CANDIDATE_LEAST},}}" if kind == "markov" else PATTERNS[kind]


def _matches(text: Column, kind: str) -> Column:
    """Matches from left to right: length of the text since the last match, the match, its value.

    The text between matches comes from a split at the same pattern. Only texts with a match pay for it.
    """
    pattern = F.lit(_long_runs(kind))
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(2)) if kind == "assign" else whole
    gaps = F.transform(F.split(text, _long_runs(kind), -1), F.length)
    parts = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value"))
    return F.when(F.regexp_like(text, pattern), parts)


def matched(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Stored rows (``uid``, ``id``, the matches), and one row per match: ``uid``, ``kind`` (number),
    ``start``, ``end``, ``value``; ``end`` exclusive, in code points; kind 3 are candidates of the models."""
    kinds = (*KINDS, "markov")
    text = text_of(text_col)
    rows = materialise(docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"),
        *[_matches(text, k).alias(k) for k in kinds]))
    each = None
    for number, kind in enumerate(kinds):
        some = rows.select("uid", F.lit(number).alias("kind"), F.posexplode(kind).alias("pos", "m")).select(
            "uid", "kind", "pos", F.col("m.gap").alias("gap"), F.length("m.whole").alias("long"), F.col("m.value").alias("value"))
        each = some if each is None else each.unionAll(some)
    before = Window.partitionBy("uid", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("gap") + F.col("long")).over(before), F.lit(0)) + F.col("gap")
    placed = each.select("uid", "kind", start.alias("start"), (start + F.col("long")).alias("end"), "value")
    least = literal_array([*[LEAST[k] for k in KINDS], CANDIDATE_LEAST], "int")
    # a key's own word is no part of an assigned value; the others are their whole match
    return rows, placed.filter(F.length("value") >= F.get(least, F.col("kind")))


def _ratios(pairs: Mapping[tuple[bool, int], int]) -> list[int]:
    """Log-likelihood ratios of character pairs in thousandths of a nat, from their counts by class (true: random).

    One first-order model per class. A character's row leans on the class's single characters with
    the weight of ``LEAN`` pairs, and these have one added to each count.
    """
    firsts, seconds, total = Counter(), Counter(), Counter()
    for (c, pair), n in pairs.items():
        firsts[c, pair // STATES] += n
        seconds[c, pair % STATES] += n
        total[c] += n

    def log(c: bool, pair: int) -> float:
        alone = (seconds[c, pair % STATES] + 1) / (total[c] + STATES)
        return math.log((pairs.get((c, pair), 0) + LEAN * alone) / (firsts[c, pair // STATES] + LEAN))

    return [round(1000 * (log(True, p) - log(False, p))) for p in range(STATES * STATES)]


def train(samples: DataFrame) -> list[int]:
    """The ratios learnt from ``value`` and ``random`` (boolean). At most 2 x 69 x 69 counts reach the driver."""
    codes = _codes(F.col("value"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.get("c", i) * STATES + F.get("c", i + 1))
    counts = (samples.select("random", codes.alias("c")).filter(F.size("c") > 1).select("random", F.explode(pairs).alias("pair"))
              .groupBy("random", "pair").count().collect())
    return _ratios({(r["random"], r["pair"]): r["count"] for r in counts})


@cache
def standard() -> tuple[int, ...]:
    """The ratios learnt from the training part of ``identifiers.labelled()``, a fixed 12,000 strings."""
    counts: Counter = Counter()
    for value, random in parted(labelled())[0]:
        codes = [ALPHABET.find(c) + 1 for c in value]
        counts.update((random, a * STATES + b) for a, b in zip(codes, codes[1:]))
    return tuple(_ratios(counts))


def ratio(value: Column, model: list[int]) -> Column:
    """Sum of the ratios along ``value``, less the margin per step: above zero is random."""
    table, codes = literal_array(model, "int"), _codes(value)
    # the array is built once per row: as the accumulator's companion, not inside the lambda
    step = F.aggregate(codes, F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("sum")), lambda a, c: F.struct(
        c.alias("last"), (a["sum"] + F.when(a["last"] < 0, F.lit(0)).otherwise(F.get(table, a["last"] * STATES + c) - MARGIN)).alias("sum")))
    return step["sum"]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: DataFrame | None = None) -> DataFrame:
    """Spans of secrets in every document.

    The fixed patterns find the base spans, leftmost and without overlap per kind. Two character
    Markov models are trained from labelled ``samples`` (``value``, ``random``); without any, from
    the fixed strings of ``identifiers``. A run of 16 or more letters, digits, ``_`` and ``-``
    that overlaps no base span is added when its log-likelihood ratio leads by the margin.

    Returns per row the id, ``n_assign``, ``n_access``, ``n_hex``, ``n_markov``, ``base_sha256`` and ``spans``
    (kind:start:end by start, then kind). Null or empty text: no spans. Repeated rows are scanned one
    by one; ids may be null. Empty table: no rows. Other columns are not read.
    """
    rows, found = matched(docs, id_col, text_col)
    found = materialise(found)
    model = list(standard()) if samples is None else train(samples)
    kept = found.filter((F.col("kind") < 3) | (ratio(F.col("value"), model) > 0))
    span = F.struct("start", "kind", "end")
    per_row = kept.groupBy("uid").agg(F.sort_array(F.collect_list(span)).alias("all"))
    base = F.filter("all", lambda s: s["kind"] < 3)
    free = F.filter("all", lambda s: (s["kind"] < 3) | ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    per_row = per_row.withColumn("base", base).withColumn("all", free)
    names = F.array(*[F.lit(k) for k in (*KINDS, "markov")])

    def written(spans: str) -> Column:
        return F.coalesce(F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","), F.lit(""))

    def number(kind: int) -> Column:
        return F.greatest(F.coalesce(F.size(F.filter("all", lambda s: s["kind"] == kind)), F.lit(0)), F.lit(0)).cast("long")

    out = rows.select("uid", "id").join(per_row, "uid", "left")
    return out.select(F.col("id").alias(id_col), number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), number(3).alias("n_markov"),
                      F.sha2(written("base").cast("binary"), 256).alias("base_sha256"), written("all").alias("spans"))
