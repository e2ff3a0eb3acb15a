"""Near duplicates by SimHash fingerprints and multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise
from .graph import components

DISTANCE = 3  # bits that linked fingerprints may differ in
CROWDED = 64  # fingerprints that share half of their bits; more are first joined by shared neighbours
FLIPS = 32


def fingerprint(text: bytes) -> int:
    """Majority bits of the XXH64 of all 3-word shingles, A-Z lower-cased; zero without words."""
    words = text.lower().split()  # on bytes both know ASCII only
    if not words:
        return 0
    n = max(1, len(words) - 2)
    joined, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    ends = (starts + lengths)[min(2, len(words) - 1):]
    of = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 16_384):
        part = zip(starts[at:min(n, at + 16_384)].tolist(), ends[at:at + 16_384].tolist(), strict=False)
        hashes = np.array([of(joined[s:e], 42) for s, e in part], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in range(64) if 2 * ones[b] > n)


def with_fingerprint(docs: DataFrame, id_col: str, text_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """``id``, the columns of ``keep`` and ``fp`` (the fingerprint as a signed long) of every row; null text is empty."""
    kept = docs.select(F.col(id_col).cast("long").alias("id"), *keep)
    rows = docs.select(F.col(text_col).cast("string").cast("binary").alias("__text"), F.col(id_col).cast("long").alias("id"), *keep)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py() or b"") for t in batch.column(0)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(prints.view(np.int64))], names=[*batch.schema.names[1:], "fp"])

    return rows.mapInArrow(scan, ", ".join(f"`{n}` {k}" for n, k in kept.dtypes) + ", fp long")


def _half(fp: Column, half: int) -> Column:
    """One 32-bit segment, with its number in the bits above."""
    bits = F.shiftrightunsigned(fp, 32) if half == 0 else fp.bitwiseAND(F.lit(0xFFFFFFFF))
    return bits.bitwiseOR(F.lit(half << 32))


def links(prints: DataFrame) -> DataFrame:
    """Pairs ``u``, ``v`` of labels of fingerprints (columns ``fp``, ``label``) at distance 3 or less.

    Of two fingerprints that differ in at most 3 bits, one 32-bit half differs in at most one bit.
    Each fingerprint is entered in the table under both halves; the Hamming ball of radius 1 around
    each half is enumerated and looked up, and hits are compared in full. A pair whose half differs
    in a bit is met from the side where that bit is 0, so only those flips are enumerated. Pairs
    with one label already aren't returned.
    """
    table = prints.select(F.explode(F.array(_half(F.col("fp"), 0), _half(F.col("fp"), 1))).alias("key"), F.col("fp").alias("t_fp"), F.col("label").alias("t_label"))

    def ball(half: int) -> Column:
        at = _half(F.col("fp"), half)
        flips = F.filter(F.array(*[F.lit(1 << b).cast("long") for b in range(FLIPS)]), lambda bit: at.bitwiseAND(bit) == 0)
        return F.concat(F.array(at), F.transform(flips, lambda bit: at.bitwiseOR(bit)))

    probes = prints.select(F.explode(F.concat(ball(0), ball(1))).alias("key"), "fp", "label")
    near = (F.col("label") != F.col("t_label")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("t_fp"))) <= DISTANCE)
    return probes.join(table, "key").filter(near).select(F.greatest("label", "t_label").alias("u"), F.least("label", "t_label").alias("v")).distinct()


def crowd_links(prints: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Links inside crowds, a few per fingerprint instead of all pairs.

    Fingerprints that share a half with more than ``crowded`` others are listed under themselves and
    their 64 neighbours at distance 1. All under one entry (65 at most) are at distance 2 or less
    of each other, so each is linked to the smallest.
    """
    halves = prints.select("fp", F.explode(F.array(_half(F.col("fp"), 0), _half(F.col("fp"), 1))).alias("key"))
    full = halves.groupBy("key").count().filter(F.col("count") > crowded).select("key")
    members = halves.join(full, "key", "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    near = members.select("fp", F.explode(F.transform(flips, lambda bit: F.col("fp").bitwiseXOR(bit))).alias("entry"))
    stars = near.groupBy("entry").agg(F.collect_set("fp").alias("all")).filter(F.size("all") > 1)
    return stars.select(F.explode("all").alias("u"), F.array_min("all").alias("v")).filter("u <> v").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowded: int = CROWDED,
                    keep: Sequence[str] = ()) -> DataFrame:
    """Fingerprint and component of every document.

    Copies share a fingerprint and are one node. Crowds of fingerprints are joined first, so that
    the search between halves emits only links between different parts. ``crowded`` changes
    the work, never the result.

    Returns one row per input row: the id, ``fingerprint`` (16 hex digits) and ``component_id``, the
    smallest id among all documents reached over links, itself included, then ``component`` (a long that
    names the component also where ids are null) and the columns of ``keep``. Null or empty text has
    fingerprint zero and is linked like any other. A null id never names a component unless all its
    ids are null. Repeated rows are kept. Empty table: no rows. Ids are integers; other columns are not read.
    """
    rows = materialise(with_fingerprint(docs, id_col, text_col, keep))
    nodes = materialise(rows.groupBy("fp").agg(F.min("id").alias("least")))
    crowds = components(crowd_links(nodes, crowded)).select(F.col("node").alias("fp"), "root")
    labelled = materialise(nodes.join(crowds, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("label")))
    roots = components(links(labelled)).select(F.col("node").alias("label"), "root")
    rooted = materialise(labelled.join(roots, "label", "left").select("fp", "least", F.coalesce("root", "label").alias("root")))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id", F.col("root").alias("component"))
    return rows.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component", *keep)
