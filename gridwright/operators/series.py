"""Outlier filtering along time series."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import period_end
from ..session import materialise


def first_present(columns: Sequence[str]) -> Column:
    """First non-empty of several columns, as text."""
    return F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in columns])


def series_columns(df: DataFrame, dates: Sequence[str], values: Sequence[str], ignored: Sequence[str] = ("ord", "value_raw")) -> list[str]:
    """All columns that identify a series: neither a date nor a value."""
    return [c for c in df.columns if c not in dates and c not in values and c not in ignored]


Point = tuple[float, float] | None  # value and day of the last kept point of a series, if it has one


def _near(pv, pd, v: np.ndarray, d: np.ndarray, ratio: float | None, yearly: float | None) -> np.ndarray:
    """Whether values are within the change rules of the points before them; always so where either is missing."""
    with np.errstate(divide="ignore", invalid="ignore"):
        base, gap = np.minimum(np.abs(pv), np.abs(v)), np.abs(pv - v)
        change = np.where(base > 0, gap / base, np.where(gap == 0, 0.0, np.inf))
        ok = np.ones(len(v), bool)
        if ratio is not None:
            ok &= ~(change > ratio)
        if yearly is not None:
            ok &= ~((change > 0) & (change / (np.abs(d - pd) / 365.0) > yearly))
    return ok | np.isnan(v) | np.isnan(pv)


def _walk(new: np.ndarray, v: np.ndarray, d: np.ndarray, lo, hi, ratio, yearly, last: Point) -> tuple[np.ndarray, Point]:
    """Keep flags of a stretch in order, and the last kept point at its end; ``new`` marks where a series starts.

    As long as points follow kept ones, neighbours are compared all at once; after a dropped one, the next points are
    compared with the last kept one, block by block, until one is kept.
    """
    n = len(v)
    inside = np.ones(n, bool)
    if lo is not None:
        inside &= ~(v < lo)
    if hi is not None:
        inside &= ~(v > hi)
    steady = inside.copy()
    steady[1:] &= new[1:] | _near(v[:-1], d[:-1], v[1:], d[1:], ratio, yearly)
    breaks = np.append(np.flatnonzero(~steady), n)
    keep = np.zeros(n, bool)
    at = lambda i: None if np.isnan(v[i]) else (float(v[i]), float(d[i]))
    i, block = 0, 64
    while i < n:
        j = min(n, i + block)
        ok = inside[i:j] if last is None else inside[i:j] & _near(last[0], last[1], v[i:j], d[i:j], ratio, yearly)
        begun = np.flatnonzero(new[i:j] | ok)
        if not len(begun):
            i, block = j, min(2 * block, 1 << 16)
            continue
        i, block = i + int(begun[0]), 64
        if new[i]:
            last = None
            if not inside[i]:
                i += 1
                continue
        end = int(breaks[np.searchsorted(breaks, i + 1)])
        keep[i:end] = True
        last, i = at(end - 1), end
    return keep, last


def _within(parts: set[int]) -> Column:
    """Ranges of the stored row numbers of some partitions, so that the files of others are skipped."""
    ordered = sorted(parts)
    runs = [[ordered[0], ordered[0]]]
    for p in ordered[1:]:
        if p == runs[-1][1] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    if len(runs) > 200:
        runs = [[ordered[0], ordered[-1]]]
    cond = F.lit(False)
    for a, b in runs:
        cond = cond | ((F.col("_mid") >= F.lit(a << 33)) & (F.col("_mid") < F.lit((b + 1) << 33)))
    return cond


def filter_outliers(obs: DataFrame, series: Sequence[str], date: str = "observationDate", value: str = "value", min_value: float | None = None,
                    max_value: float | None = None, max_change_ratio: float | None = None, max_yearly_change: float | None = None,
                    keep_recent: bool = True, tie: Sequence[str] = ()) -> DataFrame:
    """Drop points outside fixed bounds or too far from the last kept point of their series.

    Bounds alone are a plain filter. The change rules depend on what was kept before, so rows are
    range-partitioned by (series, date): a long series simply spans several partitions. Each
    partition is walked on its own, as a stream of which only the last kept point is held; that point (one row per
    partition) is handed to the next partition where a series continues, and only partitions whose entry point
    changed are walked again until nothing changes.
    """
    if all(x is None for x in (min_value, max_value, max_change_ratio, max_yearly_change)):
        return obs
    if max_change_ratio is None and max_yearly_change is None:
        keep = F.lit(True)
        if min_value is not None:
            keep = keep & ~(F.col(value) < min_value)
        if max_value is not None:
            keep = keep & ~(F.col(value) > max_value)
        return obs.filter(F.col(value).isNull() | keep)

    direction = (lambda c: F.col(c).desc()) if keep_recent else (lambda c: F.col(c).asc())
    keyed = obs.withColumns({"_series": F.xxhash64(*series), "_key": F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in series])),
                             "_day": F.datediff(period_end(F.col(date).cast("string")), F.lit("1970-01-01"))})
    order = [F.col("_series"), F.col("_key"), direction(date), *[F.col(t) for t in tie]]
    cut = materialise(keyed.repartitionByRange(*order).sortWithinPartitions(*order)
                      .withColumn("_mid", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_mid", 33))
    rules = (min_value, max_value, max_change_ratio, max_yearly_change)
    steps = ["_part", "_key", F.col(value).cast("double").alias("_v"), F.coalesce(F.col("_day").cast("double"), F.lit(0.0)).alias("_d")]

    def in_order(rows: DataFrame, *more: str) -> DataFrame:
        """Each partition's rows in one stream, in their stored order; sorted by Spark, which spills."""
        return rows.repartition("_part").sortWithinPartitions("_part", "_mid").select(*steps, *more)

    def walked(batches: Iterator[pa.RecordBatch], known: dict[int, Point]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, int, Point]]:
        """Batches, cut where a partition ends, with their keep flags; only the last kept point is held."""
        now, key, last = None, None, None
        for whole in batches:
            part = whole.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                batch = whole.slice(a, b - a)
                if not len(batch):
                    continue
                keys = batch.column(1)
                new = np.ones(len(keys), bool)
                new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
                if part[a] != now:
                    now, last = part[a], known.get(int(part[a]))
                    new[0] = last is None
                else:
                    new[0] = keys[0].as_py() != key
                key = keys[-1].as_py()
                keep, last = _walk(new, batch.column(2).to_numpy(zero_copy_only=False).astype(float), batch.column(3).to_numpy(), *rules, last)
                yield batch, keep, int(now), last

    # which partitions start in the middle of a series
    ends = {r["_part"]: r for r in cut.groupBy("_part").agg(F.min_by("_key", "_mid").alias("first"), F.max_by("_key", "_mid").alias("last")).collect()}
    parts = sorted(ends)
    linked = {b: a for a, b in zip(parts, parts[1:]) if ends[a]["last"] == ends[b]["first"]}
    entries: dict[int, Point] = {}
    exits: dict[int, Point] = {}
    todo = set(linked.values())
    while todo:
        def last_kept(batches: Iterator[pa.RecordBatch], known=dict(entries)) -> Iterator[pa.RecordBatch]:
            found: dict[int, Point] = {}
            for _, _, part, last in walked(batches, known):
                found[part] = last
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([x and x[0] for x in found.values()], pa.float64()),
                                                  pa.array([x and x[1] for x in found.values()], pa.float64())], names=["part", "v", "d"])

        some = cut.filter(_within(todo) & F.col("_part").isin(*todo))
        for r in in_order(some).mapInArrow(last_kept, "part long, v double, d double").collect():
            exits[r["part"]] = None if r["v"] is None else (r["v"], r["d"])
        todo = set()
        for b, a in linked.items():
            if exits.get(a) != entries.get(b):
                entries[b] = exits[a]
                if b in linked.values():
                    todo.add(b)

    def kept(batches: Iterator[pa.RecordBatch], known=dict(entries)) -> Iterator[pa.RecordBatch]:
        for batch, keep, _, _ in walked(batches, known):
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[4:]], names=obs_columns)

    obs_columns = list(obs.columns)
    return in_order(cut, *[f"`{c}`" for c in obs_columns]).mapInArrow(kept, obs.schema)
