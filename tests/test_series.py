import math
import random
from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from gridwright.operators.series import _walk, filter_outliers


def brute(rows, lo, hi, ratio, yearly, recent):
    kept, state = [], {}
    for s, d, v in sorted(rows, key=lambda r: r[1], reverse=recent):
        prev = state.get(s)
        ok = lo is None or v >= lo
        ok = ok and (hi is None or v <= hi)
        if prev:
            pv, pd = prev
            base = min(abs(pv), abs(v))
            change = abs(pv - v) / base if base else (0 if pv == v else math.inf)
            if ratio is not None and change > ratio:
                ok = False
            if yearly is not None and change > 0 and change / (abs((d - pd).days) / 365) > yearly:
                ok = False
        if ok:
            state[s] = (v, d)
            kept.append((s, d.isoformat(), v))
    return sorted(kept)


def test_published_case(spark):
    values = [10, 1, 8, 70, 500, 12, 60]
    rows = [("p", f"20{i + 10}", float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "place string, observationDate string, value double")
    out = filter_outliers(df, ["place"], min_value=2, max_value=100, max_change_ratio=5)
    dropped = {r[1] for r in rows} - {r["observationDate"] for r in out.collect()}
    # newest first: 60, 12 kept (ratio 4), 500 over max, 70 kept (4.83), 8 dropped (7.75), 1 under min, 10 dropped (6)
    assert dropped == {"2010", "2011", "2012", "2014"}


def test_series_over_many_partitions(spark):
    """One series holds most rows and spans partitions; bad stretches carry over the borders."""
    rnd = random.Random(5)
    rows = []
    for s, n in (("hot", 3000), ("a", 40), ("b", 1), ("c", 300)):
        level = 100.0
        for i in range(n):
            level = max(1.0, level * rnd.choice([1, 1.1, 0.9, 1, 1, 8, 0.1]))
            rows.append((s, date(1990, 1, 1) + timedelta(days=3 * i), round(level, 3)))
    df = spark.createDataFrame([(s, d.isoformat(), v) for s, d, v in rows], "s string, observationDate string, value double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        for recent in (True, False):
            for ratio, yearly in ((3.0, None), (2.0, 900.0)) if recent else ((None, 400.0),):
                out = filter_outliers(df.repartition(16), ["s"], min_value=1.5, max_value=1e6, max_change_ratio=ratio, max_yearly_change=yearly, keep_recent=recent)
                got = sorted((r["s"], r["observationDate"], r["value"]) for r in out.collect())
                assert got == brute(rows, 1.5, 1e6, ratio, yearly, recent)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_bounds_only_is_a_filter(spark):
    df = spark.createDataFrame([("a", "2020", 1.0), ("a", "2021", None), ("a", "2022", 9.0)], "s string, observationDate string, value double")
    out = filter_outliers(df, ["s"], min_value=2.0)
    assert [r[0] for r in out.select(F.col("observationDate")).orderBy("observationDate").collect()] == ["2021", "2022"]
    assert filter_outliers(df, ["s"]).count() == 3


def test_walk_in_batches_of_any_size():
    """Stretches of steady, wild and missing values, cut anywhere, against one step at a time."""
    rng = np.random.default_rng(8)
    for lo, hi, ratio, yearly in ((None, None, 0.5, None), (1.0, 50.0, 2.0, None), (None, 60.0, None, 3.0), (0.5, None, 1.0, 9.0)):
        n = 4000
        v = np.where(rng.random(n) < 0.02, rng.choice([np.nan, 0.0, 400.0, -3.0], n), 10 + rng.random(n) * rng.choice([0.1, 9.0], n))
        v[1000:2500] *= 8  # a level that is never reached by the rules
        d, new = np.cumsum(rng.integers(0, 4, n)).astype(float), rng.random(n) < 0.002
        last, want = None, []
        for i in range(n):
            last = None if new[i] else last
            ok = np.isnan(v[i]) or not (lo is not None and v[i] < lo or hi is not None and v[i] > hi)
            if ok and last and not np.isnan(v[i]):
                base, gap = min(abs(last[0]), abs(v[i])), abs(last[0] - v[i])
                change = gap / base if base > 0 else (0.0 if gap == 0 else math.inf)
                years = abs(d[i] - last[1]) / 365
                ok = not (ratio is not None and change > ratio or yearly is not None and change > 0 and (years == 0 or change / years > yearly))
            if ok:
                last = None if np.isnan(v[i]) else (v[i], d[i])
            want.append(ok)
        state, got, at = None, [], 0
        while at < n:
            to = min(n, at + int(rng.integers(1, 700)))
            keep, state = _walk(new[at:to], v[at:to], d[at:to], lo, hi, ratio, yearly, state)
            got += keep.tolist()
            at = to
        assert got == want and 0 < sum(got) < n
