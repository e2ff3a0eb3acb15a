"""Hard negatives against plain Python."""

import math
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gridwright.llm import hardneg
from gridwright.llm.hardneg import Tree, hard_negatives, tiles
from gridwright.llm.queries import ORACLES, QUERIES


def brute(rows, is_anchor, positives=5, negatives=10):
    """rows: (id, label, vector); the answer by looking at every pair."""
    good = []
    for i, (vec_id, label, v) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, vec_id, label, [math.floor(256 * x) for x in v]))
    order = lambda s, vec_id: (-s, vec_id is None, vec_id or 0)
    out = []
    for a in good:
        if a[1] is None or not is_anchor(a[1]):
            continue
        scored = [(sum(x * y for x, y in zip(a[3], r[3])), r) for r in good if r[0] != a[0]]
        same = sorted((s for s in scored if s[1][2] == a[2]), key=lambda s: order(s[0], s[1][1]))[:positives]
        for p, positive in same:
            hard = sorted((s for s in scored if s[1][2] != a[2] and 30 * p <= 100 * s[0] <= 90 * p), key=lambda s: order(s[0], s[1][1]))[:negatives]
            out += [(a[1], positive[1], k + 1, r[1], p, s) for k, (s, r) in enumerate(hard)]
    return sorted(out, key=repr)


def mined(df, anchors):
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, hard_negatives(df, anchors).select(*columns).collect()), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 700), st.integers(1, 6))
def test_tree_search_equals_a_scan(seed, n, dims):
    rng = np.random.default_rng(seed)
    points = rng.integers(-4, 5, (n, dims)).astype(float)
    labels, uid = rng.integers(0, 3, n), rng.permutation(n)
    ids = [None if i % 11 == 0 else int(i) // 2 for i in uid]
    tree = Tree(uid, ids, labels, points)
    for same in (True, False):
        v, label, low, high = points[0], int(labels[0]), [-np.inf, 0, -9, 40], [np.inf, 12, -3, 3]
        got = tree.search(int(uid[0]), label, v, low, high, same, 5)
        for w in range(4):
            scores = points @ v
            fit = [i for i in range(n) if (labels[i] == label) == same and uid[i] != uid[0] and low[w] <= scores[i] <= high[w]]
            want = sorted((-int(scores[i]), 2**63 - 1 if ids[i] is None else ids[i], int(uid[i])) for i in fit)[:5]
            assert [r[:3] for r in got[w]] == want


def test_tiles_are_full_and_tight():
    points = np.random.default_rng(1).random((10_000, 2))
    order = tiles(points, 100)
    assert sorted(order.tolist()) == list(range(10_000))
    areas = [np.prod(np.ptp(points[order[a:a + 100]], axis=0)) for a in range(0, 10_000, 100)]
    assert np.mean(areas) < 0.02  # near the hundredth part of the square that each leaf can have


def test_far_boxes_are_not_opened():
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(40, 8)) * 10
    points = np.repeat(middles, 256, axis=0) + rng.normal(size=(40 * 256, 8)) * 0.01
    tree = Tree(np.arange(len(points)), list(range(len(points))), np.repeat(np.arange(40), 256), points)
    opened = []
    inner = tree._open
    tree._open = lambda level, *a: ((level == 0 and opened.append(e), e)[1] for e in inner(level, *a))
    tree.search(-1, 0, middles[0], [-np.inf], [np.inf], True, 5)
    assert 0 < len(opened) < 20


@pytest.mark.parametrize("part", [16, 4096])
def test_mined_rows_equal_brute_force(spark, monkeypatch, part):
    """Ties, copies of one vector over many parts, clusters and negative products."""
    monkeypatch.setattr(hardneg, "PART", part)
    rng = random.Random(part)
    middles = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(4)]
    rows = [(i, rng.randrange(3), [rng.choice([m, round(m)]) / 8 + rng.gauss(0, 0.02) for m in middles[i % 4]]) for i in range(260)]
    rows += [(1000 + i, i % 3, [0.5, -0.25, 0.125, 0.0, 1.0]) for i in range(130)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, part string").repartition(7)
    rows = [tuple(r)[:3] for r in df.collect()]
    assert mined(df, F.col("vec_id") % 10 == 0) == brute(rows, lambda i: i % 10 == 0)


def test_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "PART", 4)
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (1, 1, [0.9, 0.5]), (2, 0, [0.8, 0.1]), (3, 0, [0.4]), (4, 0, []), (5, None, [1.0, 1.0]), (6, 0, None), (7, 0, [nan, 1.0]),
            (8, 0, [inf, 1.0]), (9, 0, [None, 1.0]), (None, 0, [0.7, 0.2]), (None, 1, [0.7, 0.2]), (10, 2, [0.6, 0.3]), (10, 2, [0.6, 0.3]), (20, 2, [0.0, 0.0]), (30, 3, [-1.0, 2.0]), (40, 3, [1.0, -2.0])]
    df = spark.createDataFrame([(*r, "u") for r in rows], "vec_id long, label int, embedding array<double>, uid string")
    anchor = lambda i: i % 10 == 0
    assert mined(df, F.col("vec_id") % 10 == 0) == brute(rows, anchor)
    assert mined(df.limit(0), F.col("vec_id") % 10 == 0) == []
    # products that a double can't hold
    wide = [(i, i % 2, [2.0**20 + i, 2.0**20 - i * i, 3.0]) for i in range(0, 60, 3)]
    assert mined(spark.createDataFrame(wide, "vec_id long, label int, embedding array<double>"), F.col("vec_id") % 10 == 0) == brute(wide, anchor)


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    got = QUERIES["op13_hard_negatives"](spark, "/root/testdata/sf0.01").collect()
    want = con.execute(ORACLES["op13_hard_negatives"]).fetchall()
    assert got and sorted(map(tuple, got)) == sorted(want)
