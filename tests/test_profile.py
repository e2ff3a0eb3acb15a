"""Relations between columns against plain Python."""

import random

from gridwright.operators.profile import redundant_pairs


def brute(rows, columns):
    out = []
    trimmed = [[("" if v is None else str(v)).strip() for v in r] for r in rows]
    for i, a in enumerate(columns):
        for j in range(i + 1, len(columns)):
            na, nb = ({r[k] for r in trimmed if r[k]} for k in (i, j))
            pairs = {(r[i], r[j]) for r in trimmed if r[i] or r[j]}
            if 1 < len(na) == len(nb) == len(pairs):
                out.append((a, columns[j], len(na)))
    return sorted(out)


def test_columns_in_correspondence(spark):
    """Renamed, shuffled, partly empty and repeated values; equal counts that don't correspond; swapped classes."""
    rng = random.Random(6)
    columns = list("abcdefghij")
    for n in (0, 1, 40, 300):
        rows = []
        for k in range(n):
            x, y = rng.randrange(5), rng.choice([None, "", "u", "v"])
            rows.append((x, f" n{x * 7 % 5} ", (x + 1) % 5 if rng.random() < 0.98 else x, y, None if not y else y + y, k, f"k{k}", "same", x // 2, "p" if x < 2 else "q" if x < 4 else "r"))
        rows += rows[: n // 3]
        df = spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in rows], ", ".join(f"{c} string" for c in columns))
        got = sorted(map(tuple, redundant_pairs(df.repartition(3)).collect()))
        assert got == brute(rows, columns)
        if n == 300:
            assert ("a", "b", 5) in got and ("d", "e", 2) in got and ("f", "g", 300) in got and ("i", "j", 3) in got and all("c" not in p[:2] for p in got)


def test_equal_counts_with_other_classes_differ(spark):
    """Even multiplicities and equal class sizes don't make two divisions alike."""
    df = spark.createDataFrame([("c", "x", "y"), ("c", "x", "y"), ("a", "x", "x"), ("d", "y", "x"), ("d", "y", "x"), ("b", "y", "y")], "id string, one string, two string")
    assert redundant_pairs(df).collect() == []
