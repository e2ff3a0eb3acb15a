"""Shards, mixtures, exact copies and packing against plain Python."""

import contextlib
import hashlib
import itertools
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from gridwright.llm.exact import exact_dedup
from gridwright.llm.learn import WordHashes
from gridwright.llm.mixture import curriculum, training_order
from gridwright.llm.packing import best_edges, pack
from gridwright.llm.shards import shard

BLANKS = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return len((text or "").encode().split())


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def check_shards(df, shards, **options):
    rows, want = shard(df, shards, **options).collect(), pairs(df)
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in want)
    slots, load = defaultdict(list), Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(0 <= s < shards for s in slots) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    return rows, load


def test_shards_near_equal_bytes(docs):
    rows, load = check_shards(docs, 8)
    total = sum(load.values())
    most = max(len((t or "").encode()) for _, t in pairs(docs)) + 16
    assert all(abs(load[s] - total / 8) <= total / 8 / 20 + most for s in range(8))
    together = defaultdict(set)
    for r in rows:
        together[r["text_crc32"]].add(r["shard"])
    assert max(map(len, together.values())) == 1  # the groups here are all smaller than a twentieth of a shard


def test_a_hot_text_is_divided(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same text")).otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    _, load = check_shards(df, 5)
    assert max(load.values()) - min(load.values()) < 0.02 * sum(load.values())
    assert len(load) == 5


def test_shards_odd_rows(odd, no_rows):
    check_shards(odd, 3)
    check_shards(no_rows, 3)


def targets(sizes, weights=(1, 2, 3), most=3):
    """Share, cap, share the excess among the others, until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in full)
        level = left / max(1, sum(weight[s] for s in order if s not in full))
        over = {s for s in order if s not in full and weight[s] * level > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in order}
        full |= over


def check_mixture(df):
    rows = df.select("doc_id", "text", "source").collect()
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += words(r["text"])
    want, got = targets(sizes), curriculum(df, keep=["source"]).collect()
    assert Counter((r["doc_id"], r["size"], r["source_size"]) for r in got) == Counter((r["doc_id"], words(r["text"]), sizes[r["source"]]) for r in rows)
    taken, largest = Counter(), Counter()
    for r in got:
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-6)
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] and len(r["positions"]) == r["copies"]
        assert all(0 <= p <= 1 for p in r["positions"]) and list(r["positions"]) == sorted(r["positions"])
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, curriculum(df, keep=["source"]).collect()), key=repr)
    return got


def test_mixture(docs, odd, no_rows):
    check_mixture(odd)
    check_mixture(no_rows)
    got = check_mixture(docs)
    # slopes -0.8, 0 and 0.8 integrate to 0.7, 0.5 and 0.3 by the middle of the run
    order = sorted({r["source"] for r in got})
    def early(names):
        rows = [r for r in got if r["source"] in names]
        return sum(r["size"] * sum(p < 0.5 for p in r["positions"]) for r in rows) / sum(r["taken"] for r in rows)

    assert abs(early(order[0::3]) - 0.7) < 0.1 and abs(early(order[1::3]) - 0.5) < 0.1 and abs(early(order[2::3]) - 0.3) < 0.1


def test_training_order(docs):
    rows = training_order(curriculum(docs)).select("position").collect()
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows)


def check_exact(df, **options):
    groups = defaultdict(list)
    for i, t in pairs(df):
        groups[BLANKS.sub(" ", t or "")].append(i)
    want = Counter()
    for text, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, least, len(ids))] += 1
    got = exact_dedup(df, **options).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    return groups, got


def test_exact_copies(docs, odd, no_rows):
    groups, got = check_exact(docs)
    assert {r["digest"] for r in got} == {hashlib.sha256(t.encode()).hexdigest() for t in groups}
    check_exact(odd)
    check_exact(no_rows)


def test_colliding_digests_are_told_apart_by_text(docs):
    check_exact(docs, digest=lambda text: (F.length(text) % 50).cast("string"))


def test_state_goes_on_from_its_checkpoint(spark, tmp_path):
    from gridwright.llm.exact import keep_state

    schema, state = "digest string, id long, __file string, __row long", str(tmp_path / "state")
    path = str(tmp_path / "feed")
    for first, rows in ((5, [("a", 5), ("b", 6)]), (3, [("a", 3), ("c", 7)])):
        spark.createDataFrame([(d, i, "f", i) for d, i in rows], schema).write.mode("append").parquet(path)
        found = keep_state(spark.readStream.schema(schema).parquet(path), state)
        assert {r["digest"]: r["keeper"]["id"] for r in found.collect()}["a"] == first
    assert sorted((r["digest"], r["keeper"]["id"], r["n"]) for r in found.collect()) == [("a", 3, 2), ("b", 6, 1), ("c", 7, 1)]


def test_state_stores_are_closed_with_their_tasks(spark):
    rows = spark.createDataFrame([(i, f"text {i % 50}") for i in range(200)], "doc_id long, text string")
    check_exact(rows)
    pid = spark.sparkContext._jvm.java.lang.ProcessHandle.current().pid()
    files = []
    for fd in os.listdir(f"/proc/{pid}/fd"):
        with contextlib.suppress(OSError):  # closed meanwhile
            files.append(os.readlink(f"/proc/{pid}/fd/{fd}"))
    assert files and not [f for f in files if "StateStoreId" in f]


def test_remembered_word_hashes_are_few():
    cache = WordHashes()
    some = [b"w%d" % i for i in range(100_000)]
    assert cache.of(some).tolist() == [xxhash.xxh64_intdigest(w, 3) for w in some]
    assert 0 < len(cache) <= 1 << 16


def test_edges_are_optimal():
    lengths = [1, 2, 2, 3, 9, 10, 10, 11, 30, 31, 33, 80]
    cells = [(v, n, v * n) for v, n in sorted(Counter(lengths).items())]
    cost = lambda edges: sum(min(e for e in edges if e >= v) - v for v in lengths)
    for k in (1, 2, 3, 4, 20):
        values = sorted(set(lengths))
        best = min(cost((*c, 80)) for n in range(k) for c in itertools.combinations(values[:-1], min(n, len(values) - 1)))
        assert cost(best_edges(cells, k)) == best
    assert best_edges([], 4) == []


def check_packing(df, buckets, budget):
    got, want = pack(df, buckets, budget).collect(), pairs(df)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((i, words(t)) for i, t in want)
    batches = defaultdict(list)
    for r in got:
        assert r["padding"] == r["bucket_len"] - r["n_tokens"] >= 0
        batches[r["bucket"], r["batch"]].append(r)
    for (bucket, _), rows in batches.items():
        most = max(1, budget // max(1, rows[0]["bucket_len"]))
        assert sorted(r["slot"] for r in rows) == list(range(len(rows))) and len(rows) <= most
    for bucket in {b for b, _ in batches}:
        numbers = sorted(n for b, n in batches if b == bucket)
        assert numbers == list(range(len(numbers)))
        assert sum(len(batches[bucket, n]) < max(1, budget // max(1, batches[bucket, n][0]["bucket_len"])) for n in numbers) <= 1
    return got


def test_packing(docs, odd, no_rows):
    got = check_packing(docs, 6, 4096)
    lengths = Counter(r["n_tokens"] for r in got)
    edges = best_edges([(v, n, v * n) for v, n in sorted(lengths.items())], 6)
    assert {r["bucket_len"] for r in got} <= set(edges)
    check_packing(odd, 3, 64)
    check_packing(no_rows, 3, 64)
