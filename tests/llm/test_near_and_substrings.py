"""SimHash groups and passage removal against plain Python."""

import hashlib
from collections import defaultdict

import xxhash
from pyspark.sql import Row

from gridwright.llm.graph import components
from gridwright.llm.simhash import near_duplicates
from gridwright.llm.substrings import remove_repeats


def simhash(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(prints):
    """prints: {any key: (id, fingerprint)}; smallest id reachable over all pairs."""
    keys, parent = list(prints), {k: k for k in prints}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
                parent[top(a)] = top(b)
    least = defaultdict(list)
    for k in keys:
        if prints[k][0] is not None:
            least[top(k)].append(prints[k][0])
    return {k: min(least[top(k)], default=None) for k in keys}


def check_simhash(df, **options):
    rows = df.select("doc_id", "text").collect()
    prints = {i: (r["doc_id"], simhash(r["text"])) for i, r in enumerate(rows)}
    roots = grouped(prints)
    want = sorted(((r["doc_id"], f"{prints[i][1]:016x}", roots[i]) for i, r in enumerate(rows)), key=repr)
    found = near_duplicates(df, **options)
    got = sorted(map(tuple, found.select("doc_id", "fingerprint", "component_id").collect()), key=repr)
    assert got == want


def test_simhash_brute_force(docs):
    check_simhash(docs)


def test_simhash_odd_rows(odd, no_rows):
    check_simhash(odd)
    assert near_duplicates(no_rows).collect() == []


def test_crowds_change_no_result(spark):
    base = " ".join(f"word{i}" for i in range(400)).split()
    rows = []
    for i in range(150):
        words = list(base)
        for j in range(i % 7):
            words[(i * 37 + j * 11) % 400] = f"other{i}"
        rows.append(Row(doc_id=i, text=" ".join(words)))
    df = spark.createDataFrame(rows)
    check_simhash(df, crowded=3)
    check_simhash(df)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def removed(rows, window=20):
    """rows: (id, text) in any order; kept text per row by looking at every window."""
    first = {}
    order = lambda i: (i is None, i or 0)
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in texts:
        for s in range(len(w) - window + 1):
            k, at = tuple(w[s:s + window]), (order(i), s)
            first[k] = min(first.get(k, at), at)
    out = []
    for i, w in texts:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] < (order(i), s):
                gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return sorted(out, key=repr)


def check_removal(df):
    got = [(r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"]).hexdigest()) for r in remove_repeats(df).collect()]
    assert sorted(got, key=repr) == removed([tuple(r) for r in df.select("doc_id", "text").collect()])


def test_removal_brute_force(docs):
    check_removal(docs)


def test_removal_odd_rows(odd, no_rows):
    check_removal(odd)
    assert remove_repeats(no_rows).collect() == []


def test_removal_overlaps_and_copies(spark):
    passage = [f"p{i}" for i in range(55)]
    noise = lambda n, k: [f"n{k}_{i}" for i in range(n)]
    texts = [noise(7, 1) + passage + noise(13, 2), noise(3, 3) + passage + passage[:33], ["a"] * 70, ["a"] * 19, passage[:19], noise(25, 4),
             noise(25, 4), noise(12, 5) + passage[20:41] + noise(2, 6), ["x", "y"] * 30, noise(19, 7), noise(19, 7)]
    rows = [(100 - i, " ".join(t)) for i, t in enumerate(texts)] + [(None, " ".join(passage)), (3, " ".join(passage)), (3, " ".join(noise(30, 9)))]
    check_removal(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


def test_removal_across_flushes(spark, monkeypatch):
    """Documents cut into pieces and passages met in different worker batches."""
    import gridwright.llm.substrings as module

    monkeypatch.setattr(module, "FLUSH", 50)
    long = [f"l{i % 331}" for i in range(700)]
    rows = [(i, " ".join(long[i * 13:] + [f"u{i}_{j}" for j in range(40)])) for i in range(30)]
    check_removal(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))


def test_settled_places_are_dealt_over_all_parts():
    """The first batches of many tasks don't send what they settle to one group, nor one batch all of it."""
    import numpy as np

    from gridwright.llm import substrings

    def settled(task, docs):
        gathered = substrings._Gathered()
        for doc in range(docs):
            gathered.add(np.arange(40, dtype=np.uint64), doc, doc, 0)
        sent = substrings._anchors(gathered, 10, 8, (task << 32) + 1).to_pylist()
        return [(r["part"], len(r["data"]) // substrings.BLOCK_AT.itemsize) for r in sent if r["kind"] == substrings.SETTLED]

    assert len({part for task in range(200) for part, _ in settled(task, 2)}) > 90
    large = settled(0, 20_000)
    assert sum(n for _, n in large) == 80_000 and len({part for part, _ in large}) > 10
