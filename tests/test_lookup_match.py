import itertools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridwright.operators import lookup as l, mapping, match as m, places as pl
from gridwright.sources.pvmaps import pv_map_from_dict

WORDS = "alpha beta gamma delta eps zeta".split()


def strings(spark, texts):
    return spark.createDataFrame([(t, None) for t in sorted(set(texts))], "value string, header string")


def brute_phrases(words, keys, width):
    """Longest first, leftmost first, then both sides with at most that width."""
    for n in range(min(width, len(words)), 0, -1):
        for s in range(len(words) - n + 1):
            gram = " ".join(words[s:s + n])
            if gram in keys:
                return brute_phrases(words[:s], keys, n) + [gram] + brute_phrases(words[s + n:], keys, n)
    return []


def test_phrases_against_recursion(spark):
    rnd = random.Random(3)
    keys = {" ".join(rnd.choices(WORDS, k=rnd.choice([1, 2, 2, 3]))) for _ in range(14)}
    texts = {" ".join(rnd.choices(WORDS + ["other"], k=rnd.randint(2, 9))) for _ in range(150)}
    pv = pv_map_from_dict(spark, {"GLOBAL": {k: {"p" + k.replace(" ", ""): "x"} for k in keys}})
    schema = l.pv_schema(pv)
    got = {r["value"]: list(r["matched"]) for r in l.phrase_lookup(strings(spark, texts), pv, schema, ["value"]).collect()}
    want = {}
    for t in texts:
        ws = t.split(" ")
        hit = brute_phrases(ws, keys, min(schema.max_words, len(ws) - 1))
        if hit:
            want[t] = hit
    assert got == want


def brute_substrings(text, keys, boundary):
    out, rest = [], text
    inside = lambda k, t: any(t[i:i + len(k)] == k and (not boundary or not ((i > 0 and t[i - 1].isalpha()) or (i + len(k) < len(t) and t[i + len(k)].isalpha()))) for i in range(len(t)))
    for k in sorted(keys, key=lambda k: -len(k)):
        if inside(k, text) and k in rest:
            out.append(k)
            rest = rest.replace(k, " ")
    return out


def test_substrings_by_automata_of_any_size(spark):
    rnd = random.Random(9)
    keys = list(dict.fromkeys(["be", "beta", "a g", "zeta", "eps", "ta", "ga", "gamma d", "x.*y"]))
    texts = {" ".join(rnd.choices(WORDS + ["x.*y", "betas"], k=rnd.randint(1, 6))) for _ in range(80)}
    pv = pv_map_from_dict(spark, {"GLOBAL": {k: {"p": k} for k in keys}})
    for boundary, part in itertools.product((True, False), (100_000, 2)):
        got = {r["value"]: list(r["matched"]) for r in l.substring_lookup(strings(spark, texts), pv, ["value"], word_boundary=boundary, part_keys=part).collect()}
        want = {t: brute_substrings(t, keys, boundary) for t in texts}
        assert got == {t: w for t, w in want.items() if w}, (boundary, part)


def test_substrings_of_many_keys(spark):
    """Thousands of keys on whole documents, in several automata."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    words = sorted({w for t in texts.values() for w in t.split()})
    keys = words[::3] + [f"{a} {b}" for a, b in zip(words[::7], words[1::7])] + [f"none{i}" for i in range(2000)]
    pv = spark.createDataFrame([(k, {"p": k}, i) for i, k in enumerate(dict.fromkeys(keys))], "key string, props map<string,string>, ord int")
    df = spark.createDataFrame(list(texts.items()), "doc_id long, value string")
    got = {}
    for r in l._contained_keys(df.withColumnRenamed("value", "_v"), pv, ["doc_id"], False, 900).collect():
        got.setdefault(r["doc_id"], set()).add(r["key"])
    assert len(set(keys)) > 3000
    assert got == {i: w for i, t in texts.items() if (w := {k for k in set(keys) if k in t})}


def test_stretches_end_with_their_row(monkeypatch):
    """Over borders of the hashed pieces, but never of rows; equal bytes have equal hashes wherever they lie."""
    monkeypatch.setattr(l, "STRETCH", 7)
    texts, lengths = ["abcdefghijklmno", "", "pq", "rstuvwxyzabcdefg" * 2, "y"], [1, 3, 5, 9, 17]
    data, ends = l._bytes_of(pa.array(["before", *texts])[1:])
    everything = np.full((1 << 24) + (1 << 20), 255, dtype=np.uint8)
    got = sorted((row, data[a:b].tobytes().decode()) for row, a, b in l._marked_stretches(data, ends, lengths, 20, everything))
    assert got == sorted((i, t[a:a + n]) for i, t in enumerate(texts) for n in lengths for a in range(len(t) - n + 1))
    hashes = l._Hashes(np.frombuffer(b"some words, some words", dtype=np.uint8))
    assert hashes.of(np.array([0]), 10, True) == hashes.of(np.array([12]), 10, True) != hashes.of(np.array([1]), 10, True)


def test_substrings_of_many_keys_read_the_texts_once(spark, monkeypatch):
    """More keys than an automaton takes: odd lengths, cut characters, borders of rows, repeated keys and rows."""
    texts = ["é", "aé\U0001f600b", "xx customer-0001 yy", "0001", "ab" * 40 + "c", "customer-000", "1 customer-0001", "Éab ab,ab", "w" * 70, "w" * 69, "", None, "ab"]
    keys = ["é", "\U0001f600", "0001", "customer-0001", "ab", "b", "a", "abc", "w" * 70, "ab" * 40, "", "zz", "-", "ɩ", *[f"key {i}" for i in range(50)]]
    rows = [(i, t) for i, t in enumerate([*texts, "ab"])]
    pv = spark.createDataFrame([(k, {"p": f"{n}{k}"}, n) for n in range(2) for k in keys], "key string, props map<string,string>, ord int").repartition(3)
    df = spark.createDataFrame([*rows, rows[2]], "id long, value string").repartition(2)
    scans, stretches = [], l._looked_up_keys
    monkeypatch.setattr(l, "_looked_up_keys", lambda *a: (scans.append(1), stretches(*a))[1])
    for boundary in (True, False):
        found = l.substring_lookup(df, pv, ["id"], word_boundary=boundary, part_keys=5).collect()
        got = {r["id"]: (set(r["matched"]), r["props"]["p"][0]) for r in found}
        want = {i: set(brute_substrings(t, [k for k in keys if k], boundary)) for i, t in rows if t}
        assert got == {i: (w, "0") for i, w in want.items() if w} and len(found) == len(got) + 1
    assert len(scans) == 2


def normal(t):
    return "".join(c for c in " ".join(w for w in t.lower().split(" ") if w) if c.isalnum() or c == " ")


def gram_list(t):
    out = t.split(" ")
    for i in range(max(len(t) - 4, 0) + 1):
        if t[i:i + 4] not in out:
            out.append(t[i:i + 4])
    return out


def brute_grams(query, corpus, fraction):
    index = {}
    for i, key in corpus:
        for g in set(gram_list(normal(key))):
            index.setdefault(g, {})[i] = normal(key).find(g)
    q = normal(query)
    hits = {}
    for g in gram_list(q):
        for i, pos in index.get(g, {}).items():
            s, n, p = hits.get(i, (0.0, 0, 10**9))
            hits[i] = (s + 1 / len(index[g]), n + 1, min(p, pos))
    need = max(1, len(gram_list(q)) * fraction)
    scored = [(-(s + (len(q) - p) * 10000 + n * 100), i) for i, (s, n, p) in hits.items() if n >= need]
    return [i for _, i in sorted((round(s, 6), i) for s, i in scored)]


def test_gram_match_against_index(spark):
    rnd = random.Random(1)
    corpus = [(i, " ".join(rnd.choices(["North", "south", "Port", "ville", "San", "New", "York"], k=rnd.randint(1, 3)))) for i in range(120)]
    corpus += [(120 + i, "New Port") for i in range(60)]  # copies of one key
    queries = ["new york", "San  Port!", "ville", "north north port", "nothing here", "New Port"]
    cdf = spark.createDataFrame(corpus, "id long, key string")
    qdf = spark.createDataFrame([(q,) for q in queries + queries], "query string")
    for fraction, k in ((0.8, None), (0.3, None), (0.3, 4)):
        got = {}
        for r in m.gram_match(qdf, cdf, min_fraction=fraction, k=k).orderBy("query", "rank").collect():
            got.setdefault(r["query"], []).append(r["id"])
        for q in queries:
            want = brute_grams(q, corpus, fraction)
            assert got.get(q, []) == (want if k is None else want[:k]), (q, fraction, k)


def test_components_of_long_chain(spark):
    ids = list(range(400))
    random.Random(2).shuffle(ids)
    edges = [(ids[i], i) for i in range(400)] + [(ids[i], i - 1) for i in range(1, 400)] + [(1000, 5000), (1001, 5000)]
    out = m.components(spark.createDataFrame(edges, "e long, k long"), "e", "k")
    got = {r["entity"]: r["component"] for r in out.collect()}
    assert {got[i] for i in ids} == {0} and got[1000] == got[1001] == 1000


def test_place_names(spark):
    rows = [("country/FR", "Country", "France", "Republique", ["europe"]), ("city/P", "City", "Paris", "", ["country/FR"]), ("city/T", "City", "Paris", "", ["state/TX"]),
            ("state/TX", "State", "Texas", "", ["country/US"]), ("country/US", "Country", "United States", "USA", ["namerica"])]
    gaz = spark.createDataFrame(rows, "dcid string, typeOf string, name string, alternate_name string, containedInPlace array<string>")
    q = spark.createDataFrame([("Paris Texas",), ("paris france",), ("USA",)], "query string")
    best = {r["query"]: r["dcid"] for r in pl.match_names(q, gaz, k=1).collect()}
    assert best == {"Paris Texas": "city/T", "paris france": "city/P", "USA": "country/US"}
    only = pl.match_names(q, gaz, k=3, types=["City"], within=["country/FR"], mode="all").select("dcid").distinct().collect()
    assert [r[0] for r in only] == ["city/P"]
    good, bad = pl.resolve_places(spark.createDataFrame([("Paris Texas",), ("country/X",), ("zzzz",)], "n string"), "n", gazetteer=gaz)
    assert {(r["name"], r["step"]) for r in good.collect()} == {("Paris Texas", "name"), ("country/X", "id")}
    assert [r[0] for r in bad.collect()] == ["zzzz"]


def test_run_names(spark):
    names = spark.createDataFrame([("school_scores",), ("kenya_census",), ("manual_one",), ("skip_me",)], "name string")
    bench = spark.createDataFrame([("SchoolScores",), ("finland_census",), ("Target",)], "name string")
    fixed = spark.createDataFrame([("manual_one", "Target")], "a string, b string")
    out = mapping.match_run_names(names, bench, fixed, spark.createDataFrame([("skip_me",)], "x string"), threshold=0.8)
    assert {(r["name"], r["match"]) for r in out.collect()} == {("school_scores", "SchoolScores"), ("manual_one", "Target")}


def test_schema_search(spark):
    nodes = spark.createDataFrame([("dcs:Red", "ColorEnum", "red color"), ("dcs:Redwood", "TreeEnum", "red wood tree"), ("dcs:Oak", "TreeEnum", "oak tree")], "id string, typeOf string, text string")
    sub = spark.createDataFrame([("TreeEnum", "PlantEnum"), ("PlantEnum", "LifeEnum")], "child string, parent string")
    rng = spark.createDataFrame([("treeKind", "TreeEnum")], "prop string, type string")
    q = spark.createDataFrame([("red",)], "query string")
    out = m.schema_search(q, nodes, ["LifeEnum"], sub, rng, min_fraction=0.5)
    assert [(r["id"], r["prop"]) for r in out.collect()] == [("dcs:Redwood", "treeKind")]


def test_vector_blocks(spark):
    rnd = random.Random(4)
    vec = lambda: [rnd.gauss(0, 1) for _ in range(6)]
    corpus = [(i, vec()) for i in range(200)]
    queries = [(i, vec()) for i in range(9)]
    c, q = spark.createDataFrame(corpus, "id long, embedding array<double>").repartition(5), spark.createDataFrame(queries, "query_id long, embedding array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    want = {qi: [i for _, i in sorted((-cos(qv, cv), i) for i, cv in corpus)[:4]] for qi, qv in queries}
    for rows in (4096, 7):
        got = {}
        for r in m.vector_top_k(q, c, 4, cell_rows=rows).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["id"])
        assert got == want
    assert F is not None


def test_vectors_in_clusters_are_compared_with_few_cells(spark):
    """Clusters, copies of one vector, vectors without length and a large cell in pieces; most cells are left out."""
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(30, 6))
    rows = [(i, (middles[i % 30] + rng.normal(size=6) * 0.01).tolist()) for i in range(900)]
    rows += [(1000 + i, middles[3].tolist()) for i in range(80)] + [(2000, [0.0] * 6), (2001, [0.0] * 6), (2002, None)]
    queries = [(1, middles[0].tolist()), (2, middles[3].tolist()), (3, [0.0] * 6), (4, rng.normal(size=6).tolist())]
    c = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(5)
    q = spark.createDataFrame(queries, "query_id long, embedding array<double>")

    def unit(v):
        v = np.array(v)
        return v / np.linalg.norm(v) if v.any() else v

    got = {}
    for r in m.vector_top_k(q, c, 5, cell_rows=20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 9)))
    for number, v in queries:
        scored = sorted((-round(float(unit(v) @ unit(x)), 9), i) for i, x in rows if x is not None)
        assert sorted(s for _, s in got[number]) == sorted(-s for s, _ in scored[:5])
        if number in (2, 3):  # ties by id
            assert [i for i, _ in got[number]] == [i for _, i in scored[:5]]
    laid, cells = m.vector_cells(c, "id", "embedding", 20)
    met = m.near_cells(q.filter("query_id < 3").select(F.col("query_id").alias("id"), F.col("embedding").alias("v")), cells, 5)
    compared = met.join(laid.select("cell", "piece", F.col("id").alias("row")), ["cell", "piece"]).count()
    assert 0 < compared < 2 * len(rows) / 4
