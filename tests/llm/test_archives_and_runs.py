"""WARC archives and periodic runs against plain Python."""

import base64
import gzip
import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import Row, functions as F

from gridwright.llm.common import bounded_batches, fresh_dir
from gridwright.llm.periodic import find_runs, periodic_runs
from gridwright.llm.queries import ORACLES, QUERIES
from gridwright.llm.warc import deduplicate, read_archives, records_of, resolve, rewrite, write_archives

BODIES = ["", None, "x" * 999, "y" * 1000, "ends in a line\r\n" * 80, "two\r\n\r\nparts " * 90, "z" * 1200 + "\r\n\r", "\r\n\r\n" * 300, "é€😀" * 200]


def pages_of(spark, bodies):
    rows = [(i if i % 13 else None, None if i % 7 == 0 else f"http://a/{i}\r\nX: y", b, "other", 1) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, key string, type int")


def brute_pages(rows):
    groups = defaultdict(list)
    for r in rows:
        body = (r["html"] or "").encode()
        if len(body) >= 1000:
            groups[body].append(r["page_id"])
    out = []
    for body, ids in groups.items():
        top = max(ids, key=lambda i: (i is not None, i or 0))
        digest = hashlib.sha1(body).hexdigest()
        out.append((top, len(body), digest, "response", None))
        ids = list(ids)
        ids.remove(top)
        out += [(i, len(body), digest, "revisit", top) for i in ids]
    for r in rows:
        body = (r["html"] or "").encode()
        if len(body) < 1000:
            out.append((r["page_id"], len(body), hashlib.sha1(body).hexdigest(), "response", None))
    return sorted(out, key=repr)


def through_archives(spark, pages):
    path = fresh_dir(spark, "warc")
    write_archives(deduplicate(records_of(pages)), path)
    found = resolve(read_archives(spark, path, payloads=False))
    return path, sorted(map(tuple, found.select("key", "payload_bytes", "sha1", "type", "refers_key").collect()), key=repr)


def test_archives_round_trip(spark):
    pages = pages_of(spark, BODIES * 5 + ["t" * 5000] * 40)
    path, got = through_archives(spark, pages)
    assert got == brute_pages(pages.collect())
    records = read_archives(spark, path).collect()
    for r in records:
        assert r["http"].endswith(b"\r\n\r\n") and r["date"] == "1970-01-01T00:00:00Z"
        if r["type"] == "response":
            assert r["digest"] == "sha1:" + base64.b32encode(bytes.fromhex(r["sha1"])).decode()
            assert hashlib.sha1(r["payload"]).hexdigest() == r["sha1"] and len(r["payload"]) == r["payload_bytes"]
        else:
            assert r["payload"] is None and r["refers_to"]
    assert len({r["record_id"] for r in records}) == len(records)
    assert sum(len(r["payload"] or b"") for r in records) < sum(len((b or "").encode()) for b in BODIES * 5)


def test_rewritten_archives_keep_their_originals(spark, tmp_path):
    def record(kind, number, uri, payload=b"", extra=(), content="application/http; msgtype=response"):
        block = (b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n" if content.startswith("application/http") else b"") + payload
        lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{number}>", "WARC-Date: 2020-02-03T04:05:06Z",
                 f"warc-target-uri: {uri}", f"Content-Type: {content}", "X-Folded: a", "  b", *extra, f"Content-Length: {len(block)}"]
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    body = b"\xff\x00 not text \r\n\r\n" * 100
    digest = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    first = [record("warcinfo", 1, "", b"made by hand", content="application/warc-fields"), record("response", 2, "http://a", body),
             record("revisit", 3, "http://b", extra=[f"WARC-Payload-Digest: {digest}"]), record("response", 4, "http://c", b"")]
    second = [record("response", 5, "http://d", body), record("revisit", 6, "http://e", extra=["WARC-Payload-Digest: sha1:" + "A" * 32])]
    for name, records in (("1", first), ("2", second)):
        with open(tmp_path / f"{name}.warc.gz", "wb") as f:
            f.write(b"".join(gzip.compress(r) for r in records))  # a member for each record
    out = fresh_dir(spark, "warc")
    rewrite(spark, str(tmp_path), out)
    got = {r["uri"]: r for r in read_archives(spark, out).collect()}
    assert {u: r["type"] for u, r in got.items() if u} == {"http://a": got["http://a"]["type"], "http://b": "revisit", "http://c": "response", "http://d": got["http://d"]["type"], "http://e": "revisit"}
    assert sorted([got["http://a"]["type"], got["http://d"]["type"]]) == ["response", "revisit"]
    kept = next(r for r in got.values() if r["type"] == "response" and r["payload_bytes"])
    assert kept["payload"] == body and kept["http"] == b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n" and kept["date"] == "2020-02-03T04:05:06Z"
    assert got["http://b"]["refers_to"] == kept["record_id"] and got["http://b"]["refers_uri"] == kept["uri"]
    assert [r["payload"] for r in got.values() if r["type"] == "warcinfo"] == [b"made by hand"]
    solved = {r["uri"]: r for r in resolve(read_archives(spark, out)).collect()}
    assert solved["http://b"]["payload_bytes"] == len(body) and solved["http://e"]["payload_bytes"] is None


def test_cut_archives_fail(spark, tmp_path):
    with gzip.open(tmp_path / "a.warc.gz", "wb") as f:
        f.write(b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort")
    with pytest.raises(Exception, match="ends inside a record"):
        read_archives(spark, str(tmp_path)).collect()


def test_archives_of_odd_rows(spark):
    pages = pages_of(spark, [])
    assert through_archives(spark, pages)[1] == []
    long = "long " * 500_000
    rows = spark.createDataFrame([(1, None, long), (1, "", long), (None, "u", long), (2, "u", "")], "page_id long, url string, html string")
    assert through_archives(spark, rows)[1] == brute_pages(rows.collect())


def test_archives_query(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet'")
    got = QUERIES["op11_warc_revisits"](spark, "/root/testdata/sf0.001").toPandas()
    want = con.execute(ORACLES["op11_warc_revisits"]).df()[list(got.columns)]
    plain = lambda d: sorted(map(repr, d.astype(object).where(d.notna(), None).itertuples(index=False, name=None)))
    assert plain(got.astype({"refers_to": "Int64"})) == plain(want.astype({"refers_to": "Int64"}))


def brute_runs(words, least=12):
    runs = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i + p - start >= max(least, 2 * p):
                runs.setdefault((start, i + p - start), p)
            i = max(i, start + 1) if i == start else i
    return sorted(((s, n, p) for (s, n), p in runs.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 4)), max_size=6), st.sampled_from([1, 2, 12]))
def test_runs_of_small_alphabets(parts, least):
    words = [w for block, times in parts for w in block * times]
    assert list(map(tuple, find_runs(np.array(words, np.int64), least).tolist())) == brute_runs(words, least)


def test_runs_whose_factors_recur_inside_the_period():
    words = [int(c) for c in "0101010" * 2 + "2" + "10101010101" * 2 + "3" + "0001000100010" * 2]
    assert list(map(tuple, find_runs(np.array(words), 2).tolist())) == brute_runs(words, 2)


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_odd_rows(spark, odd, no_rows):
    more = [(100, "a b " * 40 + "end"), (101, "x " * 11), (102, "x " * 12), (103, "\x0b\x0c".join(["é", "z"] * 9)), (104, "a b " * 30)]
    for df in (odd.select("doc_id", "text", "n"), spark.createDataFrame([(*r, "k") for r in more], "doc_id long, text string, n string")):
        for got in periodic_runs(df, keep=["n"]).collect():
            matches = [r for r in df.collect() if r["doc_id"] == got["doc_id"]]
            words = [b.decode() for b in (matches[0]["text"] or "").encode().split()]
            runs = brute_runs(words) if len(words) < 5000 else [tuple(r) for r in got["runs"]]
            assert got["n_words"] == len(words) and [tuple(r) for r in got["runs"]] == runs
            assert got["collapsed"] == collapsed(words, runs) and got["n"] == matches[0]["n"]
    assert periodic_runs(odd).count() == odd.count() and periodic_runs(no_rows).collect() == []


def test_runs_query(spark, tmp_path):
    """The query against plain Python, planted periods included."""
    rows = [Row(doc_id=i, text=None if i == 3 else " ".join(f"w{(i * 7 + j * j) % 11}" for j in range(i % 90))) for i in range(300)]
    spark.createDataFrame(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for r in rows:
        words = (r["text"] or "").split()
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None,) * 3)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want = (r["doc_id"], len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(collapsed(words, runs)))
        assert tuple(got[r["doc_id"]]) == want


def test_batches_are_bounded_and_the_setting_put_back(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    with bounded_batches(spark, 1 << 16):
        rows = spark.range(0, 200, 1, 1).select(F.lit("x" * 10_000).alias("t"))
        sizes = rows.mapInArrow(lambda bs: (b.slice(0, 1).set_column(0, "t", b.column(0).slice(0, 1)) for b in bs), "t string").count()
        assert sizes >= 20
    assert spark.conf.get(key) == before
