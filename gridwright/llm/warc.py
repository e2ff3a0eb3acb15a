"""WARC archives: writing, reading, and resolving repeated payloads to one original response.

Archives are gzip files of records. A record ends in two line ends, and so does its header, which makes
them plain text tables with that as line separator: Spark's own sink and source move, commit and retry
the files, on any store.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialise
from .common import at_row, located, without_rows

LEAST = 1000  # bytes of the smallest payload that is replaced by a revisit record
DATE = "1970-01-01T00:00:00Z"  # for tables that record no time of capture
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FLUSH = 16 << 20  # bytes of payload handed on at once

# Fixed value: the alphabet of base 32, beside the digits that conv() writes.
BASE32, DIGITS32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"

RECORD = {"key": "long", "record_id": "string", "type": "string", "uri": "string", "date": "string", "refers_to": "string",
          "refers_uri": "string", "refers_date": "string", "digest": "string", "content_type": "string", "http": "binary", "payload": "binary",
          "payload_bytes": "long", "sha1": "string"}


def base32(digest: Column) -> Column:
    """A SHA-1 in hex as base 32: five hex digits are four of them."""
    part = lambda i: F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0")
    return F.translate(F.concat(*[part(i) for i in range(8)]), DIGITS32, BASE32)


def _one_line(value: Column) -> Column:
    """Line ends would end a header field."""
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def records_of(pages: DataFrame, key: str = "page_id", uri: str = "url", body: str = "html", date: str | None = None) -> DataFrame:
    """One response record for each page; a null body is empty. Other columns are not read, but a located row stays so."""
    at = [c for c in ("__file", "__row") if c in pages.columns]
    payload = F.coalesce(F.col(body).cast("string"), F.lit("")).cast("binary")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload), F.lit(END))
    return pages.select(F.col(key).cast("long").alias("key"), F.lit("response").alias("type"), F.col(uri).cast("string").alias("uri"),
                        (F.col(date).cast("string") if date else F.lit(DATE)).alias("date"), F.lit("application/http; msgtype=response").alias("content_type"),
                        http.cast("binary").alias("http"), payload.alias("payload"), *at)


def write_archives(records: DataFrame, path: str) -> None:
    """Write ``records`` (the columns of ``RECORD`` but for the last two) with fresh lengths, digests and headers.

    A revisit's payload is not written. Null fields are left out; a null or missing ``digest`` is worked out from the payload.
    """
    of = lambda c: F.col(c) if c in records.columns else F.lit(None).cast("string")
    empty = F.lit("").cast("binary")
    payload = F.when(F.col("type") == "revisit", empty).otherwise(F.coalesce(F.col("payload"), empty))
    block = F.concat(F.coalesce(of("http").cast("binary"), empty), payload)
    digest = F.coalesce(of("digest"), F.when(F.col("type").isin("response", "resource"), F.concat(F.lit("sha1:"), base32(F.sha1(payload)))))
    field = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), _one_line(value.cast("string"))))
    revisit = F.when(F.col("type") == "revisit", F.lit(PROFILE))
    head = F.concat_ws("\r\n", F.lit("WARC/1.1"), field("WARC-Type", F.col("type")), field("WARC-Record-ID", F.concat(F.lit("<"), of("record_id"), F.lit(">"))),
                       field("WARC-Date", F.coalesce(of("date"), F.lit(DATE))), field("WARC-Target-URI", of("uri")), field("WARC-Payload-Digest", digest),
                       field("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32(F.sha1(block)))), field("WARC-Profile", revisit),
                       field("WARC-Refers-To", F.concat(F.lit("<"), of("refers_to"), F.lit(">"))), field("WARC-Refers-To-Target-URI", of("refers_uri")),
                       field("WARC-Refers-To-Date", of("refers_date")), field("X-Record-Key", of("key")),
                       field("Content-Type", of("content_type")), field("Content-Length", F.octet_length(block)))
    whole = F.concat(head.cast("binary"), F.lit(END).cast("binary"), block)
    records.select(whole.cast("string").alias("value")).write.option("compression", "gzip").option("lineSep", END).text(path)


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-cased name; a line that starts with a blank goes on with the one before."""
    out, last = {}, ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def _sha1_hex(digest: str | None) -> str | None:
    """The stated SHA-1, in base 32 or hex, as hex; null for other digests."""
    kind, _, value = (digest or "").partition(":")
    if kind.lower() != "sha1":
        return None
    try:
        return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()
    except ValueError:
        return None


def _record(head: bytes, block: bytes, payloads: bool) -> tuple:
    f = _fields(head)
    bare = lambda name: f[name].strip("<>") if name in f else None
    kind, http, body = f.get("warc-type"), b"", block
    if f.get("content-type", "").startswith("application/http"):
        cut = block.find(END.encode())
        http, body = (block, b"") if cut < 0 else (block[:cut + 4], block[cut + 4:])
    key = f.get("x-record-key", "")
    stored = kind != "revisit"  # a revisit holds no payload of its own
    return (int(key) if key.lstrip("-").isdigit() else None, bare("warc-record-id"), kind, f.get("warc-target-uri"), f.get("warc-date"), bare("warc-refers-to"),
            f.get("warc-refers-to-target-uri"), f.get("warc-refers-to-date"), f.get("warc-payload-digest"), f.get("content-type"), http if payloads else None, body if payloads and stored else None,
            len(body) if stored else None, hashlib.sha1(body).hexdigest() if stored else _sha1_hex(f.get("warc-payload-digest")))


def _parsed(pieces: Iterator[tuple[str, bytes]], payloads: bool) -> Iterator[tuple]:
    """Records of the files whose ``pieces``, the bytes between double line ends, come in order.

    The stated length alone ends a block: it may hold double line ends, or end in a part of one.
    """
    gap, file, head, need, parts, have = END.encode(), None, None, 0, [], 0
    for path, piece in pieces:
        if path != file:
            if head is not None:
                raise ValueError(f"{file} ends inside a record")
            file, head = path, None
        while True:
            if head is None:
                piece = piece.lstrip(b"\r\n")
                if piece:
                    if not piece.startswith(b"WARC/"):
                        raise ValueError(f"{file}: no record header at {piece[:40]!r}")
                    head, parts, have = piece, [], -len(gap)
                    need = int(_fields(piece).get("content-length", "0"))
                break
            parts.append(piece)
            have += len(gap) + len(piece)
            if have < need:
                break
            whole = gap.join(parts)
            yield _record(head, whole[:need], payloads)
            head, piece = None, whole[need + len(gap):]  # what is left, if any, starts the next header
    if head is not None:
        raise ValueError(f"{file} ends inside a record")


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of gzip archives (``path`` may be a folder or a pattern), with the columns of ``RECORD``.

    ``payload_bytes`` and ``sha1`` are worked out from the payload read; of a revisit, the length is null and ``sha1``
    the stated one. ``digest`` is as stated. Without ``payloads``, ``http`` and ``payload`` are null. A gzip file is read as
    a stream by one task; of its records one is held at a time. A file cut inside a record is an error. No files: no rows.
    """
    pieces = spark.read.option("lineSep", END).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(n, types[k]) for n, k in RECORD.items()])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = ((p.as_py(), v.as_py()) for b in batches for p, v in zip(b.column(0), b.column(1), strict=True))
        rows, size = [], 0
        for row in _parsed(each, payloads):
            rows.append(row)
            size += len(row[11] or b"") + 500
            if size > FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return pieces.mapInArrow(scan, ", ".join(f"{n} {k}" for n, k in RECORD.items()))


def _record_id() -> Column:
    """A UUID that follows from where the record lies: the same in a retried task."""
    h = F.md5(F.concat_ws(":", "__file", "__row"))
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def deduplicate(records: DataFrame, least: int = LEAST) -> DataFrame:
    """``records`` with fresh ids, in which only one response of each payload of ``least`` bytes or more stays.

    Of responses with equal payloads, the one with the largest key stays (null lowest; equal keys: any one), the others
    become revisits that refer to it. Revisits in the input refer to the response of their stated digest, if it is there. Payloads
    are digested where they lie and only headers are shuffled, by digest; equal means equal SHA-1 and SHA-256. A
    payload that a third of all records share is reduced per task first, and its records are joined to one row.
    Records of other types are passed on. Empty table: no rows. Result: input for ``write_archives``.
    """
    rows = located(records)
    state = F.col("type") == "response"
    columns = ["key", "type", "uri", "date", "content_type"]
    old = [c for c in ("refers_to", "refers_uri", "refers_date", "digest") if c in rows.columns]
    stated = F.when(F.col("type") == "revisit", F.col("sha1")) if "sha1" in rows.columns else F.lit(None).cast("string")
    heads = materialise(rows.select(
        *columns, *old, "__file", "__row", "http", F.when(state, F.sha1("payload")).otherwise(stated).alias("sha1"), F.when(state, F.sha2("payload", 256)).alias("sha256"),
        F.when(state, F.octet_length("payload")).alias("size")).withColumn("record_id", _record_id()))
    own = F.struct(F.col("key").isNotNull().alias("has"), "key", "__file", "__row", "record_id", "uri", "date")
    responses = heads.filter((F.col("type") == "response") & (F.col("size") >= least))
    # one row for each payload
    groups = materialise(responses.groupBy("sha1", "sha256").agg(F.max(own).alias("first"), F.count(F.lit(1)).alias("n")))
    again = responses.select("__file", "__row", "sha1", "sha256").join(groups.filter("n > 1"), ["sha1", "sha256"]).filter(
        (F.col("__file") != F.col("first.__file")) | (F.col("__row") != F.col("first.__row")))
    later = [materialise(again.select("__file", "__row", "first"))]
    if "sha1" in rows.columns:  # revisits read from archives
        every = heads.filter("type = 'response'").groupBy("sha1").agg(F.max(own).alias("first"))
        known = materialise(every)
        later.append(materialise(heads.filter("type = 'revisit' AND sha1 IS NOT NULL").select("__file", "__row", "sha1").join(known, "sha1").select("__file", "__row", "first")))
    refers = later[0] if len(later) == 1 else later[0].unionByName(later[1])

    none = lambda c, kind="string": F.lit(None).cast(kind).alias(c)
    whole = without_rows(rows.withColumn("record_id", _record_id()), refers).select(
        "record_id", *columns, "http", "payload", *[F.when(F.col("type") == "revisit", F.col(c)).alias(c) for c in old], *[none(c) for c in ("refers_to", "refers_uri", "refers_date", "digest") if c not in old])
    met = heads.select("*", *at_row()).join(refers.select(*at_row(), "first"), ["__f", "__r"])
    digest = F.concat(F.lit("sha1:"), base32("sha1"))
    revisits = met.select(
        "record_id", "key", F.lit("revisit").alias("type"), "uri", "date", "content_type", "http", none("payload", "binary"),
        F.col("first.record_id").alias("refers_to"), F.col("first.uri").alias("refers_uri"), F.col("first.date").alias("refers_date"), digest.alias("digest"))
    return whole.unionByName(revisits)


def resolve(records: DataFrame) -> DataFrame:
    """Per read record its payload's length and SHA-1, and of a revisit the key and URI of the response that it refers to.

    Revisits meet responses by the id they name, else by digest. One row stands for each id or digest, so a payload with
    very many revisits multiplies nothing. Where the response isn't in ``records``, length, ``refers_key`` and ``refers_uri`` are null.
    """
    heads = materialise(records.drop("http", "payload"))
    named = F.concat(F.lit("sha1:"), F.col("sha1"))
    own = F.struct(F.col("key").isNotNull().alias("has"), "key", "record_id", "uri", "payload_bytes", "sha1")
    originals = heads.filter("type = 'response'").select(F.explode(F.array("record_id", named)).alias("name"), own.alias("own"))
    first = materialise(originals.filter("name IS NOT NULL").groupBy("name").agg(F.max("own").alias("own")))
    met = (heads.filter("type = 'revisit'").withColumn("name", F.coalesce("refers_to", named)).join(first, "name", "left")
           .select("key", "record_id", "type", "uri", F.col("own.payload_bytes").alias("payload_bytes"), F.coalesce("sha1", "own.sha1").alias("sha1"),
                   F.col("own.key").alias("refers_key"), F.col("own.uri").alias("refers_uri")))
    rest = heads.filter("type IS DISTINCT FROM 'revisit'").select(
        "key", "record_id", "type", "uri", "payload_bytes", "sha1", F.lit(None).cast("long").alias("refers_key"), F.lit(None).cast("string").alias("refers_uri"))
    return rest.unionByName(met)


def rewrite(spark: SparkSession, source: str, target: str, least: int = LEAST) -> None:
    """Read archives, replace repeated payloads by revisits, and write the archives with fresh headers."""
    write_archives(deduplicate(materialise(read_archives(spark, source)), least), target)
