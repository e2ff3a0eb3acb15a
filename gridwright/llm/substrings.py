"""Removal of repeated passages: fixed-block anchors, rolling probes, exact extension."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .common import text_of

FLUSH = 1_000_000  # words that a worker holds before it sends them on
PART_BYTES = 64 << 20  # text per part of the hash space
LEAST_PARTS_BITS = 8
FEW_DOCS, FEW_RUNS = 250_000, 4_000_000  # broadcast bounds: documents, and numbers in their lists (32 MB)
LAST = (1 << 63) - 1  # order of a null id
SETTLED_ROWS = 4096  # places in one record of those that need no comparison

BLOCK_AT = np.dtype([("hash", "<u8"), ("id", "<i8"), ("text", "<i8"), ("at", "<i4")])
WINDOW_AT = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("id", "<i8"), ("text", "<i8"), ("at", "<i4")])


class _WordHashes(dict):
    """XXH64 of a word, remembered for the last half million different words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, 7)
        return value


def _factors(n: int, seed: int) -> list[np.uint64]:
    return [np.uint64(xxhash.xxh64_intdigest(f"{seed}:{i}", 11) | 1) for i in range(n)]


def _rolling(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hash of every run of ``n`` words."""
    total = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64)
    for i, f in enumerate(_factors(n, seed)):
        total += words[i:i + len(total)] * f
    total ^= total >> np.uint64(31)
    total *= np.uint64(0x9E3779B97F4A7C15)
    return total ^ (total >> np.uint64(29))


class _Gathered:
    """Words of several documents one after the other, as hashes, with the place of each piece."""

    def __init__(self) -> None:
        self.hashes, self.pieces, self.words = [], [], 0

    def add(self, words: np.ndarray, doc: int, text: int, offset: int) -> None:
        self.hashes.append(words)
        self.pieces.append((len(words), doc, text, offset))
        self.words += len(words)

    def flat(self, n: int) -> tuple[np.ndarray, ...]:
        """All hashes; for each word: whether ``n`` words of the document follow, id, text hash, place."""
        length = np.array([p[0] for p in self.pieces], dtype=np.int64)
        ends = np.repeat(np.cumsum(length), length)
        at = np.arange(self.words, dtype=np.int64)
        start = np.repeat(np.cumsum(length) - length, length)
        doc, text, offset = (np.repeat(np.array([p[i] for p in self.pieces], dtype=np.int64), length) for i in (1, 2, 3))
        return np.concatenate(self.hashes), at + n <= ends, doc, text, at - start + offset


def _pieces(hashes: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, int]]:
    """A long document in pieces that overlap by one word less than a window."""
    for at in range(0, max(1, len(hashes) - window + 1), FLUSH):
        yield hashes[at:at + FLUSH + window - 1], at


def _five_bytes(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from_five(data: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(data), dtype=np.uint8).reshape(-1, 5)
    wide = np.zeros((len(raw), 8), dtype=np.uint8)
    wide[:, :5] = raw
    return wide.view("<u8").ravel()


def _cut(parts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs of equal values of a sorted array: value, begin, end."""
    if len(parts):
        at = np.concatenate([[0], np.flatnonzero(np.diff(parts)) + 1, [len(parts)]])
        for b, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield int(parts[b]), b, e


def _rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int8()), pa.array([f[2] for f in found], pa.binary())],
        names=["part", "kind", "data"])


PROBES, OPEN, SETTLED = 0, 1, 2
SENT = "part int, kind byte, data binary"
PLACES = "id long, text_hash long, at int"


def _first_turn() -> int:
    """Number before a task's first batch: batches count upwards from it, and no two tasks share one."""
    return TaskContext.get().partitionId() << 32


def _settled(found: np.ndarray, bits: int, turn: int) -> list[tuple[int, int, bytes]]:
    """Places that need no comparison, in short records dealt over all parts, whatever the number of tasks and batches."""
    cuts = range(0, len(found), SETTLED_ROWS)
    return [(xxhash.xxh64_intdigest(f"{turn}:{at}", 13) % (1 << bits), SETTLED, found[at:at + SETTLED_ROWS].tobytes()) for at in cuts]


def _anchors(gathered: _Gathered, block: int, bits: int, turn: int) -> pa.RecordBatch:
    """Every rolling window's hash once, and the aligned blocks.

    A block met twice among these documents is settled here and needs no comparison elsewhere, so
    a passage in a third of all documents leaves one row per worker batch.
    """
    words, whole, doc, text, place = gathered.flat(block)
    hashes = _rolling(words, block, 1)
    whole = whole[:len(hashes)]
    short = hashes >> np.uint64(24 - bits)  # part, then 40 bits
    probes, times = np.unique(short[whole], return_counts=True)
    found = [(p, PROBES, _five_bytes(probes[b:e])) for p, b, e in _cut((probes >> np.uint64(40)).astype(np.int64))]
    mine = np.flatnonzero(whole & (place[:len(hashes)] % block == 0))
    blocks = np.zeros(len(mine), dtype=BLOCK_AT)
    blocks["hash"], blocks["id"], blocks["text"], blocks["at"] = short[mine], doc[mine], text[mine], place[mine] // block
    again = times[np.searchsorted(probes, blocks["hash"])] > 1 if len(mine) else np.zeros(0, dtype=bool)
    found += _settled(blocks[again], bits, turn)
    alone = blocks[~again]
    parts = (alone["hash"] >> np.uint64(40)).astype(np.int64)
    order = np.argsort(parts, kind="stable")
    alone = alone[order]
    found += [(p, OPEN, alone[b:e].tobytes()) for p, b, e in _cut(parts[order])]
    return _rows(found)


def _places(found: np.ndarray) -> pa.Table:
    return pa.table({"id": pa.array(found["id"]), "text_hash": pa.array(found["text"]), "at": pa.array(found["at"])})


def _of_kind(group: pa.Table, kind: int) -> list[bytes]:
    return [d for k, d in zip(group.column("kind").to_pylist(), group.column("data").to_pylist(), strict=True) if k == kind]


def _met_blocks(group: pa.Table) -> pa.Table:
    """Blocks whose hash some other worker batch has as a rolling window too."""
    settled = np.frombuffer(b"".join(_of_kind(group, SETTLED)), dtype=BLOCK_AT)
    blocks = np.frombuffer(b"".join(_of_kind(group, OPEN)), dtype=BLOCK_AT)
    if len(blocks):
        probes = np.sort(_from_five(_of_kind(group, PROBES)))
        key = blocks["hash"] & np.uint64((1 << 40) - 1)
        times = np.searchsorted(probes, key, "right") - np.searchsorted(probes, key, "left")
        blocks = blocks[times > 1]
    return _places(np.concatenate([settled, blocks]))


def _later(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that start after the first one of their words, and those that don't, by hash."""
    order = np.lexsort((found["at"], found["id"], found["h2"], found["h1"]))
    found = found[order]
    if not len(found):
        return found, found
    new = np.concatenate([[True], (found["h1"][1:] != found["h1"][:-1]) | (found["h2"][1:] != found["h2"][:-1])])
    first = found[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = (found["id"] != first["id"]) | (found["at"] != first["at"])
    return found[later], found[~later]


def _extended(gathered: _Gathered, masks: list[np.ndarray], window: int, bits: int, turn: int) -> pa.RecordBatch:
    """All windows that hold a met block, by 128 bits of hash; those after an equal one in this batch are settled."""
    words, whole, doc, text, place = gathered.flat(window)
    h1, h2 = _rolling(words, window, 2), _rolling(words, window, 3)
    take = np.flatnonzero(whole[:len(h1)] & np.concatenate(masks)[:len(h1)])
    found = np.zeros(len(take), dtype=WINDOW_AT)
    found["h1"], found["h2"], found["id"], found["text"], found["at"] = h1[take], h2[take], doc[take], text[take], place[take]
    later, first = _later(found)
    rows = _settled(later, bits, turn)
    parts = (first["h1"] >> np.uint64(64 - bits)).astype(np.int64)
    rows += [(p, OPEN, first[b:e].tobytes()) for p, b, e in _cut(parts)]
    return _rows(rows)


def _repeated(group: pa.Table) -> pa.Table:
    settled = np.frombuffer(b"".join(_of_kind(group, SETTLED)), dtype=WINDOW_AT)
    later, _ = _later(np.frombuffer(b"".join(_of_kind(group, OPEN)), dtype=WINDOW_AT))
    return _places(np.concatenate([settled, later]))


def _joined(docs: DataFrame, side: DataFrame, keys: list[str], how: str, numbers: str | None = None) -> DataFrame:
    """Join with a stored table, broadcast if its counted rows and numbers are within the bounds."""
    size = side.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.expr(numbers)) if numbers else F.lit(0), F.lit(0)).alias("m")).first()
    return docs.join(F.broadcast(side) if size["n"] <= FEW_DOCS and size["m"] <= FEW_RUNS else side, keys, how)


def repeated_runs(rows: DataFrame, window: int, bits: int) -> DataFrame:
    """Runs of window starts to remove: ``id``, ``text_hash``, arrays ``begins`` and ``ends`` (inclusive).

    ``rows``: ``id`` (long), ``text`` (binary), ``text_hash``, one row per different text.
    """
    block = window // 2

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, gathered, turn = _WordHashes(), _Gathered(), _first_turn()
        for batch in batches:
            for doc, text, key in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = text.as_py().split()
                if len(words) < window:
                    continue
                for piece, at in _pieces(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)), window):
                    gathered.add(piece, doc, key, at)
                    if gathered.words >= FLUSH:
                        yield _anchors(gathered, block, bits, turn := turn + 1)
                        gathered = _Gathered()
        if gathered.words:
            yield _anchors(gathered, block, bits, turn + 1)

    met = (rows.mapInArrow(anchors, SENT).groupBy("part").applyInArrow(_met_blocks, PLACES)
           .groupBy("id", "text_hash").agg(F.collect_set("at").alias("blocks")))
    met = materialise(met)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, gathered, masks, turn = _WordHashes(), _Gathered(), [], _first_turn()
        for batch in batches:
            for doc, text, key, blocks in zip(batch.column("id").to_pylist(), batch.column("text"), batch.column("text_hash").to_pylist(), batch.column("blocks"), strict=True):
                words = text.as_py().split()
                begins = np.asarray(blocks.values.to_numpy(), dtype=np.int64) * block
                # the windows that hold block b start at b - (window - block) ... b
                mask = np.zeros(len(words) + 1, dtype=np.int32)
                np.add.at(mask, np.maximum(0, begins - (window - block)), 1)
                np.add.at(mask, begins + 1, -1)
                mask = np.cumsum(mask[:-1]) > 0
                for piece, at in _pieces(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)), window):
                    gathered.add(piece, doc, key, at)
                    masks.append(mask[at:at + len(piece)])
                    if gathered.words >= FLUSH:
                        yield _extended(gathered, masks, window, bits, turn := turn + 1)
                        gathered, masks = _Gathered(), []
        if gathered.words:
            yield _extended(gathered, masks, window, bits, turn + 1)

    chosen = _joined(rows, met, ["id", "text_hash"], "inner", "size(blocks)").select("id", "text", "text_hash", "blocks")
    found = (chosen.mapInArrow(extend, SENT).groupBy("part").applyInArrow(_repeated, PLACES)
             .groupBy("id", "text_hash").agg(F.sort_array(F.collect_set("at")).alias("at")))
    begins = F.filter("at", lambda x, i: (i == 0) | (F.get("at", i - 1) != x - 1))
    ends = F.filter("at", lambda x, i: (i == F.size("at") - 1) | (F.get("at", i + 1) != x + 1))
    return materialise(found.select("id", "text_hash", begins.alias("begins"), ends.alias("ends")))


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word that lies in a window of ``window`` words whose words also start earlier.

    Earlier is a smaller id, or an earlier start in the same document. Blocks of half a window are
    cut from each document end to end; every window holds one of its own document's. A block met by a
    rolling window elsewhere marks the windows around it; these are extended to full windows and
    compared by 128 bits of hash (two independent 64-bit sums), and runs of repeated windows are the
    maximal repeats. Copies of a text are represented by the smallest id, and later copies lose all
    words if a window fits. Words travel as five bytes per rolling window and once per worker batch.

    Returns per row: the id, ``n_words``, ``n_removed``, ``kept_text`` (kept words joined by one space,
    UTF-8 as binary). Null or empty text: no words. A null id comes after all others. Rows that share
    id and text are one document, and none of them removes the other; rows that share only the id
    count as one document, in which the smaller start is earlier. Empty table: no rows. Other columns are not read.
    """
    if window % 2:
        raise ValueError("window must be even")
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("own_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), text.cast("binary").alias("text"),
                       F.xxhash64(text).alias("text_hash"), F.xxhash64(F.lit("second"), text).alias("text_hash2"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    bits = min(24, max(LEAST_PARTS_BITS, (size // PART_BYTES).bit_length()))
    copies = materialise(rows.groupBy("text_hash", "text_hash2").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
                         .filter("first_id < last_id").drop("last_id"))
    known = _joined(rows, copies, ["text_hash", "text_hash2"], "left").withColumn("copy", F.coalesce(F.col("id") > F.col("first_id"), F.lit(False)))
    runs = repeated_runs(known.filter("NOT copy").select("id", "text", "text_hash"), window, bits)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for text, copy, begins, ends in zip(batch.column("text"), batch.column("copy").to_pylist(), batch.column("begins"), batch.column("ends"), strict=True):
                words = text.as_py().split()
                n = len(words)
                total.append(n)
                if copy and n >= window:
                    words = []
                elif not copy and begins.is_valid:
                    stay, at = [], 0
                    for b, e in zip(begins.as_py(), ends.as_py(), strict=True):
                        stay += words[at:max(at, b)]
                        at = max(at, e + window)
                    words = stay + words[at:]
                removed.append(n - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("own_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
                                             names=[id_col, "n_words", "n_removed", "kept_text"])

    marked = _joined(known, runs, ["id", "text_hash"], "left", "2 * size(begins)").select("own_id", "text", "copy", "begins", "ends")
    kind = dict(docs.dtypes)[id_col]
    return marked.mapInArrow(remove, f"`{id_col}` {kind}, n_words long, n_removed long, kept_text binary")
