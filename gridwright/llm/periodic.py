"""Runs of periodically repeated words, found by a dictionary of basic factors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import WORDS

LEAST = 12  # words of the shortest run
TOGETHER = 1 << 19  # words of short texts that are numbered together; a longer text is alone

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _progressions(at: np.ndarray, name: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods proposed by the occurrences ``at`` (sorted by ``name``, then place) of factors of ``width`` words.

    Successors at most twice the width apart form arithmetic progressions. A run of period q between
    ``width`` and twice that maps a progression to the next one of the same factor, so either their first or their
    last members lie q apart, or there is just one member each and the successor does.
    """
    gap = np.zeros(len(at), np.int64)
    gap[:-1] = np.where((name[1:] == name[:-1]) & (at[1:] - at[:-1] <= 2 * width), at[1:] - at[:-1], 0)
    turn = np.arange(len(at))
    changes = np.concatenate([gap[1:] != gap[:-1], [True]])
    last = np.minimum.accumulate(np.where(changes, turn, len(at))[::-1])[::-1]
    last = np.where(gap > 0, last + 1, turn)  # the last member of the progression that goes on from here
    go = turn[gap > 0]
    ends = last[go]
    first = go[gap[ends] > 0]
    onward = last[go + 1]
    i = np.concatenate([at[go], at[first], at[go]])
    p = np.concatenate([gap[go], at[last[first] + 1] - at[first], at[onward] - at[go]])
    near = p <= 2 * width
    return i[near], p[near]


def _extent(names: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal words from ``a`` and ``b`` on, and right before them, by falling powers of two."""
    n = len(names[0])
    ahead, behind = a.copy(), a.copy()
    shift = b - a
    for k in range(len(names) - 1, -1, -1):
        name, width = names[k], 1 << k
        at = np.minimum(ahead + shift, n - 1)
        ahead += np.where((ahead + shift < n) & (name[np.minimum(ahead, n - 1)] >= 0) & (name[np.minimum(ahead, n - 1)] == name[at]), width, 0)
        back = np.maximum(behind - width, 0)
        behind -= np.where((behind >= width) & (name[back] >= 0) & (name[back] == name[np.minimum(back + shift, n - 1)]), width, 0)
    return behind, ahead


def find_runs(words: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows of start, length and smallest period of all maximal runs, by start, then period.

    ``words`` are numbers; negative ones equal nothing, so they part texts. Level k of the
    dictionary names every stretch of 2**k words that occurs again, from the names of its halves.
    """
    names, found = [], []
    at, code, width = np.flatnonzero(words >= 0), words[words >= 0].astype(np.int64), 1
    while len(at):
        order = np.argsort(code, kind="stable")
        at, code = at[order], code[order]
        new = np.concatenate([[True], code[1:] != code[:-1], [True]])
        again = ~(new[1:] & new[:-1])
        at, number = at[again], (np.cumsum(new[:-1]) - 1)[again]
        name = np.full(len(words), -1, np.int32)
        name[at] = number
        names.append(name)
        if not len(at):
            break
        i, p = _progressions(at, number, width)
        place = np.unique(p * (len(words) + 1) + i)
        place = place[np.concatenate([[True], np.diff(place) != 1])[:len(place)]]  # neighbours of one period lie in one run
        found.append(place)
        at = np.flatnonzero((name[:-width] >= 0) & (name[width:] >= 0)) if width < len(name) else at[:0]
        code = name[at].astype(np.int64) * (len(order) + 1) + name[at + width] if len(at) else at
        width *= 2
    place = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    if not len(place):
        return np.zeros((0, 3), np.int64)
    p, i = place // (len(words) + 1), place % (len(words) + 1)
    start, ahead = _extent(names, i, i + p)
    length = ahead + p - start
    long = (length >= np.maximum(least, 2 * p))
    runs = np.unique(np.stack([start[long], length[long], p[long]], axis=1), axis=0)  # by start, length, period
    smallest = np.ones(len(runs), bool)
    smallest[1:] = (runs[1:, 0] != runs[:-1, 0]) | (runs[1:, 1] != runs[:-1, 1])  # the same stretch by a multiple of its period
    runs = runs[smallest]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _numbered(texts: list[list[bytes]]) -> np.ndarray:
    """Words as numbers, with a -1 after each text."""
    seen: dict[bytes, int] = {}
    out: list[int] = []
    for words in texts:
        out.extend([seen.setdefault(w, len(seen)) for w in words])
        out.append(-1)
    return np.array(out, np.int64)


def _runs_of(texts: list[list[bytes]], least: int) -> Iterator[np.ndarray]:
    """Per text its runs; several short texts share one dictionary."""
    numbers = _numbered(texts)
    runs = find_runs(numbers, least)
    begin = np.concatenate([[0], np.cumsum([len(w) + 1 for w in texts])])
    cut = np.searchsorted(runs[:, 0], begin)
    for k in range(len(texts)):
        yield runs[cut[k]:cut[k + 1]] - np.array([begin[k], 0, 0])


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without those that a run holds after its first period."""
    if not len(runs):
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(w for w, inside in zip(words, np.cumsum(edges[:-1]).tolist(), strict=True) if not inside)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, keep: Sequence[str] = ()) -> DataFrame:
    """Maximal runs of words with a smallest period, and each text without the repeats.

    A run is a stretch of at least ``least`` words and two periods in which words one period apart are equal and
    which no neighbouring word extends. Words are runs of anything but ASCII blanks, compared as they are.

    Returns per row the id, the columns of ``keep``, ``n_words``, ``runs`` (``start``, ``length``, ``period``; by start, then
    period) and ``collapsed`` (the kept words joined by one space). Null, empty and blank texts have no words and no
    runs; ids may be null or repeated; rows are treated one by one, whole, in one pass without a shuffle. Empty
    table: no rows. Other columns are not read. Run it inside ``bounded_batches`` where texts may be very long. A text
    takes about 4 bytes a word for each doubling of its longest repeated stretch.
    """
    source = docs.select(F.col(id_col).alias("id"), *keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("__text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [t.as_py().split() for t in batch.column(batch.num_columns - 1)]  # bytes know ASCII blanks only
            runs, part, size = [], [], 0
            for w in words:
                if part and size + len(w) > TOGETHER:
                    runs += _runs_of(part, least)
                    part, size = [], 0
                part.append(w)
                size += len(w) + 1
            runs += _runs_of(part, least) if part else []
            every = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
            parts = pa.StructArray.from_arrays([pa.array(every[:, k]) for k in range(3)], names=["start", "length", "period"])
            texts = pa.array([_collapsed(w, r) for w, r in zip(words, runs, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), parts), texts],
                names=[*batch.schema.names[:-1], "n_words", "runs", "collapsed"])

    columns = [f"`{n}` {k}" for n, k in source.dtypes[:-1]]
    out = source.mapInArrow(scan, ", ".join([*columns, "n_words long", f"runs {RUNS}", "collapsed binary"]))
    return out.select(F.col("id").alias(id_col), *keep, "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def planted(doc_id: Column, text: Column) -> Column:
    """The text in which a tenth of the documents, by a hash of the id, end in a period of their own words."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("long")

    def turned(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        period = F.slice(words, (a + 1).cast("int"), F.least(p, n - a).cast("int"))
        ending = F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int")))
        whole = F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(ending, F.lit(1), (n - a).cast("int")))
        return F.when(n > 0, F.array_join(whole, " ")).otherwise("")

    words = F.regexp_extract_all(text, F.lit(f"({WORDS})"), F.lit(1))
    # a lambda's argument is evaluated once, however often it is used
    return F.when(h % 10 == 0, F.get(F.transform(F.array(words), turned), F.lit(0))).otherwise(text)
