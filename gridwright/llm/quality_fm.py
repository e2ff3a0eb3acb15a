"""Quality scores by a factorisation machine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small_batches
from .learn import Adam, HELD_OUT, WordHashes, fold_of, labelled_sample, sigmoid

WORDS = 1 << 15  # buckets of hashed words
LENGTHS = 40  # buckets of the recorded length, the last for none
SHAPES = 10  # structure statistics
SIZE = WORDS + LENGTHS + SHAPES
FACTORS = 8
MOST_LABELLED = 6000  # labelled documents that the model is fitted on
_LETTERS = np.zeros((256, 5), dtype=bool)
_LETTERS[ord("A"):ord("Z") + 1, 0] = True
_LETTERS[ord("0"):ord("9") + 1, 1] = True
_LETTERS[[ord(c) for c in "#*$%&|<>"], 2] = True
_LETTERS[[ord(c) for c in ".,;:!?"], 3] = True
_LETTERS[ord("\n"), 4] = True


def features(text: bytes, n_chars: int | None, cache: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices and values of hashed words (length 1 together) and recorded length, and the structure statistics."""
    words = text.split()
    length = WORDS + (LENGTHS - 1 if n_chars is None or n_chars < 0 else min(LENGTHS - 2, int(n_chars).bit_length()))
    kinds = _LETTERS[np.frombuffer(text, np.uint8)].sum(axis=0) / max(1, len(text))
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    if n:
        buckets, times = np.unique((cache.of(words) % np.uint64(WORDS)).astype(np.int64), return_counts=True)
        values = np.sqrt(times).astype(np.float32)
        values /= np.sqrt((values * values).sum())
        own = [np.log1p(n), sum(map(len, words)) / n, len(buckets) / n, float(times.max()) / n, 1 - len(set(lines)) / len(lines)]
    else:
        buckets, values, own = np.zeros(0, np.int64), np.zeros(0, np.float32), [0.0] * 5
    return (np.concatenate([buckets, [length]]), np.concatenate([values, np.ones(1, np.float32)]),
            np.array([*own, *kinds], dtype=np.float32))


@dataclass
class Model:
    """Bias, linear weights, factors, and the scale of the structure statistics: 1.2 MB, whatever the corpus."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def row(self, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at, x, shape = found
        scaled = np.clip((shape - self.mean) / self.spread, -4, 4) / 2
        return np.concatenate([at, np.arange(SIZE - SHAPES, SIZE)]), np.concatenate([x, scaled]).astype(np.float32)

    def score(self, text: bytes, n_chars: int | None, cache: WordHashes) -> float:
        at, x = self.row(features(text, n_chars, cache))
        v = self.factors[at]
        sums = x @ v
        # all pairs at once: half of (sum of the products) squared less the sum of their squares
        pairs = 0.5 * float((sums * sums).sum() - ((x * x) @ (v * v)).sum())
        return float(sigmoid(np.float64(self.bias + x @ self.linear[at] + pairs)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], good: np.ndarray, epochs: int = 12, batch: int = 128, seed: int = 5) -> Model:
    """Minimise the log loss with Adam in fixed batches. The classes weigh as they come; without rows all scores are 1/2."""
    rng = np.random.default_rng(seed)
    shapes = np.array([r[2] for r in rows], dtype=np.float32).reshape(-1, SHAPES)
    mean = shapes.mean(axis=0) if len(rows) else np.zeros(SHAPES, np.float32)
    spread = shapes.std(axis=0) + 1e-3 if len(rows) else np.ones(SHAPES, np.float32)
    model = Model(0.0, np.zeros(SIZE, np.float32), rng.normal(0, 0.05, (SIZE, FACTORS)).astype(np.float32), mean, spread)
    data = [model.row(r) for r in rows]
    bias, steps = np.zeros(1, np.float32), (Adam(SIZE, 0.02), Adam((SIZE, FACTORS), 0.01), Adam(1, 0.02))
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for b in range(0, len(order), batch):
            mine = order[b:b + batch]
            sizes = np.array([len(data[i][0]) for i in mine])
            at, x = np.concatenate([data[i][0] for i in mine]), np.concatenate([data[i][1] for i in mine])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            v = model.factors[at]
            xv = x[:, None] * v
            sums = np.add.reduceat(xv, starts)
            z = bias[0] + np.add.reduceat(x * model.linear[at], starts) + 0.5 * ((sums * sums) - np.add.reduceat(xv * xv, starts)).sum(axis=1)
            wrong = np.repeat((sigmoid(z) - good[mine]) / len(mine), sizes).astype(np.float32)
            pull = wrong * x
            per_factor = pull[:, None] * (np.repeat(sums, sizes, axis=0) - xv)
            g_v = np.stack([np.bincount(at, per_factor[:, f], SIZE) for f in range(FACTORS)], axis=1).astype(np.float32)
            steps[0].step(model.linear, np.bincount(at, pull, SIZE).astype(np.float32) + 1e-5 * model.linear)
            steps[1].step(model.factors, g_v + 1e-5 * model.factors)
            steps[2].step(bias, np.array([(sigmoid(z) - good[mine]).mean()], dtype=np.float32))
    model.bias = float(bias[0])
    return model


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> Model:
    """Fit on at most ``most`` labelled documents outside the held-out fold. Tasks turn texts to
    numbers; those numbers of the bounded sample come to the driver."""
    sample = labelled_sample(docs, labels, most, id_col, {"text": F.col(text_col).cast("string").cast("binary"), "chars": F.col(chars_col).cast("long")})

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            out = [features(t.as_py() or b"", c, cache) for t, c in zip(batch.column("text"), batch.column("chars").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column("good"), *[pa.array([f[i].astype(k).tobytes() for f in out], pa.binary()) for i, k in ((0, "<u4"), (1, "<f4"), (2, "<f4"))]],
                names=["good", "at", "x", "shape"])

    got = sample.select("text", "chars", "good").mapInArrow(numbers, "good int, at binary, x binary, shape binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["at"], r["x"], r["shape"], r["good"]))  # the order in which tasks end must not matter
    rows = [(np.frombuffer(r["at"], "<u4").astype(np.int64), np.frombuffer(r["x"], "<f4"), np.frombuffer(r["shape"], "<f4")) for r in got]
    return fit(rows, np.array([r["good"] for r in got], dtype=np.float32))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """Score every whole text in Arrow batches: the id, ``held_out``, ``score`` (0 to 1), ``predicted``.

    Inputs of the score are the text and the recorded length alone. Null or empty text is scored by
    its structure; repeated rows get equal scores; ids may be null; empty table: no rows. Other
    columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, own = WordHashes(), shared.value
        for batch in batches:
            scores = [own.score(t.as_py() or b"", c, cache) for t, c in zip(batch.column(1), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"), F.col(chars_col).cast("long").alias("chars"))
    scored = rows.mapInArrow(scan, f"id {dict(docs.dtypes)[id_col]}, score double")
    return scored.select(F.col("id").alias(id_col), (fold_of(F.col("id")) == HELD_OUT).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``least``; scored as in ``score``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_at, chars_at = docs.columns.index(text_col), docs.columns.index(chars_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, own = WordHashes(), shared.value
        for batch in batches:
            texts = batch.column(text_at).cast(pa.binary())
            yield batch.filter(pa.array([own.score(t.as_py() or b"", c, cache) >= least
                                         for t, c in zip(texts, batch.column(chars_at).to_pylist(), strict=True)], pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)
