"""Quality rules: counts, and a calibrated logistic regression on hashed word and character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .learn import Adam, WordHashes, labelled_sample, sigmoid

BUCKETS = 1 << 14  # of each kind: words, word pairs, characters in threes and in fives
KINDS = 4
SCALE = 8.0  # of the shares that are the features
MOST_LABELLED = 4000  # labelled documents that the model is fitted and calibrated on
KEEP_AT = 0.3  # fixed threshold of the calibrated probability of good quality
LEAST_WORDS, MOST_REPEATED = 50, 50  # fixed limits of the base rules: words, and per cent of repeated words
SYMBOLS = b"#*$%&|<>"


def _chars(data: np.ndarray, n: int) -> np.ndarray:
    """Buckets of all runs of ``n`` bytes."""
    if len(data) < n:
        return np.zeros(0, dtype=np.uint32)
    total = np.zeros(len(data) - n + 1, dtype=np.uint32)
    for i in range(n):
        total = total * np.uint32(0x01000193) + data[i:i + len(total)]
    return (total * np.uint32(0x9E3779B1)) >> np.uint32(18)


def buckets(text: bytes, hashes: np.ndarray) -> list[np.ndarray]:
    """For each kind of n-gram the buckets of all its occurrences, each kind in a range of its own."""
    data = np.frombuffer(text, dtype=np.uint8)
    pairs = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ hashes[1:]
    mask = np.uint64(BUCKETS - 1)
    found = [(hashes & mask), ((pairs >> np.uint64(20)) & mask), _chars(data, 3), _chars(data, 5)]
    return [f.astype(np.int64) + i * BUCKETS for i, f in enumerate(found)]


@dataclass
class Model:
    """Weights, bias, and slope and offset of the calibration: 0.3 MB, whatever the corpus."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, text: bytes, hashes: np.ndarray) -> float:
        return self.bias + SCALE * sum(float(self.weights[b].mean()) for b in buckets(text, hashes) if len(b))

    def probability(self, text: bytes, hashes: np.ndarray) -> float:
        return float(sigmoid(np.float64(self.slope * self.raw(text, hashes) + self.offset)))


def counts(text: bytes, words: list[bytes], hashes: np.ndarray) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    inner = sum(1 for b in text if 0x80 <= b < 0xC0) if len(text) < 64 else int(((np.frombuffer(text, np.uint8) & 0xC0) == 0x80).sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if len(words) > 3:
        windows = (hashes[:-2] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[2:]
        _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
        if len(times) < len(windows):
            again = times[which] > 1
            covered = np.zeros(len(words), dtype=bool)
            for i in range(3):
                covered[i:i + len(again)] |= again
            repeated = int(covered.sum())
    return sum(map(len, words)) - inner, sum(text.count(bytes([c])) for c in SYMBOLS), len(lines) - len(set(lines)), repeated


def fit(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, calibrate: np.ndarray, epochs: int = 25, batch: int = 200, seed: int = 3) -> Model:
    """Logistic regression by Adam on the rows outside ``calibrate``, then slope and offset by damped Newton steps on those inside."""
    rng = np.random.default_rng(seed)
    weights, bias = np.zeros(KINDS * BUCKETS, np.float32), np.zeros(1, np.float32)
    steps = Adam(weights.shape, 0.05), Adam(1, 0.05)

    def raw(mine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(rows[i][0]) + 1 for i in mine])
        at = np.concatenate([np.append(rows[i][0], 0) for i in mine])
        x = np.concatenate([np.append(rows[i][1], np.float32(0)) for i in mine])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return at, x, sizes, bias[0] + np.add.reduceat(x * weights[at], starts)

    learned = np.flatnonzero(~calibrate)
    for _ in range(epochs):
        order = rng.permutation(learned)
        for b in range(0, len(order), batch):
            mine = order[b:b + batch]
            at, x, sizes, z = raw(mine)
            wrong = (sigmoid(z) - good[mine]) / len(mine)
            steps[0].step(weights, np.bincount(at, x * np.repeat(wrong, sizes), len(weights)).astype(np.float32) + 1e-5 * weights)
            steps[1].step(bias, np.array([wrong.sum()], dtype=np.float32))
    model = Model(weights, float(bias[0]))
    held = np.flatnonzero(calibrate)
    if len(held):
        z, good_held = raw(held)[3].astype(np.float64), good[held]
        middle, spread = z.mean(), z.std() + 1e-6
        design = np.stack([(z - middle) / spread, np.ones_like(z)], axis=1)
        # targets drawn in by one row of each class, so that classes told apart exactly stay finite
        y = np.where(good_held > 0.5, (good_held.sum() + 1) / (good_held.sum() + 2), 1 / (len(held) - good_held.sum() + 2))
        a = np.array([spread, middle])
        for _ in range(100):
            p = sigmoid(design @ a)
            step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.eye(2), design.T @ (p - y))
            a -= step * min(1.0, 1.0 / (np.abs(step).max() + 1e-12))
        if a[0] > 0:
            model.slope, model.offset = float(a[0] / spread), float(a[1] - a[0] * middle / spread)
    return model


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``most`` labelled documents: fold 0 trains, fold 2 calibrates, fold 1 is held out."""
    sample = labelled_sample(docs, labels, most, id_col, {"text": F.col(text_col).cast("string").cast("binary")})

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            at, x = [], []
            for t in batch.column("text"):
                text = t.as_py() or b""
                found = [np.unique(b, return_counts=True) for b in buckets(text, cache.of(text.split()))]
                at.append(np.concatenate([f[0] for f in found]).astype("<u2").tobytes())
                x.append(np.concatenate([SCALE * f[1] / max(1, f[1].sum()) for f in found]).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("good"), batch.column("fold"), pa.array(at, pa.binary()), pa.array(x, pa.binary())],
                                             names=["good", "fold", "at", "x"])

    got = sample.select("text", "good", "fold").mapInArrow(numbers, "good int, fold int, at binary, x binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["at"], r["x"], r["good"]))
    rows = [(np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["x"], "<f4")) for r in got]
    return fit(rows, np.array([r["good"] for r in got], dtype=np.float64), np.array([r["fold"] == 2 for r in got], dtype=bool))


def judge(docs: DataFrame, model: Model, keep_at: float = KEEP_AT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdict for every whole text, in Arrow batches.

    Returns the id, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``base_failed``, ``probability`` of good quality (calibrated) and ``kept``: not failed, and the
    probability at or above ``keep_at``. Null or empty text has no words and fails. Repeated rows get
    equal rows; ids may be null; empty table: no rows. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, own = WordHashes(), shared.value
        for batch in batches:
            rows, chances = [], []
            for t in batch.column("__text"):
                text = t.as_py() or b""
                words = text.split()
                hashes = cache.of(words)
                rows.append((len(words), *counts(text, words, hashes)))
                chances.append(own.probability(text, hashes))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("__own_id"), *[pa.array(c, pa.int64()) for c in columns], pa.array(chances, pa.float64())],
                                             names=["__own_id", *names, "probability"])

    rows = docs.select(F.col(id_col).alias("__own_id"), F.col(text_col).cast("string").cast("binary").alias("__text"))
    found = rows.mapInArrow(scan, f"__own_id {dict(docs.dtypes)[id_col]}, " + ", ".join(f"{n} long" for n in names) + ", probability double")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return found.select(F.col("__own_id").alias(id_col), *names, failed.alias("base_failed"), "probability",
                        (~failed & (F.col("probability") >= keep_at)).alias("kept"))
