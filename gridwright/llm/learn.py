"""What the learned operators share: labelled samples of bounded size, word hashes, Adam."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

FOLDS = 3
HELD_OUT = 1


def fold_of(id_column: Column) -> Column:
    """CRC-32 of the id as text, modulo 3; remainder 1 is never learned from. A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, id_col: str, columns: dict[str, Column]) -> DataFrame:
    """At most ``most`` labelled documents outside the held-out fold: ``columns``, ``good`` (0/1), ``fold``.

    The ids are drawn by hash from the labels alone; ``most`` bounds what is broadcast and what a
    model is fitted on. Of several labels for one id the least counts.
    """
    ids = (labels.select(F.col("doc_id").alias("__id"), F.col("quality").alias("__good")).filter("__id IS NOT NULL AND __good IS NOT NULL")
           .groupBy("__id").agg(F.min("__good").cast("int").alias("__good"))
           .withColumn("__fold", fold_of(F.col("__id"))).filter(F.col("__fold") != HELD_OUT)
           .orderBy(F.xxhash64("__id"), "__id").limit(most))
    return (docs.select(F.col(id_col).alias("__doc"), *[c.alias(n) for n, c in columns.items()])
            .join(F.broadcast(ids), F.col("__doc") == F.col("__id"))
            .select(*columns, F.col("__good").alias("good"), F.col("__fold").alias("fold")))


class WordHashes(dict):
    """Signed 64-bit XXH64 of a word, remembered for the last 65,536 different words: some 10 MB a worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 16:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, 3)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Adam:
    """Adam for one array."""

    def __init__(self, shape, rate: float) -> None:
        self.m, self.v, self.rate, self.t = np.zeros(shape, np.float32), np.zeros(shape, np.float32), rate, 0

    def step(self, values: np.ndarray, gradient: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.001 * (gradient * gradient - self.v)
        values -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))
