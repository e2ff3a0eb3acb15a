"""Length buckets with the least padding, and batches of a token budget inside each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise
from .common import chunk_bits, hex_bits, in_chunks, literal_array, text_of, word_count

EXACT_CELLS = 4096  # lengths up to here are histogram cells of their own


def cell_of(length: Column) -> Column:
    """Upper end of the histogram cell: the length itself, above 4096 rounded up to 13 leading bits.

    The histogram so has at most 4096 cells for each doubling of the length, whatever the table.
    """
    width = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length, F.lit(1)).cast("double"))) - 12).cast("int")
    step = F.pow(F.lit(2.0), width).cast("long")
    return F.when(length <= EXACT_CELLS, length).otherwise(F.ceil(length / step).cast("long") * step)


def best_edges(cells: list[tuple[int, int, int]], buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets with the least total padding.

    ``cells`` are (upper end, documents, tokens), by upper end. Dynamic programme over the cells:
    best cost of the first j cells in k buckets, extended by one bucket at a time. Of equal costs
    the cut with the fewest cells before it is taken.
    """
    if not cells:
        return []
    ends = np.array([c[0] for c in cells], dtype=np.float64)
    docs = np.concatenate([[0], np.cumsum([c[1] for c in cells])]).astype(np.float64)
    tokens = np.concatenate([[0], np.cumsum([c[2] for c in cells])]).astype(np.float64)
    n = len(cells)
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    cuts = []
    for _ in range(min(buckets, n)):
        longer, cut = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + ends[j - 1] * (docs[j] - docs[:j]) - (tokens[j] - tokens[:j])
            cut[j] = int(np.argmin(cost))
            longer[j] = cost[cut[j]]
        cuts.append(cut)
        best = longer
    edges, j = [], n
    for cut in reversed(cuts):
        edges.append(int(ends[j - 1]))
        j = cut[j]
    return edges[::-1]


def pack(docs: DataFrame, buckets: int = 16, budget: int = 65_536, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Give every document a bucket, a batch and a row in the batch.

    Tokens are words. The global histogram of lengths (one row per cell) goes to the driver, where
    the dynamic programme finds the bucket ends. A batch of a bucket with end ``e`` holds
    ``budget // e`` documents padded to ``e``; longer documents than the budget are batches of one.
    Rows are numbered inside a bucket in the order of an md5 of the id, by chunks of it, so a bucket may hold any share of the table.

    Returns id, ``n_tokens``, ``bucket``, ``bucket_len``, ``batch`` (0, 1, ... in a bucket), ``slot``
    and ``padding``. Null or empty text: length 0, in the lowest bucket. Repeated rows are packed
    one by one. Empty table: no rows. Only the two named columns are read.
    """
    rows = materialise(docs.select(
        F.col(id_col).alias("id"), word_count(text_of(text_col)).alias("n_tokens"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("hash")))
    cells = rows.groupBy(cell_of(F.col("n_tokens")).alias("cell")).agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))
    found = sorted((r["cell"], r["docs"], r["tokens"]) for r in cells.collect())
    edges = best_edges(found, buckets)
    n_rows = sum(c[1] for c in found)
    bucket = F.size(F.filter(literal_array(edges), lambda e: e < F.col("n_tokens")))
    chunk = hex_bits(F.col("hash"), chunk_bits(n_rows))
    dealt = in_chunks(rows.withColumn("bucket", bucket).withColumn("chunk", chunk).withColumn("one", F.lit(1)),
                      ["bucket"], "chunk", ["hash", "id", "n_tokens"], {"at": "one"})
    per_batch = literal_array([max(1, budget // max(1, e)) for e in edges])
    end, rows_in = F.get(literal_array(edges), F.col("bucket")), F.get(per_batch, F.col("bucket"))
    return dealt.select(
        F.col("id").alias(id_col), "n_tokens", "bucket", end.alias("bucket_len"), F.floor(F.col("at") / rows_in).cast("long").alias("batch"),
        (F.col("at") % rows_in).cast("long").alias("slot"), (end - F.col("n_tokens")).alias("padding"))
