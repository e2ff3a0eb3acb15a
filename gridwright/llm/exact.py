"""Exact deduplication as a stateful stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialise
from .common import BLANKS, BROADCAST_IDS, fresh_dir, located, text_of

STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # many small stores: no space on disk reserved ahead
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # a store is closed with its task, else each keeps its native buffers on the executor after the stream has ended
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def normalised(text_col: str) -> Column:
    """The text with every run of blanks as one space; null as empty."""
    return F.regexp_replace(text_of(text_col), BLANKS, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def keep_state(stream: DataFrame, checkpoint: str) -> DataFrame:
    """Run the stream of (digest, id, __file, __row) over all its input and return the state.

    The state holds, for each digest and without expiry, the smallest identifier, the locator of its
    content and the number of rows. It lies in RocksDB on the executors' disks and, after every
    micro-batch, in ``checkpoint``: a lost executor's part is loaded from there, and a later run
    with the same checkpoint goes on where this one ended. Null identifiers come after all others.
    """
    spark = stream.sparkSession
    state = stream.groupBy("digest").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "__file", "__row")).alias("keeper"), F.count(F.lit(1)).alias("n"))
    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    for k, v in STATE_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        run = (state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
               .trigger(availableNow=True).start())
        run.awaitTermination()
        table = spark.read.format("statestore").load(checkpoint)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    names = table.schema["value"].dataType.names  # the aggregates, in the order above
    return table.select(F.col("key").getField(table.schema["key"].dataType.names[0]).alias("digest"),
                        F.col("value").getField(names[0]).alias("keeper"), F.col("value").getField(names[1]).alias("n"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256,
                files_per_batch: int = 1000) -> DataFrame:
    """Mark, for every row, the row that stays of all rows with the same text.

    Texts are equal when equal after replacing each run of blanks by one space; null is empty. Each
    row's digest, identifier and locator (file and row number) go through the stateful stream. Of
    groups with more than one row, the full texts are compared as well, by their least and greatest
    per digest: Spark combines these per task first, so a hot text isn't gathered anywhere. Digests
    shared by different texts, should there be any, are then grouped by the texts themselves.

    Returns one row per input row: the id, ``keep_id``, ``group_size``, ``kept`` and ``digest``, with
    the locator ``__file``, ``__row``. The smallest id stays; of repeated rows with one id, the first
    by locator; null ids come last. Empty table: no rows. Other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    here = located(docs).select(F.col(id_col).alias("id"), normalised(text_col).alias("text"), "__file", "__row")
    here = here.withColumn("digest", digest(F.col("text")))
    feed = fresh_dir(spark, "dedup-feed")
    here.select("digest", "id", "__file", "__row").write.parquet(feed)
    rows = spark.read.parquet(feed)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_per_batch).parquet(feed)
    state = materialise(keep_state(stream, fresh_dir(spark, "dedup-state")))  # read thrice, opened once

    hits = state.filter("n > 1").select("digest")
    side = F.broadcast(hits) if hits.count() <= BROADCAST_IDS // 4 else hits  # a digest takes 64 bytes
    mixed = (here.join(side, "digest").groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("greatest"))
             .filter("least <> greatest").select("digest"))
    clashes = [r["digest"] for r in mixed.limit(2).collect()]
    result = rows.join(state, "digest")
    if clashes:  # different texts share a digest: decide those by the texts
        whole = here.join(mixed, "digest").groupBy("digest", "text").agg(
            F.min(F.struct(F.col("id").isNull().alias("none"), "id", "__file", "__row")).alias("keeper"), F.count(F.lit(1)).alias("n"))
        by_text = here.join(mixed, "digest").join(whole, ["digest", "text"]).select("digest", "id", "__file", "__row", "keeper", "n")
        result = result.join(mixed, "digest", "left_anti").unionByName(by_text)
    kept = (F.col("keeper.__file") == F.col("__file")) & (F.col("keeper.__row") == F.col("__row"))
    return result.select(F.col("id").alias(id_col), F.col("keeper.id").alias("keep_id"), F.col("n").alias("group_size"),
                         kept.alias("kept"), "digest", "__file", "__row")
