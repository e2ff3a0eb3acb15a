"""Node files: blocks of ``property: value`` lines separated by blank lines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.text import add_namespace, strip_namespace
from ..operators.scale import with_position

BLOCK_LINES = 10_000


def blocks_to_triples(blocks: DataFrame, text: str = "value", block: str = "block") -> DataFrame:
    """``node, prop, value, ord, block`` of text blocks. The id is the ``Node`` line, else ``dcid``.

    Whole-line quotes added by spreadsheets are removed, doubled quotes repaired; ``#`` lines stay as comments.
    """
    lines = F.transform(F.split(F.col(text), "\n"), lambda x: F.trim(x))
    fixed = F.transform(lines, lambda l: F.when(l.rlike('^"[A-Za-z].*: .*"$'), F.replace(F.regexp_replace(l, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(l))
    used = F.filter(fixed, lambda l: l != "")
    pick = lambda name: F.regexp_extract(F.get(F.filter(F.col("_l"), lambda l: l.rlike(f"^{name} *:")), F.lit(0)), r"^[^:]*: *(.*)$", 1)
    rows = blocks.select(F.col(block).alias("block"), used.alias("_l")).filter(F.size("_l") > 0)
    named = rows.withColumn("node", strip_namespace(F.coalesce(F.nullif(pick("Node"), F.lit("")), F.nullif(pick("dcid"), F.lit("")))))
    out = named.select("block", "node", F.posexplode("_l").alias("ord", "line"))
    comment = F.col("line").startswith("#")
    return out.select("node", F.when(comment, F.lit("#")).otherwise(F.trim(F.regexp_extract("line", "^([^:]*):", 1))).alias("prop"),
                      F.when(comment, F.col("line")).otherwise(F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1))).alias("value"), "ord", "block").filter(
        (F.col("prop") != "") & ~F.col("prop").isin("Node"))


def text_blocks(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``block, value`` of text files whose blocks are parted by blank lines, blanks and any line ends allowed.

    Lines are read in parallel. A line's block is the number of blank lines before it: those of its
    own split, and those of the file's earlier splits from one row per split.
    """
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value")
    blank = (F.trim(F.translate("value", "\t\r\x0b\x0c", "    ")) == "").cast("long")
    per_split = lines.groupBy("file", "start").agg(F.sum(blank).alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_split.select("file", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    upto = Window.partitionBy("file", "start").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("blank", blank).withColumn("local", F.sum("blank").over(upto)).join(offsets, ["file", "start"])
    kept = numbered.filter("blank = 0").withColumn("no", F.col("base") + F.col("local"))
    grouped = kept.groupBy("file", "no").agg(F.array_sort(F.collect_list(F.struct("start", "at", "value"))).alias("l"), F.min("at").alias("block"))
    return grouped.select("block", F.array_join(F.transform("l", lambda x: x["value"]), "\n").alias("value"))


def read_nodes(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Read node files in parallel, one record per block."""
    return blocks_to_triples(text_blocks(spark, paths))


def read_csv_nodes(spark: SparkSession, paths: str | Sequence[str], id_column: str = "dcid") -> DataFrame:
    """Nodes given as CSV rows."""
    rows = spark.read.csv(paths if isinstance(paths, str) else list(paths), header=True)
    others = [c for c in rows.columns if c != id_column]
    pairs = F.array(*[F.struct(F.lit(c).alias("prop"), F.col(f"`{c}`").alias("value")) for c in others])
    return rows.select(strip_namespace(F.col(id_column)).alias("node"), F.posexplode(pairs).alias("ord", "p")).select(
        "node", "p.prop", "p.value", "ord").filter(F.coalesce("value", F.lit("")) != "")


def node_blocks(triples: DataFrame, defaults: Mapping[str, str] | None = None, comments: bool = True, sort: bool = True) -> DataFrame:
    """``node, part, text`` blocks. A node with more than BLOCK_LINES lines is written as several blocks
    of the same id, which readers merge again, so no node has to fit into one row."""
    rows = triples if comments else triples.filter(~F.col("prop").startswith("#"))
    if defaults:
        extra = F.array(*[F.struct(F.lit(p).alias("prop"), F.lit(v).alias("value")) for p, v in defaults.items()])
        wanted = rows.select("node").distinct().select("node", F.explode(extra).alias("d")).select("node", "d.prop", "d.value")
        rows = rows.select("node", "prop", "value", "ord").unionByName(
            wanted.join(rows.select("node", "prop").distinct(), ["node", "prop"], "left_anti").withColumn("ord", F.lit(-1)))
    line = F.when(F.col("prop").startswith("#") & F.col("value").startswith("#"), F.col("value")).otherwise(F.concat_ws(": ", "prop", "value"))
    order = F.struct("prop", "ord", line.alias("line")) if sort else F.struct("ord", F.col("prop"), line.alias("line"))
    large = rows.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / BLOCK_LINES).alias("_parts")).filter(F.col("_parts") > 1)
    spread = rows.join(large, "node", "left")
    part = F.coalesce(F.pmod(F.xxhash64("prop", "value"), F.col("_parts")), F.lit(0))
    grouped = spread.groupBy("node", part.alias("part")).agg(F.array_sort(F.collect_list(order)).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return grouped.select("node", "part", F.concat(F.lit("Node: "), add_namespace(F.col("node")), F.lit("\n"), body, F.lit("\n")).alias("text"))


def write_nodes(triples: DataFrame, path: str, header: str | None = None, defaults: Mapping[str, str] | None = None, comments: bool = True,
                sort: bool = True, nodes_per_file: int | None = None, bytes_per_file: int | None = None, mode: str = "errorifexists") -> None:
    """Write blocks as text files; a block is one record, so neither bound ever cuts a node's lines.

    The header is one record ahead of the first node. With ``bytes_per_file`` blocks go to folders
    ``shard=0``, ``shard=1``, … by the bytes before them, each a file of about that size.
    """
    blocks = node_blocks(triples, defaults, comments, sort).select("node", "part", "text")
    if header:
        first = triples.sparkSession.createDataFrame([("", -1, f"{header}\n")], "node string, part int, text string")
        blocks = first.unionByName(blocks.withColumn("part", F.col("part").cast("int")))
    if bytes_per_file:
        sized = with_position(blocks.withColumn("size", F.octet_length("text") + 1), ["node", "part"], "before", "size")
        sharded = sized.withColumn("shard", F.floor(F.col("before") / bytes_per_file).cast("long"))
        (sharded.repartition("shard").sortWithinPartitions("shard", "node", "part").select("shard", "text")
         .write.mode(mode).partitionBy("shard").option("lineSep", "\n").text(path))
        return
    if sort:
        blocks = blocks.repartitionByRange("node", "part").sortWithinPartitions("node", "part")
    writer = blocks.select("text").write.mode(mode)
    if nodes_per_file:
        writer = writer.option("maxRecordsPerFile", nodes_per_file)
    writer.option("lineSep", "\n").text(path)


def fill_template(records: DataFrame, template: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """Node text per record: ``{var}`` lines filled from columns.

    A line with a missing optional variable is left out, a missing required one raises.
    """
    import re

    lines = []
    for raw in template:
        text, present = F.lit(raw), F.lit(True)
        for var in re.findall(r"\{(\w+)\}", raw):
            value = F.col(var).cast("string") if var in records.columns else F.lit(None).cast("string")
            if var in required:
                value = F.when(F.coalesce(value, F.lit("")) == "", F.raise_error(F.lit(f"missing required {var}"))).otherwise(value)
            present = present & (F.coalesce(value, F.lit("")) != "")
            text = F.replace(text, F.lit("{%s}" % var), F.coalesce(value, F.lit("")))
        lines.append(F.when(present, text))
    return records.withColumn("text", F.concat_ws("\n", *lines))
