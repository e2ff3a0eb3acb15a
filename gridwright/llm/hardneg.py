"""Hard negatives for anchors: an STR-packed R-tree searched best-first by inner product."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise
from .common import bounded_batches, literal_array, located

LEAF, FANOUT = 256, 16  # rows of a leaf, children of an inner node
PART, MOST_PARTS = 4096, 4096  # least rows of a part of the table and most parts; each part has its own tree
MEASURED = 64  # leading coordinates among which the two that deal rows to parts are chosen
BATCH = 8 << 20
EXACT = 1 << 53

WINDOWS = "array<struct<lo:double,hi:double>>"


def tiles(points: np.ndarray, capacity: int = LEAF) -> np.ndarray:
    """Sort-tile-recursive order of the rows: every ``capacity`` rows of it are one leaf.

    Rows are sorted by one coordinate and cut into slabs of equal size, each slab by the next coordinate, and so on.
    Of many coordinates the widest are used, as many as halving needs.
    """
    leaves = -(-len(points) // capacity)
    dims = min(points.shape[1], max(1, math.ceil(math.log2(max(leaves, 1)))))
    spread = np.argsort(-points.astype(np.float64).var(axis=0), kind="stable")[:dims]

    def tile(index: np.ndarray, level: int) -> list[np.ndarray]:
        parts = -(-len(index) // capacity)
        if parts <= 1 or level == len(spread):
            return [index]
        slabs = math.ceil(parts ** (1 / (len(spread) - level)))
        size = capacity * -(-parts // slabs)
        index = index[np.argsort(points[index, spread[level]], kind="stable")]
        return [t for at in range(0, len(index), size) for t in tile(index[at:at + size], level + 1)]

    return np.concatenate(tile(np.arange(len(points)), 0)) if len(points) else np.zeros(0, np.int64)


class Tree:
    """An R-tree packed bottom-up over tiled rows; ``lo`` and ``hi`` hold each level's bounding boxes, leaves first."""

    def __init__(self, uid: np.ndarray, ids: list[int | None], labels: np.ndarray, points: np.ndarray) -> None:
        order = tiles(points)
        self.uid, self.labels, self.points = uid[order], labels[order], points[order]
        self.ids = [ids[i] for i in order.tolist()]
        self.rank = np.array([(1 << 63) - 1 if i is None else i for i in self.ids], np.int64)  # null ids come last
        cut = np.arange(0, len(order), LEAF)
        self.lo, self.hi = [np.minimum.reduceat(self.points, cut)], [np.maximum.reduceat(self.points, cut)]
        self.least, self.most = [np.minimum.reduceat(self.labels, cut)], [np.maximum.reduceat(self.labels, cut)]
        while len(self.lo[-1]) > 1:
            cut = np.arange(0, len(self.lo[-1]), FANOUT)
            for levels, of in ((self.lo, np.minimum), (self.hi, np.maximum), (self.least, np.minimum), (self.most, np.maximum)):
                levels.append(of.reduceat(levels[-1], cut))

    def _open(self, level: int, a: int, b: int, v: tuple, label: int, same: bool, low: np.ndarray, high: np.ndarray) -> Iterator[tuple]:
        """Queue entries of the nodes ``a`` to ``b`` that may hold rows of a window.

        A box bounds each coordinate's product, and their sums the inner products of all rows in it.
        """
        up, down = v
        most = self.hi[level][a:b] @ up + self.lo[level][a:b] @ down
        least = self.lo[level][a:b] @ up + self.hi[level][a:b] @ down
        meets = (most[:, None] >= low) & (least[:, None] <= high)
        if same:
            meets &= ((self.least[level][a:b] <= label) & (label <= self.most[level][a:b]))[:, None]
        else:
            meets &= ~((self.least[level][a:b] == label) & (self.most[level][a:b] == label))[:, None]
        for i in np.flatnonzero(meets.any(axis=1)).tolist():
            yield -min(most[i], high[meets[i]].max()), level, a + i, most[i], least[i]

    def search(self, uid: int, label: int, v: np.ndarray, low: Sequence[float], high: Sequence[float], same: bool, k: int) -> list[list[tuple]]:
        """Per window of scores the first ``k`` rows of the same or of other labels: (-score, rank, uid, id), sorted.

        Nodes wait in a queue by their best score in any window. A window's lower end rises to its kth score
        once there are k rows; boxes strictly below it, or beside all windows, are left out.
        """
        low, high = np.array(low, self.points.dtype), np.array(high, self.points.dtype)
        found: list[list[tuple]] = [[] for _ in low]
        signs = np.maximum(v, 0), np.minimum(v, 0)
        top = len(self.lo) - 1
        queue = list(self._open(top, 0, len(self.lo[top]), signs, label, same, low, high))
        heapq.heapify(queue)
        while queue:
            _, level, node, most, least = heapq.heappop(queue)
            if not ((most >= low) & (least <= high)).any():
                continue
            if level:
                a = node * FANOUT
                for entry in self._open(level - 1, a, min(a + FANOUT, len(self.lo[level - 1])), signs, label, same, low, high):
                    heapq.heappush(queue, entry)
                continue
            a, b = node * LEAF, min((node + 1) * LEAF, len(self.points))
            scores = self.points[a:b] @ v
            fit = ((self.labels[a:b] == label) == same) & (self.uid[a:b] != uid)
            for w in range(len(found)):
                at = np.flatnonzero(fit & (scores >= low[w]) & (scores <= high[w]))
                if not len(at):
                    continue
                at = at[np.lexsort((self.uid[a:b][at], self.rank[a:b][at], -scores[at]))[:k]]
                found[w] = sorted(found[w] + [(-int(scores[i]), int(self.rank[a + i]), int(self.uid[a + i]), self.ids[a + i]) for i in at.tolist()], key=lambda r: r[:3])[:k]
                if len(found[w]) == k:
                    low[w] = max(low[w], -found[w][-1][0])
        return found


def _matrix(column: pa.Array, dims: int, exact: bool) -> np.ndarray:
    """Rows of a list column; whole numbers that products may carry beyond a double's are Python's own."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)
    return flat if exact else np.array([[int(x) for x in row] for row in flat.tolist()], object).reshape(len(column), dims)


def _visit(laid: DataFrame, requests: DataFrame, parts: int, dims: int, exact: bool, same: bool, k: int) -> DataFrame:
    """Search the tree of ``part`` for each request routed there; stored rows (``uid``, ``w``, ``score``, ``id``, ``hit``).

    A part's rows come first and are packed, then its requests stream by, however many. One part is held at a time.
    """
    rows = laid.select("part", F.lit(0).alias("kind"), "uid", "id", "label", "v", F.lit(None).cast(WINDOWS).alias("windows"))
    asked = requests.select("part", F.lit(1).alias("kind"), "uid", "id", "label", "v", "windows")
    stream = rows.unionByName(asked).repartition(parts, "part").sortWithinPartitions("part", "kind")
    schema = pa.schema([("uid", pa.int64()), ("w", pa.int32()), ("score", pa.int64()), ("id", pa.int64()), ("hit", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces, tree = None, [], None
        for batch in batches:
            part, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])])).tolist() + [len(part)]
            hits = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                piece = batch.slice(a, b - a)
                if part[a] != now:
                    now, pieces, tree = part[a], [], None
                points = _matrix(piece.column(5), dims, exact)
                labels, uid = piece.column(4).to_numpy(), piece.column(2).to_numpy()
                if kind[a] == 0:
                    pieces.append((uid, piece.column(3).to_pylist(), labels, points))
                    continue
                if tree is None:
                    if not pieces:
                        continue
                    u, i, l, p = zip(*pieces, strict=True)
                    tree, pieces = Tree(np.concatenate(u), [x for y in i for x in y], np.concatenate(l), np.concatenate(p)), []
                for row, windows in enumerate(piece.column(6).to_pylist()):
                    low, high = [x["lo"] for x in windows], [x["hi"] for x in windows]
                    for w, found in enumerate(tree.search(int(uid[row]), int(labels[row]), points[row], low, high, same, k)):
                        hits += [(int(uid[row]), w, -r[0], r[3], r[2]) for r in found]
            if hits:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*hits, strict=True), schema.types, strict=True)], schema=schema)

    with bounded_batches(laid.sparkSession, BATCH):
        return materialise(stream.mapInArrow(scan, "uid long, w int, score long, id long, hit long"))


def _route(requests: DataFrame, boxes: list, dims: int) -> DataFrame:
    """Each request once for every part but its own whose box may hold rows of a window.

    ``boxes`` has one row a part, ``MOST_PARTS`` at most.
    """
    numbers = np.array([b["part"] for b in boxes], np.int64)
    lo, hi = np.array([b["lo"] for b in boxes]).reshape(-1, dims), np.array([b["hi"] for b in boxes]).reshape(-1, dims)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(4), dims, True)
            up, down = np.maximum(vectors, 0), np.minimum(vectors, 0)
            slack = 1e-9 * (np.abs(vectors) @ np.maximum(np.abs(lo), np.abs(hi)).T)  # rounding of products beyond a double's whole numbers
            most, least = up @ hi.T + down @ lo.T + slack, up @ lo.T + down @ hi.T - slack
            rows, parts = [], []
            for i, (home, windows) in enumerate(zip(batch.column(0).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                meets = np.zeros(len(numbers), bool)
                for x in windows:
                    meets |= (most[i] >= x["lo"]) & (least[i] <= x["hi"])
                to = numbers[meets & (numbers != home)]
                rows += [i] * len(to)
                parts.append(to)
            if rows:
                picked = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts)), *picked.columns[1:]], names=batch.schema.names)

    asked = requests.select("part", "uid", "id", "label", "v", "windows")
    return asked.mapInArrow(scan, f"part long, uid long, id long, label long, v array<double>, windows {WINDOWS}")


def search(laid: DataFrame, requests: DataFrame, boxes: list, parts: int, dims: int, exact: bool, same: bool, k: int) -> DataFrame:
    """The first ``k`` rows of each request's windows over all parts, with their ``rank``; stored.

    A request visits its own part's tree first. The kth scores found there raise its windows' lower ends, and
    then it visits all other parts whose boxes still meet a window.
    """
    home = _visit(laid, requests, parts, dims, exact, same, k)
    kth = home.groupBy("uid", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).filter(F.col("n") == k)
    raised = kth.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("w", F.col("kth").cast("double")))).alias("kth"))
    up = F.transform("windows", lambda x, i: F.struct(F.greatest(x["lo"], F.element_at("kth", i)).alias("lo"), x["hi"].alias("hi")))
    onward = materialise(requests.join(raised, "uid", "left").withColumn("windows", F.when(F.col("kth").isNull(), F.col("windows")).otherwise(up)).drop("kth"))
    rest = _visit(laid, _route(onward, boxes, dims), parts, dims, exact, same, k)
    first = Window.partitionBy("uid", "w").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "hit")
    return materialise(home.unionByName(rest).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k))


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0,
                   id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """For each anchor and positive the best rows of other labels whose score lies between ``low`` and ``high`` percent of the positive's.

    A score is the inner product with the anchor of components floor(``scale`` x); higher ones come first, ties by smaller
    id (null last). An anchor's positives are its first other rows of the same label. Searches are exact.

    The table is range-partitioned by its two widest coordinates into parts; each part's R-tree is packed by
    sort-tile-recursive order. A search visits nodes best-first and leaves out boxes that can't reach a window or the kth
    row. Parts and their boxes are ``MOST_PARTS`` at most; all else is rows. Anchors stream past the trees.

    Returns ``anchor_id``, ``positive_id``, ``positive_rank``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``. Rows with a
    null label, vector or component, or one that isn't finite, take no part. A shorter vector ends in zeros. Rows of equal
    id or vector are different rows; an anchor is only itself left out. No row in a window, or an empty table: no rows. Scores must fit a long; windows beyond 2**53 are rounded to doubles.
    Other columns are not read unless ``anchors`` names them.
    """
    whole = F.transform(F.col(vector_col), lambda x: F.when(F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")), F.lit(None)).otherwise(F.floor(F.lit(scale) * x.cast("double")).cast("double")))
    rows = located(vectors).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole.alias("v"),
                                   F.coalesce(anchors, F.lit(False)).alias("anchor"), "__file", "__row")
    rows = rows.filter(F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    at = lambda i: F.coalesce(F.get("v", F.lit(i)), F.lit(0.0))
    top = F.aggregate("v", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims"), F.max(top).alias("top"), *[F.var_pop(at(i)).alias(f"v{i}") for i in range(MEASURED)]).first()
    n, dims = seen["n"], max(1, seen["dims"] or 0)
    exact = dims * (seen["top"] or 0.0) ** 2 < EXACT
    parts = max(1, min(MOST_PARTS, -(-n // PART)))
    widest = sorted(range(min(dims, MEASURED)), key=lambda i: -(seen[f"v{i}"] or 0.0))
    one, two = widest[0], widest[min(1, len(widest) - 1)]
    slabs = math.ceil(math.sqrt(parts))
    cuts = [] if slabs == 1 else rows.agg(F.percentile_approx(at(one), [i / slabs for i in range(1, slabs)])).first()[0]
    slab = F.size(F.filter(literal_array([float(c) for c in cuts], "double"), lambda c: c <= at(one)))
    padded = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dims) - F.size("v")))
    dealt = rows.withColumn("__slab", slab).withColumn("__two", at(two)).repartitionByRange(parts, "__slab", "__two", "__file", "__row")
    laid = materialise(dealt.select(F.spark_partition_id().cast("long").alias("part"), F.monotonically_increasing_id().alias("uid"), "id", "label", padded.alias("v"), "anchor"))
    boxes = _boxes(laid, dims)

    own = laid.filter("anchor").select("part", "uid", "id", "label", "v")
    anywhere = F.array(F.struct(F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi")))
    found = search(laid, own.withColumn("windows", anywhere), boxes, parts, dims, exact, True, positives)
    # shares of a score in whole numbers, from its hundreds and the rest, so that nothing overflows
    hundreds, rest = "(score - pmod(score, 100L)) div 100L", "pmod(score, 100L)"
    window = F.struct(F.expr(f"{low}L * ({hundreds}) + ({low}L * {rest} + 99L) div 100L").cast("double").alias("lo"),
                      F.expr(f"{high}L * ({hundreds}) + ({high}L * {rest}) div 100L").cast("double").alias("hi"))
    # windows in the order of the positives' ranks
    windows = found.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", window.alias("x")))), lambda r: r["x"]).alias("windows"))
    mined = search(laid, own.join(windows, "uid"), boxes, parts, dims, exact, False, negatives)
    pairs = found.select("uid", F.col("rank").alias("positive_rank"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    hits = mined.select("uid", (F.col("w") + 1).alias("positive_rank"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return (hits.join(pairs, ["uid", "positive_rank"]).join(own.select("uid", F.col("id").alias("anchor_id")), "uid")
            .select("anchor_id", "positive_id", "positive_rank", "rank", "negative_id", "positive_score", "negative_score"))


def _boxes(laid: DataFrame, dims: int) -> list:
    """The bounding box of each part: (``part``, ``lo``, ``hi``)."""
    schema = pa.schema([("part", pa.int64()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, points = batch.column(0).to_numpy(), _matrix(batch.column(1), dims, True)
            own = [(p, points[part == p]) for p in np.unique(part).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*[(p, x.min(axis=0).tolist(), x.max(axis=0).tolist()) for p, x in own], strict=True), schema.types, strict=True)], schema=schema)

    with bounded_batches(laid.sparkSession, BATCH):
        several = materialise(laid.select("part", "v").mapInArrow(scan, "part long, lo array<double>, hi array<double>"))
    each = several.select("part", F.posexplode(F.arrays_zip("lo", "hi")).alias("i", "x")).groupBy("part", "i").agg(F.min("x.lo").alias("lo"), F.max("x.hi").alias("hi"))
    ordered = each.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("i", "lo", "hi"))).alias("b"))
    return ordered.select("part", F.transform("b", lambda b: b["lo"]).alias("lo"), F.transform("b", lambda b: b["hi"]).alias("hi")).collect()
