"""Finding the properties of a string: exact keys with fall-backs, phrases, substrings, positions."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.props import overlay_all, sort_by
from ..functions.text import delimiter_char, words
from ..session import materialise
from .scale import bounded, localised, spread

GLOBAL = "GLOBAL"
ANY = "*"  # namespace of the merged default maps, used for headers that are no namespace themselves
DIRECTIVES = ("#Regex", "#Format", "#Eval", "#Header", "#MergedCell", "#IgnoreRow", "#ignore", "#Multiply", "#Aggregate")
_GROUP = re.compile(r"\(\?P<(\w+)>")
_REFERENCE = re.compile(r"@([A-Za-z][A-Za-z0-9_]{2,})|\{@?([A-Za-z][A-Za-z0-9_]*)(?::[^}]*)?\}")


@dataclass(frozen=True)
class PvSchema:
    """What a PV map can emit, read once from the (small) map before the big scan."""

    namespaces: tuple[str, ...]
    props: tuple[str, ...]
    n_pairs: int
    max_words: int
    prefixed_keys: bool = False
    spaced_digits: bool = False
    references: dict[str, frozenset[str]] = field(default_factory=dict)
    rules: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def all_props(self) -> tuple[str, ...]:
        """Map properties plus those made by patterns, formats and expressions."""
        made = {g for r in self.rules.get("#Regex", ()) for g in _GROUP.findall(r)}
        for name in ("#Format", "#Eval"):
            made |= {r.split("=", 1)[0].strip() for r in self.rules.get(name, ()) if "=" in r}
        made |= {r.split(":=", 1)[0].strip() for n, rules in self.rules.items() if n.startswith("#Filter") for r in rules if ":=" in r}
        return tuple(sorted(set(self.props) | {p for p in made if p != "Data"}))


def references_in(text: str) -> set[str]:
    return {a or b for a, b in _REFERENCE.findall(text or "")}


def pv_schema(pv_map: DataFrame) -> PvSchema:
    """Collect the distinct properties, reference texts and rules of a PV map (never its keys)."""
    row = pv_map.agg(F.collect_set("namespace").alias("ns"), F.sum(F.size("props")).alias("pairs"),
                     F.max("n_words").alias("words"), F.max(F.col("key").contains(":")).alias("colon"),
                     F.max(F.col("key").rlike("(^|:)-?[0-9]+( [0-9]+)+$")).alias("digits")).first()
    pairs = pv_map.select(F.explode("props").alias("prop", "value"))
    props = [r["prop"] for r in pairs.select("prop").distinct().collect()]
    selects = F.col("prop").isin("measurementDenominator", "variableMeasured")
    spoken = pairs.filter(F.col("value").rlike(r"[@{]") | F.col("prop").startswith("#") | selects).distinct().collect()
    references: dict[str, set[str]] = {}
    rules: dict[str, set[str]] = {}
    for r in spoken:
        if r["prop"].startswith("#"):
            rules.setdefault(r["prop"], set()).add(r["value"])
            continue
        if r["prop"] in ("measurementDenominator", "variableMeasured"):
            rules.setdefault(r["prop"], set()).add(r["value"])
        if references_in(r["value"]):
            references.setdefault(r["prop"], set()).update(references_in(r["value"]))
    return PvSchema(tuple(sorted(row["ns"] or ())), tuple(sorted(props)), int(row["pairs"] or 0), int(row["words"] or 1),
                    bool(row["colon"]), bool(row["digits"]), {k: frozenset(v) for k, v in references.items()},
                    {k: tuple(sorted(v)) for k, v in rules.items()})


def with_default_namespace(pv_map: DataFrame, defaults: Sequence[str] = (GLOBAL,)) -> DataFrame:
    """Add namespace ``*``: the default maps merged per key, later maps win."""
    place = F.array_position(F.array(*[F.lit(d) for d in defaults]), F.col("namespace"))
    merged = (pv_map.filter(F.col("namespace").isin(*defaults)).groupBy("key")
              .agg(overlay_all(F.transform(sort_by(F.collect_list(F.struct(place.alias("o"), "props")), "o"), lambda s: s["props"])).alias("props")))
    return pv_map.select("namespace", "key", "props").unionByName(merged.select(F.lit(ANY).alias("namespace"), "key", "props"))


def effective_namespace(header: Column, namespaces: Sequence[str]) -> Column:
    return F.when(header.isin(*namespaces), header).otherwise(F.lit(ANY)) if namespaces else F.lit(ANY)


_PUNCTUATION = "[^A-Za-z0-9_%$-]+"


def key_variants(value: Column, ns: Column, header: Column) -> Column:
    """Ranked candidates: the text, ``header:text``, lower case, then the same without punctuation."""
    filtered = F.trim(F.regexp_replace(value, _PUNCTUATION, " "))
    label = F.coalesce(header, F.lit(GLOBAL))

    def chain(v: Column, base: int) -> list[Column]:
        return [F.struct(F.lit(base).alias("rank"), ns.alias("namespace"), v.alias("key")),
                F.struct(F.lit(base + 1).alias("rank"), F.lit(ANY).alias("namespace"), F.concat(label, F.lit(":"), v).alias("key")),
                F.struct(F.lit(base + 2).alias("rank"), ns.alias("namespace"), F.lower(v).alias("key"))]

    # a candidate equal to an earlier one can never rank first, so it is not emitted
    def needed(c: Column) -> Column:
        return ((c["key"] != "") & ~((c["rank"] == 2) & (c["key"] == value))
                & ~((c["rank"] >= 3) & (filtered == value)) & ~((c["rank"] == 5) & (c["key"] == filtered)))

    return F.filter(F.array(*chain(value, 0), *chain(filtered, 3)), needed)


def exact_lookup(strings: DataFrame, pv_map: DataFrame, schema: PvSchema, keys: Sequence[str], value: str = "value",
                 header: str | None = "header", defaults: Sequence[str] = (GLOBAL,), table: DataFrame | None = None) -> DataFrame:
    """Properties of each string by its best-ranked key variant; one row per string that hits.

    ``keys`` identify the strings; the map side is broadcast if measured small.
    """
    head = F.col(header) if header else F.lit(None).cast("string")
    table = bounded(with_default_namespace(pv_map, defaults)) if table is None else table
    spread = strings.select(*keys, F.explode(key_variants(F.col(value), effective_namespace(head, schema.namespaces), head)).alias("c")).select(
        *keys, F.col("c.rank").alias("rank"), F.col("c.namespace").alias("namespace"), F.col("c.key").alias("key"))
    hit = spread.join(table, ["namespace", "key"])
    return hit.groupBy(*keys).agg(F.min_by(F.struct("props", "key"), "rank").alias("b")).select(
        *keys, F.col("b.props").alias("props"), F.col("b.key").alias("matched"))


def phrase_lookup(strings: DataFrame, pv_map: DataFrame, schema: PvSchema, keys: Sequence[str], value: str = "value",
                  header: str | None = "header", delimiter: str = " ", max_words: int | None = None,
                  defaults: Sequence[str] = (GLOBAL,), table: DataFrame | None = None) -> DataFrame:
    """Longest word n-grams that are keys, leftmost on ties, then both sides; merged left to right.

    Only n-grams that hit the map are kept before the group-by, so a group holds at most the hits
    of one text. Run it on distinct strings.
    """
    width = max_words or schema.max_words
    joiner = delimiter_char(delimiter)
    ws = words(F.col(value), delimiter)
    split = strings.select(*keys, *( [header] if header and header not in keys else []), ws.alias("_w")).filter(F.size("_w") >= 2)
    top = F.least(F.lit(width), F.size("_w") - 1)
    grams = F.flatten(F.transform(F.sequence(F.lit(1), top), lambda n: F.transform(
        F.sequence(F.lit(0), F.size("_w") - n), lambda s: F.struct(
            s.alias("start"), n.alias("n"), F.array_join(F.slice(F.col("_w"), s + 1, n), joiner).alias("gram")))))
    exploded = split.select(*keys, *( [header] if header and header not in keys else []), F.explode(grams).alias("g")).select(
        *keys, *( [header] if header and header not in keys else []), "g.start", "g.n", "g.gram")
    hits = exact_lookup(exploded, pv_map, schema, [*keys, "start", "n"], "gram", header, defaults, table)
    candidates = sort_by(F.collect_list(F.struct((-F.col("n")).alias("size"), F.col("start"), F.col("n"), "props", "matched")), "size", "start")
    free = lambda acc, x: ~F.exists(acc, lambda a: (x["start"] < a["start"] + a["n"]) & (a["start"] < x["start"] + x["n"]))
    grouped = hits.groupBy(*keys).agg(candidates.alias("_c"))
    picked = grouped.withColumn("_p", F.aggregate(
        "_c", F.slice("_c", 1, 0), lambda acc, x: F.when(free(acc, x), F.array_append(acc, x)).otherwise(acc)))
    ordered = sort_by(F.col("_p"), "start")
    placed = picked.select(*keys, ordered.alias("_o"))
    return placed.select(*keys, overlay_all(F.transform("_o", lambda p: p["props"])).alias("props"),
                         F.transform("_o", lambda p: p["matched"]).alias("matched"))


def _contained_keys(text: DataFrame, table: DataFrame, keys: Sequence[str], word_boundary: bool, part_keys: int) -> DataFrame:
    """``keys, key``: the map keys that occur in each text (``_v``).

    Up to ``part_keys`` keys make one automaton, which runs once over each text, in Arrow batches, and tells every place where
    a key ends; a task's worker builds it once. More keys are met by ``_looked_up_keys``, which reads the texts once too, however many there are.
    """
    if table.count() > part_keys:
        return _looked_up_keys(text, table, keys, word_boundary)
    shipped = text.sparkSession.sparkContext.broadcast([r["key"] for r in table.select("key").toLocalIterator()])

    def scan(batches: Iterator[pa.RecordBatch], name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(name, shipped)
        for batch in batches:
            rows, found = [], []
            for i, v in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                hits = set()
                for end, key in automaton.iter(v):
                    first = end - len(key) + 1
                    if key in hits or word_boundary and (first and v[first - 1].isalpha() or v[end + 1:end + 2].isalpha()):
                        continue
                    hits.add(key)
                rows += [i] * len(hits)
                found += sorted(hits)
            if rows:
                picked = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*picked.columns[:-1], pa.array(found)], names=[*batch.schema.names[:-1], "key"])

    return text.select(*keys, "_v").mapInArrow(scan, StructType([*text.select(*keys).schema.fields, StructField("key", StringType())]))


def _looked_up_keys(text: DataFrame, table: DataFrame, keys: Sequence[str], word_boundary: bool) -> DataFrame:
    """As ``_contained_keys``, for maps of any size: one pass over the keys, one over the texts, then joins on the key.

    The first pass marks hashes of the keys and of their beginnings in a bit map of bounded size. The second sends the stretches of
    the texts that the marks may mean, each once a text; the joins keep those that are keys. So the bit map decides the work, never the result.
    """
    spark = text.sparkSession
    lengths, bits, marks = _marks(table)
    shipped = spark.sparkContext.broadcast(marks)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.frombuffer(shipped.value, dtype=np.uint8)
        for batch in batches:
            data, ends = _bytes_of(batch.column(batch.num_columns - 1))
            found = set()
            for row, first, last in _marked_stretches(data, ends, lengths, bits, marked):
                try:
                    key = data[first:last].tobytes().decode()
                except UnicodeDecodeError:  # cut inside a character
                    continue
                if word_boundary and (data[max(ends[row], first - 4):first].tobytes().decode(errors="ignore")[-1:].isalpha()
                                      or data[last:min(ends[row + 1], last + 4)].tobytes().decode(errors="ignore")[:1].isalpha()):
                    continue
                found.add((row, key))
            if found:
                rows, of = zip(*sorted(found), strict=True)
                picked = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*picked.columns[:-1], pa.array(of)], names=[*batch.schema.names[:-1], "key"])

    stretches = materialise(text.select(*keys, "_v").mapInArrow(scan, StructType([*text.select(*keys).schema.fields, StructField("key", StringType())])))
    sought = bounded(materialise(stretches.select("key").distinct()))
    real = bounded(materialise(table.select("key").join(sought, "key", "left_semi").distinct()))
    return stretches.join(real, "key", "left_semi")


START = 4  # bytes of a key's beginning that every place of a text is asked for, in a small bit map of its own
START_BITS, LEAST_BITS, MOST_BITS = 24, 20, 29
BEGINNINGS = (8, 16, 32, 64)  # bytes of further beginnings
STRETCH = 1 << 20  # bytes of text hashed at a time
PIECE = 1 << 16  # bytes of the bit map that travel in a row
_BASE = 0x9E3779B97F4A7C15
_OF_BYTE = np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = []


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings, none of them null, and where they begin and end."""
    plain = column.cast(pa.large_binary())
    ends = np.frombuffer(plain.buffers()[1], dtype=np.int64)[plain.offset:plain.offset + len(plain) + 1]
    return np.frombuffer(plain.buffers()[2] or b"", dtype=np.uint8), ends


def _powers(n: int) -> list[np.ndarray]:
    """At least ``n`` powers of the base and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.cumprod(np.append(np.uint64(1), np.full(2 * n, b, dtype=np.uint64)), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS


class _Hashes:
    """Hashes of all stretches of some bytes, each in constant time: differences of one running sum."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _powers(len(data) + 1)
        self.sums = np.append(np.uint64(0), np.cumsum(_OF_BYTE[data] * power[:len(data)], dtype=np.uint64))

    def of(self, first: np.ndarray, length: np.ndarray | int, whole: bool) -> np.ndarray:
        h = (self.sums[first + length] - self.sums[first]) * self.inverse[first]
        h ^= np.asarray(2 * length + whole).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def _places(hashes: np.ndarray, bits: int, turn: int) -> np.ndarray:
    """Bits of the map that hashes mark; those of ``START`` (turn 0) lie before all others."""
    mixed = hashes * np.uint64((0x94D049BB133111EB, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)[turn])
    return (mixed >> np.uint64(64 - (bits if turn else START_BITS))).astype(np.int64) + ((1 << START_BITS) if turn else 0)


def _is_marked(marked: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (marked[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)


def _marks(table: DataFrame) -> tuple[list[int], int, bytes]:
    """The lengths of the keys in bytes, the size of the bit map as a power of 2 and the bit map."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * table.count()).bit_length()))
    size = ((1 << START_BITS) + (1 << bits)) // 8

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, lengths = np.zeros(size, dtype=np.uint8), set()
        for batch in batches:
            data, ends = _bytes_of(batch.column(0))
            if len(ends) < 2:
                continue
            hashes, first, length = _Hashes(data[ends[0]:ends[-1]]), ends[:-1] - ends[0], np.diff(ends)
            lengths.update(np.unique(length).tolist())
            whole = hashes.of(first, length, True)
            places = [_places(whole, bits, 1), _places(whole, bits, 2)]
            for n in (START, *BEGINNINGS):
                places.append(_places(hashes.of(first[length >= n], n, False), bits, int(n > START)))
            at = np.concatenate(places)
            np.bitwise_or.at(marked, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        if lengths:
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([np.array(sorted(lengths), dtype="<i8").tobytes()], pa.binary())], names=["piece", "bytes"])
        for at in range(0, size if lengths else 0, PIECE):
            if (part := marked[at:at + PIECE]).any():
                yield pa.RecordBatch.from_arrays([pa.array([at // PIECE], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["piece", "bytes"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[int, np.ndarray] = {}
        lengths: set[int] = set()
        for batch in batches:
            for piece, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if piece < 0:
                    lengths.update(np.frombuffer(part, dtype="<i8").tolist())
                else:
                    of = np.frombuffer(zlib.decompress(part), dtype=np.uint8)
                    merged[piece] = merged[piece] | of if piece in merged else of
        for piece, of in merged.items():
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([zlib.compress(of.tobytes(), 1)], pa.binary())], names=["piece", "bytes"])
        if lengths:
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([np.array(sorted(lengths), dtype="<i8").tobytes()], pa.binary())], names=["piece", "bytes"])

    found = table.select("key").mapInArrow(mark, "piece int, bytes binary").repartition("piece").mapInArrow(merge, "piece int, bytes binary").toArrow()
    lengths, marked = [], bytearray(size)
    for piece, part in zip(found.column(0).to_pylist(), found.column(1), strict=True):
        if piece < 0:
            lengths = np.frombuffer(part.as_py(), dtype="<i8").tolist()
        else:
            of = zlib.decompress(part.as_py())
            marked[piece * PIECE:piece * PIECE + len(of)] = of
    return lengths, bits, bytes(marked)


def _marked_stretches(data: np.ndarray, ends: np.ndarray, lengths: Sequence[int], bits: int, marked: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Row, first byte and end of all stretches of rows (from ``ends`` to the next) that are as long as some key and marked.

    Places are narrowed down by ever longer beginnings of keys before whole lengths are tried.
    """
    for begin in range(int(ends[0]), int(ends[-1]), STRETCH):
        end = min(begin + STRETCH, int(ends[-1]))
        hashes = _Hashes(data[begin:min(end + max(lengths), int(ends[-1]))])
        rows = np.searchsorted(ends, np.arange(begin, end), side="right") - 1
        room = ends[rows + 1] - np.arange(begin, end)  # bytes up to the row's end
        at, least = np.arange(end - begin), {}
        for n in (n for n in (1, START, *BEGINNINGS) if n <= max(lengths)):
            if n > 1:
                at = at[room[at] >= n]
                at = at[_is_marked(marked, _places(hashes.of(at, n, False), bits, int(n > START)))]
            least[n] = at
        for length in lengths:
            at = least[max(n for n in least if n <= length)]
            at = at[room[at] >= length]
            whole = hashes.of(at, length, True)
            at = at[_is_marked(marked, _places(whole, bits, 1)) & _is_marked(marked, _places(whole, bits, 2))]
            yield from zip(rows[at].tolist(), (at + begin).tolist(), (at + begin + length).tolist(), strict=True)


_AUTOMATA: dict[str, ahocorasick.Automaton] = {}


def _automaton(name: str, shipped: Broadcast) -> ahocorasick.Automaton:
    """The automaton of the shipped keys; a worker keeps the last one that it built."""
    if name not in _AUTOMATA:
        built = ahocorasick.Automaton()
        for key in shipped.value:
            built.add_word(key, key)
        built.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[name] = built
    return _AUTOMATA[name]


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    other = right.select(*[F.col(k).alias(f"_j{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_j{i}"))
    return left.join(other, cond).drop(*[f"_j{i}" for i in range(len(keys))])


def substring_lookup(strings: DataFrame, pv_map: DataFrame, keys: Sequence[str], value: str = "value",
                     word_boundary: bool = True, part_keys: int = 100_000) -> DataFrame:
    """Keys contained in the text, longest first, each one blanking the text it used.

    The map is stored once. A large one is not grouped as a whole, only its keys that some text holds.
    """
    pv_map = materialise(pv_map.filter("key <> ''").select("key", "props", "ord"))
    text = strings.select(*keys, F.col(value).alias("_v")).filter(F.length("_v") > 0)
    merged = lambda rows: localised(rows.groupBy("key").agg(F.min_by("props", F.col("ord")).alias("props"), F.min("ord").alias("ord")))
    if pv_map.count() > part_keys:
        pieces = materialise(_contained_keys(spread(text, *keys), pv_map, keys, word_boundary, part_keys))
        held = bounded(materialise(pieces.select("key").distinct()))
        table = merged(materialise(pv_map.join(held, "key", "left_semi")))
    else:
        table, text = merged(pv_map), spread(text, *keys)
        pieces = _contained_keys(text, table, keys, word_boundary, part_keys)
    listed = pieces.join(table, "key").groupBy(*keys).agg(
        sort_by(F.collect_list(F.struct((-F.length("key")).alias("size"), "ord", "key", "props")), "size", "ord").alias("_c"))
    found = _null_safe_join(listed, text, keys)
    start = F.struct(F.col("_v").alias("rest"), F.slice("_c", 1, 0).alias("picked"))
    folded = found.withColumn("_f", F.aggregate("_c", start, lambda acc, x: F.when(
        acc["rest"].contains(x["key"]),
        F.struct(F.replace(acc["rest"], x["key"], F.lit(" ")).alias("rest"), F.array_append(acc["picked"], x).alias("picked"))).otherwise(acc)))
    return folded.select(*keys, overlay_all(F.transform("_f.picked", lambda p: p["props"])).alias("props"),
                         F.transform("_f.picked", lambda p: p["key"]).alias("matched"))


def find_properties(strings: DataFrame, pv_map: DataFrame, schema: PvSchema, keys: Sequence[str] = ("header", "value"),
                    delimiter: str = " ", word_boundary: bool = True, table: DataFrame | None = None,
                    substrings: bool = False) -> DataFrame:
    """Exact key, else phrases (with ``substrings``, keys anywhere in the text), one row per string that hits."""
    table = bounded(with_default_namespace(pv_map)) if table is None else table
    exact = materialise(exact_lookup(strings, pv_map, schema, keys, table=table).select(*keys, "props", F.array("matched").alias("matched")))
    if not delimiter:
        return exact
    n_words = F.size(words(F.col("value"), delimiter))
    many = strings.filter(n_words >= 2)
    cond = F.lit(True)
    for k in keys:
        cond = cond & many[k].eqNullSafe(exact[k])
    rest = many.join(exact, cond, "left_anti")
    if not substrings:
        return exact.unionByName(phrase_lookup(rest, pv_map, schema, keys, delimiter=delimiter, table=table))
    return exact.unionByName(substring_lookup(rest, pv_map, keys, word_boundary=word_boundary))


def positional_keys(row: Column, col: Column) -> Column:
    """``Cell:r:c``, ``Column:c``, ``Row:r`` as ranked keys for cells whose text is unknown."""
    return F.array(
        F.struct(F.lit(0).alias("rank"), F.concat_ws(":", F.lit("Cell"), row.cast("string"), col.cast("string")).alias("key")),
        F.struct(F.lit(1).alias("rank"), F.concat_ws(":", F.lit("Column"), col.cast("string")).alias("key")),
        F.struct(F.lit(2).alias("rank"), F.concat_ws(":", F.lit("Row"), row.cast("string")).alias("key")))


def remap(df: DataFrame, column: str, table: DataFrame, old: str, new: str) -> DataFrame:
    """Replace ids listed in a (old, new) table; others stay."""
    small = bounded(table.select(F.col(old).alias("_old"), F.col(new).alias("_new")).dropDuplicates(["_old"]))
    return df.join(small, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")
