"""Grid to observations: the whole path from text cells to long observations and variables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import ids
from ..functions.dates import period_of, resolve_date
from ..functions.numbers import parse_number
from ..functions.props import overlay_all, valid_column, valid_value
from ..functions.text import add_namespace, strip_namespace
from ..operators import grid as g, observe, resolve
from ..operators.lookup import PvSchema, find_properties, pv_schema, with_default_namespace, ANY, effective_namespace
from ..operators.nodes import reuse_existing
from ..operators.places import resolve_places
from ..operators.resolve import prop
from ..operators.scale import bounded, localised, settle
from ..session import materialise
from ..sources.pvmaps import config_rows

ROW_KEYS = ("file", "row_no", "col_no")


@dataclass(frozen=True)
class GridOptions:
    """Options of one import."""

    header_rows: int = 0
    header_columns: int = 0
    mapped_rows: int | Sequence[int] = 0
    mapped_columns: int | Sequence[int] = 0
    skip_rows: int = 0
    process_rows: Sequence[int] = ()
    ignore_rows: Sequence[int] = ()
    min_columns: int = 2
    max_rows: int | None = None
    max_columns: int | None = None
    word_delimiter: str = " "
    substrings: bool = False
    word_boundary: bool = True
    merged_cells: int | None = None
    decimal: str = "."
    separators: str = ", "
    all_numbers_are_values: bool = False
    multi_value: Sequence[str] = ()
    date_format: str | None = None
    output_date_format: str | None = None
    output_columns: Sequence[str] = ()
    variable_defaults: Mapping[str, str] = field(default_factory=lambda: dict(observe.VARIABLE_DEFAULTS))
    id_ignore: Sequence[str] = ("description", "name", "nameWithLanguage", "descriptionUrl", "alternateName")
    boolean_props: Sequence[str] = ()
    affixes: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    carry_bucket: int = 2_000
    resolve_duplicates: bool = True
    unused_variables: bool = False
    default_pv_key: str = "DEFAULT_PV"
    hook: Callable[[DataFrame], DataFrame] | None = None


@dataclass(frozen=True)
class Result:
    """``dropped``: observations that lack a required column. ``rejects``: every lost cell or observation with its
    ``stage`` and ``reason``. ``conflicts``: keys that had different values."""

    observations: DataFrame
    variables: DataFrame
    dropped: DataFrame
    rejects: DataFrame
    conflicts: DataFrame | None = None

    def counters(self) -> DataFrame:
        return observe.count_reasons(self.rejects)


def with_config_rows(options: GridOptions, pv_map: DataFrame) -> GridOptions:
    """Options overridden by the map's own ``config:`` rows (a few rows of text)."""
    kinds = {f.name: f for f in fields(GridOptions)}
    changed = {}
    for r in config_rows(pv_map).collect():
        if r["option"] not in kinds:
            continue
        was = getattr(options, r["option"])
        text = r["value"].strip()
        if isinstance(was, bool):
            changed[r["option"]] = text.lower() in ("true", "yes", "1")
        elif isinstance(was, int) or "int" in str(kinds[r["option"]].type):
            changed[r["option"]] = int(text)
        elif isinstance(was, str) or "str |" in str(kinds[r["option"]].type):
            changed[r["option"]] = text
        elif "Sequence[str]" in str(kinds[r["option"]].type):
            changed[r["option"]] = tuple(x.strip() for x in text.split(",") if x.strip())
    return replace(options, **changed)


def file_level_properties(names: DataFrame, hits: DataFrame, table: DataFrame, options: GridOptions) -> DataFrame:
    """``file, file_props``: what the map says about the file's name, over its default entry.

    ``hits`` are the searched texts (:func:`searched`), the names of ``names`` among them.
    """
    default = table.filter((F.col("namespace") == ANY) & (F.col("key") == options.default_pv_key)).select(F.lit(1).alias("_one"), F.col("props").alias("_default"))
    own = hits.filter(F.col("_h") == "").select("value", "_p3")
    joined = names.select("file", "value").join(own, "value", "left").withColumn("_one", F.lit(1)).join(F.broadcast(default), "_one", "left")  # one row at most
    return joined.select("file", overlay_all(F.array_compact(F.array("_default", "_p3"))).alias("file_props")).filter(F.size("file_props") > 0)


def ignored_reason(wide: DataFrame) -> Column:
    """Why a cell is left out by its ``#IgnoreRow`` or ``#ignore``; null for the others."""
    reason = F.lit(None).cast("string")
    if "#ignore" in wide.columns:
        reason = F.when(prop("#ignore").isNotNull(), "#ignore")
    if "#IgnoreRow" in wide.columns:
        reason = F.when(F.coalesce(F.lower(prop("#IgnoreRow")).isin("true", "yes", "1"), F.lit(False)), "#IgnoreRow").otherwise(reason)
    return reason


def _same(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Equality of keys, nulls included."""
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & a.eqNullSafe(b)
    return out


def merge_duplicates(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per observation key, and the keys with different values, in one aggregate combined per task.

    Rows that carry ``#Aggregate`` are combined by its method, whatever their measurement method; the others must agree.
    Combined rows are marked by their measurement method, merged means by ``statType``. A ``list`` keeps all its
    values, a row each, told apart by ``ord``; the lists of a hot key need no single row.
    """
    if "#Aggregate" in obs.columns:
        obs = obs.withColumns({c: F.lit(None).cast("string") for c in ("measurementMethod", "statType") if c not in obs.columns})
    key = observe.obs_key_columns(obs, ["#Aggregate", "measurementMethod", "statType"])
    columns = [c for c in obs.columns if c != "#Aggregate"]
    others = [c for c in columns if c not in key]
    how = F.lower(F.coalesce(F.col("`#Aggregate`"), F.lit(""))) if "#Aggregate" in obs.columns else F.lit("")
    tagged = obs.withColumn("_how", F.when(how.isin(*observe.AGGREGATES, "list"), how).otherwise(""))
    method = F.col("measurementMethod") if "measurementMethod" in columns else F.lit(None).cast("string")
    grouped = tagged.groupBy(*key, "_how", F.when(F.col("_how") == "", method).alias("_method")).agg(
        F.min_by(F.struct(*others), "ord").alias("_first"), F.max_by("value", "ord").alias("_last"), F.sum("value").alias("_sum"),
        F.avg("value").alias("_mean"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.count(F.lit(1)).alias("n_rows"))
    chosen = F.col("_first.value")
    for name, column in (("sum", "_sum"), ("mean", "_mean"), ("min", "min_value"), ("max", "max_value"), ("last", "_last")):
        chosen = F.when(F.col("_how") == name, F.col(column)).otherwise(chosen)
    made = {"value": chosen}
    if "measurementMethod" in columns:
        marked = observe.aggregate_method(F.coalesce("_first.measurementMethod", F.lit("")), F.col("_how"), F.col("n_rows") > 1)
        made["measurementMethod"] = F.when(F.col("_how") == "", F.col("_first.measurementMethod")).otherwise(marked)
    if "statType" in columns:
        made["statType"] = F.when((F.col("_how") == "mean") & (F.col("n_rows") > 1), F.lit("dcs:meanValue")).otherwise(F.col("_first.statType"))
    agree = (F.col("_how") != "") | F.col("min_value").eqNullSafe(F.col("max_value"))
    good = grouped.filter(agree & (F.col("_how") != "list")).select(*[(made[c] if c in made else F.col(f"_first.`{c}`") if c in others else prop(c)).alias(c) for c in columns])
    if "#Aggregate" in obs.columns:
        heads = grouped.filter("_how = 'list'").select(*[prop(k).alias(f"_k{i}") for i, k in enumerate(key)], made["measurementMethod"].alias("_marked"))
        listed = tagged.filter("_how = 'list'").join(heads, _same([prop(k) for k in key], [F.col(f"_k{i}") for i in range(len(key))]))
        good = good.unionByName(listed.withColumn("measurementMethod", F.col("_marked")).select(*[F.col(f"`{c}`") for c in columns]))
    names = [F.col("_method").alias("measurementMethod")] if "measurementMethod" in columns else []
    return good, grouped.filter(~agree).select(*[prop(k) for k in key], *names, "n_rows", "min_value", "max_value")


def _tagged(cells: DataFrame, schema: PvSchema, options: GridOptions, header: str | None) -> DataFrame:
    """Cells with their header text ``_h``, whether the text is ``_plain`` and whether it is looked up at all (``_want``)."""
    numeric = "" if schema.spaced_digits else r"|-?[0-9]+([.,][0-9]+)*"
    plain = F.col("value").rlike(f"^([a-z0-9_%$-]*{numeric})$")
    head = F.coalesce(F.col(header), F.lit("")) if header else F.lit("")
    wanted = g.mapped_cells(options.header_rows, options.header_columns, options.mapped_rows, options.mapped_columns, schema.namespaces, header)
    return cells.withColumns({"_h": head, "_plain": plain, "_want": wanted & (F.col("value") != "")})


def searched(cells: DataFrame, pv_map: DataFrame, schema: PvSchema, options: GridOptions, table: DataFrame, header: str | None = None,
             names: DataFrame | None = None) -> DataFrame:
    """Properties (``_p3``) of the distinct texts of ``cells`` that aren't plain words or numbers: fall-backs and phrases. Stored.

    ``names`` (``value``) are searched with them, whatever they look like.
    """
    rest = _tagged(cells, schema, options, header).filter(~F.col("_plain") & F.col("_want")).select(F.col("_h").alias("header"), "value")
    rest = (rest if names is None else rest.unionByName(names.select(F.lit("").alias("header"), "value"))).distinct()
    # one pass collects the distinct texts; everything the searches do afterwards reads that table
    strings = materialise(rest.withColumn("header", F.nullif(F.col("header"), F.lit(""))))
    hits = find_properties(strings, pv_map, schema, delimiter=options.word_delimiter, word_boundary=options.word_boundary, table=table, substrings=options.substrings)
    return bounded(materialise(hits.select(F.coalesce("header", F.lit("")).alias("_h"), F.col("value"), F.col("props").alias("_p3"))))


def attach_properties(cells: DataFrame, pv_map: DataFrame, schema: PvSchema, options: GridOptions, table: DataFrame,
                      header: str | None = None, hits: DataFrame | None = None) -> DataFrame:
    """Add ``props`` (null when nothing is mapped) to cells.

    Plain lower-case words and numbers can only hit the map as they are: one broadcast join, no
    shuffle. Only the remaining distinct (header, text) pairs go through the fall-backs and the
    phrase search (``hits``, if that was done already), and are joined back.
    """
    hits = searched(cells, pv_map, schema, options, table, header) if hits is None else hits
    direct = table.select(F.col("namespace").alias("_ns"), F.col("key").alias("_k"), F.col("props").alias("_p1"))
    ns = effective_namespace(F.col("_h"), [n for n in schema.namespaces if n]) if header else F.lit(ANY)
    out = _tagged(cells, schema, options, header).withColumns({"_ns": ns, "_k": F.when(F.col("_plain") & F.col("_want"), F.col("value"))}).join(direct, ["_ns", "_k"], "left")
    found = [F.col("_p1")]
    if schema.prefixed_keys:
        second = table.filter(F.col("namespace") == ANY).select(F.col("key").alias("_k2"), F.col("props").alias("_p2"))
        label = F.when(F.col("_h") != "", F.col("_h")).otherwise(F.lit("GLOBAL"))
        out = out.withColumn("_k2", F.when(F.col("_plain") & F.col("_want") & F.col("_p1").isNull(), F.concat(label, F.lit(":"), F.col("value"))))
        out = out.join(second, "_k2", "left").drop("_k2")
        found.append(F.col("_p2"))
    out = out.join(hits, ["_h", "value"], "left")
    found.append(F.col("_p3"))

    if schema.prefixed_keys:
        out = positional_fallback(out.withColumn("_p", F.coalesce(*found)), table)
        found = [F.col("_p")]
    out = out.withColumn("props", F.coalesce(*found))
    return out.drop("_ns", "_k", "_h", "_plain", "_want", "_p1", "_p2", "_p3", "_p")


def positional_fallback(cells: DataFrame, table: DataFrame) -> DataFrame:
    """``Cell:r:c``, ``Column:c``, ``Row:r`` keys for cells whose text has no entry."""
    spots = table.filter((F.col("namespace") == ANY) & F.col("key").rlike(r"^(Cell:\d+:\d+|Column:\d+|Row:\d+)$"))
    side = spots.select(F.col("key").alias("_spot"), F.col("props").alias("_q"))
    row, col = F.col("row_no").cast("string"), F.col("col_no").cast("string")
    for text in (F.concat_ws(":", F.lit("Cell"), row, col), F.concat_ws(":", F.lit("Column"), col), F.concat_ws(":", F.lit("Row"), row)):
        cells = cells.withColumn("_spot", F.when(F.col("_p").isNull() & F.col("_want"), text)).join(side, "_spot", "left")
        cells = cells.withColumn("_p", F.coalesce("_p", "_q")).drop("_spot", "_q")
    return cells


def named_by_header(schema: PvSchema) -> bool:
    """Whether what a cell's text means depends on the text above it."""
    return len(schema.namespaces) > 1 or schema.prefixed_keys


def _headed_cells(rows: DataFrame, pv_map: DataFrame, schema: PvSchema, options: GridOptions, props: Sequence[str],
                  table: DataFrame, hits: DataFrame) -> DataFrame:
    """Body cells with own ``props`` and one ``h:<prop>`` column per header property.

    Rows are dealt out once, whole (``g.dealt``); their cells are melted in place and stay there.
    """
    by_header = named_by_header(schema)
    if options.header_rows > 0:
        cells = g.melt(g.dealt(rows, options.carry_bucket), ["_bucket"])
        top_cells = g.melt(rows.filter(F.col("row_no") <= options.header_rows))
        top = attach_properties(top_cells, pv_map, schema, options, table, hits=hits)
        folded = materialise(g.fold_headers(g.fill_merged(top, default=options.merged_cells)))
        body = g.attach_fixed_headers(cells.filter(F.col("row_no") > options.header_rows), folded)
        body = attach_properties(body, pv_map, schema, options, table, "header") if by_header else attach_properties(body, pv_map, schema, options, table, hits=hits)
        return body.withColumns({f"h:{p}": F.col("header_props")[p] for p in props}).drop("header", "header_props")

    names = [f"h:{p}" for p in props] + (["header"] if by_header else [])
    known = lambda cells: attach_properties(cells, pv_map, schema, options, table, hits=hits)
    states = g.header_states(_header_cells(rows, known, schema, options, props, by_header), names, options.carry_bucket)
    body = g.with_header_state(rows, materialise(states), options.carry_bucket)
    headed = g.melt(body, ["_bucket", "state"]).withColumn("_s", F.get("state", F.col("col_no") - 1)).drop("state")
    headed = headed.select("*", *[F.col(f"_s.`{n}`").alias(n) for n in names]).drop("_s")
    if by_header:
        return attach_properties(headed, pv_map, schema, options, table, "header").drop("header")
    return attach_properties(headed, pv_map, schema, options, table, hits=hits)


def _header_cells(rows: DataFrame, known: Callable[[DataFrame], DataFrame], schema: PvSchema, options: GridOptions, props: Sequence[str], named: bool) -> DataFrame:
    """Cells of header rows, which have mapped cells and no unmapped number, and of rows with a ``#Header`` cell.

    Rows are judged by three flags, combined where they lie; then the cells of those few rows are looked up again.
    """
    number = parse_number(F.col("value"), options.decimal, options.separators)
    mapped = F.col("props").isNotNull()
    listed = F.coalesce(F.col("props")["#Header"].isNotNull(), F.lit(False)) if "#Header" in schema.props else F.lit(False)
    judged = known(g.melt(g.dealt(rows, options.carry_bucket), ["_bucket"])).groupBy("file", "_bucket", "row_no").agg(
        F.max(mapped).alias("_m"), F.max(~mapped & number.isNotNull()).alias("_n"), F.max(listed).alias("_l"))
    heads = judged.withColumn("head", F.col("_m") & ~F.col("_n")).filter(F.col("head") | F.col("_l")).select("file", "row_no", "head")
    few = bounded(materialise(heads))
    cells = materialise(known(g.melt(rows.join(few, ["file", "row_no"]), ["head"])))
    if options.merged_cells is not None or "#MergedCell" in schema.props:
        cells = g.fill_merged(cells.withColumn("_props", F.col("props")), "_props", options.merged_cells)
    else:
        cells = cells.withColumn("_props", F.col("props"))
    shown = lambda p: (F.col("head") | F.array_contains(F.split(F.col("props")["#Header"], ","), p)) if "#Header" in schema.props else F.col("head")
    texts = [F.when(F.col("head"), F.col("value")).alias("header")] if named else []
    return cells.select("file", "row_no", "col_no", "head", *[F.when(shown(p), F.col("_props")[p]).alias(f"h:{p}") for p in props], *texts)


def resolve_cells(cells: DataFrame, schema: PvSchema, options: GridOptions, props: Sequence[str], file_props: DataFrame | None = None) -> DataFrame:
    """Own, header and file properties to one column per property, resolved within cell and row."""
    number = parse_number(F.col("value"), options.decimal, options.separators)
    file_level = {}
    if file_props is not None:
        cells = cells.join(file_props, "file", "left")
        file_level = {p: F.col("file_props")[p] for p in props}
    columns = {p: F.coalesce(F.col("props")[p], F.col(f"`h:{p}`"), *([file_level[p]] if file_level else [])) for p in props}
    columns["Data"] = F.col("value")
    text = F.when(F.col("props").isNull() & number.isNotNull(), F.trim(F.translate(F.col("value"), options.separators, "")))
    columns["Number"] = F.coalesce(text, columns.get("Number", F.lit(None).cast("string")))
    if options.all_numbers_are_values:
        columns["value"] = F.coalesce(text, columns.get("value", F.lit(None).cast("string")))
    # the cell text lives on as Data, so that a property called "value" has its name to itself
    keys = [F.col(k) for k in (*ROW_KEYS, "_bucket")]
    wide = cells.select(*keys, *[c.alias(p) for p, c in columns.items()])
    wide = settle(resolve.process(wide, schema))
    has = lambda p: prop(p).isNotNull() if p in wide.columns else F.lit(False)
    no_value = ~(has("value") | has("measurementResult"))
    shared = [p for p in wide.columns if p not in (*ROW_KEYS, "_bucket") and p not in observe.INTERNAL_PROPS and p not in ("#Regex", "#Format", "#Eval", "value", "measurementResult")]
    made = {r.split("=", 1)[0].strip() for r in schema.rules.get("#Format", ())}
    wanted = ~no_value | (has("#Format") if made & {"value", "measurementResult"} else F.lit(False))
    # open references stay in their own cell
    flowing = {p: F.when(valid_column(p), prop(p)) for p in schema.references if p in shared}
    carried = g.fold_row(wide, ("file", "_bucket", "row_no"), shared, no_value, wanted, flowing).drop("_bucket")
    carried = settle(carried)
    carried = resolve.substitute(carried, schema.references)
    # one that is still open gives way to what the row has
    carried = carried.withColumns({p: F.when(valid_column(p), prop(p)).otherwise(F.col(f"`_c:{p}`")) for p in flowing}).drop(*[f"_c:{p}" for p in flowing])
    carried = resolve.apply_formats(carried, schema.rules.get("#Format", ()))
    return settle(carried)


def _value(df: DataFrame, name: str) -> Column:
    return prop(name) if name in df.columns else F.lit(None).cast("string")


def _dependants(df: DataFrame, schema: PvSchema, options: GridOptions, variable_props: Sequence[str]) -> DataFrame:
    """Denominators and variables given as property selections become ids of further variables.

    Those variables are added in columns ``_dep…``, arrays of structs (``dcid``, ``e``: entries).
    """
    extra = []
    for target in ("measurementDenominator", "variableMeasured"):
        if target not in df.columns:
            continue
        text = prop(target)
        for rule in schema.rules.get(target, ()):
            chosen = resolve.selection(rule, variable_props, options.id_ignore)
            if chosen is None:
                continue
            names, fixed = chosen
            columns = {n: prop(n) for n in names} | {n: F.lit(v) for n, v in fixed.items()}
            for n, v in options.variable_defaults.items():
                columns.setdefault(n, F.lit(v))
            made = ids.variable_id(columns, options.id_ignore, options.boolean_props, options.affixes)
            extra.append(F.when(prop(target) == rule, F.struct(made.alias("dcid"), _entries(columns).alias("e"))))
            text = F.when(prop(target) == rule, add_namespace(made)).otherwise(text)
        df = df.withColumns({f"_dep{len(extra)}:{target}": F.array_compact(F.array(*extra)), target: text}) if extra else df.withColumn(target, text)
        extra = []
    return df


def _entries(columns: Mapping[str, Column]) -> Column:
    entries = F.array(*[F.struct(F.lit(n).alias("key"), c.alias("value")) for n, c in sorted(columns.items())])
    return F.filter(entries, lambda e: valid_value(e["value"]))


def grid_to_observations(grid: DataFrame, pv_map: DataFrame, options: GridOptions = GridOptions(), places: DataFrame | None = None,
                         file_props: DataFrame | None = None, id_map: DataFrame | None = None, known_variables: DataFrame | None = None,
                         gazetteer: DataFrame | None = None) -> Result:
    """Observations, variables and rejects of a grid (``file, row_no, cells``).

    ``places`` (name, dcid) resolves names, then ``gazetteer`` (places with names and parents) by likeness; ``id_map`` (old, new) renames generated ids;
    ``known_variables`` (node, props) lend their ids to variables with the same properties. File
    properties are looked up in the map by file name unless ``file_props`` gives them. The map's
    ``config:`` rows override ``options``. ``options.hook`` sees the observations before validation.
    Lost cells are listed in ``rejects`` with the stage that lost them.
    """
    pv_map = localised(pv_map)
    options = with_config_rows(options, pv_map)
    pv_map = pv_map.filter(~F.lower("key").startswith("config:"))
    schema = pv_schema(pv_map)
    table = localised(with_default_namespace(pv_map))
    props = [p for p in dict.fromkeys((*schema.all_props, "value")) if p not in ("Data",)]
    rows = g.select_rows(grid, options.skip_rows, options.process_rows, options.ignore_rows, options.min_columns, options.max_rows, options.max_columns)
    # header cells alone are known without their header, where that decides
    first = rows.filter(F.col("row_no") <= options.header_rows) if options.header_rows > 0 and named_by_header(schema) else rows
    names = None if file_props is not None else g.file_properties(grid, options.word_delimiter)
    hits = searched(g.melt(first), pv_map, schema, options, table, names=names)
    if file_props is None:
        file_props = localised(file_level_properties(names, hits, table, options))
        file_props = file_props if file_props.head(1) else None
    cells = _headed_cells(rows, pv_map, schema, options, props, table, hits)
    wide = resolve_cells(cells, schema, options, props, file_props)

    result = valid_value(_value(wide, "measurementResult"))
    candidates = wide.filter(F.coalesce(result, F.lit(False)) | F.coalesce(valid_column("value"), F.lit(False)))
    if options.header_columns:
        candidates = candidates.filter(F.col("col_no") > options.header_columns)
    candidates = candidates.withColumn("_reason", ignored_reason(candidates))
    candidates = observe.expand_values(candidates, [p for p in options.multi_value if p in candidates.columns])

    number = parse_number(prop("value"))
    amount = number * F.coalesce(parse_number(_value(candidates, "#Multiply")), F.lit(1.0))
    date = resolve_date(_value(candidates, "observationDate"), _value(candidates, "#DateFormat") if "#DateFormat" in candidates.columns else options.date_format,
                        options.output_date_format)
    dated = settle(candidates.withColumns({"_amount": amount, "observationDate": date}))
    keep, assigned = resolve.filter_rules(dated, schema.rules)
    dated = dated.withColumns({"_reason": F.when(F.col("_reason").isNull() & ~keep, "#Filter").otherwise(F.col("_reason")), **assigned})
    present = [c for c in dated.columns if c not in ROW_KEYS and not c.startswith("_")]
    obs_props, variable_props = observe.split_properties(present, options.output_columns)
    dated = _dependants(dated, schema, options, variable_props)
    entry = "struct<dcid:string,e:array<struct<key:string,value:string>>>"

    columns = {p: F.when(valid_column(p), prop(p)) for p in variable_props}
    for name, default in options.variable_defaults.items():
        columns[name] = F.coalesce(columns.get(name, F.lit(None).cast("string")), F.lit(default))
    stated = strip_namespace(_value(dated, "variableMeasured"))
    made = ids.variable_id(columns, options.id_ignore, options.boolean_props, options.affixes)
    tagged = settle(dated.withColumn("_id", F.coalesce(F.nullif(stated, F.lit("")), made)))
    if id_map is not None:
        from ..operators.lookup import remap
        tagged = remap(tagged, "_id", id_map, "old", "new")

    about = _value(tagged, "observationAbout")
    rest = [p for p in obs_props if p in ("unit", "measurementMethod", "scalingFactor", "measurementResult", "#Aggregate") or p in options.output_columns]
    period = _value(tagged, "observationPeriod")
    # read several times below: by the validation, the merge of duplicates, the variables and the rejects
    stored = materialise(settle(tagged.select(
        F.struct(*ROW_KEYS).alias("ord"), "observationDate", about.alias("observationAbout"), add_namespace(F.col("_id")).alias("variableMeasured"),
        F.col("_amount").alias("value"), prop("value").alias("value_raw"),
        F.when(period == "", period_of(F.col("observationDate"))).otherwise(period).alias("observationPeriod"), *[prop(p) for p in rest],
        "_reason", F.struct(F.col("_id").alias("dcid"), _entries(columns).alias("e")).cast(entry).alias("_variable"),
        F.flatten(F.array(F.array().cast(f"array<{entry}>"), *[prop(d).cast(f"array<{entry}>") for d in tagged.columns if d.startswith("_dep")])).alias("_further"))))
    if places is not None or gazetteer is not None:
        # each distinct name once: an id as it is, then the table, then the gazetteer
        names = stored.select(F.col("observationAbout").alias("name")).filter("name IS NOT NULL").distinct()
        found, _ = resolve_places(names, "name", resolved=places, gazetteer=gazetteer)
        table = bounded(materialise(found.select(F.col("name").alias("_place"), F.col("dcid").alias("_pid"))))
        stored = stored.join(table, F.col("observationAbout") == F.col("_place"), "left").withColumn("observationAbout", F.col("_pid")).drop("_place", "_pid")
    rejects = stored.filter(F.col("_reason").isNotNull()).select(
        F.when(F.col("_reason") == "#Filter", "filters").otherwise("cells").alias("stage"), F.col("_reason").alias("reason"), "ord.*")
    left = stored.filter(F.col("_reason").isNull())
    required = [c for c in observe.REQUIRED_OBS if c != "value"]
    obs = left.drop("_reason", "_variable", "_further")
    if options.hook:
        obs = options.hook(obs)
    complete, bad = observe.validate(obs, required)
    rejects = rejects.unionByName(bad.select(F.lit("validation").alias("stage"), F.concat(F.lit("no "), F.array_join("missing", ", ")).alias("reason"), "ord.*"))
    good, conflicts = complete.drop("#Aggregate"), None
    if options.resolve_duplicates:
        good, conflicts = merge_duplicates(complete)
        key = [c for c in conflicts.columns if c not in ("n_rows", "min_value", "max_value")]
        if "measurementMethod" in key and "measurementMethod" not in complete.columns:  # none of the rows names one
            key.remove("measurementMethod")
        same = _same([prop(k) for k in key], [F.col(f"_k{i}") for i in range(len(key))])
        lost = complete.join(conflicts.select(*[prop(k).alias(f"_k{i}") for i, k in enumerate(key)]), same, "left_semi")
        rejects = rejects.unionByName(lost.select(F.lit("duplicates").alias("stage"), F.lit("different values").alias("reason"), "ord.*"))

    further = left.select(F.explode("_further").alias("v")).select("v.*").distinct()
    # maps cannot be grouped: the entries stand in for them
    variables = left.select("_variable.*").distinct()
    if known_variables is not None:
        made = variables.select(F.col("dcid").alias("node"), F.col("dcid").alias("_made"), F.map_from_entries("e").alias("props"))
        renamed = materialise(reuse_existing(made, known_variables).select("node", "_made", F.map_entries("props").alias("e")))
        names = renamed.filter("node <> _made").select("_made", F.col("node").alias("_known")).distinct()
        good = good.join(names, strip_namespace(F.col("variableMeasured")) == F.col("_made"), "left").withColumn(
            "variableMeasured", F.coalesce(add_namespace(F.col("_known")), F.col("variableMeasured"))).drop("_made", "_known")
        variables = renamed.select(F.col("node").alias("dcid"), "e").distinct()
    if not options.unused_variables:
        used = good.select(strip_namespace(F.col("variableMeasured")).alias("dcid")).distinct()
        variables = variables.join(used, "dcid", "left_semi")
    # denominators and other dependants stay: observations name them through their own variable
    variables = variables.unionByName(further).distinct().select("dcid", F.map_from_entries("e").alias("props"))
    return Result(good, variables, bad, rejects, conflicts)
