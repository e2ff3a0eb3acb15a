"""End to end: sheets made here, with the observations worked out from the same tables."""

import pytest

from gridwright.plans.observations import GridOptions, grid_to_observations
from gridwright.sources.pvmaps import pv_map_from_dict

# district sections, one column per year, a fuel per row, a marked footer
YEARS = ("2019", "2020")
FUEL_USE = {"North District": [("Coal", (5, 6)), ("Peat", (1, 2)), ("Coal", (7, 8))], "South District": [("Peat", (3, 4)), ("Peat", (3, 4)), ("Wood", (9, 10)), ("Wood", (9, 11))]}
FUEL_MAP = {"GLOBAL": {
    **{y: {"observationDate": y, "value": "@Number", "populationType": "dcs:Fuel"} for y in YEARS},
    "North District": {"observationAbout": "dcid:district/north"}, "South District": {"observationAbout": "dcid:district/south"},
    "Coal": {"fuel": "dcs:Coal", "#Aggregate": "sum"}, "Peat": {"fuel": "dcs:Peat"}, "Wood": {"fuel": "dcs:Wood"},
    "DEFAULT_PV": {"unit": "dcs:Tonne", "measurementMethod": "dcs:Guess"}, "fuel_survey.csv": {"measurementMethod": "dcs:FuelSurvey"},
}}


def grid_of_rows(spark, rows, file="dir/fuel_survey.csv"):
    return spark.createDataFrame([(file, i + 1, [str(c) for c in r]) for i, r in enumerate(rows)], "file string, row_no long, cells array<string>")


def fuel_rows():
    rows = [("Use of fuels", "", ""), ("", *YEARS)]
    for district, fuels in FUEL_USE.items():
        rows += [(district, "", ""), *((f, *v) for f, v in fuels)]
    return [*rows, ("* estimates", "", "")]


def fuel_observations():
    """Sums for coal, one of equal repeats, none of repeats that differ."""
    seen = {}
    for district, fuels in FUEL_USE.items():
        for fuel, values in fuels:
            for year, v in zip(YEARS, values):
                seen.setdefault((year, f"dcid:district/{district.split()[0].lower()}", f"dcid:Count_Fuel_{fuel}"), []).append(float(v))
    return {(*k, sum(v) if "Coal" in k[2] else v[0]) for k, v in seen.items() if "Coal" in k[2] or len(set(v)) == 1}


def found(result):
    return {(r["observationDate"], r["observationAbout"], r["variableMeasured"], r["value"]) for r in result.observations.collect()}


def test_sections_duplicates_and_file_properties(spark):
    result = grid_to_observations(grid_of_rows(spark, fuel_rows()), pv_map_from_dict(spark, FUEL_MAP), GridOptions(carry_bucket=3))
    assert found(result) == fuel_observations()
    rows = result.observations.collect()
    assert {r["unit"] for r in rows} == {"dcs:Tonne"}
    # the file's own entry goes before the default; a sum over several rows is marked as one
    assert {r["measurementMethod"] for r in rows if "Coal" not in r["variableMeasured"]} == {"dcs:FuelSurvey"}
    assert {r["measurementMethod"] for r in rows if "Coal" in r["variableMeasured"] and "north" in r["observationAbout"]} == {"dcs:dcAggregate/FuelSurvey"}
    lost = {(r["stage"], r["reason"], r["n"]) for r in result.counters().collect()}
    assert lost == {("duplicates", "different values", 2)}
    assert {r["dcid"] for r in result.variables.collect()} == {"Count_Fuel_Coal", "Count_Fuel_Peat", "Count_Fuel_Wood"}


def test_known_variables_hooks_and_config_rows(spark):
    from pyspark.sql import functions as F

    maps = {"GLOBAL": {**FUEL_MAP["GLOBAL"], "config:import": {"header_rows": "1", "unknown": "x"}}}
    rows = [("district", "fuel", *YEARS), ("North District", "Peat", 1, 2), ("South District", "Wood", "n/a", 4)]
    known = spark.createDataFrame([("PeatInAll", {"typeOf": "dcs:StatisticalVariable", "statType": "dcs:measuredValue", "measuredProperty": "dcs:count", "populationType": "dcs:Fuel", "fuel": "dcs:Peat"})],
                                  "node string, props map<string,string>")
    hook = lambda obs: obs.withColumn("value", F.col("value") * 10)
    result = grid_to_observations(grid_of_rows(spark, rows), pv_map_from_dict(spark, maps), GridOptions(hook=hook), known_variables=known)
    assert found(result) == {("2019", "dcid:district/north", "dcid:PeatInAll", 10.0), ("2020", "dcid:district/north", "dcid:PeatInAll", 20.0),
                             ("2020", "dcid:district/south", "dcid:Count_Fuel_Wood", 40.0)}
    assert {r["dcid"] for r in result.variables.collect()} == {"PeatInAll", "Count_Fuel_Wood"}


def test_filters_that_drop_and_filters_that_assign(spark):
    maps = {"GLOBAL": {"place": {"observationAbout": "dcid:p/{Data}", "observationDate": "2001"},
                       "height": {"value": "@Number", "populationType": "dcs:Tree", "#Filter": "cast(value as double) < 100"},
                       "width": {"value": "@Number", "populationType": "dcs:Bush", "#Filter": "unit := CASE WHEN cast(value as double) > 5 THEN 'Metre' END", "unit": "Foot"},
                       "secret": {"value": "@Number", "populationType": "dcs:Tree", "#ignore": "1"}}}
    rows = [("Place", "Height", "Width", "Secret"), ("a", 5, 3, 1), ("b", 500, 30, 2)]
    result = grid_to_observations(grid_of_rows(spark, rows), pv_map_from_dict(spark, maps), GridOptions(header_rows=1))
    got = {(r["observationAbout"], r["variableMeasured"], r["value"], r["unit"]) for r in result.observations.collect()}
    assert got == {("dcid:p/a", "dcid:Count_Tree", 5.0, None), ("dcid:p/a", "dcid:Count_Bush", 3.0, "Foot"), ("dcid:p/b", "dcid:Count_Bush", 30.0, "Metre")}
    assert {(r["stage"], r["reason"], r["n"]) for r in result.counters().collect()} == {("filters", "#Filter", 1), ("cells", "#ignore", 2)}


def test_namespaces_positions_and_dependants(spark):
    maps = {"GLOBAL": {"Harbour": {"observationAbout": "dcid:port/{Data}"}, "Flag:X": {"flag": "dcs:FlagX"}, "Column:2": {"unit": "Crate"},
                       "cargo": {"value": "@Number", "populationType": "dcs:Freight", "observationDate": "2001", "measurementDenominator": "-flag,+speed=dcs:Slow"}},
            "Route": {"X": {"route": "dcs:RouteX"}, "Y": {"#ignore": "1"}}}
    rows = [("Harbour", "Flag", "Route", "Cargo"), ("h1", "X", "X", 5), ("h3", "Z", "Y", 6), ("h4", "Z", "Z", 7)]
    result = grid_to_observations(grid_of_rows(spark, rows), pv_map_from_dict(spark, maps), GridOptions(header_rows=1))
    by = {r["observationAbout"]: r for r in result.observations.collect()}
    # h3 is left out by the namespace of its column; the key of column 2 reaches every row
    assert set(by) == {"dcid:port/h1", "dcid:port/h4"} and {r["unit"] for r in by.values()} == {"Crate"}
    assert by["dcid:port/h1"]["variableMeasured"] == "dcid:Count_Freight_FlagX_RouteX_AsAFractionOf_Count_Freight_RouteX_Slow"
    assert by["dcid:port/h4"]["variableMeasured"] == "dcid:Count_Freight_AsAFractionOf_Count_Freight_Slow"
    assert "Count_Freight_RouteX_Slow" in {r["dcid"] for r in result.variables.collect()}


def test_merged_header_cells(spark):
    kinds, sides = ("Apples", "Plums"), ("Left", "Right")
    maps = {"GLOBAL": {"plot": {"observationAbout": "dcid:plot/{Data}", "observationDate": "1999"},
                       **{k: {"value": "@Number", "populationType": f"dcs:{k[:-1]}"} for k in kinds}, **{s: {"bank": f"dcs:{s}"} for s in sides}}}
    rows = [("Plot", "Left", "", "Right", ""), ("", *kinds, *kinds), ("z", 1, 2, 3, 4)]
    result = grid_to_observations(grid_of_rows(spark, rows), pv_map_from_dict(spark, maps), GridOptions(header_rows=2, merged_cells=1))
    want = {(f"dcid:Count_{k[:-1]}_{s}", float(1 + i * 2 + j)) for i, s in enumerate(sides) for j, k in enumerate(kinds)}
    assert {(r["variableMeasured"], r["value"]) for r in result.observations.collect()} == want


def test_long_reference_chains(spark):
    n = 12
    maps = {"GLOBAL": {"spot": {"observationAbout": "dcid:s/{p0}", **{f"p{i}": "{p%d}" % (i + 1) for i in range(n - 1)}, f"p{n - 1}": "{Data}", "observationDate": "2000"},
                       "mass": {"value": "@Number", "populationType": "dcs:Rock"}}}
    rows = [("Spot", "Mass"), ("q", 3)]
    options = GridOptions(header_rows=1, id_ignore=tuple(f"p{i}" for i in range(n)))
    result = grid_to_observations(grid_of_rows(spark, rows), pv_map_from_dict(spark, maps), options)
    assert found(result) == {("2000", "dcid:s/q", "dcid:Count_Rock", 3.0)}


def test_reference_levels():
    from gridwright.operators.resolve import reference_levels

    assert reference_levels({"a": frozenset("b"), "b": frozenset("c"), "x": frozenset("x")}) == [["b", "x"], ["a"]]
    assert reference_levels({"a": frozenset("b"), "b": frozenset("a"), "c": frozenset("a")}) == [["a", "b"], ["a", "b"], ["c"]]


@pytest.mark.parametrize("low,high", [("7", "-"), ("-", "7"), ("3", "7")])
def test_quantity_terms(spark, low, high):
    from pyspark.sql import functions as F

    from gridwright.functions.ids import quantity_term

    want = {("7", "-"): "7OrMoreMetre", ("-", "7"): "7OrLessMetre", ("3", "7"): "3To7Metre"}[low, high]
    assert spark.range(1).select(quantity_term(F.lit(f"[{low} {high} Metre]"))).first()[0] == want


def test_id_words(spark):
    from pyspark.sql import functions as F

    from gridwright.functions.ids import affixed, boolean_term, denominator_term, id_word

    one = spark.range(1)
    assert one.select(id_word(F.lit("dcs:River__Lake"))).first()[0] == "RiverOrLake"
    assert one.select(boolean_term(F.lit("hasGarden"), F.lit("True"))).first()[0] == "HasGarden"
    assert one.select(boolean_term(F.lit("isRented"), F.lit("False"))).first()[0] == "NotRented"
    assert one.select(denominator_term(F.lit("dcs:volume"))).first()[0] == "PerVolume"
    assert one.select(affixed(F.lit("Stone"), {"prepend": "Wall", "append": "Face"})).first()[0] == "WallStoneFace"
