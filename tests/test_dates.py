"""Dates of many shapes against trying every pattern in turn."""

import itertools

from pyspark.sql import functions as F

from gridwright.functions.dates import resolve_date

FREE = ("yyyy-MM-dd", "yyyy-M-d", "yyyy/MM/dd", "yyyyMMdd", "MM/dd/yyyy", "M/d/yyyy", "d MMM yyyy", "d MMMM yyyy",
        "MMM d yyyy", "MMMM d yyyy", "MMM d, yyyy", "MMMM d, yyyy", "dd-MM-yyyy", "yyyy-MM-dd HH:mm:ss")
MONTHS = ("yyyy-MM", "yyyy-M", "MMM yyyy", "MMMM yyyy", "MM/yyyy", "yyyy MMM", "yyyy MMMM")


def every_pattern(v):
    parsed = lambda t, p: F.try_to_timestamp(t, F.lit(p))
    t = F.trim(v)
    dashed = F.regexp_replace(t, "[^A-Za-z0-9]+", "-")
    own = (F.when(dashed.rlike(r"^\d{4}$"), F.date_format(parsed(dashed, "yyyy"), "yyyy")).when(dashed.rlike(r"^\d{4}-\d{1,2}$"), F.date_format(parsed(dashed, "yyyy-M"), "yyyy-MM"))
           .when(dashed.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.date_format(parsed(dashed, "yyyy-M-d"), "yyyy-MM-dd")))
    return F.coalesce(own, *[F.date_format(parsed(t, p), "yyyy-MM-dd") for p in FREE], *[F.date_format(parsed(t, p), "yyyy-MM") for p in MONTHS])


def test_one_pattern_reads_what_all_read(spark):
    texts = ["", " 2020 ", "2020.5", "20-1-1", "Total", "n/a", "12345", "1234567", "May 2020", "2020 May", "31 June 2020", "2020-13-01", "2020-02-30", "29 Feb 2021", "Sept 2020", "maY 2020", "Q1 2020"]
    for y, m, d in itertools.product((1999, 2024), (2, 11), (3, 29)):
        name = ("", "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")[m]
        for month, day in ((f"{m}", f"{d}"), (f"{m:02}", f"{d:02}")):
            texts += [f"{y}-{month}-{day}", f"{y}/{month}/{day}", f"{y}{month}{day}", f"{month}/{day}/{y}", f"{day}-{month}-{y}", f"{y}-{month}", f"{month}/{y}", f"{y} {month} {day}",
                      f"{y}-{month}-{day} 10:11:12", f"{y}-{month}-{day}T10:11:12", f"{day}.{month}.{y}"]
            for word in (name, name[:3], name.lower(), name[:3] + "."):
                texts += [f"{day} {word} {y}", f"{word} {day} {y}", f"{word} {day}, {y}", f"{word} {y}", f"{y} {word}", f"{word}-{y}", f"{word}  {y}"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").repartition(1)
    rows = df.select("t", resolve_date(F.col("t")).alias("one"), every_pattern(F.col("t")).alias("all")).collect()
    assert [(r["t"], r["one"]) for r in rows] == [(r["t"], r["all"]) for r in rows]
    assert sum(r["one"] is not None for r in rows) > 150


def test_given_formats_come_after_the_own_grain(spark):
    df = spark.createDataFrame([("03.04.2021",), ("2021",), ("1/2/2020",)], "t string")
    got = [tuple(r) for r in df.select(resolve_date(F.col("t"), "dd.MM.yyyy"), resolve_date(F.col("t"), None, "yyyy")).collect()]
    assert got == [("2021-04-03", None), ("2021", "2021"), ("2020-01-02", "2020")]
