"""Functions of instant vectors and scalars: mathematics, calendar, labels, absence, order, histograms."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tideline.functions import ieee
from tideline.functions import labels as L
from tideline.operators.ranges import with_scalar
from tideline.operators.select import java_regex
from tideline.operators.vector import Grid, Scalar, Vector, relabel
from tideline.plans.tree import QueryError

LABEL_NAME = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")

MATH = {"abs": F.abs, "ceil": ieee.ceil, "floor": ieee.floor, "sqrt": F.sqrt, "exp": F.exp, "ln": ieee.ln, "log2": ieee.log2, "log10": ieee.log10}

#: Calendar parts of epoch seconds in UTC. Monday is 1 and Sunday 7.
CALENDAR = {
    "year": F.year,
    "month": F.month,
    "day_of_month": F.day,
    "days_of_month": F.day,
    "day_of_week": lambda d: F.weekday(d) + 1,
    "days_of_week": lambda d: F.weekday(d) + 1,
    "days_in_month": lambda d: F.day(F.last_day(d)),
}


def calendar(name: str, seconds: Column) -> Column:
    """Independent of the session's time zone: days since the epoch, and seconds of the day."""
    ok = ~F.isnan(seconds) & (F.abs(seconds) < 1e11)
    whole = F.floor(F.when(ok, seconds).otherwise(0.0))
    if name in ("hour", "minute"):
        of_day = F.pmod(whole, F.lit(86_400))
        part = F.floor(of_day / 3600) if name == "hour" else F.floor(of_day / 60) % 60
    else:
        part = CALENDAR[name](F.date_from_unix_date(F.floor(whole / 86_400).cast("int")))
    return F.when(ok, part.cast("double")).otherwise(ieee.NAN)


def rounded(v: Vector, to: Scalar) -> Vector:
    """To the nearest multiple, halves upwards."""
    if to.facts is not None:
        raise QueryError("round needs a constant")
    inverse = ieee.fold("/", 1.0, to.constant)
    return v.map(ieee.floor(F.col("value") * inverse + 0.5) / inverse)


def clamp(v: Vector, s: Scalar, most: bool) -> Vector:
    rows = Vector(with_scalar(v.facts, s, "bound"), v.series, v.one_name)
    return rows.map((ieee.least if most else ieee.greatest)(F.col("value"), F.col("bound")))


def time_scalar(spark, grid: Grid) -> Scalar:
    return Scalar(facts=grid.steps(spark).select("t", (F.col("t") / 1000.0).alias("value")))


def vector_of(spark, s: Scalar, grid: Grid) -> Vector:
    """One series without labels."""
    rows = with_scalar(grid.steps(spark), s, "value")
    empty = F.array().cast(L.TYPE)
    return Vector(rows.select(L.fingerprint(empty).alias("sid"), "t", F.col("t").alias("sample_ts"), F.col("value").cast("double").alias("value")), spark.range(1).select(L.fingerprint(empty).alias("sid"), empty.alias("labels")))


def scalar_of(v: Vector, grid: Grid) -> Scalar:
    """The value of a step with just one series, else NaN."""
    spark = v.facts.sparkSession
    only = v.facts.groupBy("t").agg(F.when(F.count(F.lit(1)) == 1, F.first("value")).otherwise(ieee.NAN).alias("value"))
    return Scalar(facts=grid.steps(spark).join(only, "t", "left").select("t", F.coalesce("value", F.lit(ieee.NAN)).alias("value")))


def absent(v: Vector, grid: Grid) -> Vector:
    """1 at the steps without any value, with the labels that a direct selector asks to be equal."""
    spark = v.facts.sparkSession
    labels = L.literal(dict(v.equal_labels)) if v.equal_labels else F.array().cast(L.TYPE)
    rows = grid.steps(spark).join(v.facts.select("t").distinct(), "t", "left_anti")
    return Vector(rows.select(L.fingerprint(labels).alias("sid"), "t", F.col("t").alias("sample_ts"), F.lit(1.0).alias("value")), spark.range(1).select(L.fingerprint(labels).alias("sid"), labels.alias("labels")))


def check_label(name: str) -> str:
    if not LABEL_NAME.fullmatch(name):
        raise QueryError(f"invalid label name {name!r}")
    return name


def label_replace(v: Vector, target: str, replacement: str, source: str, pattern: str) -> Vector:
    """Sets `target` to the replacement ($1 .. stand for groups) where the whole of `source` matches; an empty result takes it away."""
    anchored, groups = java_regex(pattern), re.compile(pattern).groups
    check_label(target)
    value = F.coalesce(L.get(F.col("labels"), source), F.lit(""))
    parts = [F.lit("")]
    for part in re.split(r"(\$\d+|\$\{\d+\})", replacement):
        if m := re.fullmatch(r"\$\{?(\d+)\}?", part):
            if int(m[1]) <= groups:
                parts.append(F.regexp_extract(value, anchored, int(m[1])))
        elif part:
            parts.append(F.lit(part))
    labels = F.when(value.rlike(anchored), L.put(F.col("labels"), target, F.concat(*parts))).otherwise(F.col("labels"))
    return relabel(v, v.series.select("sid", labels.alias("labels")))


def label_join(v: Vector, target: str, separator: str, sources: list[str]) -> Vector:
    for name in (target, *sources):
        check_label(name)
    value = F.concat_ws(separator, *(F.coalesce(L.get(F.col("labels"), s), F.lit("")) for s in sources)) if sources else F.lit("")
    return relabel(v, v.series.select("sid", L.put(F.col("labels"), target, value).alias("labels")))


def histogram_quantile(q: Scalar, v: Vector) -> Vector:
    """Quantile of cumulative buckets labelled `le`, linear inside a bucket.

    Series whose le is no number are passed over. Buckets of equal bounds add up, counts never fall with the bound;
    a step with fewer than two buckets gives NaN. A rank in the last bucket gives the bound before it.
    """
    le = L.get(F.col("labels"), "le")
    bound = F.when(le.isin("+Inf", "Inf"), ieee.INF).when(le == "-Inf", -ieee.INF).when(le.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), le.try_cast("double"))
    series = v.series.filter(F.exists("labels", lambda e: e["key"] == "le")).select("sid", L.drop(F.col("labels"), ["le", L.NAME]).alias("labels"), bound.alias("bound")).filter(F.col("bound").isNotNull()).withColumn("gid", L.fingerprint(F.col("labels")))
    buckets = v.facts.join(series.select("sid", "gid", "bound"), "sid").groupBy("gid", "t", "bound").agg(F.sum("value").alias("c"))
    up = Window.partitionBy("gid", "t").orderBy("bound")
    buckets = buckets.withColumn("c", F.max("c").over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    buckets = buckets.withColumn("i", F.row_number().over(up)).withColumn("low", F.lag("bound").over(up)).withColumn("under", F.lag("c").over(up))
    every = Window.partitionBy("gid", "t")
    buckets = with_scalar(buckets.withColumn("n", F.count(F.lit(1)).over(every)).withColumn("total", F.max("c").over(every)).withColumn("top", F.max("bound").over(every)), q, "q")
    hit = F.col("c") >= F.col("q") * F.col("total")
    found = buckets.groupBy("gid", "t").agg(
        F.max("n").alias("n"), F.max("total").alias("total"), F.max("top").alias("top"), F.max("q").alias("q"),
        F.min_by(F.struct("i", "bound", "c", "low", "under"), F.when(hit, F.col("i"))).alias("b"),
        F.max_by("bound", F.when(F.col("i") < F.col("n"), F.col("i"))).alias("second"),
    )
    b = F.col("b")
    start = F.when(b["i"] == 1, F.lit(0.0)).otherwise(b["low"])
    below = F.when(b["i"] == 1, F.lit(0.0)).otherwise(b["under"])
    inside = start + (b["bound"] - start) * ieee.div(F.col("q") * F.col("total") - below, b["c"] - below)
    value = (
        F.when(F.isnan("q"), ieee.NAN).when(F.col("q") < 0, -ieee.INF).when(F.col("q") > 1, ieee.INF)
        .when((F.col("n") < 2) | (F.col("top") < 0) | F.isnan("total"), ieee.NAN)
        .when(b["i"] == F.col("n"), F.col("second")).when((b["i"] == 1) & (b["bound"] <= 0), b["bound"]).otherwise(inside)
    )
    facts = found.select(F.col("gid").alias("sid"), "t", F.col("t").alias("sample_ts"), F.coalesce(value, F.lit(ieee.NAN)).alias("value"))
    return Vector(facts, series.select(F.col("gid").alias("sid"), "labels").distinct())


def sort(v: Vector, descending: bool) -> Vector:
    return replace(v, order="desc" if descending else "asc", equal_labels=())
