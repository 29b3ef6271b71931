"""Aggregation across series at one step: by, without, or into one group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import ieee
from tideline.functions import labels as L
from tideline.operators.ranges import interpolated, with_scalar
from tideline.operators.vector import Scalar, Vector
from tideline.plans.tree import QueryError

#: Aggregators that one built-in aggregate expresses; Spark combines them before the shuffle.
BUILT_IN = {"sum": F.sum, "avg": F.avg, "count": F.count, "min": ieee.min_number, "max": ieee.max_number, "stddev": F.stddev_pop, "stdvar": F.var_pop}


def group_labels(labels: Column, by: tuple[str, ...] | None, without: tuple[str, ...] | None) -> Column:
    if without is not None:
        return L.drop(labels, [*without, L.NAME])
    return L.keep(labels, by or ())


def _grouped(v: Vector, by: tuple[str, ...] | None, without: tuple[str, ...] | None) -> tuple[DataFrame, DataFrame]:
    """Facts with their group's id (gid), and the groups (gid, labels). Groups are made on the series alone."""
    if without is None and not by:
        one = F.array().cast(L.TYPE)
        groups = v.series.sparkSession.range(1).select(L.fingerprint(one).alias("gid"), one.alias("labels"))
        return v.facts.withColumn("gid", L.fingerprint(one)), groups
    named = v.series.select("sid", group_labels(F.col("labels"), by, without).alias("labels")).withColumn("gid", L.fingerprint(F.col("labels")))
    return v.facts.join(named.select("sid", "gid"), "sid"), named.select("gid", "labels").distinct()


def _nameless(by: tuple[str, ...] | None) -> bool:
    """Whether the groups have no name, so that no two of them differ in it."""
    return L.NAME not in (by or ())


def _vector(rows: DataFrame, groups: DataFrame, one_name: bool) -> Vector:
    facts = rows.select(F.col("gid").alias("sid"), "t", F.col("t").alias("sample_ts"), F.col("value").cast("double").alias("value"))
    return Vector(facts, groups.select(F.col("gid").alias("sid"), "labels"), one_name)


def simple(op: str, v: Vector, by: tuple[str, ...] | None, without: tuple[str, ...] | None) -> Vector:
    facts, groups = _grouped(v, by, without)
    return _vector(facts.groupBy("gid", "t").agg(BUILT_IN[op](F.col("value")).alias("value")), groups, _nameless(by))


def topk(v: Vector, k: Scalar, by: tuple[str, ...] | None, without: tuple[str, ...] | None, bottom: bool = False) -> Vector:
    """The k largest (or smallest) values of each group and step with all their labels; NaN last, ties by series."""
    facts, _ = _grouped(v, by, without)
    value = F.col("value")
    order = Window.partitionBy("gid", "t").orderBy(F.isnan(value), value.asc() if bottom else value.desc(), "sid")
    ranked = facts.withColumn("r", F.row_number().over(order))
    if k.facts is None:
        most = 0 if k.constant != k.constant or k.constant < 1 else int(min(k.constant, 2**31 - 1))
        ranked = ranked.filter(F.col("r") <= most)  # a constant lets Spark cut each task's ranks before the shuffle
    else:
        ranked = with_scalar(ranked, k, "k").filter(F.col("r") <= F.col("k"))
    return Vector(ranked.select("sid", "t", "sample_ts", "value"), v.series, v.one_name, order="asc" if bottom else "desc")


def value_text(x: Column) -> Column:
    """A whole number without a fraction, other values as Java writes a double; infinities as +Inf and -Inf."""
    whole = (x == F.floor(F.when(F.isnan(x) | (F.abs(x) >= 2.0**53), 0.5).otherwise(x))) & (F.abs(x) < 2.0**53)
    return F.when(F.isnan(x), "NaN").when(x == ieee.INF, "+Inf").when(x == -ieee.INF, "-Inf").when(whole, F.when(whole, x).otherwise(0.0).cast("long").cast("string")).otherwise(x.cast("string"))


def count_values(label: str, v: Vector, by: tuple[str, ...] | None, without: tuple[str, ...] | None) -> Vector:
    """How many series of a group have each value; the value becomes a label, in place of one of that name."""
    facts, groups = _grouped(v, by, without)
    rows = facts.groupBy("gid", "t", value_text(F.col("value")).alias("text")).agg(F.count(F.lit(1)).alias("n"))
    named = rows.join(groups, "gid").withColumn("labels", L.put(F.col("labels"), label, F.col("text"))).withColumn("sid", L.fingerprint(F.col("labels")))
    merged = named.groupBy("sid", "labels", "t").agg(F.sum("n").cast("double").alias("value"))
    return Vector(merged.select("sid", "t", F.col("t").alias("sample_ts"), "value"), merged.select("sid", "labels").distinct(), _nameless(by) and label != L.NAME)


def quantile(q: Scalar, v: Vector, by: tuple[str, ...] | None, without: tuple[str, ...] | None) -> Vector:
    """Linear interpolation between the values of a group; below 0 -Inf, above 1 +Inf.

    A constant q is a built-in aggregate whose buffers hold counts of distinct values; a q for each step sorts a group's values.
    """
    facts, groups = _grouped(v, by, without)
    if q.facts is None:
        c = q.constant
        if c != c or not 0 <= c <= 1:
            value = F.lit(ieee.NAN if c != c else -ieee.INF if c < 0 else ieee.INF)
            return _vector(facts.groupBy("gid", "t").agg(F.count(F.lit(1)).alias("n")).withColumn("value", value), groups, _nameless(by))
        return _vector(facts.groupBy("gid", "t").agg(F.percentile("value", c).alias("value")), groups, _nameless(by))
    rows = with_scalar(facts.groupBy("gid", "t").agg(F.array_sort(F.collect_list("value")).alias("a")), q, "q")
    return _vector(rows.withColumn("value", interpolated(F.col("a"), F.col("q"))), groups, _nameless(by))


def aggregate(op: str, v: Vector, param: Scalar | str | None, by: tuple[str, ...] | None, without: tuple[str, ...] | None) -> Vector:
    if op in BUILT_IN:
        return simple(op, v, by, without)
    if op in ("topk", "bottomk"):
        return topk(v, param, by, without, op == "bottomk")
    if op == "quantile":
        return quantile(param, v, by, without)
    if op == "count_values":
        return count_values(param, v, by, without)
    raise QueryError(f"unknown aggregator {op}")
