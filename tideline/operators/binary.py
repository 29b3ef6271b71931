"""Binary operators: scalars and vectors, vector matching, and the set operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import ieee
from tideline.functions import labels as L
from tideline.operators.ranges import with_scalar
from tideline.operators.vector import Scalar, Vector, keyed
from tideline.plans.parser import COMPARISONS
from tideline.plans.tree import Matching, QueryError

#: Arithmetic takes the metric's name away; powers keep it, as comparisons do.
DROPS_NAME = ("+", "-", "*", "/", "%")


def arithmetic(op: str, a: Column, b: Column) -> Column:
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: ieee.div(a, b), "%": lambda: ieee.mod(a, b), "^": lambda: ieee.power(a, b)}[op]()


def _number(x: float) -> Column:
    return F.lit(float(x))


def scalars(op: str, a: Scalar, b: Scalar, flag: bool) -> Scalar:
    """Two scalars; a comparison gives 1 or 0."""
    if op in COMPARISONS and not flag:
        raise QueryError("a comparison of scalars needs bool")
    if a.facts is None and b.facts is None:
        x, y = a.constant, b.constant
        if op in COMPARISONS:
            return Scalar(float({"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]))
        return Scalar(ieee.fold(op, x, y))
    rows = (a.facts or b.facts).select("t")
    rows = with_scalar(with_scalar(rows, a, "a"), b, "b")
    value = ieee.comparison(op, F.col("a"), F.col("b")) if op in COMPARISONS else arithmetic(op, F.col("a"), F.col("b"))
    return Scalar(facts=rows.select("t", value.cast("double").alias("value")))


def vector_scalar(op: str, v: Vector, s: Scalar, flag: bool, swapped: bool) -> Vector:
    """A vector and a scalar, in this order or swapped. A filter keeps the vector's value."""
    if s.facts is None:
        side, other = v, _number(s.constant)
    else:
        side, other = Vector(with_scalar(v.facts, s, "other"), v.series, v.one_name), F.col("other")
    a, b = (other, F.col("value")) if swapped else (F.col("value"), other)
    if op not in COMPARISONS:
        return side.map(arithmetic(op, a, b), op in DROPS_NAME)
    if flag:
        return side.map(ieee.comparison(op, a, b).cast("double"))
    out = side.where(ieee.comparison(op, a, b))
    return Vector(out.facts.select("sid", "t", "sample_ts", "value"), v.series, v.one_name)


def signature(labels: Column, m: Matching) -> Column:
    """What two series must share: the labels of on(), or all but the name and those of ignoring()."""
    return L.keep(labels, m.on) if m.on is not None else L.drop(labels, [*m.ignoring, L.NAME])


def _signed(v: Vector, m: Matching, result: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Facts with the hash of their series' signature (sig), and the series with it.

    With `result`, the label set that a series has afterwards, also the id of that set (nid): one join brings both.
    An empty on() joins nothing: all series have one signature.
    """
    if m.on == ():
        one = L.fingerprint(F.array().cast(L.TYPE))
        ids = {"sig": one} | ({} if result is None else {"nid": one})
        return v.facts.withColumns(ids), v.series.withColumns(ids)
    series = v.series.withColumn("sig", L.fingerprint(signature(F.col("labels"), m)))
    if result is not None:
        series = series.withColumn("nid", L.fingerprint(result))
    return v.facts.join(series.drop("labels"), "sid"), series


def _single(rows: DataFrame, what: str) -> DataFrame:
    """rows with at most one a signature and step: a second one is an error when the plan runs. The shuffle is the join's own."""
    rest = [c for c in rows.columns if c not in ("sig", "t")]
    one = rows.groupBy("sig", "t").agg(F.count(F.lit(1)).alias("n"), F.any_value(F.struct(*rest)).alias("x"))
    only = F.when(F.col("n") > 1, F.raise_error(F.lit(what)).cast("boolean")).otherwise(F.lit(True))  # as a filter, no optimiser prunes it
    return one.filter(only).select("sig", "t", "x.*")


def _unique(v: Vector, m: Matching) -> bool:
    """Whether no two series can share a signature: it is all labels but the name, in which alone they don't differ."""
    return m.on is None and not m.ignoring and v.one_name


def vectors(op: str, left: Vector, right: Vector, m: Matching, flag: bool) -> Vector:
    """One-to-one, or with group_left / group_right many-to-one matching; series and steps without a partner have no result."""
    many, one = (right, left) if m.group == "right" else (left, right)
    drop_name = op in DROPS_NAME or flag
    labels = F.col("labels")
    if m.on is not None and not m.group:
        labels = L.keep(labels, m.on)
    elif drop_name or not m.group:
        labels = L.drop(labels, [*([] if m.group else m.ignoring), *([L.NAME] if drop_name else [])])
    (many_facts, many_series), (one_facts, one_series) = _signed(many, m, None if m.group else labels), _signed(one, m)
    if not _unique(one, m):
        one_facts = _single(one_facts, f"{op}: two series on the 'one' side have the same matching labels at one step")
    one_facts = one_facts.select("sig", "t", F.col("sid").alias("osid"), F.col("value").alias("other"))
    if not m.group and not _unique(many, m):
        many_facts = _single(many_facts, f"{op}: two series have the same matching labels at one step; if that is meant, say group_left or group_right")
    both = many_facts.join(one_facts, ["sig", "t"])
    a, b = (F.col("other"), F.col("value")) if m.group == "right" else (F.col("value"), F.col("other"))
    if op not in COMPARISONS:
        both = both.withColumn("result", arithmetic(op, a, b))
    elif flag:
        both = both.withColumn("result", ieee.comparison(op, a, b).cast("double"))
    else:
        both = both.filter(ieee.comparison(op, a, b)).withColumn("result", a)
    if not m.include:
        out = Vector(both.select("sid", "t", "sample_ts", F.col("result").alias("value")), many.series, many.one_name)
        renamed = many_series.select("sid", labels.alias("labels"))
        if m.group and not drop_name:
            return Vector(out.facts, renamed, many.one_name)
        if m.group:
            return out.without_name()
        # at most one series of a signature a step: equal label sets never meet, so ids are merged without a check
        facts = both.select(F.col("nid").alias("sid"), "t", "sample_ts", F.col("result").alias("value"))
        return Vector(facts, many_series.select(F.col("nid").alias("sid"), labels.alias("labels")).distinct(), many.one_name or drop_name or m.on is not None and L.NAME not in m.on)
    copied = labels
    for key in m.include:
        copied = L.put(copied, key, L.get(F.col("olabels"), key))
    pairs = many_series.join(one_series.select(F.col("sid").alias("osid"), F.col("labels").alias("olabels"), "sig"), "sig").select("sid", "osid", copied.alias("labels")).withColumn("pid", F.xxhash64("sid", "osid"))
    facts = both.withColumn("pid", F.xxhash64("sid", "osid")).select(F.col("pid").alias("sid"), "t", "sample_ts", F.col("result").alias("value"))
    named = pairs.select(F.col("pid").alias("sid"), "labels").withColumn("nid", L.fingerprint(F.col("labels")))
    rows = facts.join(named.select("sid", "nid"), "sid")
    checked = rows.groupBy("nid", "t").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("value"), F.max("sample_ts").alias("sample_ts"))
    only = F.when(F.col("n") > 1, F.raise_error(F.lit(f"{op}: the labels taken over by the group modifier leave two results with the same labels")).cast("boolean")).otherwise(F.lit(True))
    return Vector(checked.filter(only).select(F.col("nid").alias("sid"), "t", "sample_ts", "value"), named.select(F.col("nid").alias("sid"), "labels").distinct(), drop_name and L.NAME not in m.include)


def sets(op: str, left: Vector, right: Vector, m: Matching) -> Vector:
    """and, or, unless: by signature and step."""
    if m.group:
        raise QueryError("set operators take no grouping")
    if op == "or":
        left, right = keyed(left), keyed(right)
    (a, _), (b, _) = _signed(left, m), _signed(right, m)
    there = b.select("sig", "t")
    if op == "and":
        return Vector(a.join(there, ["sig", "t"], "left_semi").select("sid", "t", "sample_ts", "value"), left.series, left.one_name)
    if op == "unless":
        return Vector(a.join(there, ["sig", "t"], "left_anti").select("sid", "t", "sample_ts", "value"), left.series, left.one_name)
    rest = b.join(a.select("sig", "t"), ["sig", "t"], "left_anti")
    columns = ["sid", "t", "sample_ts", "value"]
    return Vector(a.select(*columns).unionByName(rest.select(*columns)), left.series.unionByName(right.series).distinct())
