"""Functions of range vectors.

A sample belongs to the windows of all steps from `low` to `high`. Samples with the same first and last step make a
pane; panes are aggregated first, and only panes are repeated for the steps they belong to. So a window that is a
hundred steps long repeats a pane's few numbers a hundred times, not each of its samples. What looks at the sample
before (resets, changes) takes it once, before windows are made, and gives back what the first of a window counted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import ieee
from tideline.operators.select import first_step, steps_between
from tideline.operators.vector import Grid, RangeVector, Scalar, Vector
from tideline.plans.tree import QueryError


def _spans(rv: RangeVector, grid: Grid) -> DataFrame:
    """Samples with the first and last step of the windows they belong to."""
    at = F.col("ts") + rv.offset
    high = F.lit(grid.start) + F.floor((F.least(F.lit(grid.last), at + rv.range) - grid.start) / F.lit(grid.step)).cast("long") * grid.step
    return rv.samples.withColumn("low", first_step(grid, at)).withColumn("high", high).filter((F.col("low") <= F.col("high")) & (F.col("low") <= grid.last))


def _value() -> Column:
    """The value where it is no stale marker: markers keep a window's row, and count for nothing else."""
    return F.when(~F.col("stale"), F.col("value"))


def _panes(rv: RangeVector, grid: Grid, inner: dict[str, Column], outer: dict[str, Column], before: bool = False) -> DataFrame:
    """Aggregates of windows (sid, t, ..): `inner` over a pane's samples, `outer` over a window's panes."""
    rows = _spans(rv, grid)
    if before:
        seen = Window.partitionBy("sid").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
        held = F.last(F.when(~F.col("stale"), F.struct("ts", "value")), ignorenulls=True).over(seen)
        rows = rows.withColumn("prev", held)
        value, prev = F.col("value"), F.col("prev.value")
        rows = rows.withColumn("drop", F.when(~F.col("stale") & (value < prev) & ~F.isnan(value) & ~F.isnan(prev), prev).otherwise(0.0))
        rows = rows.withColumn("change", (~F.col("stale") & F.col("prev").isNotNull() & (value != prev) & ~(F.isnan(value) & F.isnan(prev))).cast("int"))
        rows = rows.withColumn("reset", (F.col("drop") != 0).cast("int") + (~F.col("stale") & (value < 0) & (prev == 0)).cast("int"))
        rows = rows.withColumn("point", F.when(~F.col("stale"), F.struct("ts", "value", "prev", "drop", "change", "reset")))
    panes = rows.groupBy("sid", "low", "high").agg(*(c.alias(k) for k, c in inner.items()))
    return _over_steps(panes, grid, inner, outer)


def _over_steps(panes: DataFrame, grid: Grid, inner, outer: dict[str, Column]) -> DataFrame:
    """`outer` over the panes of each window; a pane's first step (low) can be used in it."""
    each = panes.select("sid", "low", steps_between(grid, F.col("low"), F.col("high")).alias("t"), *inner)
    return each.groupBy("sid", "t").agg(*(c.alias(k) for k, c in outer.items()))


def _result(rv: RangeVector, rows: DataFrame, value: Column) -> Vector:
    """Windows without a value have no row; the metric name goes."""
    facts = rows.select("sid", "t", F.col("t").alias("sample_ts"), value.cast("double").alias("value")).filter(F.col("value").isNotNull())
    return Vector(facts, rv.series, rv.one_name).without_name()


def _number(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def _simple(name: str, rv: RangeVector, grid: Grid) -> Vector:
    v = _value()
    nan = F.lit(ieee.NAN)
    inner, outer, value = {
        "sum_over_time": ({"a": F.sum(v)}, {"a": F.sum("a")}, _number(F.col("a"))),
        "count_over_time": ({"a": F.count(v)}, {"a": F.sum("a")}, F.col("a")),
        "avg_over_time": ({"a": F.sum(v), "n": F.count(v)}, {"a": F.sum("a"), "n": F.sum("n")}, F.when(F.col("n") == 0, nan).otherwise(F.col("a") / F.greatest(F.col("n"), F.lit(1)))),
        "min_over_time": ({"a": ieee.min_number(v)}, {"a": ieee.min_number(F.col("a"))}, F.col("a")),
        "max_over_time": ({"a": ieee.max_number(v)}, {"a": ieee.max_number(F.col("a"))}, F.col("a")),
    }[name]
    return _result(rv, _panes(rv, grid, inner, outer), value)


def _ends(rv: RangeVector, grid: Grid) -> DataFrame:
    """Of each window: first and last point, number of points, and sums over points of drop, change and reset."""
    inner = {"first": F.min("point"), "last": F.max("point"), "n": F.count("point"), "drops": F.sum("drop"), "changes": F.sum("change"), "resets": F.sum("reset")}
    outer = {"first": F.min("first"), "last": F.max("last"), "n": F.sum("n"), "drops": F.sum("drops"), "changes": F.sum("changes"), "resets": F.sum("resets")}
    return _panes(rv, grid, inner, outer, before=True)


def _extrapolated(rv: RangeVector, grid: Grid, counter: bool, per_second: bool) -> Vector:
    rows = _ends(rv, grid).filter("n >= 2")
    first, last, n = F.col("first"), F.col("last"), F.col("n")
    gain = last["value"] - first["value"] + (F.col("drops") - first["drop"] if counter else F.lit(0.0))
    until_first = (first["ts"] - (F.col("t") - rv.range - rv.offset)) / 1000.0
    after_last = (F.col("t") - rv.offset - last["ts"]) / 1000.0
    sampled = (last["ts"] - first["ts"]) / 1000.0
    rows = rows.select("sid", "t", gain.alias("gain"), until_first.alias("head"), after_last.alias("tail"), sampled.alias("span"), (sampled / (n - 1)).alias("gap"), first["value"].alias("v0"))
    if counter:  # a counter cannot have been below zero
        zero = F.col("span") * F.col("v0") / F.when(F.col("gain") > 0, F.col("gain")).otherwise(1.0)
        rows = rows.withColumn("head", F.when((F.col("gain") > 0) & (F.col("v0") >= 0) & (zero < F.col("head")), zero).otherwise(F.col("head")))
    near = lambda c: F.when(F.col(c) < F.col("gap") * 1.1, F.col(c)).otherwise(F.col("gap") / 2)
    value = F.col("gain") * ((F.col("span") + near("head") + near("tail")) / F.when(F.col("span") == 0, F.lit(None)).otherwise(F.col("span")))
    return _result(rv, rows, value / (rv.range / 1000.0) if per_second else value)


def _last_two(rv: RangeVector, grid: Grid, rate: bool) -> Vector:
    rows = _ends(rv, grid).filter("n >= 2")
    last = F.col("last")
    span = (last["ts"] - last["prev"]["ts"]) / 1000.0
    gain = last["value"] - last["prev"]["value"]
    if rate:
        gain = F.when(last["value"] < last["prev"]["value"], last["value"]).otherwise(gain) / F.when(span == 0, F.lit(None)).otherwise(span)
    return _result(rv, rows, gain)


def _moments(rv: RangeVector, grid: Grid) -> DataFrame:
    """Of each window: n, base, and over (x, y) the sums sx, sy, sxx, sxy, syy of its points.

    y is a value less the series' base (the mean of one of its panes), so that large values with small differences keep
    their digits; x is the time since the step, in seconds. Panes keep their own sums, which are moved to the window's step.
    """
    v = _value()
    x = F.when(v.isNotNull(), (F.col("ts") + rv.offset - F.col("low")) / 1000.0)
    inner = {"n": F.count(v), "m": F.avg(v), "m2": F.var_pop(v) * F.count(v), "sx": F.sum(x), "sxx": F.sum(x * x), "sxv": F.covar_pop(x, v) * F.count(v)}
    panes = _spans(rv, grid).groupBy("sid", "low", "high").agg(*(c.alias(k) for k, c in inner.items())).filter("n > 0")
    finite = ~F.isnan("m") & (F.abs("m") < ieee.INF)
    base = panes.groupBy("sid").agg(F.coalesce(F.min_by("m", F.when(finite, F.col("low"))), F.lit(0.0)).alias("base"))
    n, m = F.col("n"), F.col("m") - F.col("base")  # sums of y, yy and xy from a pane's central moments
    panes = panes.join(base, "sid").select("sid", "low", "high", "n", "base", "sx", "sxx", (n * m).alias("sy"), (F.col("m2") + n * m * m).alias("syy"), (F.col("sxv") + F.col("sx") * m).alias("sxy"))
    d = (F.col("low") - F.col("t")) / 1000.0
    outer = {
        "n": F.sum("n"), "base": F.max("base"), "sx": F.sum(F.col("sx") + F.col("n") * d), "sy": F.sum("sy"), "syy": F.sum("syy"),
        "sxx": F.sum(F.col("sxx") + 2 * d * F.col("sx") + F.col("n") * d * d), "sxy": F.sum(F.col("sxy") + d * F.col("sy")),
    }
    return _over_steps(panes, grid, ("n", "base", "sx", "sxx", "sy", "syy", "sxy"), outer)


def _spread(rv: RangeVector, grid: Grid, root: bool) -> Vector:
    """Population variance or its root."""
    var = (F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")) / F.col("n")
    var = F.when(F.isnan(var), var).otherwise(F.greatest(var, F.lit(0.0)))
    return _result(rv, _moments(rv, grid), F.sqrt(var) if root else var)


def _values_of(rv: RangeVector, grid: Grid) -> DataFrame:
    """a: the values of each window in the order of time. A pane's values are collected once; windows put panes together."""
    inner = {"p": F.collect_list(F.when(~F.col("stale"), F.struct("ts", "value")))}
    rows = _panes(rv, grid, inner, {"p": F.flatten(F.collect_list("p"))})
    return rows.select("sid", "t", F.transform(F.array_sort("p"), lambda p: p["value"]).alias("a"))


def interpolated(sorted_values: Column, q: Column) -> Column:
    """Quantile of an ascending array by linear interpolation; outside 0..1 an infinity, NaN for a q that is NaN; null for an empty array."""
    n = F.size(sorted_values)
    rank = F.when((q >= 0) & (q <= 1), q).otherwise(0.0) * (n - 1)
    low = F.floor(rank).cast("int")
    at = lambda i: F.element_at(sorted_values, F.greatest(F.lit(1), F.least(n, i + 1)).cast("int"))
    weight = rank - low
    inside = F.when(weight == 0, at(low)).otherwise(at(low) * (1 - weight) + at(low + 1) * weight)
    return F.when(n == 0, F.lit(None).cast("double")).when(F.isnan(q), ieee.NAN).when(q < 0, -ieee.INF).when(q > 1, ieee.INF).otherwise(F.when(n == 0, 0.0).otherwise(inside))


def with_scalar(rows: DataFrame, s: Scalar, name: str) -> DataFrame:
    """rows with the scalar of their step as a column."""
    if s.facts is None:
        return rows.withColumn(name, F.lit(s.constant))
    return rows.join(s.facts.select("t", F.col("value").alias(name)), "t")


def quantile_over_time(q: Scalar, rv: RangeVector, grid: Grid) -> Vector:
    rows = _values_of(rv, grid).withColumn("a", F.array_sort("a"))
    return _result(rv, with_scalar(rows, q, "q"), interpolated(F.col("a"), F.col("q")))


def _line(rv: RangeVector, grid: Grid) -> DataFrame:
    """slope (per second) and level (at the step) of each window's least-squares line; none for fewer than two points."""
    rows = _moments(rv, grid).filter("n >= 2")
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    across = n * F.col("sxx") - sx * sx
    rows = rows.withColumn("slope", (n * F.col("sxy") - sx * sy) / F.when(across > 0, across))
    return rows.withColumn("level", (sy - F.col("slope") * sx) / n + F.col("base"))


def deriv(rv: RangeVector, grid: Grid) -> Vector:
    return _result(rv, _line(rv, grid), F.col("slope"))


def predict_linear(rv: RangeVector, ahead: Scalar, grid: Grid) -> Vector:
    # x counts from the step less the offset, the prediction from the step
    return _result(rv, with_scalar(_line(rv, grid), ahead, "ahead"), F.col("level") + F.col("slope") * (F.col("ahead") + rv.offset / 1000.0))


def holt_winters(rv: RangeVector, smooth: Scalar, trend: Scalar, grid: Grid) -> Vector:
    """Double exponential smoothing of a window's values; both factors strictly between 0 and 1."""
    for s in (smooth, trend):
        if s.constant is not None and not 0 < s.constant < 1:
            raise QueryError("holt_winters needs factors between 0 and 1")
    rows = _values_of(rv, grid).filter(F.size("a") >= 2)
    rows = with_scalar(with_scalar(rows, smooth, "sf"), trend, "tf")
    sf, tf, a = F.col("sf"), F.col("tf"), F.col("a")
    step = lambda acc, s1, b: F.struct(acc["now"].alias("old"), s1.alias("now"), b.alias("slope"))
    begin = F.struct(a[0].alias("old"), (sf * a[1] + (1 - sf) * (a[0] + (a[1] - a[0]))).alias("now"), (a[1] - a[0]).alias("slope"))

    def one(acc: Column, x: Column) -> Column:
        slope = tf * (acc["now"] - acc["old"]) + (1 - tf) * acc["slope"]
        return step(acc, sf * x + (1 - sf) * (acc["now"] + slope), slope)

    value = F.aggregate(F.slice(a, F.lit(3), F.size(a)), begin, one, lambda acc: acc["now"])
    return _result(rv, rows, value)


#: name -> (parameters before and after the range vector, function of (range vector, grid, scalars)).
FUNCTIONS: dict[str, Callable[[RangeVector, Grid], Vector]] = {
    **{name: (lambda rv, grid, name=name: _simple(name, rv, grid)) for name in ("sum_over_time", "count_over_time", "avg_over_time", "min_over_time", "max_over_time")},
    "rate": lambda rv, grid: _extrapolated(rv, grid, True, True),
    "increase": lambda rv, grid: _extrapolated(rv, grid, True, False),
    "delta": lambda rv, grid: _extrapolated(rv, grid, False, False),
    "irate": lambda rv, grid: _last_two(rv, grid, True),
    "idelta": lambda rv, grid: _last_two(rv, grid, False),
    "stddev_over_time": lambda rv, grid: _spread(rv, grid, True),
    "stdvar_over_time": lambda rv, grid: _spread(rv, grid, False),
    "changes": lambda rv, grid: _result(rv, _ends(rv, grid), F.col("changes") - F.coalesce(F.col("first")["change"], F.lit(0))),
    "resets": lambda rv, grid: _result(rv, _ends(rv, grid), F.col("resets") - F.coalesce(F.col("first")["reset"], F.lit(0))),
    "deriv": deriv,
}
