"""Queries over several steps against a plain computation."""

import math
import random

import pytest
import spec
from pyspark.sql import functions as F

from tideline.engine import Engine, to_result
from tideline.functions import ieee
from tideline.operators.vector import Grid


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)
    series = {}
    for k in ("a", "b", "c"):
        t, rows = 0, []
        while t < 3_000_000:
            t += rng.choice([10_000, 20_000, 60_000, 400_000, 7_000])
            rows.append((t, float(rng.randint(0, 50)), rng.random() < 0.05))
        series[k] = rows
    return series


@pytest.fixture(scope="module")
def engine(spark, data):
    from tideline.functions import labels as L
    from tideline.sources.store import store_of

    rows = [({"__name__": "m", "k": k}, t, v, s) for k, points in data.items() for t, v, s in points]
    df = spark.createDataFrame(rows, "labels map<string,string>, ts long, value double, stale boolean")
    return Engine(store_of(df.withColumn("labels", L.from_map(F.col("labels")))))


GRIDS = [(0, 3_000_000, 60_000), (30_000, 2_900_000, 47_000), (600_000, 600_000, 1)]


def collected(df):
    return {(r["labels"].get("k"), r["t"]): r["value"] for r in df.collect()}


@pytest.mark.parametrize("grid", GRIDS)
def test_instant(engine, data, grid):
    want = {}
    for k, points in data.items():
        for t in range(grid[0], grid[1] + 1, grid[2]):
            before = [p for p in points if p[0] <= t]
            if before and t - before[-1][0] <= 300_000 and not before[-1][2]:
                want[k, t] = before[-1][1]
    assert collected(engine.query_range("m", *grid)) == want


@pytest.mark.parametrize("grid", GRIDS)
@pytest.mark.parametrize("span, offset", [(120_000, 0), (600_000, 30_000)])
def test_windows(engine, data, grid, span, offset):
    sums, counts, falls = {}, {}, {}
    for k, points in data.items():
        for t in range(grid[0], grid[1] + 1, grid[2]):
            window = [p for p in points if t - offset - span <= p[0] <= t - offset]
            if window:
                live = [v for _, v, s in window if not s]
                sums[k, t], counts[k, t] = sum(live), len(live)
                falls[k, t] = sum(b < a for a, b in zip(live, live[1:], strict=False))
    suffix = f"[{span}ms] offset {offset}ms" if offset else f"[{span}ms]"
    assert collected(engine.query_range(f"sum_over_time(m{suffix})", *grid)) == sums
    assert collected(engine.query_range(f"count_over_time(m{suffix})", *grid)) == counts
    assert collected(engine.query_range(f"resets(m{suffix})", *grid)) == falls


def test_scalars_follow_the_grid(engine):
    rows = engine.query_range("time() + 1", 0, 2000, 1000).collect()
    assert [(r["t"], r["value"]) for r in sorted(rows, key=lambda r: r["t"])] == [(0, 1.0), (1000, 2.0), (2000, 3.0)]


def test_results(engine):
    rows = engine.query_instant("sum(m) * 0 + 1.5", 60_000).collect()
    assert to_result(rows, True) == {"resultType": "vector", "result": [{"metric": {}, "value": [60.0, "1.5"]}]}
    assert to_result(engine.query_instant("1/0", 0).collect(), True, True) == {"resultType": "scalar", "result": [0.0, "+Inf"]}


def test_plan_has_one_shuffle_for_rates(engine):
    rows, trace = engine.traced("rate(m[5m])", 0, 600_000, 60_000)
    assert trace.seconds.keys() == {"parse", "plan", "exec"} and rows
    plan = engine.query_range("rate(m[5m])", 0, 600_000, 60_000)._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def exchanges(engine, text):
    plan = engine.query_range(text, 0, 600_000, 60_000)._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan.count("Scan")


def test_arithmetic_on_aggregates_costs_no_shuffle(engine):
    for text in ("sum by (k) (rate(m[5m]))", "max(rate(m[5m]))", "quantile(0.5, m)", "sum without (k) (m)"):
        assert exchanges(engine, f"{text} * 100") == exchanges(engine, text)


def test_default_matching_needs_no_count(engine):
    """Both sides have one name, so no two series of a side can match alike; on(k) has to look."""
    plan = lambda text: engine.query_range(text, 0, 600_000, 60_000)._jdf.queryExecution().executedPlan().toString()
    assert "raise_error" not in plan("rate(m[5m]) + rate(m[1m])") and "raise_error" in plan("rate(m[5m]) + on(k) rate(m[1m])")


@pytest.mark.parametrize("f", ["stddev_over_time", "stdvar_over_time", "deriv"])
def test_moments_come_from_panes(engine, f):
    """Steps are made after samples are aggregated to panes: the explode stands above an aggregate over the samples."""
    plan = engine.query_range(f"{f}(m[1h])", 0, 3_000_000, 60_000)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "Aggregate" in plan[plan.rindex("Generate") :]


def test_moments_keep_their_digits(spark):
    """Values of a billion that differ by ones, and a series whose first pane is NaN."""
    e = Engine(spec.store(spark, [(1000, "big 1000000001 1000000002 1000000003 1000000004 1000000001"), (1000, "odd NaN 3 4 5 6"), (1000, "flat 7.3 7.3 7.3 7.3 7.3")]))
    one = lambda text: e.query_instant(text, 4000).first()["value"]
    assert one("stdvar_over_time(big[4s])") == pytest.approx(1.36, rel=1e-9) and one("stddev_over_time(flat[4s])") < 1e-12
    assert one("stdvar_over_time(odd[3s])") == pytest.approx(1.25) and math.isnan(one("stdvar_over_time(odd[4s])"))
    assert one("deriv(odd[3s])") == pytest.approx(1.0) and one("predict_linear(odd[3s], 10)") == pytest.approx(16.0)
    assert one("predict_linear(odd[2s] offset 1s, 10)") == pytest.approx(16.0)


def test_grid():
    assert Grid(0, 10, 3).size == 4 and Grid(0, 10, 3).last == 9
    with pytest.raises(ValueError):
        Grid(5, 1, 1)


def test_ieee(spark):
    nan, inf = math.nan, math.inf
    cases = [(1.0, 0.0), (-1.0, 0.0), (1.0, -0.0), (0.0, 0.0), (nan, 0.0), (7.0, -2.0), (-7.0, 2.0), (inf, 2.0)]
    df = spark.createDataFrame(cases, "a double, b double")
    got = df.select(ieee.div(df.a, df.b), ieee.mod(df.a, df.b), ieee.comparison("==", df.a, df.b), ieee.comparison("!=", df.a, df.b)).collect()
    for (a, b), r in zip(cases, got, strict=True):
        assert spec.same(r[0], ieee.fold("/", a, b)), (a, b, r)
        assert spec.same(r[1], ieee.fold("%", a, b)), (a, b, r)
        assert r[2] == (a == b) and r[3] == (a != b)
