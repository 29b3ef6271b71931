"""Queries over the star-schema tables, one for each operator and function, with DuckDB SQL for their results.

Values are rounded to four decimals on both sides: sums of doubles depend on their order in the last places.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.api import Api
from tideline.engine import Engine, result_rows
from tideline.functions import labels as L
from tideline.rules import AlertRule, RecordingRule, alert_states, record
from tideline.sources.exposition import parse_lines, scraped
from tideline.sources.store import Store, clear, compact, load, save, scratch, store_of
from tideline.sources.tables import EPOCH, millis, stores
from tideline.sources.wide import from_wide
from tideline.streaming.ingest import ingest

DAY, HOUR = 86_400_000, 3_600_000
#: All of the events' month (2024-01-01 to 2024-01-31) by hours and by quarter days; all days of the orders (1995 to 2001).
HOURLY = (1_704_067_200_000, 1_706_659_200_000, HOUR)
COARSE = (1_704_067_200_000, 1_706_659_200_000, 6 * HOUR)
DAILY = (788_918_400_000, 1_009_756_800_000, DAY)
ONCE = (EPOCH, EPOCH, 1)

#: Added before rounding, so that sums of hundredths don't fall on the edge between two results.
SHIFT = 0.0000123

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def label(name: str) -> Column:
    return F.try_element_at("labels", F.lit(name))


def query_of(views: str, text: str, labels: str, grid: tuple[int, int, int]) -> Query:
    """A query of the language; its labels become columns, rows without a label have null there."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = Engine(stores(spark, sf_dir, *views.split())).query_range(text, *grid)
        return rows.select(*(label(x).alias(x) for x in labels.split()), "t", (F.round(F.col("value") + SHIFT, 4) + 0.0).alias("value"))

    run.__doc__ = text
    return run


def add(name: str, views: str, text: str, labels: str, grid: tuple[int, int, int], sql: str) -> None:
    QUERIES[name] = query_of(views, text, labels, grid)
    ORACLE_SQL[name] = re.sub(r", 4\)( \+ 0\.0)? AS value", f" + {SHIFT:.7f}::DOUBLE, 4) + 0.0 AS value", sql)


def _grid(g: tuple[int, int, int]) -> str:
    return f"grid AS (SELECT unnest(range({g[0]}::BIGINT, {g[1] + 1}::BIGINT, {g[2]}::BIGINT)) AS t)"


#: Samples of the views.
EV = "ev AS (SELECT event_type, epoch_us(ts) // 1000 AS ts, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2)"
TOTAL = f"ev AS (SELECT event_type, epoch_us(ts) // 1000 AS ts, any_value((epoch_us(ts) // 1000 % {DAY}) / 1000.0::DOUBLE) AS value FROM events GROUP BY 1, 2)"
USER = "eu AS (SELECT event_type, user_id::VARCHAR AS user_id, epoch_us(ts) // 1000 AS ts, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2, 3)"
OUT = "SELECT event_type, t, round(value, 4) + 0.0 AS value FROM "


def _instant(offset: int = 0, where: str = "true", name: str = "s") -> str:
    """Newest sample of each step within five minutes."""
    return f"{name} AS (SELECT event_type, t, arg_max(value, ts) AS value, max(ts) AS ts FROM grid JOIN ev ON ts <= t - {offset} AND ts >= t - {offset} - 300000 WHERE {where} GROUP BY 1, 2)"


def _window(span: int, offset: int = 0, source: str = "ev", name: str = "w") -> str:
    return f"{name} AS (SELECT s.*, t FROM grid JOIN {source} s ON s.ts <= t - {offset} AND s.ts >= t - {offset} - {span})"


# Selectors
add("sel_instant", "event_value", "event_value", "event_type", HOURLY, f"WITH {_grid(HOURLY)}, {EV}, {_instant()} {OUT} s")
add("sel_offset", "event_value", "event_value offset 1d", "event_type", HOURLY, f"WITH {_grid(HOURLY)}, {EV}, {_instant(DAY)} {OUT} s")
for key, matcher, where in (
    ("sel_equal", '="error"', "event_type = 'error'"),
    ("sel_not_equal", '!="error"', "event_type <> 'error'"),
    ("sel_regex", '=~"s.*|view"', "regexp_full_match(event_type, 's.*|view')"),
    ("sel_not_regex", '!~".*i.*"', "NOT regexp_full_match(event_type, '.*i.*')"),
):
    add(key, "event_value", f"event_value{{event_type{matcher}}}", "event_type", HOURLY, f"WITH {_grid(HOURLY)}, {EV}, {_instant(0, where)} {OUT} s")
add("sel_missing_label", "event_value event_user", '{__name__=~"event_.*",user_id="",event_type="view"}', "event_type", HOURLY, f"WITH {_grid(HOURLY)}, {EV}, {_instant(0, "event_type = 'view'")} {OUT} s")

# Aggregations over the sums of six hours of each user
_SUMS = f"{_grid(COARSE)}, {USER}, w AS (SELECT event_type, user_id, t, sum(value) AS v FROM grid JOIN eu ON ts <= t AND ts >= t - {6 * HOUR} GROUP BY 1, 2, 3)"
_TEXT = "sum_over_time(event_user[6h])"
for op, f in {"sum": "sum(v)", "avg": "avg(v)", "count": "count(*)::DOUBLE", "min": "min(v)", "max": "max(v)", "stddev": "stddev_pop(v)", "stdvar": "var_pop(v)"}.items():
    add(f"agg_{op}_by", "event_user", f"{op} by (event_type) ({_TEXT})", "event_type", COARSE, f"WITH {_SUMS} SELECT event_type, t, round({f}, 4) + 0.0 AS value FROM w GROUP BY 1, 2")
    add(f"agg_{op}_without", "event_user", f"{op} without (event_type) ({_TEXT})", "user_id", COARSE, f"WITH {_SUMS} SELECT user_id, t, round({f}, 4) + 0.0 AS value FROM w GROUP BY 1, 2")
    add(f"agg_{op}", "event_user", f"{op}({_TEXT})", "", COARSE, f"WITH {_SUMS} SELECT t, round({f}, 4) + 0.0 AS value FROM w GROUP BY 1")
_RANK = "SELECT event_type, t, round(v, 4) + 0.0 AS value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, t ORDER BY v {}) AS r FROM w) WHERE r <= 3"
add("agg_topk", "event_user", f"topk by (event_type) (3, {_TEXT})", "event_type", COARSE, f"WITH {_SUMS} {_RANK.format('DESC')}")
add("agg_bottomk", "event_user", f"bottomk by (event_type) (3, {_TEXT})", "event_type", COARSE, f"WITH {_SUMS} {_RANK.format('')}")
add("agg_topk_scalar", "event_user", f"topk(scalar(vector(2)), {_TEXT})", "event_type", COARSE, f"WITH {_SUMS} SELECT event_type, t, round(v, 4) + 0.0 AS value FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY v DESC) AS r FROM w) WHERE r <= 2")
add("agg_quantile", "event_user", f"quantile by (event_type) (0.9, {_TEXT})", "event_type", COARSE, f"WITH {_SUMS} SELECT event_type, t, round(quantile_cont(v, 0.9), 4) + 0.0 AS value FROM w GROUP BY 1, 2")
add("agg_quantile_scalar", "event_user", f"quantile by (event_type) (scalar(vector(0.25)), {_TEXT})", "event_type", COARSE, f"WITH {_SUMS} SELECT event_type, t, round(quantile_cont(v, 0.25), 4) + 0.0 AS value FROM w GROUP BY 1, 2")
add("agg_count_values", "event_user", 'count_values by (event_type) ("n", count_over_time(event_user[6h]))', "event_type n", COARSE, f"WITH {_SUMS.replace('sum(value) AS v', 'count(*) AS v')} SELECT event_type, v::VARCHAR AS n, t, count(*)::DOUBLE AS value FROM w GROUP BY 1, 2, 3")

# Functions of range vectors
_W = f"{_grid(HOURLY)}, {EV}, {_window(3 * HOUR)}"
for fn, f in {
    "avg": "avg(value)", "sum": "sum(value)", "count": "count(*)::DOUBLE", "min": "min(value)", "max": "max(value)", "stddev": "stddev_pop(value)", "stdvar": "var_pop(value)",
}.items():
    add(f"rng_{fn}_over_time", "event_value", f"{fn}_over_time(event_value[3h])", "event_type", HOURLY, f"WITH {_W} SELECT event_type, t, round({f}, 4) + 0.0 AS value FROM w GROUP BY 1, 2")
add("rng_quantile_over_time", "event_value", "quantile_over_time(0.3, event_value[3h])", "event_type", HOURLY, f"WITH {_W} SELECT event_type, t, round(quantile_cont(value, 0.3), 4) + 0.0 AS value FROM w GROUP BY 1, 2")
_SEEN = "seen AS (SELECT *, lag(value) OVER p AS pv, lag(ts) OVER p AS pts FROM ev WINDOW p AS (PARTITION BY event_type ORDER BY ts))"
_ENDS = """ends AS (SELECT event_type, t, count(*) AS n, min(ts) AS t0, max(ts) AS t1, arg_min(value, ts) AS v0, arg_max(value, ts) AS v1, arg_max(pv, ts) AS pv1, arg_max(pts, ts) AS pt1,
  sum(CASE WHEN value < pv THEN pv ELSE 0 END) - coalesce(arg_min(CASE WHEN value < pv THEN pv ELSE 0 END, ts), 0) AS fell,
  sum((value < pv)::INT) - arg_min(coalesce((value < pv)::INT, 0), ts) AS resets, sum((value <> pv)::INT) - arg_min(coalesce((value <> pv)::INT, 0), ts) AS changes FROM w GROUP BY 1, 2)"""


def _rate(counter: bool, span: int, per: str) -> str:
    gain = "v1 - v0 + fell" if counter else "v1 - v0"
    head = "CASE WHEN gain > 0 AND v0 >= 0 AND span * v0 / gain < head THEN span * v0 / gain ELSE head END" if counter else "head"
    return (
        f"WITH {_grid(HOURLY)}, {TOTAL}, {_SEEN}, {_window(span, 0, 'seen')}, {_ENDS}, "
        f"a AS (SELECT event_type, t, {gain} AS gain, v0, (t0 - (t - {span})) / 1000.0::DOUBLE AS head, (t - t1) / 1000.0::DOUBLE AS tail, (t1 - t0) / 1000.0::DOUBLE AS span, (t1 - t0) / 1000.0::DOUBLE / (n - 1) AS gap FROM ends WHERE n >= 2), "
        f"b AS (SELECT *, {head} AS h FROM a) SELECT event_type, t, round(gain * ((span + CASE WHEN h < gap * 1.1::DOUBLE THEN h ELSE gap / 2 END + CASE WHEN tail < gap * 1.1::DOUBLE THEN tail ELSE gap / 2 END) / span){per}, 4) + 0.0 AS value FROM b"
    )


add("rng_rate", "event_total", "rate(event_total[3h])", "event_type", HOURLY, _rate(True, 3 * HOUR, " / 10800.0::DOUBLE"))
add("rng_increase", "event_total", "increase(event_total[3h])", "event_type", HOURLY, _rate(True, 3 * HOUR, ""))
add("rng_delta", "event_total", "delta(event_total[3h])", "event_type", HOURLY, _rate(False, 3 * HOUR, ""))
_BOTH = f"WITH {_grid(HOURLY)}, {TOTAL}, {_SEEN}, {_window(3 * HOUR, 0, 'seen')}, {_ENDS} "
add("rng_irate", "event_total", "irate(event_total[3h])", "event_type", HOURLY, _BOTH + "SELECT event_type, t, round(CASE WHEN v1 < pv1 THEN v1 ELSE v1 - pv1 END / ((t1 - pt1) / 1000.0::DOUBLE), 4) + 0.0 AS value FROM ends WHERE n >= 2")
add("rng_idelta", "event_total", "idelta(event_total[3h])", "event_type", HOURLY, _BOTH + "SELECT event_type, t, round(v1 - pv1, 4) + 0.0 AS value FROM ends WHERE n >= 2")
add("rng_resets", "event_total", "resets(event_total[3h])", "event_type", HOURLY, _BOTH + "SELECT event_type, t, resets::DOUBLE AS value FROM ends")
add("rng_changes", "event_total", "changes(event_total[3h])", "event_type", HOURLY, _BOTH + "SELECT event_type, t, changes::DOUBLE AS value FROM ends")
add("rng_deriv", "event_value", "deriv(event_value[6h])", "event_type", COARSE, f"WITH {_grid(COARSE)}, {EV}, {_window(6 * HOUR)} SELECT event_type, t, round(regr_slope(value, (ts - t) / 1000.0::DOUBLE), 4) + 0.0 AS value FROM w GROUP BY 1, 2 HAVING count(*) > 1")
add("rng_predict_linear", "event_value", "predict_linear(event_value[6h], 60)", "event_type", COARSE, f"WITH {_grid(COARSE)}, {EV}, {_window(6 * HOUR)} SELECT event_type, t, round(regr_intercept(value, (ts - t) / 1000.0::DOUBLE) + 60 * regr_slope(value, (ts - t) / 1000.0::DOUBLE), 4) + 0.0 AS value FROM w GROUP BY 1, 2 HAVING count(*) > 1")
add(
    "rng_holt_winters", "event_value", "holt_winters(event_value[6h], 0.3, 0.6)", "event_type", COARSE,
    f"WITH RECURSIVE {_grid(COARSE)}, {EV}, {_window(6 * HOUR)}, o AS (SELECT event_type, t, value, row_number() OVER (PARTITION BY event_type, t ORDER BY ts) AS i, count(*) OVER (PARTITION BY event_type, t) AS n FROM w), "
    "h AS (SELECT a.event_type, a.t, 2::BIGINT AS i, a.n, a.value AS s0, 0.3::DOUBLE * b.value + 0.7::DOUBLE * (a.value + (b.value - a.value)) AS s1, b.value - a.value AS b "
    "FROM o a JOIN o b ON a.event_type = b.event_type AND a.t = b.t AND a.i = 1 AND b.i = 2 UNION ALL "
    "SELECT h.event_type, h.t, h.i + 1, h.n, h.s1, 0.3::DOUBLE * o.value + 0.7::DOUBLE * (h.s1 + (0.6::DOUBLE * (h.s1 - h.s0) + 0.4::DOUBLE * h.b)), 0.6::DOUBLE * (h.s1 - h.s0) + 0.4::DOUBLE * h.b "
    "FROM h JOIN o ON o.event_type = h.event_type AND o.t = h.t AND o.i = h.i + 1) SELECT event_type, t, round(s1, 4) + 0.0 AS value FROM h WHERE i = n",
)
add("rng_subquery", "event_value", "max_over_time(sum by (event_type) (sum_over_time(event_value[1h]))[6h:1h])", "event_type", COARSE, f"WITH {_grid(COARSE)}, {EV}, {_grid((COARSE[0] - 6 * HOUR, COARSE[1], HOUR)).replace('grid AS', 'fine AS')}, x AS (SELECT event_type, fine.t AS ts, sum(value) AS v FROM fine JOIN ev ON ts <= fine.t AND ts >= fine.t - {HOUR} GROUP BY 1, 2) SELECT event_type, t, round(max(v), 4) + 0.0 AS value FROM grid JOIN x ON x.ts <= t AND x.ts >= t - {6 * HOUR} GROUP BY 1, 2")

# Binary operators: a is an average of three hours, b the one before
_A, _B = "avg_over_time(event_value[3h])", "avg_over_time(event_value[3h] offset 3h)"
_AB = f"WITH {_grid(HOURLY)}, {EV}, {_window(3 * HOUR)}, {_window(3 * HOUR, 3 * HOUR, 'ev', 'w2')}, a AS (SELECT event_type, t, avg(value) AS a FROM w GROUP BY 1, 2), b AS (SELECT event_type, t, avg(value) AS b FROM w2 GROUP BY 1, 2), ab AS (SELECT * FROM a JOIN b USING (event_type, t)) SELECT event_type, t, round({{}}, 4) + 0.0 AS value FROM ab WHERE {{}}"
for key, op, f in (("add", "+", "a + b"), ("sub", "-", "a - b"), ("mul", "*", "a * b"), ("div", "/", "a / b"), ("mod", "%", "fmod(a, b)"), ("pow", "^ 0.5 *", "a ** 0.5::DOUBLE * b")):
    add(f"bin_{key}", "event_value", f"{_A} {op} {_B}", "event_type", HOURLY, _AB.format(f, "true"))
for key, op in (("gt", ">"), ("lt", "<"), ("ge", ">="), ("le", "<=")):
    add(f"bin_{key}", "event_value", f"{_A} {op} {_B}", "event_type", HOURLY, _AB.format("a", f"a {op} b"))
    add(f"bin_{key}_bool", "event_value", f"{_A} {op} bool {_B}", "event_type", HOURLY, _AB.format(f"(a {op} b)::INT::DOUBLE", "true"))
for key, op, sql in (("eq", "==", "="), ("ne", "!=", "<>")):  # of averages cut to whole tens, of which some are equal
    _ten = f"floor(a / 10) {sql} floor(b / 10)"
    add(f"bin_{key}", "event_value", f"floor({_A} / 10) {op} floor({_B} / 10)", "event_type", HOURLY, _AB.format("floor(a / 10)", _ten))
    add(f"bin_{key}_bool", "event_value", f"floor({_A} / 10) {op} bool floor({_B} / 10)", "event_type", HOURLY, _AB.format(f"({_ten})::INT::DOUBLE", "true"))
add("bin_aggregate_scalar", "event_total", "sum by (event_type) (rate(event_total[3h])) * 100", "event_type", HOURLY, f"SELECT event_type, t, round(value * 100, 4) + 0.0 AS value FROM ({_rate(True, 3 * HOUR, ' / 10800.0::DOUBLE').replace('round(gain', '(gain').replace(', 4) + 0.0 AS value', ') AS value')})")
add("bin_scalar_left", "event_value", f"100 - {_A}", "event_type", HOURLY, _AB.format("100 - a", "true").replace("a JOIN b USING (event_type, t)", "a"))
add("bin_scalar_filter", "event_value", f"40 < {_A}", "event_type", HOURLY, _AB.format("a", "a > 40").replace("a JOIN b USING (event_type, t)", "a"))
add("bin_scalar_fold", "event_value", "2 * 3 ^ 2 % 5 - 1 / 4", "", HOURLY, f"WITH {_grid(HOURLY)} SELECT t, 2.75::DOUBLE AS value FROM grid")
add("bin_time", "event_value", f"{_A} + time() / 1000000", "event_type", HOURLY, _AB.format("a + t / 1000.0::DOUBLE / 1000000", "true").replace("a JOIN b USING (event_type, t)", "a"))
add("bin_unary_minus", "event_value", f"-{_A}", "event_type", HOURLY, _AB.format("-a", "true").replace("a JOIN b USING (event_type, t)", "a"))
add("bin_unary_plus", "event_value", "+event_value", "event_type", HOURLY, f"WITH {_grid(HOURLY)}, {EV}, {_instant()} {OUT} s")
_ORD = f"{_grid(DAILY)}, o AS (SELECT o_orderpriority AS priority, o_orderstatus AS status, epoch_ms(date_trunc('day', o_orderdate)) AS t, sum(o_totalprice) AS value FROM orders JOIN grid ON epoch_ms(date_trunc('day', o_orderdate)) = t GROUP BY 1, 2, 3)"
add("bin_ignoring", "order_price", 'order_price{status="F"} / ignoring(status) order_price{status="O"}', "priority", DAILY, f"WITH {_ORD} SELECT a.priority, a.t, round(a.value / b.value, 4) + 0.0 AS value FROM o a JOIN o b ON a.priority = b.priority AND a.t = b.t AND a.status = 'F' AND b.status = 'O'")
add("bin_on", "order_price", 'order_price{status="F"} > on(priority) order_price{status="O"}', "priority", DAILY, f"WITH {_ORD} SELECT a.priority, a.t, round(a.value, 4) + 0.0 AS value FROM o a JOIN o b ON a.priority = b.priority AND a.t = b.t AND a.status = 'F' AND b.status = 'O' AND a.value > b.value")
add("bin_group_left", "order_price", "order_price / on(priority) group_left sum by (priority) (order_price)", "priority status", DAILY, f"WITH {_ORD}, p AS (SELECT priority, t, sum(value) AS s FROM o GROUP BY 1, 2) SELECT priority, status, t, round(value / s, 4) + 0.0 AS value FROM o JOIN p USING (priority, t)")
add("bin_group_right", "order_price", "sum by (priority) (order_price) - on(priority) group_right order_price", "priority status", DAILY, f"WITH {_ORD}, p AS (SELECT priority, t, sum(value) AS s FROM o GROUP BY 1, 2) SELECT priority, status, t, round(s - value, 4) + 0.0 AS value FROM o JOIN p USING (priority, t)")
_SUP = f"s AS (SELECT n_name AS nation, s_name AS supplier, r_name AS region, {EPOCH}::BIGINT AS t, s_acctbal AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
add("bin_group_left_labels", "supplier_bal nation_info", "supplier_bal * on(nation) group_left(region) nation_info", "nation supplier region", ONCE, f"WITH {_SUP} SELECT nation, supplier, region, t, round(value, 4) + 0.0 AS value FROM s")
add("bin_join_then_aggregate", "supplier_bal nation_info", "sum by (region) (supplier_bal * on(nation) group_left(region) nation_info)", "region", ONCE, f"WITH {_SUP} SELECT region, t, round(sum(value), 4) + 0.0 AS value FROM s GROUP BY 1, 2")

# Set operators
_ST = f"WITH {_grid(HOURLY)}, {EV}, {_instant()}, {_instant(0, 'true', 's2')} "
add("set_and", "event_value", 'event_value > 30 and event_value < 60', "event_type", HOURLY, _ST + OUT + "s WHERE value > 30 AND value < 60")
add("set_unless", "event_value", "event_value unless event_value > 50", "event_type", HOURLY, _ST + OUT + "s WHERE NOT value > 50")
add("set_or", "event_value", "event_value > 80 or event_value < 10", "event_type", HOURLY, _ST + OUT + "s WHERE value > 80 OR value < 10")
add("set_and_on", "order_price", 'order_price and on(status) order_price{priority="1-URGENT"} > 100000', "priority status", DAILY, f"WITH {_ORD} SELECT priority, status, t, round(value, 4) + 0.0 AS value FROM o WHERE EXISTS (FROM o b WHERE b.t = o.t AND b.status = o.status AND b.priority = '1-URGENT' AND b.value > 100000)")

# Functions of instant vectors
_I = f"WITH {_grid(HOURLY)}, {EV}, {_instant()} SELECT event_type, t, round({{}}, 4) + 0.0 AS value FROM s"
for fn, f in {
    "abs": ("abs(event_value - 50)", "abs(value - 50)"), "ceil": ("ceil(event_value)", "ceil(value)"), "floor": ("floor(event_value)", "floor(value)"),
    "round": ("round(event_value)", "floor(value + 0.5::DOUBLE)"), "round_to": ("round(event_value, 5)", "floor(value * (1 / 5.0::DOUBLE) + 0.5::DOUBLE) / (1 / 5.0::DOUBLE)"), "sqrt": ("sqrt(event_value)", "sqrt(value)"),
    "exp": ("exp(event_value / 100)", "exp(value / 100)"), "ln": ("ln(event_value)", "ln(value)"), "log2": ("log2(event_value)", "log2(value)"), "log10": ("log10(event_value)", "log10(value)"),
    "clamp_max": ("clamp_max(event_value, 40)", "least(value, 40)"), "clamp_min": ("clamp_min(event_value, 40)", "greatest(value, 40)"), "timestamp": ("timestamp(event_value)", "ts / 1000.0::DOUBLE"),
    "sort": ("sort(event_value)", "value"), "sort_desc": ("sort_desc(event_value)", "value"),
}.items():
    add(f"fn_{fn}", "event_value", f[0], "event_type", HOURLY, _I.format(f[1]))
for fn, f in {"year": "year(d)", "month": "month(d)", "day_of_month": "day(d)", "days_of_month": "day(d)", "day_of_week": "isodow(d)", "days_of_week": "isodow(d)", "hour": "hour(d)", "minute": "minute(d)", "days_in_month": "day(last_day(d))"}.items():
    add(f"fn_{fn}", "event_value", f"{fn}(timestamp(event_value))", "event_type", HOURLY, f"WITH {_grid(HOURLY)}, {EV}, {_instant()}, x AS (SELECT event_type, t, make_timestamp(ts * 1000) AS d FROM s) SELECT event_type, t, ({f})::DOUBLE AS value FROM x")
add("fn_hour_of_step", "event_value", "hour()", "", HOURLY, f"WITH {_grid(HOURLY)} SELECT t, hour(make_timestamp(t * 1000))::DOUBLE AS value FROM grid")
add("fn_time", "event_value", "time()", "", HOURLY, f"WITH {_grid(HOURLY)} SELECT t, round(t / 1000.0::DOUBLE, 4) AS value FROM grid")
add("fn_vector", "event_value", "vector(time() * 2)", "", HOURLY, f"WITH {_grid(HOURLY)} SELECT t, round(t / 1000.0::DOUBLE * 2, 4) AS value FROM grid")
add("fn_scalar", "event_value", 'scalar(event_value{event_type="view"})', "", HOURLY, f"WITH {_grid(HOURLY)}, {EV}, {_instant(0, "event_type = 'view'")} SELECT grid.t, round(coalesce(value, 'nan'::DOUBLE), 4) + 0.0 AS value FROM grid LEFT JOIN s ON s.t = grid.t")
add("fn_absent", "event_value", 'absent(event_value{event_type="view"})', "event_type", HOURLY, f"WITH {_grid(HOURLY)}, {EV}, {_instant(0, "event_type = 'view'")} SELECT 'view' AS event_type, t, 1.0::DOUBLE AS value FROM grid WHERE t NOT IN (SELECT t FROM s)")
add("lbl_replace", "supplier_bal", 'label_replace(supplier_bal, "number", "n$1", "supplier", "[^0-9]*0*([0-9]+)")', "nation supplier number", ONCE, rf"WITH {_SUP} SELECT nation, supplier, CASE WHEN regexp_full_match(supplier, '[^0-9]*0*([0-9]+)') THEN 'n' || regexp_extract(supplier, '^[^0-9]*0*([0-9]+)$', 1) END AS number, t, round(value, 4) + 0.0 AS value FROM s")
add("lbl_join", "supplier_bal", 'label_join(supplier_bal, "both", "/", "nation", "supplier")', "both", ONCE, f"WITH {_SUP} SELECT nation || '/' || supplier AS \"both\", t, round(value, 4) + 0.0 AS value FROM s")
_HQ = f"""WITH {_grid(HOURLY)}, h AS (SELECT event_type, (epoch_us(ts) // 1000 // {HOUR} + 1) * {HOUR} AS t, value FROM events), hh AS (SELECT h.* FROM h JOIN grid USING (t)),
  b AS (SELECT event_type, t, le, count_if(value <= le)::DOUBLE AS c FROM hh, (SELECT unnest([10.0, 25.0, 50.0, 100.0, 200.0, 'inf'::DOUBLE]) AS le) GROUP BY 1, 2, 3),
  x AS (SELECT *, lag(le) OVER p AS low, coalesce(lag(c) OVER p, 0) AS under, max(c) OVER (PARTITION BY event_type, t) AS total FROM b WINDOW p AS (PARTITION BY event_type, t ORDER BY le)),
  y AS (SELECT *, row_number() OVER (PARTITION BY event_type, t ORDER BY le) AS r FROM x WHERE c >= 0.7 * total)
  SELECT event_type, t, round(CASE WHEN le = 'inf' THEN 200.0 ELSE coalesce(low, 0) + (le - coalesce(low, 0)) * ((0.7 * total - under) / (c - under)) END, 4) + 0.0 AS value FROM y WHERE r = 1"""
add("hist_quantile", "event_latency_bucket", "histogram_quantile(0.7, event_latency_bucket)", "event_type", HOURLY, _HQ)

# The benchmark's shapes
_LONG = f"WITH {_grid(COARSE)}, {EV}, {_window(DAY)} "
add("bench_avg_day", "event_value", "avg_over_time(event_value[1d])", "event_type", COARSE, _LONG + "SELECT event_type, t, round(avg(value), 4) + 0.0 AS value FROM w GROUP BY 1, 2")
add("bench_sum_filtered", "event_value", 'sum_over_time(event_value{event_type="view"}[1d]) + on() sum_over_time(event_value{event_type="error"}[1d]) + on() sum_over_time(event_value{event_type="click"}[1d]) + on() sum_over_time(event_value{event_type="signup"}[1d])', "", COARSE, _LONG + "SELECT t, round(sum(value), 4) + 0.0 AS value FROM w WHERE event_type IN ('view', 'error', 'click', 'signup') GROUP BY 1 HAVING count(DISTINCT event_type) = 4")
add("bench_max_rate", "event_total", "max(rate(event_total[3h]))", "", HOURLY, f"SELECT t, max(value) AS value FROM ({_rate(True, 3 * HOUR, ' / 10800.0::DOUBLE')}) GROUP BY 1")


# Sources, rules and lookups
def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", "event_type", "user_id", "value", millis(e.ts).alias("ms"))


def _labelled(rows: DataFrame, *names: str) -> list[Column]:
    return [L.get(rows.labels, n).alias(n.strip("_")) for n in names]


def import_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide table of hourly sums, a column for each event type, read as a store."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    hour = F.floor(F.col("ms") / HOUR) * HOUR
    wide = _events(spark, sf_dir).groupBy(hour.alias("ts")).pivot("event_type", kinds).agg(F.sum("value"))
    for k in kinds:
        wide = wide.withColumnRenamed(k, f'hourly{{event_type="{k}"}}')
    store = from_wide(wide)
    rows = store.samples.join(store.series, "sid")
    return rows.select(*_labelled(rows, "__name__", "event_type"), "ts", (F.round(F.col("value") + SHIFT, 4) + 0.0).alias("value"))


def exposition_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as exposition lines among comments, and parsed again."""
    e = _events(spark, sf_dir)
    line = F.format_string('app:%s{user="%s", note="a \\"b\\""} %s %s', "event_type", F.col("user_id").cast("string"), F.col("value").cast("string"), F.col("ms").cast("string"))
    lines = e.select(F.explode(F.array(F.lit("# HELP x y"), line, F.lit(""))).alias("value"))
    rows = parse_lines(lines)
    return rows.select(*_labelled(rows, "__name__", "user", "note"), "value", "ts")


def ingest_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the samples of one user in one hour the last written counts."""
    e = _events(spark, sf_dir)
    labels = L.of_columns({L.NAME: F.lit("u"), "user_id": F.col("user_id")})
    store = store_of(e.select(labels.alias("labels"), (F.floor(F.col("ms") / HOUR) * HOUR).alias("ts"), "value", "event_id"), "event_id")
    rows = store.samples.join(store.series, "sid")
    return rows.select(*_labelled(rows, "user_id"), "ts", "value")


ALERT_AT = (HOURLY[0] + 5 * DAY, HOURLY[0] + 5 * DAY + HOUR)
ALERT = AlertRule("busy", "avg_over_time(event_value[3h]) > 40", wait=HOUR)


def alert_two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of an alert after a second run, an hour after the first."""
    engine = Engine(stores(spark, sf_dir, "event_value"))
    second = alert_states(engine, ALERT, ALERT_AT[1], alert_states(engine, ALERT, ALERT_AT[0]))
    return second.select(label("event_type").alias("event_type"), "fired_since", "status")


def recording_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a recording rule adds to the store."""
    store = record(Engine(stores(spark, sf_dir, "event_user")), RecordingRule("type:sum", "sum by (event_type) (sum_over_time(event_user[1d]))", {"team": "a"}), ALERT_AT[0])
    rows = store.samples.join(store.series, "sid")
    return rows.select(*_labelled(rows, "__name__", "event_type", "team"), "ts", (F.round(F.col("value") + SHIFT, 4) + 0.0).alias("value"))


def series_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label sets of series that match either of two selectors."""
    rows = Engine(stores(spark, sf_dir, "event_user")).series('event_user{user_id=~"1.*"}', 'event_user{event_type="view",user_id!="7"}')
    return rows.select(*(label(x).alias(x) for x in ("event_type", "user_id")))


def label_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(stores(spark, sf_dir, "event_user")).label_values("user_id")


def json_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each series of a range query, with its points in order: number, first and last."""
    rows = result_rows(Engine(stores(spark, sf_dir, "event_value")).query_range("sum_over_time(event_value[6h])", *COARSE))
    p = F.col("points")
    return rows.select(label("event_type").alias("event_type"), F.size(p).cast("long").alias("n"), p[0]["t"].alias("first_t"), F.element_at(p, -1)["t"].alias("last_t"), (F.round(p[0]["value"] + SHIFT, 4) + 0.0).alias("value"))


def scrape_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scrapes of one instance for each event type, with labels added and an up sample; errors stand for failed scrapes."""
    e = _events(spark, sf_dir)
    ok = F.col("event_type") != "error"
    rows = e.select("event_type", F.when(ok, L.of_columns({L.NAME: F.lit("seen"), "user": F.col("user_id")})).alias("labels"), F.when(ok, F.col("user_id").cast("double")).alias("value"), ok.cast("double").alias("up"))
    out = scraped(rows, F.lit(EPOCH), F.col("event_type"), F.lit("app"), up=F.col("up")).distinct()
    return out.select(*_labelled(out, "__name__", "instance", "job", "user"), "ts", "value")


def _user_hours(spark: SparkSession, sf_dir: str, where: Column | None = None, more: float = 0.0) -> Store:
    """Sums of each user's hours as a store; `more` is added to each."""
    e = _events(spark, sf_dir)
    hours = (e if where is None else e.filter(where)).groupBy("user_id", (F.floor(F.col("ms") / HOUR) * HOUR).alias("ts")).agg((F.sum("value") + more).alias("value"))
    return store_of(hours.select(L.of_columns({L.NAME: F.lit("user_hour"), "user_id": F.col("user_id")}).alias("labels"), "ts", "value"))


def _stored(spark: SparkSession, path: str) -> DataFrame:
    rows = Engine(load(spark, path)).query_range("user_hour", HOURLY[0], HOURLY[1], HOUR)
    return rows.select(label("user_id").alias("user_id"), "t", (F.round(F.col("value") + SHIFT, 4) + 0.0).alias("value"))


def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved, partly saved again, one day compacted, and queried: the last written counts."""
    path = scratch(spark, "store")
    save(_user_hours(spark, sf_dir), path)
    save(_user_hours(spark, sf_dir, F.col("user_id") % 2 == 0, 1000.0), path)
    compact(spark, path, [HOURLY[0] // DAY + 3])
    return _stored(spark, path)


CLEARED = (HOURLY[0] + 5 * DAY + 7 * HOUR, HOURLY[0] + 9 * DAY + 3 * HOUR)


def store_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved store without a range of four days, which begins and ends within a day."""
    path = scratch(spark, "store")
    save(_user_hours(spark, sf_dir), path)
    clear(spark, path, *CLEARED)
    return _stored(spark, path)


def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as a stream, each twice, taken into a store once; and the store queried."""
    path, mark = scratch(spark, "store"), scratch(spark, "mark")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("twice", F.explode(F.array(F.lit(1), F.lit(2))))
    labels = L.of_columns({L.NAME: F.lit("event"), "user_id": F.col("user_id"), "event_type": F.col("event_type"), "event_id": F.col("event_id")})
    ingest(e.select(labels.alias("labels"), millis(e.ts).alias("ts"), "value", e.ts.cast("timestamp").alias("at")), path, mark).awaitTermination()
    rows = Engine(load(spark, path)).query_range("count by (event_type) (count_over_time(event[6h]))", *COARSE)
    return rows.select(label("event_type").alias("event_type"), "t", "value")


def http_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a range query's answer over HTTP: labels, times in seconds and values as text, a row for each point."""
    path = scratch(spark, "store")
    save(stores(spark, sf_dir, "event_value"), path)
    status, body = Api(spark, path).handle("GET", "/api/v1/query_range", {"query": ["count_over_time(event_value[6h])"], "start": [str(COARSE[0] // 1000)], "end": [str(COARSE[1] // 1000)], "step": ["6h"]})
    if status != 200:
        raise RuntimeError(body["error"])
    body = json.loads(json.dumps(body))
    points = [(m["metric"]["event_type"], float(t), v) for m in body["data"]["result"] for t, v in m["values"]]
    return spark.createDataFrame(points, "event_type string, seconds double, text string")


for _q in (store_round_trip, store_cleared, ingest_stream, http_result, import_wide, exposition_text, ingest_last_wins, alert_two_runs, recording_rule, series_lookup, label_values, json_result, scrape_up):
    QUERIES[_q.__name__] = _q
_V = f"round({{}} + {SHIFT:.7f}::DOUBLE, 4) + 0.0 AS value"
_HOURS = f"h AS (SELECT user_id, (epoch_us(ts) // 1000) // {HOUR} * {HOUR} AS t, sum(value) AS v FROM events GROUP BY 1, 2)"
ORACLE_SQL |= {
    "store_round_trip": f"WITH {_HOURS} SELECT user_id::VARCHAR AS user_id, t, {_V.format('(v + CASE WHEN user_id % 2 = 0 THEN 1000 ELSE 0 END)')} FROM h",
    "store_cleared": f"WITH {_HOURS} SELECT user_id::VARCHAR AS user_id, t, {_V.format('v')} FROM h WHERE NOT t BETWEEN {CLEARED[0]} AND {CLEARED[1]}",
    "ingest_stream": f"WITH {_grid(COARSE)} SELECT event_type, t, count(*)::DOUBLE AS value FROM grid JOIN events ON epoch_us(ts) // 1000 <= t AND epoch_us(ts) // 1000 >= t - {6 * HOUR} GROUP BY 1, 2",
    "http_result": f"WITH {_grid(COARSE)}, {EV} SELECT event_type, t / 1000.0::DOUBLE AS seconds, count(*)::VARCHAR AS \"text\" FROM grid JOIN ev ON ts <= t AND ts >= t - {6 * HOUR} GROUP BY 1, 2",
    "import_wide": f"SELECT 'hourly' AS name, event_type, (epoch_us(ts) // 1000) // {HOUR} * {HOUR} AS ts, {_V.format('sum(value)')} FROM events GROUP BY 1, 2, 3",
    "exposition_text": "SELECT 'app:' || event_type AS name, user_id::VARCHAR AS \"user\", 'a \"b\"' AS note, value, epoch_us(ts) // 1000 AS ts FROM events",
    "ingest_last_wins": f"SELECT user_id::VARCHAR AS user_id, (epoch_us(ts) // 1000) // {HOUR} * {HOUR} AS ts, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2",
    "alert_two_runs": f"WITH {EV.replace('epoch_ms(ts)', 'epoch_us(ts) // 1000')}, a AS (SELECT run, event_type FROM ev, (SELECT unnest([{ALERT_AT[0]}::BIGINT, {ALERT_AT[1]}::BIGINT]) AS run) WHERE ts <= run AND ts >= run - {3 * HOUR} GROUP BY 1, 2 HAVING avg(value) > 40) SELECT event_type, min(run) AS fired_since, CASE WHEN min(run) = {ALERT_AT[0]} THEN 'FIRING' ELSE 'PENDING' END AS status FROM a GROUP BY 1 HAVING max(run) = {ALERT_AT[1]}",
    "recording_rule": f"SELECT 'type:sum' AS name, event_type, 'a' AS team, {ALERT_AT[0]}::BIGINT AS ts, {_V.format('sum(value)')} FROM events WHERE epoch_us(ts) // 1000 BETWEEN {ALERT_AT[0] - DAY} AND {ALERT_AT[0]} GROUP BY 2",
    "series_lookup": "SELECT DISTINCT event_type, user_id::VARCHAR AS user_id FROM events WHERE user_id::VARCHAR LIKE '1%' OR event_type = 'view' AND user_id <> 7",
    "label_values": "SELECT DISTINCT user_id::VARCHAR AS value FROM events",
    "json_result": f"WITH {_grid(COARSE)}, s AS (SELECT event_type, t, sum(value) AS v FROM grid JOIN events ON epoch_us(ts) // 1000 <= t AND epoch_us(ts) // 1000 >= t - {6 * HOUR} GROUP BY 1, 2) SELECT event_type, count(*) AS n, min(t) AS first_t, max(t) AS last_t, {_V.format('arg_min(v, t)')} FROM s GROUP BY 1",
    "scrape_up": f"SELECT DISTINCT 'seen' AS name, event_type AS instance, 'app' AS job, user_id::VARCHAR AS \"user\", {EPOCH}::BIGINT AS ts, user_id::DOUBLE AS value FROM events WHERE event_type <> 'error' UNION ALL SELECT DISTINCT 'up', event_type, 'app', NULL, {EPOCH}::BIGINT, (event_type <> 'error')::INT::DOUBLE FROM events",
}
