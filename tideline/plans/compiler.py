"""From syntax tree to DataFrames: checks types and arities, then builds one lazy plan.

Parts of a query that occur twice are built once, so Spark can reuse their exchanges. Numbers are folded here.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import ieee
from tideline.functions import labels as L
from tideline.operators import aggregate, binary, instant, ranges, select
from tideline.operators.select import java_regex
from tideline.operators.vector import Grid, RangeVector, Scalar, Vector
from tideline.plans.parser import COMPARISONS, SETS, parse
from tideline.plans.tree import Aggregate, Binary, Call, Node, Number, QueryError, Selector, Subquery, Text, Unary

#: name -> (kinds of the arguments, number that may be left out). v: vector, r: range vector, s: scalar, t: text.
SIGNATURES: dict[str, tuple[str, int]] = {
    **{name: ("r", 0) for name in ranges.FUNCTIONS},
    "quantile_over_time": ("sr", 0), "predict_linear": ("rs", 0), "holt_winters": ("rss", 0),
    **{name: ("v", 0) for name in instant.MATH},
    **{name: ("v", 1) for name in (*instant.CALENDAR, "hour", "minute")},
    "round": ("vs", 1), "clamp_max": ("vs", 0), "clamp_min": ("vs", 0), "timestamp": ("v", 0),
    "time": ("", 0), "vector": ("s", 0), "scalar": ("v", 0), "absent": ("v", 0), "sort": ("v", 0), "sort_desc": ("v", 0),
    "histogram_quantile": ("sv", 0), "label_replace": ("vtttt", 0), "label_join": ("vtt*", 0),
}
SCALAR_CALLS = ("time", "scalar")

#: name -> function of the value column; what register_function() adds.
USER_FUNCTIONS: dict[str, Callable[[Column], Column]] = {}


def register_function(name: str, f: Callable[[Column], Column]) -> None:
    """Adds a function of instant vectors, given as an expression of the value column."""
    USER_FUNCTIONS[name] = f
    SIGNATURES[name] = ("v", 0)


def kind(node: Node) -> str:
    """v, r, s or t: the static type of a tree; QueryError if an operand has the wrong one."""
    if isinstance(node, Number):
        return "s"
    if isinstance(node, Text):
        return "t"
    if isinstance(node, Selector):
        if node.name is None and not any(_needs_value(m) for m in node.matchers):
            raise QueryError("a selector needs a name or a matcher that an empty label fails")
        return "r" if node.range is not None else "v"
    if isinstance(node, Subquery):
        if kind(node.expr) != "v":
            raise QueryError("a sub-query is of an instant vector")
        return "r"
    if isinstance(node, Unary):
        return _one_of(node.expr, "vs", f"unary {node.op}")
    if isinstance(node, Binary):
        a, b = _one_of(node.left, "vs", node.op), _one_of(node.right, "vs", node.op)
        m = node.matching
        if node.op in SETS:
            if a + b != "vv":
                raise QueryError(f"{node.op} is between vectors")
            if m.group or node.bool:
                raise QueryError(f"{node.op} takes no {'grouping' if m.group else 'bool'}")
        if node.bool and node.op not in COMPARISONS:
            raise QueryError("bool is for comparisons")
        if a + b == "ss" and node.op in COMPARISONS and not node.bool:
            raise QueryError("a comparison of scalars needs bool")
        if a + b != "vv" and (m.on is not None or m.ignoring or m.group):
            raise QueryError("matching is between vectors")
        if m.on is not None and set(m.on) & set(m.include):
            raise QueryError("a label cannot be in on() and in the group's labels")
        return "v" if "v" in a + b else "s"
    if isinstance(node, Aggregate):
        _one_of(node.expr, "v", node.op)
        if node.param is not None:
            _one_of(node.param, "t" if node.op == "count_values" else "s", node.op)
        return "v"
    if isinstance(node, Call):
        if node.name not in SIGNATURES:
            raise QueryError(f"unknown function {node.name}")
        kinds, free = SIGNATURES[node.name]
        wanted = kinds.rstrip("*")
        if kinds.endswith("*"):
            wanted += "t" * max(0, len(node.args) - len(wanted))
        if not len(wanted) - free <= len(node.args) <= len(wanted):
            raise QueryError(f"{node.name} takes {len(wanted)} arguments, not {len(node.args)}")
        for arg, k in zip(node.args, wanted, strict=False):
            _one_of(arg, k, node.name)
        return "s" if node.name in SCALAR_CALLS else "v"
    raise QueryError(f"cannot type {node}")


def _needs_value(m) -> bool:
    """Whether a series without the label fails the matcher."""
    if m.op in ("=", "!="):
        return (m.op == "=") == (m.value != "")
    return m.op == "=~" and m.value != "" and not re.fullmatch(java_regex(m.value), "")


def _one_of(node: Node, kinds: str, what: str) -> str:
    if (k := kind(node)) not in kinds:
        names = {"v": "instant vector", "r": "range vector", "s": "scalar", "t": "string"}
        raise QueryError(f"{what}: expected {' or '.join(names[x] for x in kinds)}, found {names[k]}")
    return k


@dataclass
class Compiler:
    samples: DataFrame
    series: DataFrame
    grid: Grid
    built: dict = field(default_factory=dict)

    @property
    def spark(self):
        return self.series.sparkSession

    def build(self, node: Node) -> Vector | Scalar | RangeVector | str:
        if node not in self.built:
            self.built[node] = self._build(node)
        return self.built[node]

    def _build(self, node: Node):
        if isinstance(node, Number):
            return Scalar(node.value)
        if isinstance(node, Text):
            return node.value
        if isinstance(node, Selector):
            return (select.instant if node.range is None else select.ranged)(self.samples, self.series, node, self.grid)
        if isinstance(node, Subquery):
            return self._subquery(node)
        if isinstance(node, Unary):
            value = self.build(node.expr)
            if node.op == "+":
                return value
            return binary.scalars("*", Scalar(-1.0), value, False) if isinstance(value, Scalar) else value.map(-F.col("value"))
        if isinstance(node, Binary):
            return self._binary(node)
        if isinstance(node, Aggregate):
            param = self.build(node.param) if node.param is not None else None
            return aggregate.aggregate(node.op, self.build(node.expr), param, node.by, node.without)
        return self._call(node)

    def _subquery(self, node: Subquery) -> RangeVector:
        """The inner expression on a finer grid whose steps are multiples of the sub-query's step; its values are the samples."""
        step = node.step or self.grid.step
        first, last = self.grid.start - node.offset - node.range, self.grid.last - node.offset
        inner = Compiler(self.samples, self.series, Grid(-(-first // step) * step, max(-(-first // step) * step, last), step)).build(node.expr)
        rows = inner.facts.filter((F.col("t") >= first) & (F.col("t") <= last)).select("sid", F.col("t").alias("ts"), "value", F.lit(False).alias("stale"))
        return RangeVector(rows, inner.series, node.range, node.offset, inner.one_name)

    def _binary(self, node: Binary):
        a, b = self.build(node.left), self.build(node.right)
        if isinstance(a, Scalar) and isinstance(b, Scalar):
            return binary.scalars(node.op, a, b, node.bool)
        if isinstance(a, Scalar) or isinstance(b, Scalar):
            v, s = (b, a) if isinstance(a, Scalar) else (a, b)
            return binary.vector_scalar(node.op, v, s, node.bool, isinstance(a, Scalar))
        if node.op in SETS:
            return binary.sets(node.op, a, b, node.matching)
        return binary.vectors(node.op, a, b, node.matching, node.bool)

    def _call(self, node: Call):
        name, args = node.name, [self.build(a) for a in node.args]
        value = F.col("value")
        if name in ranges.FUNCTIONS:
            return ranges.FUNCTIONS[name](args[0], self.grid)
        if name in USER_FUNCTIONS:
            return args[0].map(USER_FUNCTIONS[name](value))
        if name in instant.MATH:
            return args[0].map(instant.MATH[name](value))
        if name in instant.CALENDAR or name in ("hour", "minute"):
            v = args[0] if args else instant.vector_of(self.spark, instant.time_scalar(self.spark, self.grid), self.grid)
            return v.map(instant.calendar(name, value))
        g = self.grid
        return {
            "quantile_over_time": lambda q, r: ranges.quantile_over_time(q, r, g),
            "predict_linear": lambda r, s: ranges.predict_linear(r, s, g),
            "holt_winters": lambda r, a, b: ranges.holt_winters(r, a, b, g),
            "round": lambda v, s=Scalar(1.0): instant.rounded(v, s),
            "clamp_max": lambda v, s: instant.clamp(v, s, True),
            "clamp_min": lambda v, s: instant.clamp(v, s, False),
            "timestamp": lambda v: v.map(F.col("sample_ts") / 1000.0),
            "time": lambda: instant.time_scalar(self.spark, g),
            "vector": lambda s: instant.vector_of(self.spark, s, g),
            "scalar": lambda v: instant.scalar_of(v, g),
            "absent": lambda v: instant.absent(v, g),
            "sort": lambda v: instant.sort(v, False),
            "sort_desc": lambda v: instant.sort(v, True),
            "histogram_quantile": instant.histogram_quantile,
            "label_replace": instant.label_replace,
            "label_join": lambda v, to, sep, *of: instant.label_join(v, to, sep, list(of)),
        }[name](*args)


def compile_query(samples: DataFrame, series: DataFrame, text: str, start: int, end: int, step: int) -> DataFrame:
    """labels (map), t (ms) and value of every series and step with a value; a scalar has no labels.

    The plan is lazy: QueryError is raised here for what cannot be parsed or typed, matching errors when the plan runs.
    """
    node = parse(text)
    kind(node)
    grid = Grid(start, end, step)
    value = Compiler(samples, series, grid).build(node)
    if isinstance(value, str) or isinstance(value, RangeVector):
        raise QueryError("the result must be an instant vector or a scalar")
    spark = series.sparkSession
    if isinstance(value, Scalar):
        rows = grid.steps(spark).withColumn("value", F.lit(value.constant)) if value.facts is None else value.facts
        return rows.select(F.create_map().cast("map<string,string>").alias("labels"), "t", F.col("value").cast("double").alias("value"))
    out = value.facts.join(value.series, "sid").select(L.to_map(F.col("labels")).alias("labels"), "t", "value")
    if value.order:  # an order is of values at one step; on a grid it holds step by step
        v = F.col("value")
        last = F.isnan(v) if value.order in ("asc", "desc") else F.lit(False)
        out = out.orderBy("t", last | (F.abs(v) == ieee.INF), v.desc() if value.order == "desc" else v.asc())
    return out
