"""The query interface: instant and range queries, series and label lookups, and results as JSON."""

from __future__ import annotations

import json
import math
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import labels as L
from tideline.operators.select import lookup
from tideline.plans.compiler import compile_query, kind
from tideline.plans.parser import parse
from tideline.plans.tree import QueryError, Selector
from tideline.sources.store import Store


@dataclass
class Trace:
    """Seconds of a query's phases, and its physical plan."""

    query: str
    seconds: dict[str, float] = field(default_factory=dict)
    plan: str = ""


class Engine:
    def __init__(self, store: Store):
        self.store = store

    def query_range(self, text: str, start: int, end: int, step: int) -> DataFrame:
        """labels (map), t and value on the grid start, start + step, .. (all in ms)."""
        return compile_query(self.store.samples, self.store.series, text, start, end, step)

    def query_instant(self, text: str, at: int) -> DataFrame:
        return self.query_range(text, at, at, 1)

    def series(self, *selectors: str) -> DataFrame:
        """Label sets (map) that match any of the selectors."""
        found = None
        for s in selectors:
            node = parse(s)
            if not isinstance(node, Selector) or node.range is not None:
                raise QueryError("expected an instant selector")
            rows = lookup(self.store.series, node)
            found = rows if found is None else found.unionByName(rows)
        if found is None:
            raise QueryError("expected a selector")
        return found.dropDuplicates(["sid"]).select(L.to_map(F.col("labels")).alias("labels"))

    def label_values(self, name: str) -> DataFrame:
        """The distinct values of a label."""
        return self.store.series.select(L.get(F.col("labels"), name).alias("value")).filter("value is not null").distinct()

    def traced(self, text: str, start: int, end: int, step: int) -> tuple[list, Trace]:
        """Rows of a query, with the time of each phase."""
        trace, t0 = Trace(text), time.perf_counter()
        kind(parse(text))
        trace.seconds["parse"] = time.perf_counter() - t0
        t0 = time.perf_counter()
        df = self.query_range(text, start, end, step)
        trace.plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        trace.seconds["plan"] = time.perf_counter() - t0
        t0 = time.perf_counter()
        rows = df.collect()
        trace.seconds["exec"] = time.perf_counter() - t0
        return rows, trace


def number_text(x: float) -> str:
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "+Inf" if x > 0 else "-Inf"
    return str(int(x)) if x == int(x) and abs(x) < 2**53 else repr(x)


def result_rows(df: DataFrame) -> DataFrame:
    """A row for each series with its points in order of time: what a result of many series is written from, in parallel."""
    point = F.struct(F.col("t"), F.col("value"))
    return df.groupBy("labels").agg(F.array_sort(F.collect_list(point)).alias("points"))


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines {metric, values: [[seconds, text], ..]}, a line for each series."""
    v = F.col("value")
    text = F.when(F.isnan(v), "NaN").when(v == float("inf"), "+Inf").when(v == float("-inf"), "-Inf").otherwise(v.cast("string"))
    texts = df.select("labels", "t", text.alias("value")).groupBy("labels").agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("p"))
    texts.select(F.col("labels").alias("metric"), F.transform("p", lambda x: F.array((x["t"] / 1000.0).cast("string"), x["value"])).alias("values")).write.json(path)


def to_result(rows: list, instant: bool, scalar: bool = False) -> dict:
    """The query interface's result of collected rows (labels, t, value): scalar, vector or matrix."""
    if scalar and instant:
        return {"resultType": "scalar", "result": [rows[0]["t"] / 1000, number_text(rows[0]["value"])]}
    by: dict[str, tuple[dict, list]] = {}
    for r in rows:
        by.setdefault(json.dumps(r["labels"], sort_keys=True), (dict(r["labels"]), []))[1].append((r["t"], r["value"]))
    if instant:
        return {"resultType": "vector", "result": [{"metric": m, "value": [p[0][0] / 1000, number_text(p[0][1])]} for m, p in by.values()]}
    return {"resultType": "matrix", "result": [{"metric": m, "values": [[t / 1000, number_text(v)] for t, v in sorted(p)]} for m, p in by.values()]}
