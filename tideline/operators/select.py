"""Series lookup, instant and range selection over a store of samples."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import labels as L
from tideline.operators.vector import Grid, RangeVector, Vector
from tideline.plans.tree import Matcher, QueryError, Selector

#: Fixed value: a sample is current for five minutes.
LOOKBACK = 300_000


def java_regex(pattern: str) -> str:
    """A pattern that has to match the whole value."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise QueryError(f"bad regular expression {pattern!r}: {e}") from e
    return f"^(?:{pattern})$"


def matches(labels: Column, m: Matcher) -> Column:
    """Whether a label set passes a matcher. A missing label passes != and !~, and patterns that are empty; never = or =~ with a pattern that is not."""
    value = L.get(labels, m.label)
    missing = F.lit(m.op in ("!=", "!~") or m.value == "")
    if m.op in ("=", "!="):
        found = value == m.value
    else:
        found = value.rlike(java_regex(m.value))
    return F.when(value.isNull(), missing).otherwise(found if m.op in ("=", "=~") else ~found)


def lookup(series: DataFrame, selector: Selector) -> DataFrame:
    """Series (sid, labels) that pass all matchers."""
    out = series
    if selector.name is not None:
        out = out.filter(F.col("name") == selector.name)
    for m in selector.matchers:
        if m.label == L.NAME and m.op == "=" and m.value:
            out = out.filter(F.col("name") == m.value)
        else:
            out = out.filter(matches(F.col("labels"), m))
    return out.select("sid", "labels")


def _has_one_name(selector: Selector) -> bool:
    return selector.name is not None or any(m.label == L.NAME and m.op == "=" for m in selector.matchers)


def _reached(samples: DataFrame, first: int, last: int) -> DataFrame:
    """Samples with first <= ts <= last; the bounds go to the scan, with those of the bucket column where the store has one."""
    out = samples.filter((F.col("ts") >= first) & (F.col("ts") <= last))
    if "bucket" in samples.columns:
        from tideline.sources.store import BUCKET

        out = out.filter((F.col("bucket") >= first // BUCKET) & (F.col("bucket") <= last // BUCKET))
    return out


def first_step(grid: Grid, at: Column) -> Column:
    """The first step at or after a time (possibly after the grid's end)."""
    return F.lit(grid.start) + F.ceil(F.greatest(F.lit(0), at - grid.start) / F.lit(grid.step)).cast("long") * grid.step


def steps_between(grid: Grid, low: Column, high: Column) -> Column:
    """A row for each step from low to high; none where low is behind high."""
    return F.explode(F.when(low <= high, F.sequence(low, F.greatest(low, high), F.lit(grid.step))).otherwise(F.array().cast("array<bigint>")))


def instant(samples: DataFrame, series: DataFrame, selector: Selector, grid: Grid) -> Vector:
    """For each step the newest sample at or before it that is not older than the lookback; a stale marker ends its series.

    Samples are first cut to the newest before each step, an aggregate that Spark does on each side of its shuffle:
    what is ordered by series afterwards has at most one row a step.
    """
    found = lookup(series, selector)
    reach = _reached(samples, grid.start - selector.offset - LOOKBACK, grid.last - selector.offset).join(found.select("sid"), "sid", "left_semi")
    at = F.col("ts") + selector.offset
    newest = reach.withColumn("low", first_step(grid, at)).groupBy("sid", "low").agg(F.max_by(F.struct("ts", "value", "stale"), F.col("ts")).alias("s")).select("sid", "low", "s.ts", "s.value", "s.stale")
    after = F.lead("low").over(Window.partitionBy("sid").orderBy("low"))
    high = F.least(F.lit(grid.last), at + LOOKBACK, F.coalesce(after - grid.step, F.lit(grid.last)))
    spans = newest.withColumn("high", high).filter(~F.col("stale") & (F.col("low") <= F.col("high")))
    facts = spans.select("sid", steps_between(grid, F.col("low"), F.col("high")).alias("t"), F.col("ts").alias("sample_ts"), "value")
    equal = tuple((m.label, m.value) for m in selector.matchers if m.op == "=" and m.label != L.NAME and m.value)
    return Vector(facts, found, _has_one_name(selector), equal)


def ranged(samples: DataFrame, series: DataFrame, selector: Selector, grid: Grid) -> RangeVector:
    """The raw samples of all windows of a range selector; both ends of a window belong to it."""
    found = lookup(series, selector)
    reach = _reached(samples, grid.start - selector.offset - selector.range, grid.last - selector.offset).join(found.select("sid"), "sid", "left_semi")
    return RangeVector(reach.select("sid", "ts", "value", "stale"), found, selector.range, selector.offset, _has_one_name(selector))
