"""Values of the compiler: vectors over a time grid.

A vector is two DataFrames. `facts` (sid, t, sample_ts, value) has a row for each series and step with a value; a step
without one has no row. `series` (sid, labels) names the series. Labels stay out of the facts: label matching,
grouping and renaming work on the small side, and facts carry a 64-bit id through joins, windows and shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions import labels as L


@dataclass(frozen=True)
class Grid:
    """Steps start, start + step, .. up to end, in milliseconds; one step if start equals end."""

    start: int
    end: int
    step: int

    def __post_init__(self):
        if self.step <= 0 or self.end < self.start:
            raise ValueError("a grid needs a positive step and an end not before its start")

    @property
    def size(self) -> int:
        return (self.end - self.start) // self.step + 1

    @property
    def last(self) -> int:
        return self.start + (self.size - 1) * self.step

    def steps(self, spark: SparkSession) -> DataFrame:
        """One row a step (t)."""
        return spark.range(self.start, self.last + 1, self.step).select(F.col("id").alias("t"))


@dataclass(frozen=True)
class Vector:
    facts: DataFrame
    series: DataFrame
    #: No two series differ in their name alone (they all have one name, or none has any).
    one_name: bool = False
    #: A matcher's fixed labels, for absent().
    equal_labels: tuple[tuple[str, str], ...] = ()
    #: Ascending or descending by value at the last step, where the result is ordered.
    order: str = ""

    def map(self, value: Column, drop_name: bool = True) -> Vector:
        """The vector of an expression of value, t and sample_ts."""
        out = replace(self, facts=self.facts.select("sid", "t", "sample_ts", value.cast("double").alias("value")), equal_labels=(), order="")
        return out.without_name() if drop_name else out

    def where(self, predicate: Column) -> Vector:
        return replace(self, facts=self.facts.filter(predicate), equal_labels=(), order="")

    def without_name(self) -> Vector:
        renamed = self.series.select("sid", L.drop(F.col("labels"), [L.NAME]).alias("labels"))
        if self.one_name:
            return replace(self, series=renamed)
        return relabel(self, renamed)


@dataclass(frozen=True)
class Scalar:
    """A number for each step: a constant, or facts (t, value) with a row for every step."""

    constant: float | None = None
    facts: DataFrame | None = None


@dataclass(frozen=True)
class RangeVector:
    """Raw samples (sid, ts, value, stale) that the windows [t - range - offset, t - offset] of the grid can reach."""

    samples: DataFrame
    series: DataFrame
    range: int
    offset: int
    one_name: bool


def relabel(v: Vector, renamed: DataFrame) -> Vector:
    """v with new label sets (sid, labels); two series with values that get the same labels are an error, raised when the plan runs.

    Only series that get equal labels are looked at closely: the others pass by their flag.
    """
    named = renamed.withColumn("nid", L.fingerprint(F.col("labels")))
    live = named.join(v.facts.select("sid").distinct(), "sid", "left_semi")
    twice = F.count(F.lit(1)).over(Window.partitionBy("nid")) > 1
    only = F.when(F.col("twice"), F.raise_error(F.lit("two series of the result have the same labels")).cast("boolean")).otherwise(F.lit(True))
    checked = live.withColumn("twice", twice).filter(only)  # as a filter, no optimiser prunes it
    facts = v.facts.join(checked.select("sid", "nid"), "sid").select(F.col("nid").alias("sid"), "t", "sample_ts", "value")
    return replace(v, facts=facts, series=named.select(F.col("nid").alias("sid"), "labels").distinct(), one_name=True, equal_labels=(), order="")


def keyed(v: Vector) -> Vector:
    """v with ids that are the fingerprints of its labels, so that ids of different vectors agree."""
    ids = v.series.select("sid", L.fingerprint(F.col("labels")).alias("nid"), "labels")
    facts = v.facts.join(ids.select("sid", "nid"), "sid").select(F.col("nid").alias("sid"), "t", "sample_ts", "value")
    return replace(v, facts=facts, series=ids.select(F.col("nid").alias("sid"), "labels").distinct())
