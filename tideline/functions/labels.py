"""Label sets: an array of (key, value) structs sorted by key. Unlike a map it can be grouped by, joined on and hashed."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME = "__name__"
TYPE = "array<struct<key:string,value:string>>"


def from_map(m: Column) -> Column:
    """Label set of a map; null values and empty values are no labels."""
    return F.array_sort(F.filter(F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))), lambda e: e["value"].isNotNull() & (e["value"] != ""))).cast(TYPE)


def literal(labels: dict[str, str]) -> Column:
    """A constant label set."""
    return F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in sorted(labels.items()))).cast(TYPE)


def of_columns(labels: dict[str, Column]) -> Column:
    """Label set of columns by label name; null or empty values are no labels."""
    every = F.array(*(F.struct(F.lit(k).alias("key"), c.cast("string").alias("value")) for k, c in sorted(labels.items())))
    return F.filter(every, lambda e: e["value"].isNotNull() & (e["value"] != "")).cast(TYPE)


def to_map(labels: Column) -> Column:
    return F.map_from_entries(labels)


def get(labels: Column, key: str) -> Column:
    """The value of a label, null if it is missing."""
    return F.try_element_at(F.filter(labels, lambda e: e["key"] == key), F.lit(1))["value"]


def keep(labels: Column, keys: Iterable[str]) -> Column:
    keys = list(keys)
    return F.filter(labels, lambda e: e["key"].isin(keys)) if keys else F.array().cast(TYPE)


def drop(labels: Column, keys: Iterable[str]) -> Column:
    keys = list(keys)
    return F.filter(labels, lambda e: ~e["key"].isin(keys)) if keys else labels


def put(labels: Column, key: str, value: Column) -> Column:
    """Sets a label; null or the empty string takes it away."""
    one = F.when(value.isNull() | (value == ""), F.array().cast(TYPE)).otherwise(F.array(F.struct(F.lit(key).alias("key"), value.alias("value"))).cast(TYPE))
    return F.array_sort(F.concat(drop(labels, [key]), one))


def fingerprint(labels: Column) -> Column:
    """64-bit identity of a label set."""
    return F.xxhash64(labels)
