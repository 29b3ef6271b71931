"""Exposition text: lines `name{label="value",..} value [ms]`, read with built-in functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import ieee
from tideline.functions import labels as L

NAME = r"[a-zA-Z_:][a-zA-Z0-9_:]*"
LABEL = r'([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*"((?:[^"\\]|\\.)*)"'
BODY = r'(?:\s*[a-zA-Z_][a-zA-Z0-9_]*\s*=\s*"(?:[^"\\]|\\.)*"\s*,?)*\s*'
METRIC = rf"({NAME})?\s*(?:\{{({BODY})\}})?"
LINE = rf"^\s*{METRIC}\s+(\S+)(?:\s+(-?[0-9]+))?\s*$"


def parse_metric(text: str) -> dict[str, str]:
    """Labels of one metric expression; ValueError if it is none."""
    m = re.fullmatch(rf"\s*{METRIC}\s*", text)
    if not m or not (m[1] or m[2]):
        raise ValueError(f"no metric: {text!r}")
    found = {k: _unescaped(v) for k, v in re.findall(LABEL, m[2] or "")}
    return found | ({L.NAME: m[1]} if m[1] else {})


def _unescaped(v: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n"}.get(m[1], m[1]), v)


def _unescape(c: Column) -> Column:
    held = F.replace(c, F.lit("\\\\"), F.lit("\u0001"))
    return F.replace(F.replace(F.replace(held, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\u0001"), F.lit("\\"))


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """labels, value, ts (null without one) and line of every sample; comments and empty lines go.

    A line that is no sample has null labels; the caller may count or keep such lines. Other columns stay.
    """
    rest = [c for c in lines.columns if c != column]
    line = F.col("line")
    rows = lines.select(*rest, F.col(column).alias("line")).filter(~line.rlike(r"^\s*(#|$)"))
    part = lambda n: F.regexp_extract(line, LINE, n)
    body = part(2)
    keys, values = F.regexp_extract_all(body, F.lit(LABEL), F.lit(1)), F.transform(F.regexp_extract_all(body, F.lit(LABEL), F.lit(2)), _unescape)
    pairs = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    name = F.when(part(1) != "", F.array(F.struct(F.lit(L.NAME).alias("key"), part(1).alias("value")))).otherwise(F.array().cast(L.TYPE))
    labels = F.array_sort(F.filter(F.concat(name, pairs).cast(L.TYPE), lambda e: e["value"] != ""))
    text = part(3)
    value = F.when(F.lower(text) == "nan", ieee.NAN).when(F.lower(text).isin("inf", "+inf"), ieee.INF).when(F.lower(text) == "-inf", -ieee.INF).otherwise(text.try_cast("double"))
    good = line.rlike(LINE) & ((part(1) != "") | (body != "")) & value.isNotNull()
    return rows.select(*rest, F.when(good, labels).alias("labels"), F.when(good, value).alias("value"), F.when(good & (part(4) != ""), part(4).try_cast("long")).alias("ts"), "line")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Samples of the exposition text files under a path."""
    return parse_lines(spark.read.text(path))


def scraped(samples: DataFrame, at: Column, instance: Column, job: Column, honor_labels: bool = False, up: Column | None = None) -> DataFrame:
    """What a scrape stores (labels, ts, value): its own time, with instance and job unless a metric's own labels are honoured, and an `up` sample for each instance.

    `up` is 1.0 or 0.0 for a row's scrape; rows without a sample (null labels) only count for `up`.
    """
    own = F.col("labels")
    for key, value in (("instance", instance), ("job", job)):
        own = F.when(L.get(own, key).isNotNull(), own).otherwise(L.put(own, key, value)) if honor_labels else L.put(own, key, value)
    rows = samples.filter(F.col("labels").isNotNull()).select(own.alias("labels"), at.alias("ts"), "value")
    alive = samples.select(L.of_columns({L.NAME: F.lit("up"), "instance": instance, "job": job}).alias("labels"), at.alias("ts"), (F.lit(1.0) if up is None else up).alias("value")).distinct()
    return rows.unionByName(alive)
