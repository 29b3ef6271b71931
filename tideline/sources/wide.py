"""Wide Parquet: a time column, then a column of doubles for each metric expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import labels as L
from tideline.sources.exposition import parse_metric
from tideline.sources.store import Store, store_of


def from_wide(df: DataFrame, ts: str | None = None) -> Store:
    """A store of a wide DataFrame; its first column is the time in ms. Nulls are no samples."""
    ts = ts or df.columns[0]
    names = [c for c in df.columns if c != ts]
    named = [(c, parse_metric(c)) for c in names]
    spark = df.sparkSession
    known = spark.createDataFrame(named, "metric string, labels map<string,string>").select("metric", L.from_map(F.col("labels")).alias("labels"))
    quoted = df.select(F.col(f"`{ts}`").cast("long").alias("ts"), *(F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(names)))
    long = quoted.unpivot(["ts"], [f"c{k}" for k in range(len(names))], "column", "value").filter("value is not null")
    ids = known.join(spark.createDataFrame([(c, f"c{k}") for k, c in enumerate(names)], "metric string, column string"), "metric").select("column", "labels")
    return store_of(long.join(F.broadcast(ids), "column").select("labels", "ts", "value"))  # a row for each column of the file


def import_wide(spark: SparkSession, path: str) -> Store:
    return from_wide(spark.read.parquet(path))
