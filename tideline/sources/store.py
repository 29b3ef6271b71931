"""A store of samples: facts by series id and time, and the series' labels.

samples: sid, ts (ms), value, stale, bucket (ts div BUCKET)
series: sid (fingerprint of the labels), name, labels (sorted array of pairs)

A stored table has a folder for each day (bucket) and, in it, one for each time that something was written (seq): of
samples with one series and time the last written counts. An odd seq is a day written anew as a whole: it takes the
place of all with smaller numbers, from the moment that its folder has its name. So what a reader has to look at is
given by folder names: a day with one live seq is read as it is, and only samples of other days are told apart.
"""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import labels as L

#: Milliseconds of a partition folder of the sample table: a day.
BUCKET = 86_400_000
ROW = "sid long, ts long, value double, stale boolean"
SAMPLES = f"{ROW}, seq long, bucket long"
SERIES = f"sid long, name string, labels {L.TYPE}"


@dataclass(frozen=True)
class Store:
    samples: DataFrame
    series: DataFrame


def store_of(rows: DataFrame, order: str | Column | None = None) -> Store:
    """A store of rows (labels as a label set, ts, value and optionally stale).

    Of samples with equal labels and time the last by `order` counts (any, without an order).
    """
    stale = F.coalesce("stale", F.lit(False)) if "stale" in rows.columns else F.lit(False)
    named = rows.select("labels", F.col("ts").cast("long").alias("ts"), F.col("value").cast("double").alias("value"), stale.alias("stale"), L.fingerprint(F.col("labels")).alias("sid"), *([] if order is None else [(F.col(order) if isinstance(order, str) else order).alias("_order")]))
    samples = named
    if order is not None:
        samples = named.groupBy("sid", "ts").agg(F.max_by(F.struct("value", "stale"), "_order").alias("x")).select("sid", "ts", "x.value", "x.stale")
    series = named.select("sid", "labels").distinct().select("sid", L.get(F.col("labels"), L.NAME).alias("name"), "labels")
    return Store(samples.select("sid", "ts", "value", "stale", F.floor(F.col("ts") / BUCKET).cast("long").alias("bucket")), series)


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder's path under spark.checkpoint.dir, which all machines share; only a local master may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="tideline-")
    return f"{base.rstrip('/')}/tideline-{what}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _folders(spark: SparkSession, path: str, key: str) -> list[int]:
    """n of the folders `key`=n under a path."""
    fs, p = _fs(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(rf"{key}=(-?\d+)", n)))


def days_of(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """The live seqs of each day of a stored table, by the names of its folders."""
    out = {}
    for day in _folders(spark, f"{path}/samples", "bucket"):
        seqs = _folders(spark, f"{path}/samples/bucket={day}", "seq")
        whole = max((x for x in seqs if x % 2), default=0)
        if live := [x for x in seqs if x >= whole]:
            out[day] = live
    return out


def save(store: Store, path: str, mode: str = "append") -> None:
    """Writes a store to a folder: samples by day, sorted by series and time inside a file, and the series not there yet.

    How many files a day gets follows its size: Spark splits and joins the shuffle's parts to about its advisory size.
    """
    spark = store.series.sparkSession
    if mode == "overwrite":
        clear(spark, path)
    series = store.series
    if exists(spark, f"{path}/series"):
        series = series.join(spark.read.schema(SERIES).parquet(f"{path}/series"), "sid", "left_anti")
    series.coalesce(1).write.mode("append").parquet(f"{path}/series")
    samples = store.samples.select("sid", "ts", "value", "stale", F.lit(2 * time.time_ns()).alias("seq"), "bucket")
    samples.hint("rebalance", "bucket").sortWithinPartitions("bucket", "sid", "ts").write.mode("append").partitionBy("bucket", "seq").parquet(f"{path}/samples")


def _last_written(samples: DataFrame) -> DataFrame:
    return samples.groupBy("sid", "ts", "bucket").agg(F.max_by(F.struct("value", "stale"), "seq").alias("x")).select("sid", "ts", "x.value", "x.stale", "bucket")


def _read(spark: SparkSession, path: str, days: dict[int, list[int]]) -> DataFrame:
    folders = [f"{path}/samples/bucket={day}/seq={seq}" for day, seqs in sorted(days.items()) for seq in seqs]
    if not folders:
        return spark.createDataFrame([], SAMPLES)
    return spark.read.schema(SAMPLES).option("basePath", f"{path}/samples").parquet(*folders)


def load(spark: SparkSession, path: str, last_wins: bool = True) -> Store:
    """The store in a folder. Time bounds of queries prune its day folders.

    Only days that were written more than once, and not compacted since, are aggregated by series and time, below which
    Spark pushes the bounds and the chosen series. A store that never writes a sample twice can be read without it.
    """
    days = days_of(spark, path)
    again = {d: seqs for d, seqs in days.items() if len(seqs) > 1 and last_wins}
    samples = _read(spark, path, {d: seqs for d, seqs in days.items() if d not in again}).drop("seq")
    if again:
        samples = samples.unionByName(_last_written(_read(spark, path, again)))
    series = spark.read.schema(SERIES).parquet(f"{path}/series").dropDuplicates(["sid"]) if exists(spark, f"{path}/series") else spark.createDataFrame([], SERIES)
    return Store(samples, series)


def _replace_day(spark: SparkSession, path: str, day: int, seqs: list[int], change: Callable[[DataFrame], DataFrame]) -> None:
    """Writes a day anew beside the old one, gives the new folder its name, and only then deletes the old ones.

    A run that dies leaves the old day or the new one, never a part: what is written aside has no name that readers know,
    and from the renaming on the new folder counts alone.
    """
    folder, new = f"{path}/samples/bucket={day}", 2 * time.time_ns() + 1
    rows = change(_last_written(_read(spark, path, {day: seqs}))).select("sid", "ts", "value", "stale")
    rows.repartitionByRange("sid", "ts").sortWithinPartitions("sid", "ts").write.parquet(f"{folder}/_new-{new}")
    fs, p = _fs(spark, f"{folder}/_new-{new}")
    if not fs.rename(p, _fs(spark, f"{folder}/seq={new}")[1]):
        raise OSError(f"could not put the new day {day} in place")
    for seq in _folders(spark, folder, "seq"):
        if seq < new:
            _delete(spark, f"{folder}/seq={seq}")


def compact(spark: SparkSession, path: str, days: list[int] | None = None) -> None:
    """Rewrites days with one row for each series and time, the last written: the days named, or all that were written more than once."""
    for day, seqs in days_of(spark, path).items():
        if day in days if days is not None else len(seqs) > 1:
            _replace_day(spark, path, day, seqs, lambda rows: rows)


def clear(spark: SparkSession, path: str, start: int | None = None, end: int | None = None) -> None:
    """Drops all samples, or those with start <= ts <= end; series stay known unless all goes.

    Days wholly inside a range lose their folder; the (at most two) at its ends are written anew.
    """
    if start is None and end is None:
        _delete(spark, f"{path}/samples")
        _delete(spark, f"{path}/series")
        return
    first, last = (-(1 << 62) if start is None else start), ((1 << 62) if end is None else end)
    for day, seqs in days_of(spark, path).items():
        if first <= day * BUCKET and last >= (day + 1) * BUCKET - 1:
            _delete(spark, f"{path}/samples/bucket={day}")
        elif first < (day + 1) * BUCKET and last >= day * BUCKET:
            _replace_day(spark, path, day, seqs, lambda rows: rows.filter((F.col("ts") < first) | (F.col("ts") > last)))


def series_matching(store: Store, selector) -> DataFrame:
    from tideline.operators.select import lookup

    return lookup(store.series, selector)
