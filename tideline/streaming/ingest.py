"""Streaming ingest of exposition text files into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tideline.functions import labels as L
from tideline.sources.exposition import parse_lines, scraped
from tideline.sources.store import save, store_of

#: Late samples of a series count as repeats within this time.
LATE = "5 minutes"


def text_stream(spark: SparkSession, path: str, job: str, honor_labels: bool = False) -> DataFrame:
    """Samples (labels, ts, value) of text files that appear under a path: a file is one scrape, its name the instance, its change the time."""
    lines = spark.readStream.format("text").load(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("at"))
    rows = parse_lines(lines)
    instance = F.regexp_replace("file", r"\.[^.]*$", "")
    own = rows.filter("labels is not null")
    labels = F.col("labels")
    for key, value in (("instance", instance), ("job", F.lit(job))):
        labels = F.when(L.get(labels, key).isNotNull(), labels).otherwise(L.put(labels, key, value)) if honor_labels else L.put(labels, key, value)
    return own.select(labels.alias("labels"), F.unix_millis("at").alias("ts"), "value", "at")


def deduplicated(samples: DataFrame) -> DataFrame:
    """Of samples of one series and time the first within the watermark; state is dropped behind it."""
    return samples.withColumn("sid", L.fingerprint(F.col("labels"))).withWatermark("at", LATE).dropDuplicatesWithinWatermark(["sid", "ts"]).drop("sid")


def ingest(samples: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends a stream of samples to the store in a folder, a batch at a time."""

    def write(batch: DataFrame, _: int) -> None:
        save(store_of(batch.select("labels", "ts", "value")), path)

    writer = deduplicated(samples).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def scraped_texts(rows: DataFrame, at: int) -> DataFrame:
    """labels, ts and value of fetched texts (instance, job, honor_labels, extra labels, text or null where the fetch failed)."""
    lines = rows.select("instance", "job", "honor_labels", "extra", F.col("text").isNotNull().cast("double").alias("up"), F.explode_outer(F.split("text", "\n")).alias("value"))
    kept = lines.withColumn("value", F.coalesce("value", F.lit("?")))
    blank = F.col("value").rlike(r"^\s*(#|$)")  # a scrape without samples still counts for `up`
    parsed = parse_lines(kept.withColumn("value", F.when(blank, "?").otherwise(F.col("value"))))
    own = F.filter("extra", lambda e: ~F.exists("labels", lambda o: o["key"] == e["key"]))  # a target's labels, where a sample has none of that name
    parsed = parsed.withColumn("labels", F.when(F.col("labels").isNotNull(), F.array_sort(F.concat("labels", own)).cast(L.TYPE)))
    how = lambda honor: scraped(parsed.filter(F.col("honor_labels") == honor), F.lit(at), F.col("instance"), F.col("job"), honor, F.col("up"))
    return how(False).unionByName(how(True))


def scrape_once(spark: SparkSession, texts: list[tuple[str, str, str | None]], at: int, honor_labels: bool = False) -> DataFrame:
    """labels, ts and value of fetched texts (instance, job, text or None where the fetch failed)."""
    rows = spark.createDataFrame(texts, "instance string, job string, text string")
    return scraped_texts(rows.withColumns({"honor_labels": F.lit(honor_labels), "extra": F.array().cast(L.TYPE)}), at)
