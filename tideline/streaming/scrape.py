"""The scrape loop: targets that are due are fetched on the executors, parsed, and appended to a store."""

from __future__ import annotations

import time
import urllib.request
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.config import Discovery, Target
from tideline.functions import labels as L
from tideline.sources.store import save, store_of
from tideline.streaming.ingest import scraped_texts

#: Seconds for one fetch; bytes of an answer at most; fetches of a task at once; targets of a task.
TIMEOUT, MOST_BYTES, AT_ONCE, PER_TASK = 10.0, 64 << 20, 16, 64


def fetch(url: str, timeout: float = TIMEOUT, most: int = MOST_BYTES) -> str | None:
    """The text at an address; None where it can't be had in time, is no success, or is too long."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": "text/plain"}), timeout=timeout) as answer:
            data = answer.read(most + 1)
            return data.decode("utf-8", "replace") if len(data) <= most else None
    except (OSError, ValueError):
        return None


def fetched(spark: SparkSession, targets: list[Target], timeout: float = TIMEOUT) -> DataFrame:
    """instance, job, honor_labels, extra (label set) and text of each target, fetched by tasks of PER_TASK targets."""
    rows = [(t.instance, t.job, t.honor_labels, dict(t.labels), t.url) for t in targets]
    listed = spark.createDataFrame(rows, "instance string, job string, honor_labels boolean, extra map<string,string>, url string").withColumn("extra", L.from_map(F.col("extra")))
    dealt = listed.repartition(max(1, -(-len(rows) // PER_TASK)), "url")

    def run(it):
        with ThreadPoolExecutor(AT_ONCE) as pool:
            for b in it:
                texts = list(pool.map(lambda url: fetch(url, timeout), b.column("url").to_pylist()))
                yield pa.RecordBatch.from_arrays([*b.drop_columns(["url"]).columns, pa.array(texts, pa.string())], ["instance", "job", "honor_labels", "extra", "text"])

    return dealt.mapInArrow(run, f"instance string, job string, honor_labels boolean, extra {L.TYPE}, text string")


class ScrapeLoop:
    """Scrapes what a discovery says is due. A target that fails gives up = 0 and is tried again after its interval."""

    def __init__(self, spark: SparkSession, path: str, discovery: Discovery, timeout: float = TIMEOUT):
        self.spark, self.path, self.discovery, self.timeout = spark, path, discovery, timeout
        self.last: dict[str, int] = {}
        self.stopped = False

    def run_due(self, now: int) -> int:
        """One round at a time in ms; returns the number of targets."""
        due = self.discovery.due(now, self.last)
        if due:
            self.last |= {t.url: now for t in due}
            save(store_of(scraped_texts(fetched(self.spark, due, self.timeout), now)), self.path)
        known = {t.url for ts in self.discovery.by_job.values() for t in ts}
        self.last = {url: at for url, at in self.last.items() if url in known}
        return len(due)

    def run(self, pause: float = 1.0, rounds: int | None = None) -> None:
        """Rounds until `stopped` is set (or so many of them)."""
        while not self.stopped and rounds != 0:
            self.run_due(int(time.time() * 1000))
            rounds = None if rounds is None else rounds - 1
            if rounds != 0:
                time.sleep(pause)
