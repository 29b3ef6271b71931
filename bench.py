"""Times the benchmark's query shapes over the star-schema tables; prints one line of JSON.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 2; the best counts). Results go to Spark's noop sink.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tideline.catalog import COARSE, DAILY, HOURLY
from tideline.engine import Engine
from tideline.sources.store import Store
from tideline.sources.tables import stores

#: name -> (views, query, grid). `long` shapes read days for each step, `wide` ones many series.
SHAPES = {
    "long_add": ("event_value", 'avg_over_time(event_value{event_type="view"}[1d]) + on() avg_over_time(event_value{event_type="error"}[1d])', COARSE),
    "long_sum4": ("event_value", " + on() ".join(f'sum_over_time(event_value{{event_type="{t}"}}[1d])' for t in ("view", "error", "click", "signup")), COARSE),
    "long_group_left": ("order_price", "order_price / on(priority) group_left sum by (priority) (order_price)", DAILY),
    "long_rate_add": ("event_total", 'rate(event_total{event_type="view"}[1d]) + on() rate(event_total{event_type="error"}[1d])', COARSE),
    "long_avg_day": ("event_value", "avg_over_time(event_value[1d])", COARSE),
    "long_avg_hour": ("event_value", "avg_over_time(event_value[1h])", COARSE),
    "long_max_day": ("event_value", "max_over_time(event_value[1d])", COARSE),
    "long_histogram": ("event_latency_bucket", "histogram_quantile(0.5, event_latency_bucket)", COARSE),
    "long_histogram_rate": ("event_latency_bucket", "histogram_quantile(0.5, rate(event_latency_bucket[6h]))", COARSE),
    "long_max_rate": ("event_total", "max(rate(event_total[1d]))", COARSE),
    "long_sum": ("event_value", "sum(event_value)", HOURLY),
    "long_sum_by": ("event_value", "sum by (event_type) (event_value)", HOURLY),
    "wide_rate": ("event_user", "rate(event_user[1d])", COARSE),
    "wide_rate_add": ("event_user", "rate(event_user[1d]) + rate(event_user[1d] offset 1d)", COARSE),
    "wide_sum": ("event_user", "sum(event_user)", HOURLY),
    "wide_add": ("event_user", "sum_over_time(event_user[6h]) + sum_over_time(event_user[6h] offset 6h)", COARSE),
    "wide_topk": ("event_user", "topk by (event_type) (5, sum_over_time(event_user[6h]))", COARSE),
    "wide_quantile": ("event_user", "quantile by (event_type) (0.9, sum_over_time(event_user[6h]))", COARSE),
}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    kept: dict[str, Store] = {}

    def preload(views: str) -> Store:
        """The store in memory, as a server holds it: loading is not what is timed."""
        if views not in kept:
            s = stores(spark, sf, *views.split())
            kept[views] = Store(s.samples.cache(), s.series.cache())
            kept[views].samples.count(), kept[views].series.count()
        return kept[views]

    def once(views: str, text: str, grid: tuple[int, int, int]) -> float:
        store = preload(views)
        t = time.perf_counter()
        Engine(store).query_range(text, *grid).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t

    once(*SHAPES["long_sum"])  # the JVM's start
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    seconds = {name: round(min(once(*shape) for _ in range(runs)), 3) for name, shape in SHAPES.items()}
    print(json.dumps({"metric": "benchmark query shapes, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
