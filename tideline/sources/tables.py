"""The star-schema tables as stores of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import labels as L
from tideline.sources.store import Store, store_of

#: Where the dimension tables' samples stand: 2024-01-01 00:00 UTC.
EPOCH = 1_704_067_200_000
#: Upper bounds of the histogram view.
BOUNDS = (10.0, 25.0, 50.0, 100.0, 200.0)


def millis(ts: Column) -> Column:
    """Milliseconds of a time column; one without a zone counts in the session's zone, UTC throughout."""
    return F.unix_millis(ts.cast("timestamp"))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(df: DataFrame, name: str, labels: dict[str, Column], ts: Column, value: Column, order: Column | None = None) -> Store:
    named = L.of_columns({L.NAME: F.lit(name), **labels})
    rows = df.select(named.alias("labels"), ts.alias("ts"), value.alias("value"), *([] if order is None else [order.alias("_seq")]))
    return store_of(rows, None if order is None else "_seq")


def event_value(spark: SparkSession, sf_dir: str) -> Store:
    """event_value{event_type}: each event's value; of events at one time the last counts."""
    e = _read(spark, sf_dir, "events")
    return _rows(e, "event_value", {"event_type": e.event_type}, millis(e.ts), e.value, e.event_id)


def event_total(spark: SparkSession, sf_dir: str) -> Store:
    """event_total{event_type}: a counter that starts anew each day, read at each event."""
    e = _read(spark, sf_dir, "events")
    return _rows(e, "event_total", {"event_type": e.event_type}, millis(e.ts), (millis(e.ts) % 86_400_000) / 1000.0, e.event_id)


def event_user(spark: SparkSession, sf_dir: str) -> Store:
    """event_user{event_type,user_id}: many sparse series."""
    e = _read(spark, sf_dir, "events")
    return _rows(e, "event_user", {"event_type": e.event_type, "user_id": e.user_id}, millis(e.ts), e.value, e.event_id)


def event_latency_bucket(spark: SparkSession, sf_dir: str) -> Store:
    """event_latency_bucket{event_type,le}: events of each hour by bound, at the hour's end."""
    e = _read(spark, sf_dir, "events")
    hour = (F.floor(millis(e.ts) / 3_600_000) + 1) * 3_600_000
    counted = e.groupBy("event_type", hour.alias("ts")).agg(*(F.count_if(e.value <= b).alias(f"b{k}") for k, b in enumerate(BOUNDS)), F.count(F.lit(1)).alias("all"))
    bounds = F.array(*(F.struct(F.lit(str(b)).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(BOUNDS)), F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))
    each = counted.select("event_type", "ts", F.explode(bounds).alias("b"))
    return _rows(each, "event_latency_bucket", {"event_type": F.col("event_type"), "le": F.col("b.le")}, F.col("ts"), F.col("b.n"))


def order_price(spark: SparkSession, sf_dir: str) -> Store:
    """order_price{priority,status}: sums of a day, at its beginning."""
    o = _read(spark, sf_dir, "orders")
    day = F.floor(millis(o.o_orderdate) / 86_400_000) * 86_400_000
    daily = o.groupBy("o_orderpriority", "o_orderstatus", day.alias("ts")).agg(F.sum("o_totalprice").alias("value"))
    return _rows(daily, "order_price", {"priority": F.col("o_orderpriority"), "status": F.col("o_orderstatus")}, F.col("ts"), F.col("value"))


def lineitem_qty(spark: SparkSession, sf_dir: str) -> Store:
    """lineitem_qty{flag,status}: quantities of a day."""
    li = _read(spark, sf_dir, "lineitem")
    day = F.floor(millis(li.l_shipdate) / 86_400_000) * 86_400_000
    daily = li.groupBy("l_returnflag", "l_linestatus", day.alias("ts")).agg(F.sum("l_quantity").alias("value"))
    return _rows(daily, "lineitem_qty", {"flag": F.col("l_returnflag"), "status": F.col("l_linestatus")}, F.col("ts"), F.col("value"))


def nation_info(spark: SparkSession, sf_dir: str) -> Store:
    """nation_info{nation,region}: 1 at EPOCH."""
    n, r = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    both = n.join(r, n.n_regionkey == r.r_regionkey)
    return _rows(both, "nation_info", {"nation": F.col("n_name"), "region": F.col("r_name")}, F.lit(EPOCH), F.lit(1.0))


def supplier_bal(spark: SparkSession, sf_dir: str) -> Store:
    """supplier_bal{nation,supplier}: account balances at EPOCH."""
    s, n = _read(spark, sf_dir, "supplier"), _read(spark, sf_dir, "nation")
    both = s.join(n, s.s_nationkey == n.n_nationkey)
    return _rows(both, "supplier_bal", {"nation": F.col("n_name"), "supplier": F.col("s_name")}, F.lit(EPOCH), F.col("s_acctbal"))


VIEWS = {f.__name__: f for f in (event_value, event_total, event_user, event_latency_bucket, order_price, lineitem_qty, nation_info, supplier_bal)}


def stores(spark: SparkSession, sf_dir: str, *names: str) -> Store:
    """One store of several views."""
    found = [VIEWS[n](spark, sf_dir) for n in names]
    samples, series = found[0].samples, found[0].series
    for s in found[1:]:
        samples, series = samples.unionByName(s.samples), series.unionByName(s.series)
    return Store(samples, series)
