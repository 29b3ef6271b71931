"""Mixing sources to target weights by Sainte-Laguë apportionment. Built-in functions only.

Weights give each source a target number of words (at most twice its size). Equal blocks of words are then seats:
sources get them by highest quotients target / (2 s - 1); a source's blocks go to its shards (groups of some two
thousand documents, by a seeded hash) by the same rule. A shard lays its documents end to end in seeded order and
takes its first blocks, beginning anew after the last, so that no document is taken more than twice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import REST, brought_back, set_aside, word_count, written

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
#: Words of a block, documents of a shard on average.
BLOCK, SHARD_ROWS = 16, 2000
SEED = "mix-1"
#: Sources are sent to all executors up to this number of them.
SMALL = 20_000


def in_order(df: DataFrame, order: list[str], sums: dict[str, str] | None = None) -> DataFrame:
    """Adds _pos (from 1, by `order`) and for each name in `sums` the sum of a column over the rows before.

    Ranges of the order are numbered each by itself; only the ranges' totals, a row for each partition of the shuffle, meet in one task.
    """
    sums = sums or {}
    ranges = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    zero = {k: F.lit(0).cast(dict(df.dtypes)[c]) for k, c in sums.items()}
    so_far = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"), *(F.sum(c).alias(k) for k, c in sums.items()))
    begin = totals.select("_range", F.coalesce(F.sum("_rows").over(so_far), F.lit(0)).alias("_first"), *(F.coalesce(F.sum(k).over(so_far), zero[k]).alias(f"_0{k}") for k in sums))
    inside = Window.partitionBy("_range").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = ranges.join(begin, "_range").withColumn("_pos", F.col("_first") + F.row_number().over(inside))
    for k, c in sums.items():
        out = out.withColumn(k, F.col(f"_0{k}") + F.coalesce(F.sum(c).over(before), zero[k]))
    return out.select(*df.columns, "_pos", *sums)


def _seats(df: DataFrame, votes: str, seats: Column, total: Column, n: Column) -> DataFrame:
    """Adds _sure and _most, between which the seats of a row lie.

    A seat s counts votes / (2 s - 1). With n rows and N seats, the divisor at which just N seats are filled lies
    between those of N - n/2 and N + n/2: seats beyond doubt are counted in closed form, and only the some 2 n seats
    between the two have to be ranked.
    """
    sure = F.when((seats - n / 2 > 0) & (total > 0), F.floor(F.col(votes) * (seats - n / 2) / total + 0.5)).otherwise(0).cast("long")
    most = F.when(total > 0, F.floor(F.col(votes) * (seats + n / 2) / total + 0.5) + 1).otherwise(0).cast("long")
    return df.withColumn("_sure", sure).withColumn("_most", most)


def _open(bounds: DataFrame, votes: str, columns: list[str]) -> DataFrame:
    """The seats in doubt, with _less: the quotient's negative, so that the highest comes first."""
    seat = F.explode(F.when(F.col("_most") > F.col("_sure"), F.sequence(F.col("_sure") + 1, F.col("_most"))))
    return bounds.filter(F.col(votes) > 0).select(*columns, votes, seat.alias("_seat")).withColumn("_less", -(F.col(votes) / (2 * F.col("_seat") - 1)))


def apportion(df: DataFrame, votes: str, seats: str, key: list[str], within: list[str], out: str) -> DataFrame:
    """Adds `out`: the seats that each row gets of its group's `seats` by Sainte-Laguë. Ties go to the smaller key."""
    w = Window.partitionBy(*within)
    bounds = _seats(df.withColumn("_total", F.sum(votes).over(w)).withColumn("_n", F.count(F.lit(1)).over(w)), votes, F.col(seats), F.col("_total"), F.col("_n"))
    bounds = bounds.withColumn("_left", F.col(seats) - F.sum("_sure").over(w))
    ranked = _open(bounds, votes, [*within, *key, "_left"]).withColumn("_rank", F.row_number().over(w.orderBy("_less", *key)))
    extra = ranked.filter(F.col("_rank") <= F.col("_left")).groupBy(*within, *key).agg(F.count(F.lit(1)).alias("_extra"))
    return bounds.join(extra, [*within, *key], "left").withColumn(out, F.col("_sure") + F.coalesce("_extra", F.lit(0))).drop("_total", "_n", "_sure", "_most", "_left", "_extra")


def apportion_all(df: DataFrame, votes: str, seats: int, key: list[str], out: str) -> DataFrame:
    """apportion() with all rows in one group, however many they are: no window holds them all."""
    total, n = df.agg(F.sum(votes), F.count(F.lit(1))).first()
    bounds = _seats(df, votes, F.lit(seats), F.lit(total or 0.0), F.lit(n))
    left = seats - (bounds.agg(F.sum("_sure")).first()[0] or 0)
    extra = in_order(_open(bounds, votes, key), ["_less", *key]).filter(F.col("_pos") <= left).groupBy(*key).agg(F.count(F.lit(1)).alias("_extra"))
    return bounds.join(extra, key, "left").withColumn(out, F.col("_sure") + F.coalesce("_extra", F.lit(0))).drop("_sure", "_most", "_extra")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Adds weight and target to one row a source (_null, _source, source_size).

    Targets are min(cap, weight * level), where the level makes them add up: what capped sources leave is shared by weight.
    In the order of cap / weight, the level is that of the first source which it does not fill.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("_pos") - 1) % len(weights) + 1).cast("int")).cast("double")
    s = in_order(sources, ["_null", "_source"]).withColumn("weight", weight).drop("_pos").withColumn("_cap", F.col("source_size") * F.lit(most))
    s = in_order(s.withColumn("_at", F.col("_cap") / F.col("weight")), ["_at", "_null", "_source"], {"_below": "_cap", "_lighter": "weight"})
    every, heavy = s.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit((every or 0) * share) - F.col("_below")) / (F.lit(heavy or 0.0) - F.col("_lighter"))
    level = s.filter(level * F.col("weight") <= F.col("_cap")).agg(F.min_by(level, "_pos")).first()[0]
    target = F.col("_cap") if level is None else F.least(F.col("_cap"), F.col("weight") * F.lit(level))
    return s.withColumn("target", target).drop("_cap", "_at", "_pos", "_below", "_lighter")


def plan_mix(docs: DataFrame, carry: list[str] = [], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, shard_rows: int = SHARD_ROWS, seed: str = SEED) -> DataFrame:  # noqa: B006
    """doc_id, source, size, source_size, target and taken (words) of every row, and the columns named in `carry`.

    A null text has size 0; a null source is a source of its own, last in order; a null doc_id is ordered as 'null'.
    Repeated rows are rows of their own. Sources without a word have target 0. An empty table gives no rows.
    Texts are read once: sizes are written to the shared folder, and the rest works on them.
    """
    sized = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), *carry)
        .withColumn("_null", F.col("source").isNull()).withColumn("_source", F.coalesce("source", F.lit("")))
        .withColumn("_seeded", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))),
        "sizes",
    )
    sources = sized.groupBy("_null", "_source").agg(F.sum("size").alias("source_size"), F.ceil(F.count(F.lit(1)) / F.lit(shard_rows)).cast("long").alias("_shards"))
    sources = written(targets(written(sources, "sums"), weights, share, most), "targets")
    blocks = math.floor((sources.agg(F.sum("target")).first()[0] or 0.0) / block + 0.5)
    sources = apportion_all(sources, "target", blocks, ["_null", "_source"], "quota").select("_null", "_source", "_shards", "source_size", "target", "quota")
    sources = written(sources, "sources")
    if sources.count() <= SMALL:  # a few MB at most; beyond that Spark shuffles, and splits a source that holds too many rows
        sources = F.broadcast(sources)
    dealt = sized.join(sources.select("_null", "_source", "_shards"), ["_null", "_source"]).withColumn("_shard", F.conv(F.substring("_seeded", 1, 15), 16, 10).cast("long") % F.col("_shards")).drop("_shards")
    shards = dealt.groupBy("_null", "_source", "_shard").agg(F.sum("size").alias("shard_size")).join(sources.drop("_shards"), ["_null", "_source"])
    shards = apportion(shards.withColumn("_votes", F.col("shard_size").cast("double")), "_votes", "quota", ["_shard"], ["_null", "_source"], "blocks")
    w = Window.partitionBy("_null", "_source", "_shard").orderBy("_seeded", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.join(shards.select("_null", "_source", "_shard", "shard_size", "source_size", "target", "blocks"), ["_null", "_source", "_shard"]).withColumn("_before", F.coalesce(F.sum("size").over(w), F.lit(0)))
    words = F.least(F.col("blocks") * block, F.col("shard_size") * 2)
    overlap = lambda upto: F.greatest(F.lit(0), F.least(F.col("size"), upto - F.col("_before")))
    return rows.select("doc_id", "source", "size", "source_size", "target", (overlap(words) + overlap(words - F.col("shard_size"))).cast("long").alias("taken"), *carry)


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself, with the columns of `docs`: a row for each time that a document is taken.

    A document taken whole keeps its text as it is; one taken in part keeps its first words, joined by one blank.
    Documents not taken go. n_chars, where there is one, is counted anew for a text that is cut.
    """
    plain = ("doc_id", "source", "text")
    plan = plan_mix(set_aside(docs, *plain), carry=["text", REST], **how).filter("taken > 0")
    plan = plan.withColumn("_words", F.explode(F.when(F.col("taken") > F.col("size"), F.array("size", F.col("taken") - F.col("size"))).otherwise(F.array("taken"))))
    cut = F.array_join(F.slice(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != ""), 1, F.col("_words").cast("int")), " ")
    part = F.col("_words") < F.col("size")
    changed = {"text": F.when(part, cut).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(part, F.length(cut).cast("long")).otherwise(F.col(REST).getField("n_chars"))
    return brought_back(plan, docs.columns, plain, **changed)


SQL = rf"""
WITH sized AS (
  SELECT doc_id, coalesce(source, '') AS s, source IS NULL AS n, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS seeded
  FROM documents),
src0 AS (SELECT n, s, sum(size)::BIGINT AS source_size, ceil(count(*) / {SHARD_ROWS}.0)::BIGINT AS shards FROM sized GROUP BY n, s),
src1 AS (SELECT *, ([5.0, 2.0, 1.0])[(row_number() OVER (ORDER BY n, s) - 1) % 3 + 1]::DOUBLE AS weight, source_size * {MOST}::DOUBLE AS cap,
         (sum(source_size) OVER ()) * {SHARE}::DOUBLE AS need FROM src0),
src2 AS (SELECT *, row_number() OVER (ORDER BY cap / weight, n, s) AS pos,
         (need - coalesce(sum(cap) OVER (ORDER BY cap / weight, n, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, n, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM src1),
lvl AS (SELECT arg_min(lev, pos) AS lev FROM src2 WHERE lev * weight <= cap),
src3 AS (SELECT src2.* EXCLUDE (lev, pos), CASE WHEN lvl.lev IS NULL THEN cap ELSE least(cap, weight * lvl.lev) END AS target FROM src2 LEFT JOIN lvl ON true),
src4 AS (SELECT *, floor((sum(target) OVER ()) / {BLOCK} + 0.5)::BIGINT AS seats, sum(target) OVER () AS total, count(*) OVER () AS k FROM src3),
seat1 AS (SELECT n, s, row_number() OVER (ORDER BY target / (2 * i - 1) DESC, n, s) AS r, seats
          FROM (SELECT *, unnest(range(1, (floor(target * (seats + k / 2.0) / total + 0.5) + 2)::BIGINT)) AS i FROM src4 WHERE target > 0)),
src5 AS (SELECT src4.n, src4.s, shards, source_size, target, coalesce(q, 0) AS quota
         FROM src4 LEFT JOIN (SELECT n, s, count(*) AS q FROM seat1 WHERE r <= seats GROUP BY n, s) q1 ON src4.n = q1.n AND src4.s = q1.s),
dealt AS (SELECT sized.*, ('0x' || substr(seeded, 1, 15))::BIGINT % shards AS shard, source_size, target, quota
          FROM sized JOIN src5 ON sized.n = src5.n AND sized.s = src5.s),
sh1 AS (SELECT n, s, shard, sum(size)::BIGINT AS shard_size, any_value(quota) AS quota FROM dealt GROUP BY n, s, shard),
sh2 AS (SELECT *, sum(shard_size) OVER (PARTITION BY n, s) AS total, count(*) OVER (PARTITION BY n, s) AS k FROM sh1),
seat2 AS (SELECT n, s, shard, quota, row_number() OVER (PARTITION BY n, s ORDER BY shard_size::DOUBLE / (2 * i - 1) DESC, shard) AS r
          FROM (SELECT *, unnest(range(1, (floor(shard_size::DOUBLE * (quota + k / 2.0) / total + 0.5) + 2)::BIGINT)) AS i FROM sh2 WHERE shard_size > 0)),
sh3 AS (SELECT sh2.n, sh2.s, sh2.shard, shard_size, coalesce(b, 0) AS blocks
        FROM sh2 LEFT JOIN (SELECT n, s, shard, count(*) AS b FROM seat2 WHERE r <= quota GROUP BY n, s, shard) q2 ON sh2.n = q2.n AND sh2.s = q2.s AND sh2.shard = q2.shard),
laid AS (SELECT d.*, shard_size, least(blocks * {BLOCK}, shard_size * 2) AS words,
         coalesce(sum(size) OVER (PARTITION BY d.n, d.s, d.shard ORDER BY seeded, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
         FROM dealt d JOIN sh3 ON d.n = sh3.n AND d.s = sh3.s AND d.shard = sh3.shard)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, words - before)) + greatest(0, least(size, words - shard_size - before)))::BIGINT AS taken FROM laid
"""
