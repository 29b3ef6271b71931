"""Recording and alerting rules: evaluated in batch against a store, with alert states carried from run to run."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.engine import Engine
from tideline.functions import labels as L
from tideline.sources.store import Store, store_of

STATE = "labels map<string,string>, value double, fired_since long, status string"


@dataclass(frozen=True)
class AlertRule:
    alert: str
    expr: str
    wait: int = 0  # milliseconds that a series must alert before it fires
    labels: dict[str, str] = field(default_factory=dict)
    annotations: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class RecordingRule:
    record: str
    expr: str
    labels: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Group:
    name: str
    rules: tuple[AlertRule | RecordingRule, ...]
    interval: int | None = None


def parse_groups(config: dict) -> list[Group]:
    """Rule groups of a loaded rule file: groups[].rules[] with alert or record."""
    from tideline.config import duration_ms

    out = []
    for g in config.get("groups", []):
        rules: list[AlertRule | RecordingRule] = []
        for r in g.get("rules", []):
            labels = {k: str(v) for k, v in (r.get("labels") or {}).items()}
            if "alert" in r:
                rules.append(AlertRule(r["alert"], r["expr"], duration_ms(r.get("for", 0)), labels, r.get("annotations") or {}))
            elif "record" in r:
                rules.append(RecordingRule(r["record"], r["expr"], labels))
            else:
                raise ValueError(f"a rule needs alert or record: {r}")
        out.append(Group(g["name"], tuple(rules), duration_ms(g["interval"]) if "interval" in g else None))
    return out


def alert_states(engine: Engine, rule: AlertRule, at: int, before: DataFrame | None = None) -> DataFrame:
    """The alerting series of a rule (labels, value, fired_since, status) at a time.

    A series alerts at a value of 1 or more. It keeps the time since when it has alerted without a break (`before` holds
    the last run's states) and is FIRING once that is the rule's wait ago, else PENDING. Series that stopped are not returned.
    """
    now = engine.query_instant(rule.expr, at).filter(F.col("value") >= 1.0)
    key = L.from_map(F.col("labels"))
    now = now.select("labels", "value", key.alias("key"))
    if before is not None:
        now = now.join(before.select(L.from_map(F.col("labels")).alias("key"), "fired_since"), "key", "left")
    else:
        now = now.withColumn("fired_since", F.lit(None).cast("long"))
    since = F.coalesce("fired_since", F.lit(at).cast("long"))
    return now.select("labels", "value", since.alias("fired_since"), F.when(F.lit(at) - since >= rule.wait, "FIRING").otherwise("PENDING").alias("status"))


def alert_labels(rule: AlertRule, states: DataFrame) -> DataFrame:
    """States with the labels of the alert: those of the series without its name, of the rule, and its name."""
    labels = L.drop(L.from_map(F.col("labels")), [L.NAME])
    for k, v in {**rule.labels, "alertname": rule.alert}.items():
        labels = L.put(labels, k, F.lit(v))
    return states.withColumn("labels", L.to_map(labels))


def record(engine: Engine, rule: RecordingRule, at: int) -> Store:
    """The samples that a recording rule adds at a time: save() appends them."""
    rows = engine.query_instant(rule.expr, at)
    labels = L.from_map(F.col("labels"))
    for k, v in {**rule.labels, L.NAME: rule.record}.items():
        labels = L.put(labels, k, F.lit(v))
    return store_of(rows.select(labels.alias("labels"), F.col("t").alias("ts"), "value"))


@dataclass
class Job:
    name: str
    run: object  # called with the time in ms
    interval: int
    next_at: int
    terminated: bool = False


class Scheduler:
    """Jobs with intervals on the driver. A run puts a job back at begin + interval; one that fails is tried at its next time."""

    def __init__(self):
        self.jobs: dict[str, Job] = {}
        self.errors: list[tuple[str, int, Exception]] = []

    def add(self, name: str, run, interval: int, first: int = 0) -> Job:
        self.jobs[name] = Job(name, run, interval, first)
        return self.jobs[name]

    def terminate(self, name: str) -> None:
        self.jobs[name].terminated = True

    def run_due(self, now: int) -> list[str]:
        """Runs what is due; returns the names."""
        ran = []
        for job in sorted(self.jobs.values(), key=lambda j: j.next_at):
            if job.terminated or job.next_at > now:
                continue
            job.next_at = now + job.interval
            try:
                job.run(now)
            except Exception as e:  # the others go on
                self.errors.append((job.name, now, e))
            ran.append(job.name)
        return ran


class RuleRunner:
    """Runs rule groups against a store folder: recordings are appended, alert states kept between runs."""

    def __init__(self, spark, path: str, groups: list[Group], interval: int = 15_000):
        self.spark, self.path, self.states = spark, path, {}
        self.scheduler = Scheduler()
        for g in groups:
            self.scheduler.add(g.name, lambda now, g=g: self.run(g, now), g.interval or interval)

    def run(self, group: Group, now: int) -> None:
        from tideline.sources.store import load, save

        engine = Engine(load(self.spark, self.path))
        for r in group.rules:
            if isinstance(r, RecordingRule):
                save(record(engine, r, now), self.path)
            else:
                before = self.states.get((group.name, r.alert))
                rows = alert_states(engine, r, now, None if before is None else self.spark.createDataFrame(before, STATE)).collect()  # alerting series only
                self.states[group.name, r.alert] = [tuple(x) for x in rows]
