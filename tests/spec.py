"""Runner of the scripts in tests/golden.

    load <step>            series lines follow: metric{labels} values
    eval instant at <time> <query>       expected lines follow: {labels} value
    eval_ordered ...       the same, in this order
    eval_fail ...          the query must fail
    clear

Values: a+bxN is a, a+b, .. (N more values after the first), vxN repeats v, _ is a gap, stale is a marker.
"""

from __future__ import annotations

import math
import re
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tideline.engine import Engine
from tideline.functions import labels as L
from tideline.plans.parser import duration
from tideline.sources.store import Store, store_of

METRIC = re.compile(r"([A-Za-z_:][A-Za-z0-9_:]*)?\s*(\{[^}]*\})?\s*(.*)")


def values(text: str) -> list[float | str | None]:
    out: list[float | str | None] = []
    for part in text.split():
        if m := re.fullmatch(r"(_|stale)(?:x(\d+))?", part):
            out += [None if m[1] == "_" else "stale"] * int(m[2] or 1)
        elif m := re.fullmatch(r"([+-]?[0-9.eE]+)([+-][0-9.eE]+)x(\d+)", part):
            out += [float(m[1]) + k * float(m[2]) for k in range(int(m[3]) + 1)]
        elif m := re.fullmatch(r"([+-]?[0-9.eE]+)x(\d+)", part):
            out += [float(m[1])] * (int(m[2]) + 1)
        else:
            out.append(float(part))
    return out


def metric(text: str) -> tuple[dict[str, str], str]:
    m = METRIC.match(text.strip())
    found = dict(re.findall(r'(\w+)="([^"]*)"', m[2] or ""))
    if m[1] and m[1] not in ("NaN", "Inf"):
        found["__name__"] = m[1]
        return found, m[3]
    return found, (m[1] or "") + m[3]


def store(spark: SparkSession, loads: list[tuple[int, str]]) -> Store:
    rows = []
    for step, line in loads:
        labels, rest = metric(line)
        for k, v in enumerate(values(rest)):
            if v is not None:
                rows.append((labels, k * step, float("nan") if v == "stale" else v, v == "stale"))
    df = spark.createDataFrame(rows, "labels map<string,string>, ts long, value double, stale boolean")
    made = store_of(df.withColumn("labels", L.from_map(F.col("labels"))))
    return Store(made.samples.cache(), made.series.cache())


def same(a: float, b: float) -> bool:
    return math.isnan(a) and math.isnan(b) or a == b or abs(a - b) <= 1e-6 * max(1.0, abs(b))


def steps(path: Path) -> list[tuple[int, str, str, list[str]]]:
    """(line, verb, argument, lines below) of each command."""
    out: list[tuple[int, str, str, list[str]]] = []
    for n, line in enumerate(path.read_text().splitlines(), 1):
        line = line.partition("# ")[0].rstrip()
        if not line.strip():
            continue
        if line[0] in " \t":
            out[-1][3].append(line.strip())
        else:
            verb, _, rest = line.partition(" ")
            out.append((n, verb, rest, []))
    return out


def run(spark: SparkSession, path: Path) -> int:
    """Runs a script; returns the number of queries."""
    loads: list[tuple[int, str]] = []
    engine, count = None, 0
    for n, verb, rest, below in steps(path):
        where = f"{path.name}:{n}: {rest}"
        if verb == "clear":
            loads, engine = [], None
        elif verb == "load":
            loads += [(duration(rest.strip()), line) for line in below]
            engine = None
        else:
            if engine is None:
                engine = Engine(store(spark, loads or [(1, 'nothing{a="b"} 0')]))
            m = re.match(r"instant(?: at (\S+))? (.*)", rest)
            at = 0 if m[1] is None or m[1] == "0" else duration(m[1])
            count += 1
            if verb == "eval_fail":
                try:
                    engine.query_instant(m[2], at).collect()
                except Exception:
                    continue
                raise AssertionError(f"{where}: did not fail")
            try:
                rows = [({k: v for k, v in r["labels"].items()}, r["value"]) for r in engine.query_instant(m[2], at).collect()]
            except Exception as e:
                raise AssertionError(f"{where}: {str(e)[:600]}") from e
            want = []
            for line in below:
                if re.fullmatch(r"[+-]?(\d.*|\.\d.*|NaN|[iI]nf)", line):
                    want.append(({}, float(line)))
                else:
                    labels, value = metric(line)
                    want.append((labels, float(value)))
            if verb != "eval_ordered":
                rows, want = (sorted(x, key=lambda p: sorted(p[0].items())) for x in (rows, want))
            assert [x for x, _ in rows] == [x for x, _ in want], f"{where}\n got {rows}\nwant {want}"
            assert all(same(a, b) for (_, a), (_, b) in zip(rows, want, strict=True)), f"{where}\n got {rows}\nwant {want}"
    return count
