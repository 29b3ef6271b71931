"""Alert states over a stream of evaluated rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "rule string, series string, ts long, fired_since long, status string"
#: Milliseconds without a row after which a series has stopped to alert: as long as a sample is current.
QUIET = 300_000
#: Rows of an evaluation may come so much later than those of the next ones.
LATE = "1 minute"


def follower(quiet: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """States of one rule's series: since when it has alerted without a break. A value below 1, or `quiet` without a row, ends it (status INACTIVE)."""

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, last = state.get if state.exists else (None, None)
        rows = []
        if state.hasTimedOut:
            rows.append((*key, last + quiet, since, "INACTIVE"))
            since = None
        else:
            for at, value, wait in sorted((int(r.ts), float(r.value), int(r.wait)) for b in batches for r in b.itertuples()):
                if since is not None and at > last + quiet:
                    rows.append((*key, last + quiet, since, "INACTIVE"))
                    since = None
                if value >= 1.0:
                    since, last = at if since is None else since, at
                    rows.append((*key, at, since, "FIRING" if at - since >= wait else "PENDING"))
                else:
                    if since is not None:
                        rows.append((*key, at, since, "INACTIVE"))
                    since = None
        if since is not None:
            state.update((since, last))
            state.setTimeoutTimestamp(max(last + quiet, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=["rule", "series", "ts", "fired_since", "status"])

    return follow


def alert_stream(evaluated: DataFrame, quiet: int = QUIET, late: str = LATE) -> DataFrame:
    """rule, series, ts, fired_since and status for each row of a stream (rule, series, ts, value, wait).

    A rule like `x > 5` sends no row for a series that no longer alerts: it ends `quiet` milliseconds after its last row,
    in the stream's own time, and its state goes. A row without a series only moves that time: an evaluation that
    gives nothing sends one.
    """
    at = F.timestamp_millis(F.col("ts") + 1)  # after the epoch, where a stream's watermark begins
    rows = evaluated.withColumn("at", at).withWatermark("at", late).filter("series is not null")
    return rows.groupBy("rule", "series").applyInPandasWithState(follower(quiet), OUT, "fired_since long, last long", "append", GroupStateTimeout.EventTimeTimeout)
