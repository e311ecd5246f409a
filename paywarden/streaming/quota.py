"""Sliding-window request quota per client; only accepted requests use it up."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from paywarden.operators.scan import MAX_ROWS_PER_TASK, Metric, find_hot_keys, prefix_scan
from paywarden.streaming.velocity import STATE_STORE

# The published budget.
WINDOW_US = 60_000_000
MAX_REQUESTS = 30

COLUMNS = ["client", "request_id", "ts_us", "accepted", "retry_after_s"]
OUTPUT = "client STRING, request_id STRING, ts_us BIGINT, accepted BOOLEAN, retry_after_s INT"


def decide(accepted: deque, now: int, window_us: int, limit: int) -> tuple[bool, int | None]:
    """Accept or refuse one request, given the accepted times still in the window."""
    while accepted and now - accepted[0] >= window_us:
        accepted.popleft()
    if len(accepted) >= limit:
        return False, max(1, math.ceil((window_us - (now - accepted[0])) / 1e6))
    accepted.append(now)
    return True, None


def batch_quota(
    requests: DataFrame, window_us: int = WINDOW_US, limit: int = MAX_REQUESTS, max_rows: int = MAX_ROWS_PER_TASK
) -> DataFrame:
    """Decide a table of (client, request_id, ts_us).

    A pause as long as the window empties the budget, so a client's timeline falls
    into independent stretches at such pauses. Each stretch is sorted by Spark and
    read as a stream of Arrow batches; a task holds at most ``limit`` times.
    """
    hot = find_hot_keys(requests, ["client"], "ts_us", max_rows)
    order = ["ts_us", "request_id"]
    rows = prefix_scan(requests, ["client"], order, {"_prev": Metric("lag", F.col("ts_us"))}, hot)
    fresh = F.when(F.col("_prev").isNull() | (F.col("ts_us") - F.col("_prev") >= window_us), 1).otherwise(0).cast("long")
    rows = prefix_scan(rows.withColumn("_fresh", fresh), ["client"], order, {"stretch": Metric("sum", F.col("_fresh"), True)}, hot)
    laid_out = (
        rows.select("client", "request_id", "ts_us", "stretch")
        .repartition("client", "stretch")
        .sortWithinPartitions("client", "stretch", *order)
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, accepted = None, deque()
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if (row.client, row.stretch) != current:
                    current, accepted = (row.client, row.stretch), deque()
                ok, wait = decide(accepted, int(row.ts_us), window_us, limit)
                out.append((row.client, row.request_id, int(row.ts_us), ok, wait))
            frame = pd.DataFrame(out, columns=COLUMNS)
            frame["retry_after_s"] = frame["retry_after_s"].astype("Int32")
            yield frame

    return laid_out.mapInPandas(run, OUTPUT)


class ClientQuota(StatefulProcessor):
    """Accepted times of one client, never more than the limit; cleared when the watermark has left the window behind.

    One timer a client is set to the end of the window of its newest accepted request.
    """

    def __init__(self, window_us: int = WINDOW_US, limit: int = MAX_REQUESTS) -> None:
        self._window_us, self._limit = window_us, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._accepted = handle.getListState("accepted", "ts_us BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["ts_us", "request_id"], kind="stable")
        known = self._accepted.exists()
        accepted = deque(int(r[0]) for r in self._accepted.get()) if known else deque()
        out = []
        for row in batch.itertuples(index=False):
            ok, wait = decide(accepted, int(row.ts_us), self._window_us, self._limit)
            out.append((key[0], row.request_id, int(row.ts_us), ok, wait))
        if accepted:
            self._accepted.put([(a,) for a in accepted])
            if not known:
                self._handle.registerTimer(self._over(accepted))
        frame = pd.DataFrame(out, columns=COLUMNS)
        frame["retry_after_s"] = frame["retry_after_s"].astype("Int32")
        yield frame

    def _over(self, accepted) -> int:
        return (max(accepted) + self._window_us) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        accepted = [int(r[0]) for r in self._accepted.get()] if self._accepted.exists() else []
        if accepted and self._over(accepted) > timerValues.getCurrentWatermarkInMs():
            self._handle.registerTimer(self._over(accepted))
        else:
            self._accepted.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_quota(requests: DataFrame, window_us: int = WINDOW_US, limit: int = MAX_REQUESTS, late: str = "10 minutes") -> DataFrame:
    """Decide requests as they come; those more than ``late`` behind the newest are dropped, and ``LateRows`` counts them."""
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    timed = requests.withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", late)
    return timed.groupBy("client").transformWithStateInPandas(
        statefulProcessor=ClientQuota(window_us, limit), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime"
    )
