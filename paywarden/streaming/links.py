"""Session correlation on a stream: the last payments of a session are its keyed state, and idle sessions leave."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from paywarden.operators.sessions import LINK_THRESHOLD, RECENT, described_links, has_threat
from paywarden.streaming.velocity import DAY_US, STATE_STORE, plain_rows

# What a link looks at, besides the place of a payment in its session.
FIELDS = ("ts_us", "txn_id", "amount", "call_active_during_txn", "screen_share_active", "ip_is_proxy", "beneficiary_added_ago_s", "threat")
RING = "ts_us BIGINT, txn_id STRING, amount DOUBLE, call_active_during_txn BOOLEAN, screen_share_active BOOLEAN, ip_is_proxy BOOLEAN, beneficiary_added_ago_s BIGINT, threat BOOLEAN"
PAIR = "session_id STRING, " + ", ".join(f"{side}_{field}" for side in "ab" for field in RING.split(", "))


def _by_time(row: tuple) -> tuple:
    return row[0], row[1]


# Sessions share state by hash: a call to the state store costs more than a session's few payments.
PARTS = 1_024


class SessionRing(StatefulProcessor):
    """The last ``n`` payments of each session of a part; a new one is paired with those before it.

    New payments are appended to the part's list, which is written anew when most of it
    is out of use. A timer stands at or before the time the first session of the part is
    idle for ``ttl_us``; when the watermark reaches it, idle sessions are dropped.
    """

    def __init__(self, n: int = RECENT, ttl_us: int = DAY_US) -> None:
        self._n, self._ttl_us = n, ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._rings = handle.getListState("rings", f"session_id STRING, {RING}")

    def _held(self) -> tuple[dict[str, list[tuple]], int]:
        """The last payments of each session in order, and how many rows the list has."""
        held: dict[str, list[tuple]] = {}
        size = 0
        for r in self._rings.get():
            session, *row = tuple(r)
            held.setdefault(session, []).append(tuple(row))
            size += 1
        return {session: sorted(rows, key=_by_time)[-self._n :] for session, rows in held.items()}, size

    def _idle_at(self, rows: list[tuple]) -> int:
        return (rows[-1][0] + self._ttl_us) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[str, list[tuple]] = {}
        for frame in rows:
            for session, *row in plain_rows(frame, ("session_id", *FIELDS)):
                new.setdefault(session, []).append(tuple(row))
        held, size = self._held()
        first = min(map(self._idle_at, held.values()), default=None)
        pairs, fresh = [], []
        for session, arrived in new.items():
            ring = held.setdefault(session, [])
            for row in sorted(arrived, key=_by_time):
                at = bisect_left(ring, _by_time(row), key=_by_time)
                if row[-1]:
                    pairs += [(session, *a, *row) for a in ring[max(0, at - self._n) : at] if a[-1]]
                insort(ring, row, key=_by_time)
            # Only payments of this batch may lie before the last n, where later ones of it still look.
            del ring[: -self._n]
            fresh += [(session, *row) for row in sorted(arrived, key=_by_time)[-self._n :]]
        soonest = min(map(self._idle_at, held.values()))
        if first is None or soonest < first:
            self._handle.registerTimer(soonest)
        if size + len(fresh) > 2 * sum(map(len, held.values())):
            self._rings.put([(session, *row) for session, ring in held.items() for row in ring])
        else:
            self._rings.appendList(fresh)
        if pairs:
            yield pd.DataFrame(pairs, columns=["session_id", *(f"{s}_{f}" for s in "ab" for f in FIELDS)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held, _ = self._held()
        live = {session: ring for session, ring in held.items() if self._idle_at(ring) > now}
        if live:
            if len(live) < len(held):
                self._rings.put([(session, *row) for session, ring in live.items() for row in ring])
            self._handle.registerTimer(min(map(self._idle_at, live.values())))
        else:
            self._rings.clear()
        return iter(())

    def close(self) -> None:
        pass


def link_sessions(
    payments: DataFrame, ttl_us: int = DAY_US, threshold: float = LINK_THRESHOLD, n: int = RECENT, late: str = "1 day"
) -> DataFrame:
    """Links of each new payment to the ``n`` before it in its session, as a stream to append.

    The columns are those of ``session_links``. A session that is idle for ``ttl_us`` of
    event time is forgotten; payments more than ``late`` behind the newest are
    dropped, and ``LateRows`` counts them. A payment that comes late but in time is
    linked to what the session's last ``n`` payments hold before it. Payments
    without a session are left out. One task holds a part's payments of a
    micro-batch, so the trigger's limit on files bounds it.
    """
    payments.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    slim = payments.filter("session_id IS NOT NULL").select(
        "session_id", "ts_us", "txn_id", F.col("amount").cast("double").alias("amount"), "call_active_during_txn", "screen_share_active", "ip_is_proxy",
        F.col("beneficiary_added_ago_s").cast("long").alias("beneficiary_added_ago_s"), has_threat().alias("threat"),
        F.timestamp_micros("ts_us").alias("event_time"), F.pmod(F.xxhash64("session_id"), F.lit(PARTS)).alias("_part"),
    ).withWatermark("event_time", late)
    pairs = slim.groupBy("_part").transformWithStateInPandas(
        statefulProcessor=SessionRing(n, ttl_us), outputStructType=PAIR, outputMode="Append", timeMode="EventTime"
    )
    side = lambda s: F.struct("session_id", *(F.col(f"{s}_{f}").alias(f) for f in FIELDS)).alias(s)
    return described_links(pairs.select(side("a"), side("b")), threshold)
