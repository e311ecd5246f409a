"""Online payer features: the same numbers as the batch windows, in time order behind the watermark."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
NEVER_S = 999_999.0

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

FEATURES = (
    "txn_count_last_1h", "txn_count_last_24h", "amount_spent_last_1h", "amount_spent_last_24h",
    "historical_average_amount", "amount_deviation", "time_since_prev_txn", "new_merchant_indicator",
    "new_device_indicator", "new_ip_indicator",
)
OUTPUT = "payer_id STRING, txn_id STRING, ts_us BIGINT, " + ", ".join(f"{c} DOUBLE" for c in FEATURES)


PENDING = "ts_us BIGINT, txn_id STRING, cents BIGINT, payee_id STRING, device_id STRING, ip_asn STRING"


def plain_rows(frame: pd.DataFrame, columns: Iterable[str]) -> list[tuple]:
    """Rows as tuples of plain values, None for missing ones; made for the many small frames of keyed state."""
    return list(zip(*([None if v is None or v is pd.NaT or v != v else v for v in frame[c].tolist()] for c in columns), strict=True))


class Trailing:
    """Count and sum of the payments of the last ``width`` microseconds, both ends closed."""

    def __init__(self, width: int, rows: Iterable[tuple[int, int]] = ()):
        self.width, self.rows, self.total = width, deque(), 0
        for ts, cents in rows:
            self.add(ts, cents)

    def add(self, ts: int, cents: int) -> None:
        self.rows.append((ts, cents))
        self.total += cents

    def at(self, ts: int) -> tuple[float, float]:
        while self.rows and self.rows[0][0] < ts - self.width:
            self.total -= self.rows.popleft()[1]
        return float(len(self.rows)), self.total / 100.0


class PayerVelocity(StatefulProcessor):
    """Per payer: payments the watermark has not passed, those of the last 24 h, running totals, values seen.

    Payments wait until the watermark passes them and are then emitted in time
    order, so rows that arrive out of order inside the watermark get the numbers of
    the batch windows. Values seen and totals are kept for good: a payee is new once.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._pending = handle.getListState("pending", PENDING)
        self._recent = handle.getListState("recent", "ts_us BIGINT, cents BIGINT")
        self._totals = handle.getValueState("totals", "n BIGINT, cents BIGINT, last_us BIGINT")
        self._seen = handle.getListState("seen", "kind STRING, value STRING")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            new = plain_rows(frame, ("ts_us", "txn_id", "cents", "payee_id", "device_id", "ip_asn"))
            self._pending.appendList([(int(r[0]), r[1], int(r[2]), *r[3:]) for r in new])
            low = int(min(r[0] for r in new))
            first = low if first is None else min(first, low)
        if first is not None:
            self._handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((tuple(r) for r in self._pending.get()), key=lambda r: (r[0], r[1]))
        ready = [r for r in waiting if r[0] <= passed]
        rest = waiting[len(ready) :]
        if rest:
            self._pending.put(rest)
            self._handle.registerTimer(rest[0][0] // 1000 + 1)
        else:
            self._pending.clear()
        if not ready:
            return
        kept = [(int(r[0]), int(r[1])) for r in self._recent.get()]
        # Read and appended as a whole: a call to the state store for each value would cost more than the rest.
        seen, fresh = {tuple(r) for r in self._seen.get()}, []
        hour, day = Trailing(HOUR_US, kept), Trailing(DAY_US, kept)
        n, total, last = self._totals.get() if self._totals.exists() else (0, 0, None)
        out = []
        for ts, txn_id, cents, payee, device, ip in ready:
            (n_hour, sum_hour), (n_day, sum_day) = hour.at(ts), day.at(ts)
            average = total / 100.0 / n if n else 0.0
            out.append(
                (
                    key[0], txn_id, ts, n_hour, n_day, sum_hour, sum_day, average,
                    abs(cents / 100.0 - average) if n else 0.0, (ts - last) / 1e6 if last is not None else NEVER_S,
                    *(self._first(kind, value, seen, fresh) for kind, value in (("payee", payee), ("device", device), ("ip", ip))),
                )
            )
            hour.add(ts, cents)
            day.add(ts, cents)
            n, total, last = n + 1, total + cents, ts
        self._recent.put(list(day.rows))
        self._totals.update((n, total, last))
        if fresh:
            self._seen.appendList(fresh)
        yield pd.DataFrame(out, columns=["payer_id", "txn_id", "ts_us", *FEATURES])

    @staticmethod
    def _first(kind: str, value, seen: set, fresh: list) -> float:
        if value is None or value == "" or value != value:
            return 0.0
        if (kind, str(value)) in seen:
            return 0.0
        seen.add((kind, str(value)))
        fresh.append((kind, str(value)))
        return 1.0

    def close(self) -> None:
        pass


class LateRows(StreamingQueryListener):
    """Counts the rows that streams drop because the watermark has passed them, over the whole life of each run.

    Add it with ``spark.streams.addListener``. A query's own progress list forgets all
    but its last entries; a listener sees every one.
    """

    def __init__(self) -> None:
        self._dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self._dropped.setdefault(str(event.runId), 0)

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        self._dropped[run] = self._dropped.get(run, 0) + sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def of(self, query: StreamingQuery) -> int:
        return self._dropped.get(str(query.runId), 0)


def online_velocity(payments: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Velocity features of a payments stream, emitted once the watermark is past a payment.

    Rows later than ``late`` are dropped by the watermark; ``LateRows`` counts them.
    """
    payments.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    slim = payments.select(
        "payer_id", "txn_id", "ts_us", "cents", "payee_id", "device_id", "ip_asn", F.timestamp_micros("ts_us").alias("event_time")
    ).withWatermark("event_time", late)
    return slim.groupBy("payer_id").transformWithStateInPandas(
        statefulProcessor=PayerVelocity(), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime"
    )


def payee_fan_in(payments: DataFrame, width: str = "1 hour", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Distinct payers and payments per payee and sliding window, exact.

    Pairs are counted first, so a busy payee is dealt out by its payers.
    """
    timed = payments.withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", late)
    pairs = timed.groupBy(F.window("event_time", width, slide), "payee_id", "payer_id").agg(F.count("*").alias("n"))
    return pairs.groupBy("window", "payee_id").agg(
        F.count("payer_id").alias("distinct_payers"), F.sum("n").alias("n")
    )
