"""Admission of messages as one stateful operator: repeats, refusals, blocks, limits and sessions of each user, with timers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

VERDICT = "event_id long, user_id long, t double, verdict string, session int"
_ROCKS, _PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.providerClass"


@dataclass(frozen=True)
class Rules:
    """Seconds and counts: admitted messages are a cooldown apart and at most so many a window; so many strikes in their window block; idle time ends a session."""

    cooldown: float = 3 * 3600.0
    window: float = 2 * 86400.0
    most: int = 8
    strike_window: float = 5 * 86400.0
    strikes: int = 2
    block: float = 3 * 86400.0
    idle: float = 12 * 3600.0
    remember: float = 7 * 86400.0


@dataclass
class Standing:
    """What is known of a user; sessions count from 1."""

    last: float = float("-inf")
    active: float = float("-inf")
    blocked: float = float("-inf")
    session: int = 0
    times: list[float] = field(default_factory=list)
    struck: list[float] = field(default_factory=list)

    def judge(self, t: float, refused: bool, violates: bool, rules: Rules) -> str:
        """The verdict on a message, in the order of the rules; only an admitted one leaves a trace."""
        if refused:
            return "refused"
        if t < self.blocked:
            return "blocked"
        if t - self.last < rules.cooldown:
            return "cooldown"
        self.times = [x for x in self.times if t - x < rules.window]
        if len(self.times) >= rules.most:
            return "limit"
        self.last = t
        self.times.append(t)
        if t - self.active >= rules.idle:
            self.session += 1
        self.active = t
        if not violates:
            return "admitted"
        self.struck = [x for x in self.struck if t - x < rules.strike_window] + [t]
        if len(self.struck) >= rules.strikes:
            self.struck, self.blocked = [], t + rules.block
        return "withheld"


class Admission(StatefulProcessor):
    """State of a user: standing (a value), times and strikes (lists), seen ids (a map); a timer ends the session and forgets old ids."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.standing = handle.getValueState("standing", "last double, active double, blocked double, session int, timer long")
        self.times = handle.getListState("times", "t double")
        self.struck = handle.getListState("struck", "t double")
        self.seen = handle.getMapState("seen", "event_id long", "t double")

    def _load(self) -> tuple[Standing, int]:
        if not self.standing.exists():
            return Standing(), 0
        *own, timer = self.standing.get()
        return Standing(*own, [x[0] for x in self.times.get()] if self.times.exists() else [], [x[0] for x in self.struck.get()] if self.struck.exists() else []), timer

    def _keep(self, s: Standing, timer: int) -> None:
        self.standing.update((s.last, s.active, s.blocked, s.session, timer))
        for state, values in ((self.times, s.times), (self.struck, s.struck)):
            if values:
                state.put([(x,) for x in values])
            else:
                state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(rows).sort_values(["t", "event_id"], kind="stable")  # of one user in one micro-batch
        s, timer = self._load()
        out, pending = [], bool(timer)
        for event, t, refused, violates in zip(every["event_id"], every["t"], every["refused"], every["violates"], strict=True):
            event = int(event)
            if self.seen.containsKey((event,)):
                out.append((event, key[0], t, "repeat", None))
                continue
            self.seen.updateValue((event,), (float(t),))
            session, end = s.session, s.active + self.rules.idle
            verdict = s.judge(float(t), bool(refused), bool(violates), self.rules)
            if s.session != session:
                if pending:  # a new session shows the end of the one before, ahead of its timer
                    out.append((None, key[0], end, "expired", session))
                pending = True
            out.append((event, key[0], t, verdict, s.session if verdict in ("admitted", "withheld") else None))
        end = int((s.active + self.rules.idle) * 1000) if s.session else 0
        if end and end != timer:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(end)
        self._keep(s, end or timer)
        yield _rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s, timer = self._load()
        now = expiredTimerInfo.getExpiryTimeInMs()
        old = [k for k, v in self.seen.iterator() if now / 1000 - v[0] >= self.rules.remember] if self.seen.exists() else []
        for k in old:
            self.seen.removeKey(k)
        self._keep(s, 0 if timer == now else timer)
        yield _rows([(None, key[0], now / 1000, "expired", s.session)] if timer == now else [])

    def close(self) -> None:
        pass


def _rows(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["event_id", "user_id", "t", "verdict", "session"])
    return out.astype({"event_id": "Int64", "user_id": "int64", "t": "float64", "verdict": "object", "session": "Int32"})


def admission(events: DataFrame, refused, violates, rules: Rules | None = None, delay: str = "1 hour") -> DataFrame:
    """Verdicts on a stream of (event_id, user_id, ts and more): repeat, refused, blocked, cooldown, limit, withheld or admitted, and a row where a session ends.

    refused and violates are columns of events. Rows of a user are judged in order of time inside a micro-batch; those
    that come in a later one are judged then, or dropped by Spark if they are older than the watermark (the latest time
    so far less the delay). Rows without a user or time are left out. A user's rows of one micro-batch are held together.
    """
    timed = events.filter("user_id is not null and ts is not null").withWatermark("ts", delay)
    rows = timed.select("event_id", "user_id", "ts", (F.unix_micros("ts") / 1e6).alias("t"), refused.alias("refused"), violates.alias("violates"))
    return rows.groupBy("user_id").transformWithStateInPandas(Admission(rules or Rules()), VERDICT, "Append", "EventTime")


def run_once(verdicts: DataFrame, path: str, checkpoint: str) -> None:
    """Judges all that has arrived and ends; state goes to RocksDB beside the checkpoint."""
    spark = verdicts.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        q = verdicts.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
