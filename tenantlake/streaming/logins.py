"""Login attempts as a stream, with the same rules and the same results as the batch.

Attempts may arrive out of order. Accounts are dealt to a fixed number of shards. Each shard
keeps its rows until the watermark has passed them and then folds them account by account in
(at, kind, id) order, so the stream gives what the batch gives for every row that is not later
than the watermark. Later rows are dropped by Spark; `progress.LateRows` writes down how many.
A verdict comes when the watermark has passed the minute of its attempt.

The accounts are loaded once as initial state. Status changes of accounts during the run must
arrive as control rows in the stream; those of companies are looked up by the gate of the sink.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta
from itertools import groupby

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tenantlake.operators.lockout import (
    ATTEMPT, FOLD_SCHEMA, NEVER, LockState, account_states, login_steps)
from tenantlake.session import ship_package

_EPOCH = "1970-01-01 00:00:00"
_ACCOUNT = "status string, failed int, locked bigint, suspended boolean"
_ROWS = ("rows array<struct<user_id: string, at: bigint, kind: int, id: bigint, ok: boolean, "
         "set_status: string>>")
#: Part of the state's layout: a checkpoint belongs to one number.
SHARDS = 4096
PIECE_ROWS = 1000
_MINUTE = 60_000_000
_START = datetime(1970, 1, 1)


def _micros(column: str):
    return F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), column)


def _shard():
    return F.pmod(F.xxhash64("user_id"), F.lit(SHARDS)).cast("int")


def _time(micros: int) -> datetime | None:
    return None if micros == NEVER else _START + timedelta(microseconds=micros)


class LockoutProcessor(StatefulProcessor):
    """State per shard: counter and lock of each of its accounts, and the rows the watermark
    has not passed.

    Every access to the state is a call of the executor, so rows wait in pieces of up to
    PIECE_ROWS in order of time. Arriving rows are written as new pieces; of the pieces there
    are, only one that the watermark has passed in part is written again. One timer stands at
    the end of the earliest minute; when it fires, all minutes the watermark has passed are
    folded, and the timer is set for the next one. An id without an account keeps nothing once
    its rows are folded.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.account = handle.getMapState("account", "user_id string", _ACCOUNT)
        self.pending = handle.getMapState("pending", "minute bigint, piece bigint", _ROWS)
        self.due = handle.getValueState("due", "minute bigint, pieces bigint")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.account.updateValue(
            (initialState["user_id"],),
            (initialState["status"], int(initialState["failed_count"]),
             int(initialState["locked"]), bool(initialState["suspended"])))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        found = sorted(((r["user_id"], r["at_micros"], r["kind"], r["id"], r["ok"],
                         r["set_status"]) for r in rows), key=lambda r: r[1])
        if found:
            minute, pieces = self.due.get() or (None, 0)
            pieces = self._keep(found, pieces)
            self._wait(minute, found[0][1] // _MINUTE, pieces)
        return iter(())

    def _keep(self, rows: list[tuple], pieces: int) -> int:
        """Write rows in order of time as new pieces; the number of pieces so far."""
        for low in range(0, len(rows), PIECE_ROWS):
            part = rows[low:low + PIECE_ROWS]
            self.pending.updateValue((part[0][1] // _MINUTE, pieces), (part,))
            pieces += 1
        return pieces

    def _wait(self, known: int | None, minute: int, pieces: int) -> None:
        """Have the timer at the end of `minute`, unless it stands earlier."""
        if known is None or known > minute:
            if known is not None:
                self.handle.deleteTimer((known + 1) * _MINUTE // 1000)
            self.handle.registerTimer((minute + 1) * _MINUTE // 1000)
            known = minute
        self.due.update((known, pieces))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000 // _MINUTE
        held = [tuple(k) for k in self.pending.keys()]
        _, pieces = self.due.get()
        over, rest = [], []
        for k in held:
            if k[0] < passed:
                for r in self.pending.getValue(k)[0]:
                    (over if r[1] // _MINUTE < passed else rest).append(tuple(r))
                self.pending.removeKey(k)
        self.due.clear()
        left = [k[0] for k in held if k[0] >= passed]
        if rest:
            rest.sort(key=lambda r: r[1])
            pieces = self._keep(rest, pieces)
            left.append(rest[0][1] // _MINUTE)
        if left:
            self._wait(None, min(left), pieces)
        over.sort(key=lambda r: (r[0] or "", r[:1] == (None,), *r[1:4]))
        for user, own in groupby(over, key=lambda r: r[0]):
            yield from self._fold(user, [r[1:] for r in own])

    def _fold(self, user: str | None, rows: list[tuple]) -> list[Row]:
        known = self.account.getValue((user,)) if user is not None else None
        state = LockState(*known) if known else LockState()
        out = []
        for at, kind, ident, ok, new in rows:
            event = detail = code = None
            if kind == ATTEMPT:
                event, detail, code = state.attempt(at, ok)
            elif state.status is not None:
                state.control(new)
            out.append(Row(user_id=user, kind=kind, attempt_id=ident, at=_time(at), event=event,
                           detail=detail, code=code, failed_count=state.failed,
                           locked_until=_time(state.locked)))
        if state.status is not None and rows:
            self.account.updateValue(
                (user,), (state.status, state.failed, state.locked, state.suspended))
        return out

    def close(self) -> None:
        pass


def stream_logins(attempts: DataFrame, users: DataFrame, company: DataFrame | None = None,
                  controls: DataFrame | None = None, delay: str = "15 minutes") -> DataFrame:
    """Streaming counterpart of `fold_logins`; `attempts` and `controls` are streams."""
    ship_package()
    # The watermark needs an instant; this one is the naive time read as UTC, whatever
    # the time zone of the session is.
    rows = (login_steps(attempts, controls).withColumn("at_micros", _micros("at"))
            .withColumn("at", F.timestamp_micros("at_micros")).withWatermark("at", delay)
            .withColumn("shard", _shard()))
    states = account_states(users, company).select(
        "user_id", "status", "failed_count", "suspended",
        F.coalesce(_micros("locked_until"), F.lit(NEVER)).alias("locked"), _shard().alias("shard"))
    return rows.groupBy("shard").transformWithState(
        statefulProcessor=LockoutProcessor(), outputStructType=FOLD_SCHEMA,
        outputMode="Append", timeMode="EventTime", initialState=states.groupBy("shard"))


STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
