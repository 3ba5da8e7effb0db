"""Login attempts: the lockout rules as an ordered fold per account.

A lock hides the attempts inside it, so whether an attempt counts depends on all attempts
before it; windows cannot express that. The fold runs over partitions sorted by
(user_id, at, id), one Arrow batch at a time, and carries one small state per account.

An account that is attacked hard may own a third of all attempts, and its fold is one
sequence. So all rows are cut into slices of a range partitioning, and only users whose rows
cross a border need more: each slice computes, independently of the others, what it would do
to any state it may start with; the effects of neighbours are composed as a tree, the states
go down the tree, and then every slice is folded with its true starting state. See `entries`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenantlake import config
from tenantlake.functions.rules import clean_email, email_error, lock_minutes_left
from tenantlake.functions.text import plus, strip, token_key
from tenantlake.operators.asof import with_facts_around
from tenantlake.operators.keyed import update_by_key
from tenantlake.session import ensure_checkpoint_dir, ship_package

LOCK_MICROS = config.LOCK_MINUTES * 60 * 1_000_000
ACCOUNT, CONTROL, ATTEMPT = 0, 1, 2
NEVER = -(1 << 62)

FOLD_SCHEMA = (
    "user_id string, kind int, attempt_id bigint, at timestamp_ntz, event string, "
    "detail string, code string, failed_count int, locked_until timestamp_ntz")


@dataclass
class LockState:
    """Counter and lock of one account; `status` None means there is no such account."""

    status: str | None = None
    failed: int = 0
    locked: int = NEVER
    suspended: bool = False

    def attempt(self, at: int, ok: bool) -> tuple[str, str | None, str | None]:
        """Apply one attempt; returns (event, detail, error code or None)."""
        if self.status is None:
            return "LOGIN_FAIL", "no such user", "LOGIN_FAILED"
        if self.locked > at:
            return "LOGIN_FAIL", "locked", "ACCOUNT_LOCKED"
        if not ok:
            self.failed += 1
            text = f"failed={self.failed}"
            if self.failed >= config.MAX_FAILED:
                self.locked = at + LOCK_MICROS
                return "LOCKED", text, "LOGIN_FAILED"
            return "LOGIN_FAIL", text, "LOGIN_FAILED"
        if self.status == "PENDING":
            return "LOGIN_FAIL", "pending", "ACCOUNT_PENDING"
        if self.status != "ACTIVE":
            return "LOGIN_FAIL", "disabled", "ACCOUNT_DISABLED"
        self.failed, self.locked = 0, NEVER
        return "LOGIN_OK", None, "COMPANY_SUSPENDED" if self.suspended else None

    def control(self, status: str) -> None:
        """An administrator approved or stopped the account."""
        self.status, self.failed, self.locked = status, 0, NEVER


def micros(series: pd.Series) -> np.ndarray:
    """Times as microseconds, NEVER for NULL."""
    values = series.to_numpy(dtype="datetime64[us]").astype("int64")
    return np.where(series.isna().to_numpy(), NEVER, values)


def times(values: list[int]) -> pd.Series:
    raw = np.array(values, dtype="int64")
    stamps = raw.astype("datetime64[us]")
    stamps[raw == NEVER] = np.datetime64("NaT")
    return pd.Series(stamps)


def fold_attempts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fold rows sorted by user and time.

    The first row of a user brings the state to start with in status, failed_count,
    locked_until, suspended: the account row, or any row of a later slice. A first row without a status means that there is no such account.
    """
    user, state = None, LockState()
    for batch in batches:
        out: list[tuple] = []
        rows = zip(batch["user_id"], batch["kind"].tolist(), batch["id"].tolist(),
                   micros(batch["at"]).tolist(), batch["ok"].tolist(), batch["set_status"],
                   batch["status"], batch["failed_count"].tolist(),
                   micros(batch["locked_until"]).tolist(), batch["suspended"].tolist())
        for uid, kind, ident, at, ok, new, status, failed, locked, suspended in rows:
            if uid != user:
                user, state = uid, LockState(status, failed, locked, suspended)
            if kind == ATTEMPT:
                event, detail, code = state.attempt(at, ok)
            elif kind == CONTROL:
                if state.status is not None:
                    state.control(new)
                event = detail = code = None
            else:
                continue
            out.append((uid, kind, ident, at, event, detail, code, state.failed, state.locked))
        cols = list(zip(*out)) if out else [()] * 9
        yield pd.DataFrame({
            "user_id": pd.Series(cols[0], dtype="object"),
            "kind": pd.Series(cols[1], dtype="int32"),
            "attempt_id": pd.Series(cols[2], dtype="int64"),
            "at": times(list(cols[3])),
            "event": pd.Series(cols[4], dtype="object"),
            "detail": pd.Series(cols[5], dtype="object"),
            "code": pd.Series(cols[6], dtype="object"),
            "failed_count": pd.Series(cols[7], dtype="int32"),
            "locked_until": times(list(cols[8])),
        })


# --- users in several slices ----------------------------------------------------------
EFFECT_SCHEMA = (
    "user_id string, slice int, active boolean, cls int, entry_hi bigint, resets boolean, "
    "n int, locked bigint, set_status string")
ENTRY_SCHEMA = ("user_id string, slice int, status string, failed_count int, "
                "locked_until timestamp_ntz, suspended boolean")
KEEP = NEVER - 1
ALWAYS = 1 << 62
#: Neighbouring slices of one account whose effects are composed in one task.
FAN_IN = 8
_FREE_CLASSES = config.MAX_FAILED  # counters 0 .. MAX_FAILED - 2, and "one more locks"


def _next_at(mask: np.ndarray) -> np.ndarray:
    """For every position 0..m the first position at or after it where mask holds, else m."""
    m = len(mask)
    spots = np.where(mask, np.arange(m), m)
    return np.append(np.minimum.accumulate(spots[::-1])[::-1], m)


class _SliceEffect:
    """What one slice does to any state it may be entered with.

    An exit is (resets, n, locked): with `resets` the counter leaves as n, else n higher
    than it came; `locked` is a time, NEVER, or KEEP for the lock it came with. From a
    lock the slice goes on at the first attempt after its end, so exits of locks are
    computed from the last wrong attempt backwards, each from one further back.
    """

    def __init__(self, at: np.ndarray, ok: np.ndarray, control: np.ndarray,
                 set_active: np.ndarray, active: bool):
        m = len(at)
        last_control = np.maximum.accumulate(np.where(control, np.arange(m), -1))
        is_active = np.where(last_control >= 0, set_active[np.maximum(last_control, 0)], active)
        wrong = ~ok & ~control
        resets = control | (ok & is_active)
        self.at, self.m = at, m
        self.wrong_before = np.append(0, np.cumsum(wrong))
        self.wrong_at = np.nonzero(wrong)[0]
        self.next_reset = _next_at(resets)
        self.next_control = _next_at(control)
        since = np.maximum.accumulate(np.where(resets, np.arange(m), -1)) + 1
        streak = self.wrong_before[1:] - self.wrong_before[since]
        self.next_full = _next_at(wrong & (streak == config.MAX_FAILED))
        self.tail = int(self.wrong_before[m] - self.wrong_before[since[-1]])
        self.lock_exit: dict[int, tuple[bool, int, int]] = {}
        resume = np.searchsorted(at, at[self.wrong_at] + LOCK_MICROS, "left").tolist()
        for j, p in zip(self.wrong_at[::-1].tolist(), reversed(resume)):
            end = int(at[j]) + LOCK_MICROS
            c = int(self.next_control[j + 1])
            if c < p:
                found = self._after_reset(c + 1)
            elif p == m:
                found = (False, 0, end)
            else:
                found = self._free(p, 1)
            self.lock_exit[j] = (found[0], found[1], end if found[2] == KEEP else found[2])

    def _after_reset(self, p: int) -> tuple[bool, int, int]:
        lock = int(self.next_full[p])
        if lock == self.m:
            return True, self.tail, NEVER
        resets, n, locked = self.lock_exit[lock]
        return True, n if resets else config.MAX_FAILED + n, locked

    def _free(self, p: int, missing: int) -> tuple[bool, int, int]:
        """Exit from position p, unlocked, with `missing` wrong attempts to the next lock."""
        k = int(self.wrong_before[p]) + missing - 1
        r = int(self.next_reset[p])
        if k < len(self.wrong_at) and self.wrong_at[k] < r:
            resets, n, locked = self.lock_exit[int(self.wrong_at[k])]
            return resets, n if resets else missing + n, locked
        if r < self.m:
            return self._after_reset(r + 1)
        return False, int(self.wrong_before[self.m] - self.wrong_before[p]), KEEP

    def rows(self, limit: int, odd_start: bool) -> Iterator[tuple]:
        """(cls, entry_hi, exit): the exit of a lock ending in (previous hi, this hi].

        No lock enters later than `limit`. Locked states below the usual counter exist
        only in a table someone edited (`odd_start`).
        """
        first_control = int(self.next_control[0])
        stop = int(np.searchsorted(self.at, limit, "left")) + 1
        starts = [p for p in (np.nonzero(np.diff(self.at[:stop]) > 0)[0] + 1).tolist()]
        for cls in range(_FREE_CLASSES):
            missing = config.MAX_FAILED - cls
            hi, pending = int(self.at[0]), self._free(0, missing)
            if cls == _FREE_CLASSES - 1 or odd_start:
                for p in starts:
                    found = (self._after_reset(first_control + 1) if first_control < p
                             else self._free(p, missing))
                    if found != pending:
                        yield cls, hi, pending
                    hi, pending = int(self.at[p]), found
                yield cls, hi, pending
                hi, pending = ALWAYS, (
                    self._after_reset(first_control + 1) if first_control < self.m
                    else (False, 0, KEEP))
            yield cls, hi, pending


def _slice_effects(batches: Iterator[pd.DataFrame], controlled: bool) -> Iterator[pd.DataFrame]:
    """One set of effect rows per (user, slice); rows come sorted, a slice is one run."""

    def finish(parts: list[pd.DataFrame]) -> pd.DataFrame:
        run = pd.concat(parts, ignore_index=True)
        first = run.iloc[0]
        at = micros(run["at"])
        control = (run["kind"] == CONTROL).to_numpy()
        set_active = (run["set_status"] == "ACTIVE").to_numpy()
        start_lock = int(micros(run["a_locked"].head(1))[0])
        states = (True, False) if controlled else (first["a_status"] == "ACTIVE",)
        last = run.loc[control, "set_status"].iloc[-1] if control.any() else None
        out = []
        for active in states:
            effect = _SliceEffect(at, run["ok"].to_numpy(dtype=bool), control, set_active,
                                  bool(active))
            limit = max(int(at[0]) + LOCK_MICROS, start_lock)
            for cls, hi, (resets, n, locked) in effect.rows(limit, start_lock > int(at[0])):
                out.append((first["user_id"], first["slice"], bool(active), cls, hi, resets, n,
                            locked, last))
        return pd.DataFrame(out, columns=["user_id", "slice", "active", "cls", "entry_hi",
                                          "resets", "n", "locked", "set_status"])

    parts: list[pd.DataFrame] = []
    for batch in batches:
        for _, piece in batch.groupby("user_id", sort=False):
            if parts and parts[0]["user_id"].iloc[0] != piece["user_id"].iloc[0]:
                yield finish(parts)
                parts = []
            parts.append(piece)
    if parts:
        yield finish(parts)


def _composed(first: tuple, second: tuple) -> tuple:
    """What two neighbouring runs of slices do together.

    A run is (set_status, {(active, cls): (hi, resets, n, locked)}), the exits as in
    `_SliceEffect`. An exit whose lock is known enters the second run at one place; an exit
    that keeps its lock is cut where the second run tells locks apart.
    """
    out = {}
    for (active, cls), (hi, resets, n, locked) in first[1].items():
        on = active if first[0] is None else first[0] == "ACTIVE"
        counter = np.minimum(np.where(resets, n, cls + n), _FREE_CLASSES - 1)
        pieces = []
        for into in np.unique(counter):
            own = np.flatnonzero(counter == into)
            if (on, int(into)) not in second[1]:
                continue
            g_hi, g_resets, g_n, g_locked = second[1][on, int(into)]
            keep = locked[own] == KEEP
            low = np.where(own > 0, hi[np.maximum(own - 1, 0)], NEVER - 2)
            at = np.where(keep, low + 1, locked[own])
            begin = np.searchsorted(g_hi, at, "left")
            stop = np.where(keep, np.searchsorted(g_hi, hi[own], "left"), begin)
            sizes = np.maximum(np.minimum(stop, len(g_hi) - 1) - begin + 1, 0)
            f = np.repeat(own, sizes)
            g = np.repeat(begin, sizes) + np.arange(len(f)) - np.repeat(
                np.cumsum(sizes) - sizes, sizes)
            kept = locked[f] == KEEP
            pieces.append(np.stack([
                np.where(kept, np.minimum(hi[f], g_hi[g]), hi[f]),
                np.where(g_resets[g], True, resets[f]),
                np.where(g_resets[g], g_n[g], n[f] + g_n[g]),
                np.where(g_locked[g] == KEEP, locked[f], g_locked[g])]))
        if pieces:
            rows = np.concatenate(pieces, axis=1)
            rows = rows[:, np.argsort(rows[0], kind="stable")]
            last = np.append((rows[1:, 1:] != rows[1:, :-1]).any(axis=0), True)
            rows = rows[:, last]
            out[active, cls] = rows[0], rows[1].astype(bool), rows[2], rows[3]
    return second[0] or first[0], out


def _compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Effects of FAN_IN neighbouring slices as those of one; rows come sorted by
    (user, parent, slice, active, cls, entry_hi)."""

    def run_of(rows: pd.DataFrame) -> tuple:
        return rows["set_status"].iloc[0], {
            (bool(active), int(cls)): tuple(
                part[c].to_numpy(dtype=t) for c, t in (
                    ("entry_hi", "int64"), ("resets", "bool"), ("n", "int64"),
                    ("locked", "int64")))
            for (active, cls), part in rows.groupby(["active", "cls"], sort=False)}

    def rows_of(user: str, parent: int, run: tuple) -> pd.DataFrame:
        parts = [pd.DataFrame({
            "user_id": user, "slice": np.int32(parent), "active": active, "cls": np.int32(cls),
            "entry_hi": hi, "resets": resets, "n": n.astype("int32"), "locked": locked,
            "set_status": pd.Series([run[0]] * len(hi), dtype="object")})
            for (active, cls), (hi, resets, n, locked) in run[1].items()]
        return pd.concat(parts, ignore_index=True)

    held, place, run = [], None, None

    def close():
        nonlocal run, held
        if held:
            own = run_of(pd.concat(held, ignore_index=True))
            run, held = own if run is None else _composed(run, own), []

    for batch in batches:
        for (user, parent, part), piece in batch.groupby(
                ["user_id", "parent", "slice"], sort=False):
            if place is not None and place != (user, parent, part):
                close()
                if place[:2] != (user, parent):
                    yield rows_of(place[0], place[1], run)
                    run = None
            place = (user, parent, part)
            held.append(piece)
    if place is not None:
        close()
        yield rows_of(place[0], place[1], run)


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk the effects below one parent in slice order; gives the state each is entered with."""
    user, part, state, following = None, None, LockState(), None
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            if (row.user_id, row.parent) != user:
                user, part, following = (row.user_id, row.parent), None, None
                locked = int(row.a_locked)
                state = LockState(row.a_status, row.a_failed, locked, row.a_suspended)
            if row.slice != part:
                if part is not None:
                    state = following
                part, following = row.slice, None
                out.append((row.user_id, part, state.status, state.failed, state.locked,
                            state.suspended))
            if (following is None and row.active == (state.status == "ACTIVE")
                    and row.cls == min(state.failed, _FREE_CLASSES - 1)
                    and row.entry_hi >= state.locked):
                following = LockState(
                    row.set_status or state.status,
                    row.n if row.resets else state.failed + row.n,
                    state.locked if row.locked == KEEP else row.locked, state.suspended)
        cols = list(zip(*out)) if out else [()] * 6
        yield pd.DataFrame({
            "user_id": pd.Series(cols[0], dtype="object"),
            "slice": pd.Series(cols[1], dtype="int32"),
            "status": pd.Series(cols[2], dtype="object"),
            "failed_count": pd.Series(cols[3], dtype="int32"),
            "locked_until": times(list(cols[4])),
            "suspended": pd.Series(cols[5], dtype="bool")})


# --- the operator ------------------------------------------------------------------
_STEP = ["user_id", "at", "kind", "id"]


def account_states(users: DataFrame, company: DataFrame | None = None) -> DataFrame:
    """What the fold needs of an account; `suspended` comes from its company.

    The gate is joined to the accounts, so no attempt has to be joined with anything.
    """
    picked = users.select("user_id", "status", "failed_count", "locked_until", "company_id")
    if company is None:
        picked = picked.withColumn("_closed", F.lit(False))
    else:
        closed = company.filter(F.col("status") == "SUSPENDED").select(
            "company_id", F.lit(True).alias("_closed"))
        picked = picked.join(closed, "company_id", "left")
    return picked.select("user_id", "status",
                         F.coalesce("failed_count", F.lit(0)).alias("failed_count"),
                         "locked_until",
                         F.coalesce("_closed", F.lit(False)).alias("suspended"))


def _nothing(kind: str):
    return F.lit(None).cast(kind)


def login_steps(attempts: DataFrame, controls: DataFrame | None) -> DataFrame:
    tried = attempts.select(
        strip("user_id").alias("user_id"), F.lit(ATTEMPT).alias("kind"),
        F.col("attempt_id").alias("id"), "at",
        F.coalesce("password_ok", F.lit(False)).alias("ok"),
        _nothing("string").alias("set_status"))
    if controls is None:
        return tried
    return tried.unionByName(controls.select(
        "user_id", F.lit(CONTROL).alias("kind"), F.col("request_id").alias("id"),
        F.col("request_ts").alias("at"), F.lit(False).alias("ok"),
        F.col("status").alias("set_status")))


def _rows_to_fold(steps: DataFrame, accounts: DataFrame) -> DataFrame:
    """Steps and accounts in one table; the account row of a user sorts first."""
    heads = accounts.select(
        "user_id", F.lit(ACCOUNT).alias("kind"), F.lit(0).cast("bigint").alias("id"),
        _nothing("timestamp_ntz").alias("at"), F.lit(False).alias("ok"),
        _nothing("string").alias("set_status"), "status", "failed_count", "locked_until",
        "suspended")
    return heads.unionByName(steps.withColumns({
        "status": _nothing("string"), "failed_count": F.lit(0),
        "locked_until": _nothing("timestamp_ntz"), "suspended": F.lit(False)}))


def entries(cut: DataFrame, accounts: DataFrame, controlled: bool, slices: int) -> DataFrame:
    """State with which every (user, slice) is entered; one row each.

    A slice is described by how it leaves, given how it is entered: unlocked with one of
    five counters, or locked until some time. Only locks that reach into the slice matter,
    so the description has at most as many rows as the slice has distinct times in its
    first ten minutes. FAN_IN neighbours are composed to one run, those again, and so on
    until FAN_IN are left of a user; then the states go down the tree, each task reading the
    rows of FAN_IN runs. So no task meets all slices of an account.
    """
    known = F.broadcast(accounts.select(
        "user_id", F.col("status").alias("a_status"), F.col("failed_count").alias("a_failed"),
        F.col("locked_until").alias("a_locked"), F.col("suspended").alias("a_suspended")))
    effects = (
        cut.join(known.drop("a_failed", "a_suspended"), "user_id")
        .select("user_id", "slice", "kind", "at", "ok", "set_status", "a_status", "a_locked")
        .mapInPandas(lambda it: _slice_effects(it, controlled), EFFECT_SCHEMA))
    parent = F.expr(f"slice div {FAN_IN}").cast("int")
    levels = [effects]
    while slices > FAN_IN:
        slices = -(-slices // FAN_IN)
        levels[-1] = levels[-1].checkpoint()  # read on the way up and on the way down
        levels.append(
            levels[-1].withColumn("parent", parent).repartition("user_id", "parent")
            .sortWithinPartitions("user_id", "parent", "slice", "active", "cls", "entry_hi")
            .mapInPandas(_compose, EFFECT_SCHEMA))
    state = known.withColumn("parent", F.lit(0))
    for level in reversed(levels):
        start = F.coalesce(F.timestamp_diff(
            "MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), "a_locked"), F.lit(NEVER))
        # Sorted after the join: Spark drops sorts it finds below a join.
        found = (
            level.withColumn("parent", parent)
            .join(state.withColumn("a_locked", start), ["user_id", "parent"])
            .repartition("user_id", "parent")
            .sortWithinPartitions("user_id", "parent", "slice", "active", "cls", "entry_hi")
            .mapInPandas(_chain, ENTRY_SCHEMA))
        state = found.select(
            "user_id", F.col("slice").alias("parent"), F.col("status").alias("a_status"),
            F.col("failed_count").alias("a_failed"), F.col("locked_until").alias("a_locked"),
            F.col("suspended").alias("a_suspended"))
    return found


def _crossing(cut: DataFrame) -> DataFrame:
    """Users whose rows lie in several slices; only the first and last user of a slice can be
    one, so they are fewer than the slices."""
    borders = cut.groupBy("slice").agg(
        F.array(F.min("user_id"), F.max("user_id")).alias("border"))
    return (borders.select("slice", F.explode("border").alias("user_id")).distinct()
            .groupBy("user_id").agg(F.count("*").alias("n")).filter("n > 1").select("user_id"))


_STATE = ("status", "failed_count", "locked_until", "suspended")


def fold_logins(users: DataFrame, attempts: DataFrame, company: DataFrame | None = None,
                controls: DataFrame | None = None, slices: int | None = None) -> DataFrame:
    """Every attempt with its event, detail, error code and the state it leaves.

    `controls` are accepted approve/stop requests that take part in the order. Accounts and
    steps are cut into `slices` (default: the shuffle partitions) of about equal size; of the
    users at the borders the entry states are computed first.
    """
    ship_package()
    ensure_checkpoint_dir(users.sparkSession)
    rows = _rows_to_fold(login_steps(attempts, controls), account_states(users, company))
    ranges = [slices] if slices else []
    cut = (rows.repartitionByRange(*ranges, *_STEP).sortWithinPartitions(*_STEP)
           .withColumn("slice", F.spark_partition_id()).checkpoint())
    crossing = F.broadcast(_crossing(cut))
    known = cut.filter(F.col("kind") == ACCOUNT).join(crossing, "user_id", "left_semi").select(
        "user_id", *_STATE)
    crossed = cut.filter(F.col("kind") != ACCOUNT).drop(*_STATE).join(
        crossing, "user_id", "left_semi")
    # At most two crossing users a slice, so there are at most two entries for each.
    most = slices or int(users.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entered = F.broadcast(entries(crossed, known, controls is not None, most).select(
        "user_id", "slice", F.lit(True).alias("entered"),
        *[F.col(c).alias(f"e_{c}") for c in _STATE]))
    state = {c: F.when(F.col("entered"), F.col(f"e_{c}")).otherwise(F.col(c)) for c in _STATE}
    return (cut.join(entered, ["user_id", "slice"], "left").withColumns(state)
            .select(*_STEP, "ok", "set_status", *_STATE)
            .mapInPandas(fold_attempts, FOLD_SCHEMA))


def company_gate(folded: DataFrame, users: DataFrame, company: DataFrame,
                 changes: DataFrame) -> DataFrame:
    """Folded attempts, judged by the status their company had at that moment.

    `company` is the table before the batch, `changes` (request_id, request_ts, company_id,
    status) are the accepted changes among the attempts; a change counts before an attempt of
    the same time. `ends_at` is when the session of a log-in is ended: at once in a suspended
    company, else with the next suspension.

    The status decides neither counters nor locks, so it is looked up after the fold, for
    successful log-ins only. That holds for a micro-batch of the stream as well.
    """
    good = F.col("event") == "LOGIN_OK"
    ok = folded.filter(good).join(users.select("user_id", "company_id"), "user_id", "left")
    facts = company.select(
        "company_id", F.lit(None).cast("timestamp_ntz").alias("at"), F.lit(0).alias("request_id"),
        "status").unionByName(changes.select(
            "company_id", F.col("request_ts").alias("at"), "request_id", "status"))
    seen = with_facts_around(ok, facts, "company_id", "at", "request_id",
                             later="status = 'SUSPENDED'")
    closed = F.coalesce(F.col("before.status") == "SUSPENDED", F.lit(False))
    judged = seen.select(
        *[F.when(closed, "COMPANY_SUSPENDED").alias("code") if c == "code" else F.col(c)
          for c in folded.columns],
        F.when(closed, F.col("at")).otherwise(F.col("after.at")).alias("ends_at"))
    rest = folded.filter(~good | F.col("event").isNull())
    return judged.unionByName(rest.withColumn("ends_at", _nothing("timestamp_ntz")))


def split_company_attempts(attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(attempts, refused) for the company log-in, where the id is always a mail address.

    The address is normalised before it is looked up; what is none never reaches the
    lockout rules and is not logged.
    """
    checked = attempts.withColumn("error_code", email_error("user_id")).withColumn(
        "user_id", clean_email("user_id"))
    good = F.col("error_code").isNull()
    return checked.filter(good).drop("error_code"), checked.filter(~good)


def login_verdicts(folded: DataFrame) -> DataFrame:
    """Answer per attempt; the try that sets a lock answers like any wrong one."""
    return folded.filter(F.col("kind") == ATTEMPT).select(
        "attempt_id", "user_id", "at", "event", "detail", F.col("code").alias("error_code"),
        F.when(F.col("code") == "ACCOUNT_LOCKED", lock_minutes_left("locked_until", "at"))
        .alias("minutes_left"))


def _shown_id():
    return F.coalesce(F.nullif("user_id", F.lit("")), F.lit(config.EMPTY_LOGIN_ID))


def login_log_rows(folded: DataFrame) -> DataFrame:
    """Log rows of the attempts; a suspended company logs the forced end as well."""
    tried = folded.filter(F.col("kind") == ATTEMPT).select(
        F.col("attempt_id").alias("request_id"), _shown_id().alias("user_id"), "event",
        "detail", "at", "code")
    more = F.when(F.col("code") == "COMPANY_SUSPENDED", F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0)))
    return tried.select("*", F.explode(more).alias("seq")).select(
        "request_id", "seq", "user_id",
        F.when(F.col("seq") == 1, "LOGOUT").otherwise(F.col("event")).alias("event"),
        "detail", "at")


def login_sessions(folded: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """New session rows. `tokens` (attempt_id, token) come from staging; without them the
    key is taken from the attempt number, which only suits reports."""
    ok = folded.filter(F.col("event") == "LOGIN_OK")
    if tokens is None:
        ok = ok.withColumn("token", F.concat(F.lit("login-"), "attempt_id"))
    else:
        ok = ok.join(tokens.select("attempt_id", "token"), "attempt_id")
    ends = (F.col("ends_at") if "ends_at" in folded.columns
            else F.when(F.col("code") == "COMPANY_SUSPENDED", F.col("at")))
    return ok.select(
        token_key("token").alias("session_id"), "user_id", F.col("at").alias("created_at"),
        plus("at", hours=config.SESSION_HOURS).alias("expires_at"),
        ends.alias("revoked_at"))


def login_states(folded: DataFrame) -> DataFrame:
    """What the attempts leave of each account they touched: counter, lock, last log-in."""
    last = folded.groupBy("user_id").agg(
        F.max(F.struct("at", "kind", "attempt_id", "failed_count", "locked_until")).alias("s"),
        F.max(F.when(F.col("event") == "LOGIN_OK", F.col("at"))).alias("login_at"))
    return last.select("user_id", "s.failed_count", "s.locked_until", "login_at")


def login_accounts(users: DataFrame, folded: DataFrame) -> DataFrame:
    """Accounts with the counters, locks and last log-ins the attempts leave."""
    return with_login_states(users, login_states(folded))


def with_login_states(users: DataFrame, states: DataFrame) -> DataFrame:
    return update_by_key(users, states, "user_id", {
        "failed_count": F.col("c_failed_count"), "locked_until": F.col("c_locked_until"),
        "last_login_at": F.coalesce("c_login_at", "last_login_at")})
