"""Login attempts: rules, sliced accounts, streaming."""

import random
import tempfile
from datetime import datetime, timedelta

import pytest

from tenantlake.operators import lockout
from tenantlake.schemas import APP_USER, ATTEMPTS, COMPANY
from tenantlake.sources import versions
from tenantlake.streaming.logins import LockoutProcessor, stream_logins
from tenantlake.streaming.sinks import (
    append_log_files, compact_accounts, compact_appended, current_accounts, merge_batch,
    merge_logins)
from tests.test_changes import company, user

T0 = datetime(2024, 1, 1)
CONTROLS = "request_id long, request_ts timestamp_ntz, user_id string, status string"


def account(uid, status="ACTIVE", failed=0, locked=None, firm="C0001"):
    return user(uid, firm, status=status, failed_count=failed, locked_until=locked)


def tries(spark, *rows):
    """rows: (user, minutes, ok)"""
    return spark.createDataFrame(
        [(i, u, T0 + timedelta(minutes=m), ok) for i, (u, m, ok) in enumerate(rows)], ATTEMPTS)


def answers(folded):
    rows = lockout.login_verdicts(folded).orderBy("attempt_id").collect()
    return [(r.event, r.detail, r.error_code, r.minutes_left) for r in rows]


WRONG = [("a", m, False) for m in range(5)]


def test_lock_and_relock(spark):
    users = spark.createDataFrame([account("a")], APP_USER)
    folded = lockout.fold_logins(users, tries(
        spark, *WRONG, ("a", 4.5, True), ("a", 13.999, True), ("a", 14, False),
        ("a", 20, True), ("a", 24, True)))
    assert answers(folded) == [
        *[("LOGIN_FAIL", f"failed={n}", "LOGIN_FAILED", None) for n in (1, 2, 3, 4)],
        ("LOCKED", "failed=5", "LOGIN_FAILED", None),
        ("LOGIN_FAIL", "locked", "ACCOUNT_LOCKED", 10),
        ("LOGIN_FAIL", "locked", "ACCOUNT_LOCKED", 1),
        ("LOCKED", "failed=6", "LOGIN_FAILED", None),
        ("LOGIN_FAIL", "locked", "ACCOUNT_LOCKED", 5),
        ("LOGIN_OK", None, None, None)]
    row = lockout.login_accounts(users, folded).first()
    assert (row.failed_count, row.locked_until, row.last_login_at) == (
        0, None, T0 + timedelta(minutes=24))


def test_states_and_strangers(spark):
    users = spark.createDataFrame(
        [account("p", "PENDING", 2), account("d", "DISABLED")], APP_USER)
    folded = lockout.fold_logins(users, tries(
        spark, ("p", 0, True), ("p", 1, False), ("d", 0, True), ("nobody", 0, True),
        (" ", 1, False)))
    assert answers(folded) == [
        ("LOGIN_FAIL", "pending", "ACCOUNT_PENDING", None),
        ("LOGIN_FAIL", "failed=3", "LOGIN_FAILED", None),
        ("LOGIN_FAIL", "disabled", "ACCOUNT_DISABLED", None),
        ("LOGIN_FAIL", "no such user", "LOGIN_FAILED", None),
        ("LOGIN_FAIL", "no such user", "LOGIN_FAILED", None)]
    logged = {r.request_id: r.user_id for r in lockout.login_log_rows(folded).collect()}
    assert logged[4] == "(빈 아이디)"


def test_activation_clears_the_lock(spark):
    users = spark.createDataFrame([account("a")], APP_USER)
    controls = spark.createDataFrame([(1, T0 + timedelta(minutes=5), "a", "ACTIVE")], CONTROLS)
    folded = lockout.fold_logins(users, tries(spark, *WRONG, ("a", 6, False), ("a", 7, True)),
                                 controls=controls)
    assert [a[1] for a in answers(folded)][-2:] == ["failed=1", None]


def test_suspended_company_ends_the_session_at_once(spark):
    users = spark.createDataFrame([account("a")], APP_USER)
    firms = spark.createDataFrame([company(1, status="SUSPENDED")],
                                  "company_id string, name string, domain string, "
                                  "status string, created_at timestamp_ntz, created_by string")
    folded = lockout.fold_logins(users, tries(spark, ("a", 0, True)), firms)
    assert answers(folded)[0][2] == "COMPANY_SUSPENDED"
    held = lockout.login_sessions(folded).first()
    assert held.revoked_at == held.created_at == T0
    assert held.expires_at == T0 + timedelta(hours=8)
    rows = lockout.login_log_rows(folded).orderBy("seq").collect()
    assert [r.event for r in rows] == ["LOGIN_OK", "LOGOUT"]


def test_company_login_normalises_the_address(spark):
    good, refused = lockout.split_company_attempts(tries(
        spark, (" KIM@d1.Test ", 0, True), ("kim", 0, True)))
    assert [r.user_id for r in good.collect()] == ["kim@d1.test"]
    assert [(r.user_id, r.error_code) for r in refused.collect()] == [("kim", "INVALID_EMAIL")]


def noisy(spark, seed, n=2500):
    """Accounts of every kind, dense and sparse in time, with ties and odd snapshots."""
    rnd = random.Random(seed)
    users = [account(f"u{i}", rnd.choice(["ACTIVE", "ACTIVE", "PENDING", "DISABLED"]),
                     rnd.choice([0, 0, 2, 4, 7]),
                     rnd.choice([None, None, T0 + timedelta(minutes=rnd.randint(-5, 90))]))
             for i in range(9)]
    rows = []
    for i in range(n):
        k = rnd.randint(0, 10)
        span = (20, 600, 9000)[k % 3] * 60
        rows.append((i, f"u{k}", T0 + timedelta(seconds=rnd.randint(0, span)),
                     rnd.random() < (0.02 if k % 2 else 0.3)))
    controls = [(i, T0 + timedelta(seconds=rnd.randint(0, 36000)), f"u{rnd.randint(0, 10)}",
                 rnd.choice(["ACTIVE", "DISABLED"])) for i in range(40)]
    return (spark.createDataFrame(users, APP_USER), spark.createDataFrame(rows, ATTEMPTS),
            spark.createDataFrame(controls, CONTROLS), (users, rows, controls))


def plain_python(users, rows, controls):
    """The rules once more, as a plain loop over everything in order."""
    state = {u["user_id"]: [u["status"], u["failed_count"], u["locked_until"]] for u in users}
    out = {}
    steps = [(at, 2, i, u, ok) for i, u, at, ok in rows]
    steps += [(at, 1, i, u, s) for i, at, u, s in controls]
    for at, kind, i, u, what in sorted(steps):
        s = state.get(u)
        if kind == 1:
            if s:
                s[:] = [what, 0, None]
        elif s is None:
            out[i] = "no such user"
        elif s[2] and s[2] > at:
            out[i] = "locked"
        elif not what:
            s[1] += 1
            out[i] = f"failed={s[1]}"
            if s[1] >= 5:
                s[2] = at + timedelta(minutes=10)
        elif s[0] != "ACTIVE":
            out[i] = s[0].lower()
        else:
            s[1:] = [0, None]
            out[i] = None
    return out


@pytest.mark.parametrize("seed, fan_in", [(1, 2), (2, 3), (3, 8)])
def test_plain_and_sliced_equal_the_loop(spark, seed, fan_in, monkeypatch):
    monkeypatch.setattr(lockout, "FAN_IN", fan_in)
    users, rows, controls, raw = noisy(spark, seed)
    wanted = plain_python(*raw)
    plain = lockout.fold_logins(users, rows, controls=controls, slices=1)
    assert {r.attempt_id: r.detail for r in lockout.login_verdicts(plain).collect()} == wanted
    sliced = lockout.fold_logins(users, rows, controls=controls, slices=29)
    assert sorted(map(repr, sliced.collect())) == sorted(map(repr, plain.collect()))


@pytest.mark.parametrize("fan_in", [2, 8])
def test_one_account_with_everything(spark, fan_in, monkeypatch):
    """All attempts on one account, many per second, cut into many slices."""
    monkeypatch.setattr(lockout, "FAN_IN", fan_in)
    rnd = random.Random(9)
    rows = [(i, "hot", T0 + timedelta(milliseconds=rnd.randint(0, 3_000_000)),
             rnd.random() < 0.01) for i in range(6000)]
    users = spark.createDataFrame([account("hot", failed=3)], APP_USER)
    attempts = spark.createDataFrame(rows, ATTEMPTS)
    plain = lockout.fold_logins(users, attempts, slices=1)
    sliced = lockout.fold_logins(users, attempts, slices=40)
    assert sorted(map(repr, sliced.collect())) == sorted(map(repr, plain.collect()))


def test_batches_smaller_than_an_account(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        users, rows, controls, raw = noisy(spark, 5, 600)
        folded = lockout.fold_logins(users, rows, controls=controls)
        got = {r.attempt_id: r.detail for r in lockout.login_verdicts(folded).collect()}
        assert got == plain_python(*raw)
        sliced = lockout.fold_logins(users, rows, controls=controls, slices=9)
        assert sorted(map(repr, sliced.collect())) == sorted(map(repr, folded.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.fixture(scope="module")
def arrivals(spark):
    """Attempts in four files: in order of time between files, shuffled inside."""
    rnd = random.Random(4)
    users = [account(f"u{i}", rnd.choice(["ACTIVE", "PENDING"])) for i in range(5)]
    rows = sorted((T0 + timedelta(seconds=rnd.randint(0, 7200)), i) for i in range(300))
    rows = [(i, f"u{rnd.randint(0, 6)}", at, rnd.random() < 0.15) for at, i in rows]
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for part in range(4):
        piece = rows[part * 75:(part + 1) * 75]
        rnd.shuffle(piece)
        spark.createDataFrame(piece, ATTEMPTS).coalesce(1).write.mode("append").parquet(
            f"{folder}/in")
    return folder, spark.createDataFrame(users, APP_USER), rows


def stream_of(spark, folder):
    return (spark.readStream.schema(ATTEMPTS).option("maxFilesPerTrigger", 2)
            .parquet(f"{folder}/in"))


def test_stream_equals_batch_over_a_restart(spark, arrivals):
    folder, users, rows = arrivals
    root = f"{folder}/tables"
    versions.commit_version(spark, root, {"app_user": users})
    folded = stream_logins(stream_of(spark, folder), users)
    merge_logins(folded, root, f"{folder}/cp", availableNow=True).awaitTermination(200)
    newest = max(r[2] for r in rows)
    late = (998, "u0", newest - timedelta(hours=1), True)
    close = (999, "closing", newest + timedelta(days=1), False)
    spark.createDataFrame([late, close], ATTEMPTS).coalesce(1).write.mode("append").parquet(
        f"{folder}/in")
    again = stream_logins(stream_of(spark, folder), users)
    query = merge_logins(again, root, f"{folder}/cp", availableNow=True)
    query.awaitTermination(200)
    dropped = sum(p["stateOperators"][0]["numRowsDroppedByWatermark"]
                  for p in query.recentProgress if p["stateOperators"])
    assert dropped == 1
    attempts = spark.createDataFrame(rows, ATTEMPTS)
    batch = lockout.fold_logins(users, attempts)
    merged = versions.read_current(spark, root, "user_login_log")
    got = sorted((r.user_id, r["at"], r.event, r.detail or "") for r in merged.collect())
    assert got == sorted((r.user_id, r["at"], r.event, r.detail or "")
                         for r in lockout.login_log_rows(batch).collect())
    ids = [r.log_id for r in merged.collect()]
    assert sorted(ids) == list(range(1, 301))
    assert versions.current_version(spark, root)["marks"] == {"user_login_log": 300}
    wanted = sorted(map(repr, lockout.login_accounts(users, batch).collect()))
    assert sorted(map(repr, current_accounts(spark, root).collect())) == wanted
    compact_accounts(spark, root)
    assert "login_state" not in versions.current_version(spark, root)["tables"]
    stored = versions.read_current(spark, root, "app_user").collect()
    assert sorted(map(repr, stored)) == wanted


def test_log_files_are_appended(spark, arrivals):
    folder, users, _ = arrivals
    rows = lockout.login_log_rows(stream_logins(stream_of(spark, folder), users))
    append_log_files(rows, f"{folder}/log", f"{folder}/cp2", availableNow=True
                     ).awaitTermination(200)
    assert spark.read.parquet(f"{folder}/log").count() > 0


def test_stream_with_controls_and_company(spark, tmp_path):
    """Control rows and the company gate act in the stream as in the batch."""
    rnd = random.Random(6)
    firms = spark.createDataFrame([company(1), company(2, status="SUSPENDED")], COMPANY)
    users = spark.createDataFrame(
        [account(f"u{i}", rnd.choice(["ACTIVE", "PENDING"]), firm=f"C000{i % 2 + 1}")
         for i in range(4)], APP_USER)
    tried = [(i, f"u{rnd.randrange(5)}", T0 + timedelta(seconds=rnd.randrange(3000)),
              rnd.random() < 0.4) for i in range(200)]
    asked = [(i, T0 + timedelta(seconds=rnd.randrange(3000)), f"u{rnd.randrange(4)}",
              rnd.choice(["ACTIVE", "DISABLED"])) for i in range(12)]
    batch = lockout.fold_logins(users, spark.createDataFrame(tried, ATTEMPTS), firms,
                                spark.createDataFrame(asked, CONTROLS))
    close = T0 + timedelta(days=1)
    for part, (rows, orders) in enumerate(((tried, asked), (
            [(999, "closing", close, False)], [(999, close, "closing", "ACTIVE")]))):
        spark.createDataFrame(rows, ATTEMPTS).coalesce(1).write.mode("append").parquet(
            f"{tmp_path}/in")
        spark.createDataFrame(orders, CONTROLS).coalesce(1).write.mode("append").parquet(
            f"{tmp_path}/orders")
        folded = stream_logins(
            spark.readStream.schema(ATTEMPTS).parquet(f"{tmp_path}/in"), users, firms,
            spark.readStream.schema(CONTROLS).parquet(f"{tmp_path}/orders"))
        (folded.writeStream.format("parquet").option("path", f"{tmp_path}/out")
         .option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
         .awaitTermination(200))
    got = spark.read.schema(lockout.FOLD_SCHEMA).parquet(f"{tmp_path}/out")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, batch.collect()))


def test_sessions_need_their_tokens(spark, tmp_path):
    """Stored keys are hashes of staged tokens; without tokens there are no sessions."""
    root = str(tmp_path)
    users = spark.createDataFrame([account("a")], APP_USER)
    folded = lockout.fold_logins(users, tries(spark, ("a", 0, True), ("a", 1, True)))
    versions.commit_version(spark, root, {"app_user": users})
    merge_batch(root, source="q1")(folded, 0)
    assert "user_session" not in versions.current_version(spark, root)["tables"]
    tokens = spark.createDataFrame([(0, "secret"), (1, "other")], "attempt_id long, token string")
    merge_batch(root, tokens, source="q2")(folded, 0)
    kept = versions.read_current(spark, root, "user_session").select("session_id")
    wanted = tokens.selectExpr("sha2(token, 256) AS session_id")
    assert sorted(kept.collect()) == sorted(wanted.collect())
    with pytest.raises(ValueError, match="source"):
        merge_batch(root)(folded, 1)


def test_new_checkpoint_is_a_new_source(spark, tmp_path):
    """A query that counts from 0 again is not taken for the one before; a replay is."""
    root = str(tmp_path)
    users = spark.createDataFrame([account("a")], APP_USER)
    versions.commit_version(spark, root, {"app_user": users})
    for source, number, minute in (("q1", 5, 0), ("q2", 0, 1), ("q2", 0, 1)):
        folded = lockout.fold_logins(users, tries(spark, ("a", minute, False)))
        merge_batch(root, source=source)(folded, number)
    log = versions.read_current(spark, root, "user_login_log").collect()
    assert sorted((r.log_id, r["at"].minute) for r in log) == [(1, 0), (2, 1)]
    compact_appended(spark, root)
    assert len(versions.current_version(spark, root)["tables"]["user_login_log"]) == 1
    assert versions.read_current(spark, root, "user_login_log").count() == 2


def test_compaction_beside_a_batch(spark, tmp_path, monkeypatch):
    """A batch that is merged while accounts are compacted stays, and so does the snapshot."""
    root = str(tmp_path)
    users = spark.createDataFrame([account("a")], APP_USER)
    versions.commit_version(spark, root, {"app_user": users})
    first = lockout.fold_logins(users, tries(spark, ("a", 0, False)))
    merge_batch(root, source="q")(first, 0)
    publish, merged = versions._publish, []

    def between(*args):
        if not merged:
            merged.append(True)
            second = lockout.fold_logins(users, tries(spark, ("a", 1, False), ("a", 2, False)))
            merge_batch(root, source="q")(second, 1)
        return publish(*args)

    monkeypatch.setattr(versions, "_publish", between)
    compact_accounts(spark, root)
    assert versions.read_current(spark, root, "app_user").first().failed_count == 1
    assert len(versions.current_version(spark, root)["tables"]["login_state"]) == 1
    assert current_accounts(spark, root).first().failed_count == 2
    merged.clear()
    compact_appended(spark, root)
    assert len(versions.current_version(spark, root)["tables"]["user_login_log"]) == 1
    compact_accounts(spark, root)
    assert "login_state" not in versions.current_version(spark, root)["tables"]
    assert versions.read_current(spark, root, "app_user").first().failed_count == 2
    assert versions.read_current(spark, root, "user_login_log").count() == 3


def test_compaction_does_not_undo_another_snapshot(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    users = spark.createDataFrame([account("a")], APP_USER)
    versions.commit_version(spark, root, {"app_user": users})
    merge_batch(root, source="q")(lockout.fold_logins(users, tries(spark, ("a", 0, False))), 0)
    publish, done = versions._publish, []

    def between(*args):
        if not done:
            done.append(True)
            versions.commit_version(spark, root, {"app_user": users.union(
                spark.createDataFrame([account("b")], APP_USER))})
        return publish(*args)

    monkeypatch.setattr(versions, "_publish", between)
    with pytest.raises(versions.StaleVersion):
        compact_accounts(spark, root)
    assert versions.read_current(spark, root, "app_user").count() == 2


def test_two_streams_number_one_log(spark, tmp_path, monkeypatch):
    """Both start from one version; the second takes the numbers after those of the first."""
    root = str(tmp_path)
    users = spark.createDataFrame([account("a"), account("b")], APP_USER)
    versions.commit_version(spark, root, {"app_user": users})
    publish, inside = versions._publish, []

    def between(*args):
        if not inside:
            inside.append(True)
            merge_batch(root, source="q1")(
                lockout.fold_logins(users, tries(spark, ("a", 0, False), ("a", 1, False))), 0)
        return publish(*args)

    monkeypatch.setattr(versions, "_publish", between)
    merge_batch(root, source="q2")(
        lockout.fold_logins(users, tries(spark, ("b", 2, False))), 0)
    log = versions.read_current(spark, root, "user_login_log").collect()
    assert sorted((r.log_id, r.user_id) for r in log) == [(1, "a"), (2, "a"), (3, "b")]
    assert versions.current_version(spark, root)["marks"] == {"user_login_log": 3}


def test_missing_counter_is_zero(spark):
    users = spark.createDataFrame([account("a", failed=None), account("b")], APP_USER)
    folded = lockout.fold_logins(users, tries(spark, ("a", 0, False), ("b", 0, False)))
    assert [a[1] for a in answers(folded)] == ["failed=1", "failed=1"]


class _Calls:
    """Map or value state in memory that counts its calls; timers likewise."""

    def __init__(self):
        self.held, self.timers, self.calls = {}, set(), 0

    def __getattr__(self, name):
        self.calls += 1
        return {
            "getValue": self.held.get, "updateValue": self.held.__setitem__,
            "removeKey": self.held.pop, "keys": lambda: iter(list(self.held)),
            "get": lambda: self.held.get("value"), "clear": self.held.clear,
            "update": lambda v: self.held.__setitem__("value", v),
            "registerTimer": self.timers.add, "deleteTimer": self.timers.remove}[name]


def test_stream_state_is_called_by_pieces_not_by_rows():
    """Rows of a shard in any order, folded as two watermarks pass; a row costs no call."""
    from types import SimpleNamespace

    handle = _Calls()
    parts = {n: _Calls() for n in ("account", "pending", "due")}
    made = LockoutProcessor()
    made.init(SimpleNamespace(
        getMapState=lambda n, *_: parts[n], getValueState=lambda n, *_: parts[n],
        registerTimer=handle.registerTimer, deleteTimer=handle.deleteTimer))
    rnd = random.Random(6)
    for i in range(8):
        made.handleInitialState((3,), {"user_id": f"u{i}", "status": "ACTIVE", "failed_count": 0,
                                       "locked": lockout.NEVER, "suspended": False}, None)
    base = 60_000_000
    rows = [{"user_id": rnd.choice([None, *(f"u{i}" for i in range(10))]), "kind": 2, "id": i,
             "at_micros": rnd.randrange(base * 2000), "ok": rnd.random() < 0.3,
             "set_status": None} for i in range(3000)]
    before = sum(p.calls for p in parts.values())
    got = []
    for some in (rows[:1500], rows[1500:]):
        assert list(made.handleInputRows((3,), iter(some), None)) == []
    for minute in (700, 701, 2000):
        assert min(handle.timers) * 1000 <= minute * base
        handle.timers.clear()
        got += made.handleExpiredTimer((3,), SimpleNamespace(
            getCurrentWatermarkInMs=lambda m=minute: m * base // 1000), None)
        assert all(r.at < datetime(1970, 1, 1) + timedelta(minutes=minute) for r in got)
    assert sum(p.calls for p in parts.values()) - before < 150
    assert not parts["pending"].held and not handle.timers
    assert set(parts["account"].held) == {(f"u{i}",) for i in range(8)}
    wanted = []
    for user in {r["user_id"] for r in rows}:
        known = user is not None and user in {f"u{i}" for i in range(8)}
        state = lockout.LockState("ACTIVE" if known else None)
        for r in sorted((r for r in rows if r["user_id"] == user),
                        key=lambda r: (r["at_micros"], r["id"])):
            wanted.append((r["id"], user, state.attempt(r["at_micros"], r["ok"])))
    assert {(r.attempt_id, r.user_id, r.event, r.detail, r.code) for r in got} == {
        (i, u, *v) for i, u, v in wanted}
    assert len(got) == 3000
