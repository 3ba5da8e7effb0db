"""As-of look-ups, and log-ins under a company status that changes."""

import os
import random
import time
from datetime import datetime, timedelta

import pytest

from tenantlake.operators import lockout
from tenantlake.operators.asof import with_facts_around
from tenantlake.schemas import APP_USER, ATTEMPTS, COMPANY
from tenantlake.sources import versions
from tenantlake.streaming.logins import stream_logins
from tenantlake.streaming.progress import (
    LateRows, late_rows, state_differences, stored_state)
from tenantlake.streaming.sinks import current_accounts, merge_logins
from tests.test_changes import company
from tests.test_lockout import account

T0 = datetime(2024, 1, 1)
FACTS = "k string, at timestamp_ntz, tie long, status string"
CHANGES = ("request_id long, request_ts timestamp_ntz, company_id string, status string")


def at(second):
    return None if second is None else T0 + timedelta(seconds=second)


@pytest.mark.parametrize("partitions", [1, 13])
def test_facts_around_equal_a_search(spark, partitions):
    """One key has most of the rows; times tie, keys and facts are missing."""
    rnd = random.Random(partitions)
    keys = ["hot"] * 8 + ["a", "b", None, "no facts"]
    events = [(i, rnd.choice(keys), at(rnd.randrange(60)), "x") for i in range(400)]
    facts = [(rnd.choice(["hot", "hot", "a", "b", None, "no events"]),
              at(rnd.choice([None, *range(60)])), i, rnd.choice(["ON", "OFF"]))
             for i in range(60)]
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = with_facts_around(
            spark.createDataFrame(events, "i long, k string, at timestamp_ntz, _fact string"),
            spark.createDataFrame(facts, FACTS), "k", "at", "tie",
            later="status = 'OFF'").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == len(events) and {r._fact for r in got} == {"x"}
    start = T0 - timedelta(days=1)
    for r in got:
        own = [f for f in facts if f[0] is not None and f[0] == r.k]
        past = [f for f in own if (f[1] or start) <= r["at"]]
        later = [f for f in own if (f[1] or start) > r["at"] and f[3] == "OFF"]
        before = max(past, key=lambda f: (f[1] or start, f[2]), default=None)
        after = min(later, key=lambda f: (f[1], f[2]), default=None)
        assert (r.before and tuple(r.before)) == before
        assert (r.after and tuple(r.after)) == after


def test_no_row_reads_the_rest_of_its_slice(spark, capsys):
    """A frame from the row to the end of a slice takes time with the square of the slice."""
    facts = spark.createDataFrame([("a", at(1), 1, "OFF")], FACTS)
    found = with_facts_around(facts.select("k", "at"), facts, "k", "at", "tie")
    found.explain("extended")
    plan = capsys.readouterr().out.lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan


def firms_and_changes(rnd):
    firms = [company(1), company(2, status="SUSPENDED"), company(3)]
    changes = [(i, at(rnd.randrange(3000)), f"C000{rnd.randint(1, 2)}",
                rnd.choice(["ACTIVE", "SUSPENDED"])) for i in range(25)]
    return firms, changes


def one_by_one(users, tried, firms, changes):
    """Attempts and changes applied in order of time, a change first."""
    status = {f[0] if isinstance(f, tuple) else f["company_id"]:
              f[3] if isinstance(f, tuple) else f["status"] for f in firms}
    firm = {u["user_id"]: u["company_id"] for u in users}
    state = {u["user_id"]: lockout.LockState(u["status"]) for u in users}
    codes, sessions = {}, {}
    steps = [(ts, 0, i, c, s) for i, ts, c, s in changes]
    steps += [(ts, 1, i, u, ok) for i, u, ts, ok in tried]
    for ts, kind, i, who, what in sorted(steps):
        if kind == 0:
            status[who] = what
            for number, (uid, end) in sessions.items():
                if what == "SUSPENDED" and end is None and firm[uid] == who:
                    sessions[number] = (uid, ts)
            continue
        own = state.setdefault(who, lockout.LockState())
        micros = int((ts - datetime(1970, 1, 1)) / timedelta(microseconds=1))
        event, _, codes[i] = own.attempt(micros, what)
        if event == "LOGIN_OK":
            shut = status.get(firm[who]) == "SUSPENDED"
            codes[i] = "COMPANY_SUSPENDED" if shut else None
            sessions[i] = (who, ts if shut else None)
    return codes, {i: end for i, (_, end) in sessions.items()}


def case(seed):
    rnd = random.Random(seed)
    users = [account(f"u{i}", rnd.choice(["ACTIVE", "ACTIVE", "PENDING"]),
                     firm=(None if i == 5 else f"C000{i % 3 + 1}")) for i in range(6)]
    tried = [(i, f"u{rnd.randrange(7)}", at(rnd.randrange(3000)), rnd.random() < 0.5)
             for i in range(300)]
    return users, tried, *firms_and_changes(rnd)


@pytest.mark.parametrize("seed", [1, 2])
def test_status_over_time_equals_one_by_one(spark, seed):
    users, tried, firms, changes = case(seed)
    table = spark.createDataFrame(users, APP_USER)
    gated = lockout.company_gate(
        lockout.fold_logins(table, spark.createDataFrame(tried, ATTEMPTS)), table,
        spark.createDataFrame(firms, COMPANY), spark.createDataFrame(changes, CHANGES))
    codes, ends = one_by_one(users, tried, firms, changes)
    assert {r.attempt_id: r.error_code
            for r in lockout.login_verdicts(gated).collect()} == codes
    made = lockout.login_sessions(gated, spark.createDataFrame(
        [(i, str(i)) for i in range(300)], "attempt_id long, token string"))
    number = spark.createDataFrame([(i,) for i in range(300)], "i long").selectExpr(
        "i", "sha2(cast(i as string), 256) AS session_id")
    assert {r.i: r.revoked_at for r in made.join(number, "session_id").collect()} == ends


def test_the_stream_sees_the_status_of_the_moment(spark, tmp_path):
    users, tried, firms, changes = case(3)
    table = spark.createDataFrame(users, APP_USER)
    firm = spark.createDataFrame(firms, COMPANY)
    turns = spark.createDataFrame(changes, CHANGES)
    root = f"{tmp_path}/tables"
    versions.commit_version(spark, root, {"app_user": table})
    tokens = spark.createDataFrame([(i, str(i)) for i in range(300)],
                                   "attempt_id long, token string")
    closing = [(999, "closing", T0 + timedelta(days=1), False)]
    for rows in (tried, closing):
        spark.createDataFrame(rows, ATTEMPTS).coalesce(1).write.mode("append").parquet(
            f"{tmp_path}/in")
        folded = stream_logins(spark.readStream.schema(ATTEMPTS).parquet(f"{tmp_path}/in"), table)
        merge_logins(folded, root, f"{tmp_path}/cp", tokens,
                     gate=lambda df: lockout.company_gate(df, table, firm, turns),
                     availableNow=True).awaitTermination(200)
    gated = lockout.company_gate(lockout.fold_logins(
        table, spark.createDataFrame(tried, ATTEMPTS)), table, firm, turns)
    wanted = lockout.login_sessions(gated, tokens).select(
        "session_id", "user_id", "revoked_at").collect()
    kept = versions.read_current(spark, root, "user_session").select(
        "session_id", "user_id", "revoked_at").collect()
    assert sorted(map(repr, kept)) == sorted(map(repr, wanted))
    log = versions.read_current(spark, root, "user_login_log")
    assert log.filter("event = 'LOGOUT'").count() == gated.filter(
        "code = 'COMPANY_SUSPENDED'").count() > 0


def test_late_rows_are_written_down_and_strangers_leave_no_state(spark, tmp_path):
    """Planted late rows are found batch by batch; what is left of state is the accounts."""
    rnd = random.Random(2)
    users = [account(f"u{i}", failed=i % 2) for i in range(4)]
    table = spark.createDataFrame(users, APP_USER)
    root, late_path = f"{tmp_path}/tables", f"{tmp_path}/late"
    versions.commit_version(spark, root, {"app_user": table})
    listener = LateRows(spark, late_path)
    spark.streams.addListener(listener)
    tried = [(i, f"u{rnd.randrange(7)}", at(rnd.randrange(7200)), rnd.random() < 0.3)
             for i in range(150)]
    planted = [(900 + i, f"u{i}", at(5 * i), False) for i in range(6)]
    closing = [(999, "u0", T0 + timedelta(days=1), True)]
    last = [(1000, "stranger", T0 + timedelta(days=2), True)]
    try:
        for rows in (tried, closing, planted, last):
            spark.createDataFrame(rows, ATTEMPTS).coalesce(1).write.mode("append").parquet(
                f"{tmp_path}/in")
            folded = stream_logins(
                spark.readStream.schema(ATTEMPTS).parquet(f"{tmp_path}/in"), table)
            query = merge_logins(folded, root, f"{tmp_path}/cp", availableNow=True)
            query.awaitTermination(200)
        for _ in range(100):
            found = late_rows(spark, late_path).filter("rows_late > 0").collect() if (
                os.path.exists(late_path)) else []
            if found:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert [r.rows_late for r in found] == [6] and found[0].query_id == str(query.id)
    checkpoint = f"{tmp_path}/cp"
    kept = {r.user_id for r in stored_state(spark, checkpoint, "account").collect()}
    assert kept == {u["user_id"] for u in users}
    waiting = {r.user_id for r in stored_state(spark, checkpoint, "pending").collect()}
    assert waiting <= {"stranger"}
    accounts = current_accounts(spark, root)
    assert state_differences(spark, checkpoint, accounts).count() == 0
    odd = state_differences(spark, checkpoint, table.filter("user_id <> 'u3'")).collect()
    assert {(r.user_id, r.side) for r in odd} >= {("u3", "state")}
