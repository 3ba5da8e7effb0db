"""Change sets, and tables stored by day of which only some days are written."""

import os
from datetime import date, datetime, timedelta

from tenantlake.operators import accounts, companies, members
from tenantlake.schemas import APP_USER, COMPANY, USER_SESSION
from tenantlake.sources import days, tables
from tests.test_changes import company, session, user

T0 = datetime(2024, 1, 1)


def held(i, day, revoked=None, hours=8):
    made = T0 + timedelta(days=day, minutes=i)
    return {**session(f"s{i}", f"u{i % 20}"), "created_at": made,
            "expires_at": made + timedelta(hours=hours), "revoked_at": revoked}


def stored(spark, tmp_path, rows):
    table = spark.createDataFrame(rows, USER_SESSION)
    tables.store(table, str(tmp_path), "user_session")
    return table


def files_of(tmp_path):
    """Day folder -> its files with their times."""
    root = f"{tmp_path}/user_session"
    return {d: sorted((f, os.stat(f"{root}/{d}/{f}").st_mtime_ns)
                      for f in os.listdir(f"{root}/{d}") if f.endswith(".parquet"))
            for d in os.listdir(root) if d.startswith("day=")}


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def logouts(spark, ids):
    return spark.createDataFrame(
        [(n, T0 + timedelta(days=40), f"t{i}") for n, i in enumerate(ids)],
        "request_id long, request_ts timestamp_ntz, token string")


def keyed_by_token(spark, rows):
    """Session keys are hashes of tokens."""
    table = spark.createDataFrame(rows, USER_SESSION)
    return table.selectExpr("sha2(concat('t', substr(session_id, 2)), 256) AS session_id",
                            *table.columns[1:])


def test_ten_log_outs_write_one_day(spark, tmp_path):
    rows = [held(i, i // 20) for i in range(200)]
    table = keyed_by_token(spark, rows)
    tables.store(table, str(tmp_path), "user_session")
    before = files_of(tmp_path)
    current = tables.load_days(spark, str(tmp_path), "user_session")
    outcome = accounts.log_out(current, logouts(spark, [*range(60, 70), 60, 999]))
    assert outcome.changes["user_session"].count() == 10
    wanted = accounts.log_out(table, logouts(spark, [*range(60, 70), 60, 999]))
    assert days.apply_changes(spark, str(tmp_path), outcome) == {
        "user_session": [date(2024, 1, 4)]}
    after = files_of(tmp_path)
    assert {d for d in before if before[d] != after[d]} == {"day=2024-01-04"}
    assert set(before) == set(after)
    assert same(tables.load_days(spark, str(tmp_path), "user_session"),
                wanted.tables["user_session"])
    again = accounts.log_out(tables.load_days(spark, str(tmp_path), "user_session"),
                             logouts(spark, range(60, 70)))
    assert days.apply_changes(spark, str(tmp_path), again) == {"user_session": []}


def test_changes_are_the_rows_that_differ(spark):
    users = [user(f"u{i}", f"C000{i % 3 + 1}", role="admin" if i < 6 else "member",
                  email=f"u{i}@d.test", status="ACTIVE") for i in range(20)]
    people = spark.createDataFrame(users, APP_USER)
    firms = spark.createDataFrame([company(1), company(2), company(3)], COMPANY)
    sessions = spark.createDataFrame(
        [held(i, 0, T0 if i % 5 == 0 else None) for i in range(60)], USER_SESSION)
    ask = "request_id long, request_ts timestamp_ntz, actor string, "
    at = T0 + timedelta(days=3)
    outcomes = [
        accounts.set_account_status(people, sessions, spark.createDataFrame(
            [(1, at, "x", "u1", "DISABLED"), (2, at, "x", "u2", "ACTIVE"),
             (3, at, "x", "no", "ACTIVE")], ask + "user_id string, status string")),
        companies.set_company_status(firms, people, sessions, spark.createDataFrame(
            [(1, at, "x", "C0002", "SUSPENDED"), (2, at, "x", "C0003", "ACTIVE")],
            ask + "company_id string, status string")),
        members.change_members(people, sessions, spark.createDataFrame(
            [(1, at, "x", "C0002", "u7@d.test", "remove", None, None),
             (2, at, "x", "C0001", "u0@d.test", "role", "member", None),
             (3, at, "x", "C0001", "u9@d.test", "role", "member", None)],
            ask + "company_id string, email string, op string, role string, active boolean")),
        accounts.change_passwords(people, sessions, spark.createDataFrame(
            [(1, at, "u4", "Str0ng-pass1", "h", True, False)],
            "request_id long, request_ts timestamp_ntz, user_id string, new_password string, "
            "new_hash string, old_ok boolean, same_as_old boolean"))]
    for outcome, olds in zip(outcomes, (
            {"app_user": people, "user_session": sessions},
            {"company": firms, "user_session": sessions},
            {"app_user": people, "user_session": sessions},
            {"app_user": people, "user_session": sessions})):
        assert set(outcome.changes) == set(olds) == set(outcome.tables)
        for name, old in olds.items():
            wanted = outcome.tables[name].exceptAll(old)
            assert same(outcome.changes[name], wanted) and wanted.count() > 0, name


def test_expired_days_go_as_folders(spark, tmp_path):
    rows = [held(i, i // 20) for i in range(160)]
    rows += [held(500, 6, revoked=T0 + timedelta(days=6)), held(501, 9, revoked=T0)]
    rows += [{**held(502, 1), "expires_at": None}]
    rows.append({**held(503, 0), "created_at": None, "revoked_at": T0})
    table = stored(spark, tmp_path, rows)
    before = files_of(tmp_path)
    cutoff = T0 + timedelta(days=3, hours=8, minutes=70)
    done = days.purge_days(spark, str(tmp_path), cutoff)
    assert done.dropped == [None, date(2024, 1, 1), date(2024, 1, 3), date(2024, 1, 10)]
    assert done.rewritten == [date(2024, 1, 2), date(2024, 1, 4), date(2024, 1, 7)]
    wanted = accounts.purge_sessions(table, cutoff)
    assert done.sessions == table.count() - wanted.count()
    assert same(tables.load_days(spark, str(tmp_path), "user_session"), wanted)
    after = files_of(tmp_path)
    untouched = {f"day=2024-01-0{d}" for d in (5, 6, 8)}
    assert all(after[d] == before[d] for d in untouched)
    assert "day=2024-01-01" not in after and len(after) == 6
    nothing = days.purge_days(spark, str(tmp_path), cutoff)
    assert nothing == days.Purged([], [], 0) and files_of(tmp_path) == after
