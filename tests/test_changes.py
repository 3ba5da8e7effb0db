"""A batch must end exactly like its requests applied one after another."""

import random
from datetime import datetime, timedelta

import pytest

from tenantlake.operators import accounts, companies, invites, logs, members
from tenantlake.schemas import APP_USER, COMPANY, INVITE, USER_LOGIN_LOG, USER_SESSION
from tests.model import Tables

T0 = datetime(2024, 5, 1)
REQ = "request_id long, request_ts timestamp_ntz, actor string, "


def user(uid, company="C0001", role="member", status="ACTIVE", email="same", **more):
    row = {"user_id": uid, "display_name": uid, "password_hash": "h", "role": role,
           "is_admin": role == "admin", "is_super": False, "status": status,
           "failed_count": 3, "locked_until": T0, "created_at": T0, "approved_at": None,
           "approved_by": None, "password_changed_at": T0, "last_login_at": None,
           "email": uid if email == "same" else email, "company_id": company,
           "verified": True, **more}
    return row


def company(number, domain=None, status="ACTIVE"):
    return {"company_id": f"C{number:04d}", "name": f"N{number}",
            "domain": domain or f"d{number}.test", "status": status, "created_at": T0,
            "created_by": None}


def session(sid, uid, revoked=None):
    return {"session_id": sid, "user_id": uid, "created_at": T0,
            "expires_at": T0 + timedelta(hours=8), "revoked_at": revoked}


def invite(token, number, email, expires=3, accepted=None, revoked=None):
    return {"token": token, "company_id": f"C{number:04d}", "email": email, "role": "member",
            "invited_by": "boss", "created_at": T0, "expires_at": T0 + timedelta(days=expires),
            "accepted_at": accepted, "revoked_at": revoked}


def world(rnd):
    people = [user(f"u{i}@d{i % 3 + 1}.test", f"C{i % 3 + 1:04d}",
                   rnd.choice(["admin", "member", "reviewer"]),
                   rnd.choice(["ACTIVE", "ACTIVE", "DISABLED"])) for i in range(14)]
    people.append(user("ghostadmin", "C0001", "admin", email=None))
    firms = [company(i) for i in (1, 2, 3)]
    open_ones = [session(f"s{i}", f"u{i % 14}@d{(i % 14) % 3 + 1}.test",
                         T0 if i % 5 == 0 else None) for i in range(40)]
    letters = [invite(f"t{i:02d}" + "x" * 20, i % 3 + 1, f"new{i % 7}@d{i % 3 + 1}.test",
                      rnd.choice([0, 3, 9]), T0 if i % 6 == 0 else None,
                      T0 if i % 7 == 1 else None) for i in range(20)]
    return people, firms, open_ones, letters


def staged(rnd, n, fields):
    rows = []
    for i in range(n):
        rows.append({"request_id": i, "actor": f"op{i % 2}",
                     "request_ts": T0 + timedelta(minutes=rnd.randint(0, 7 * n) * 10),
                     **fields(i)})
    return rows


def passwords(rnd):
    return rnd.choice(["Good-pass-1", "short", "aaaBBB111!", None, "Another9pass!"])


CASES = {
    "company_signup": (
        lambda r: lambda i: {
            "company": r.choice([" Firm ", " "]) if i % 9 == 0 else "Firm",
            "name": r.choice(["", "N"]), "password": passwords(r), "password_hash": f"h{i}",
            "email": r.choice(["bad", "x@gmail.com", "u1@d2.test", "who@d1.test",
                               f" Boss{r.randint(0, 2)}@F{r.randint(0, 4)}.test "])},
        "company string, name string, password string, password_hash string, email string",
        lambda t, q: companies.sign_up_companies(t["company"], t["app_user"], q)),
    "account_status": (
        lambda r: lambda i: {"user_id": r.choice(["nobody", "u1@d2.test", "u2@d3.test",
                                                  "u3@d1.test"]),
                             "status": r.choice(["ACTIVE", "DISABLED"])},
        "user_id string, status string",
        lambda t, q: accounts.set_account_status(t["app_user"], t["user_session"], q)),
    "company_status": (
        lambda r: lambda i: {"company_id": r.choice(["C0001", "C0002", "C0009"]),
                             "status": r.choice(["active", "Suspended", "PENDING"])},
        "company_id string, status string",
        lambda t, q: companies.set_company_status(t["company"], t["app_user"],
                                                  t["user_session"], q)),
    "member": (
        lambda r: lambda i: {
            "company_id": f"C{r.randint(1, 3):04d}",
            "email": r.choice([f" U{k}@d{k % 3 + 1}.TEST" for k in range(14)] + ["broken"]),
            "op": r.choice(["role", "remove", "active"]),
            "role": r.choice(["admin", "member", "reviewer", "owner"]),
            "active": r.random() < 0.5},
        "company_id string, email string, op string, role string, active boolean",
        lambda t, q: members.change_members(t["app_user"], t["user_session"], q)),
    "invite": (
        lambda r: lambda i: {
            "company_id": r.choice(["C0001", "C0002", "C0009"]), "token": f"fresh{i:03d}",
            "email": r.choice(["bad", "New1@d2.test", "new4@d2.test", "u1@d2.test",
                               "n@d1.test", "new0@d1.test"]),
            "role": r.choice(["admin", "member", "owner"])},
        "company_id string, token string, email string, role string",
        lambda t, q: invites.send_invites(t["invite"], t["company"], t["app_user"], q)),
    "revoke": (
        lambda r: lambda i: {"company_id": f"C{r.randint(1, 3):04d}",
                             "token": f"t{r.randint(0, 21):02d}" + "x" * 20},
        "company_id string, token string",
        lambda t, q: invites.revoke_invites(t["invite"], q)),
    "extend": (
        lambda r: lambda i: {"company_id": f"C{r.randint(1, 3):04d}",
                             "token": f"t{r.randint(0, 21):02d}" + "x" * 20},
        "company_id string, token string",
        lambda t, q: invites.extend_invites(t["invite"], q)),
    "accept": (
        lambda r: lambda i: {"token": f"t{r.randint(0, 21):02d}" + "x" * 20,
                             "name": r.choice([" ", "Guest", "Guest"]),
                             "password": passwords(r), "password_hash": f"h{i}"},
        "token string, name string, password string, password_hash string",
        lambda t, q: invites.accept_invites(t["invite"], t["company"], t["app_user"], q)),
    "password": (
        lambda r: lambda i: {"user_id": r.choice(["nobody", "u1@d2.test", "u2@d3.test"]),
                             "new_password": passwords(r), "new_hash": f"h{i}",
                             "old_ok": r.random() < 0.7, "same_as_old": r.random() < 0.2},
        "user_id string, new_password string, new_hash string, old_ok boolean, "
        "same_as_old boolean",
        lambda t, q: accounts.change_passwords(t["app_user"], t["user_session"], q)),
}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("kind", list(CASES))
def test_batch_equals_one_by_one(spark, kind, seed):
    rnd = random.Random(f"{kind}{seed}")
    people, firms, open_ones, letters = world(rnd)
    fields, ddl, run = CASES[kind]
    requests = staged(rnd, 60, fields(rnd))
    model = Tables(people, firms, open_ones, letters)
    codes = {}
    for r in sorted(requests, key=lambda r: (r["request_ts"], r["request_id"])):
        codes[r["request_id"]] = getattr(model, kind)(r)

    tables = {
        "app_user": spark.createDataFrame(people, APP_USER),
        "company": spark.createDataFrame(firms, COMPANY),
        "user_session": spark.createDataFrame(open_ones, USER_SESSION),
        "invite": spark.createDataFrame(letters, INVITE)}
    outcome = run(tables, spark.createDataFrame(requests, REQ + ddl))
    got = {r["request_id"]: r["error_code"] for r in outcome.verdicts.collect()}
    assert got == codes
    expected = {"app_user": model.users, "company": model.companies,
                "user_session": model.sessions, "invite": model.invites}
    for name, df in outcome.tables.items():
        names = df.columns
        rows = sorted(repr(tuple(r)) for r in df.collect())
        wanted = sorted(repr(tuple(row[c] for c in names)) for row in expected[name].values())
        assert rows == wanted, name
    numbered = logs.append_log(spark.createDataFrame([], USER_LOGIN_LOG), outcome.log_rows)
    lines = [(r.user_id, r.event, r.detail, r["at"]) for r in
             numbered.orderBy("log_id").collect()]
    assert lines == model.log


def test_two_admins_demoted_together(spark):
    people = [user("a@d1.test", role="admin"), user("b@d1.test", role="admin")]
    ask = [{"request_id": i, "request_ts": T0 + timedelta(minutes=i), "actor": "x",
            "company_id": "C0001", "email": e, "op": "role", "role": "member",
            "active": None} for i, e in enumerate(["a@d1.test", "b@d1.test"])]
    out = members.change_members(
        spark.createDataFrame(people, APP_USER), spark.createDataFrame([], USER_SESSION),
        spark.createDataFrame(ask, REQ + CASES["member"][1]))
    assert [r.error_code for r in out.verdicts.orderBy("request_id").collect()] == [
        None, "LAST_ADMIN"]
    assert [r.http_status for r in out.rejected.collect()] == [400]


def test_disabled_admin_still_guarded(spark):
    people = [user("a@d1.test", role="admin", status="DISABLED")]
    ask = [{"request_id": 1, "request_ts": T0, "actor": "x", "company_id": "C0001",
            "email": "a@d1.test", "op": "remove", "role": None, "active": None}]
    out = members.change_members(
        spark.createDataFrame(people, APP_USER), spark.createDataFrame([], USER_SESSION),
        spark.createDataFrame(ask, REQ + CASES["member"][1]))
    assert out.verdicts.first().error_code == "LAST_ADMIN"


def test_account_signup_first_per_id_wins(spark):
    base = {"actor": None, "display_name": " N ", "role": "REVIEWER", "password_hash": "h",
            "password": "Good-pass-1"}
    ask = [{"request_id": 1, "request_ts": T0, "user_id": " kim_1 ", **base},
           {"request_id": 2, "request_ts": T0, "user_id": "kim_1", **base},
           {"request_id": 3, "request_ts": T0, "user_id": "9bad", **base},
           {"request_id": 4, "request_ts": T0, "user_id": "lee_2", **base, "role": "admin"},
           {"request_id": 5, "request_ts": T0, "user_id": "park_3", **base,
            "password": "Xpark_3!x"}]
    out = accounts.sign_up_accounts(
        spark.createDataFrame([], APP_USER),
        spark.createDataFrame(ask, REQ + "user_id string, display_name string, role string, "
                                   "password_hash string, password string"))
    assert [r.error_code for r in out.verdicts.orderBy("request_id").collect()] == [
        None, "USER_EXISTS", "INVALID_USER_ID", "INVALID_ROLE", "WEAK_PASSWORD"]
    new = out.tables["app_user"].first()
    assert (new.user_id, new.display_name, new.status, new.verified, new.approved_at) == (
        "kim_1", "N", "PENDING", False, None)


def test_logout_once_and_only_open(spark):
    rows = [session("0" * 64, "u")]
    import hashlib
    rows = [session(hashlib.sha256(b"tok").hexdigest(), "u"),
            session(hashlib.sha256(b"old").hexdigest(), "u", T0)]
    ask = [{"request_id": i, "request_ts": T0 + timedelta(minutes=i), "actor": None, "token": t}
           for i, t in enumerate(["tok", "tok", "old", "none"])]
    out = accounts.log_out(spark.createDataFrame(rows, USER_SESSION),
                           spark.createDataFrame(ask, REQ + "token string"))
    assert [r.done for r in out.verdicts.orderBy("request_id").collect()] == [
        True, False, False, False]
    assert [(r.user_id, r.event) for r in out.log_rows.collect()] == [("u", "LOGOUT")]


def test_first_admin_only_into_an_empty_table(spark):
    base = {"display_name": "Boss", "role": "APPROVER", "password_hash": "h",
            "password": "Good-pass-1", "actor": None}
    ask = [{"request_id": 1, "request_ts": T0, "user_id": "9bad", **base},
           {"request_id": 2, "request_ts": T0 + timedelta(minutes=1), "user_id": "boss", **base},
           {"request_id": 3, "request_ts": T0 + timedelta(minutes=2), "user_id": "9bad", **base}]
    q = spark.createDataFrame(ask, REQ + "user_id string, display_name string, role string, "
                                   "password_hash string, password string")
    out = accounts.first_admin(spark.createDataFrame([], APP_USER), q)
    assert [r.error_code for r in out.verdicts.orderBy("request_id").collect()] == [
        "INVALID_USER_ID", None, "ALREADY_INITIALIZED"]
    row = out.tables["app_user"].first()
    assert row.is_admin and row.status == "ACTIVE" and row.approved_by == "boss"
    assert [(r.seq, r.event) for r in out.log_rows.orderBy("seq").collect()] == [
        (0, "SIGNUP"), (1, "ACTIVATE")]
    late = accounts.first_admin(spark.createDataFrame([user("x")], APP_USER), q)
    assert {r.error_code for r in late.verdicts.collect()} == {"ALREADY_INITIALIZED"}


def test_company_numbers_are_not_cut(spark):
    firms = [company(9999)]
    ask = [{"request_id": 1, "request_ts": T0, "actor": None, "company": "F", "name": "N",
            "password": None, "password_hash": "h", "email": "a@new.test"}]
    out = companies.sign_up_companies(
        spark.createDataFrame(firms, COMPANY), spark.createDataFrame([], APP_USER),
        spark.createDataFrame(ask, REQ + CASES["company_signup"][1]))
    assert {r.company_id for r in out.tables["company"].collect()} == {"C9999", "C10000"}


def test_purge_keeps_sessions_ending_at_the_cutoff(spark):
    rows = [session("a", "u"), session("b", "u", T0)]
    df = spark.createDataFrame(rows, USER_SESSION)
    cutoff = T0 + timedelta(hours=8)
    assert [r.session_id for r in accounts.purge_sessions(df, cutoff).collect()] == ["a"]
    assert accounts.purged_count(df, cutoff).first().purged == 1


def test_log_detail_is_cut_and_blank_is_null(spark):
    rows = spark.createDataFrame(
        [(1, 0, "u", "X", "d" * 201, T0), (2, 0, "u", "X", "", T0), (3, 0, "u", "X", None, T0)],
        "request_id long, seq int, user_id string, event string, detail string, "
        "at timestamp_ntz")
    log = spark.createDataFrame([(7, "u", "X", None, T0)], USER_LOGIN_LOG)
    got = logs.append_log(log, rows).orderBy("log_id").collect()
    assert [(r.log_id, None if r.detail is None else len(r.detail)) for r in got] == [
        (7, None), (8, 200), (9, None), (10, None)]


def test_staged_requests_are_guarded(spark):
    """Unknown operations and statuses are rejected, a repeated request counts once."""
    people = spark.createDataFrame([user("u@d1.test"), user("boss@d1.test", role="admin")],
                                   APP_USER)
    held = spark.createDataFrame([session("s", "u@d1.test")], USER_SESSION)
    asked = spark.createDataFrame(
        [(i, T0, "op", "u@d1.test", s) for i, s in enumerate(["active", None, "PENDING"])],
        REQ + "user_id string, status string")
    out = accounts.set_account_status(people, held, asked)
    assert {r.error_code for r in out.rejected.collect()} == {"INVALID_STATUS"}
    assert out.rejected.count() == 3 and out.log_rows.count() == 0
    assert {r.revoked_at for r in out.tables["user_session"].collect()} == {None}
    moved = spark.createDataFrame(
        [(i, T0, "op", "C0001", "u@d1.test", op, None, None)
         for i, op in enumerate(["promote", None])],
        REQ + "company_id string, email string, op string, role string, active boolean")
    out = members.change_members(people, held, moved)
    assert {r.error_code for r in out.verdicts.collect()} == {"INVALID_OP"}
    assert {r.status for r in out.tables["app_user"].collect()} == {"ACTIVE"}
    token = spark.createDataFrame([("t",)], "t string").selectExpr("sha2(t, 256)").first()[0]
    open_one = spark.createDataFrame([session(token, "u@d1.test")], USER_SESSION)
    twice = spark.createDataFrame([(7, T0, "op", "t")] * 2, REQ + "token string")
    out = accounts.log_out(open_one, twice)
    assert out.log_rows.count() == 1 and out.tables["user_session"].count() == 1
