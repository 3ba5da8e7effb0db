"""Batches of mixed requests on accounts end like the requests one after another."""

import hashlib
import random
from datetime import timedelta

import pytest

from tenantlake.operators import accounts, mixed
from tenantlake.schemas import APP_USER, USER_SESSION
from tenantlake.sources import versions
from tenantlake.sources.outcomes import commit_outcome
from tests.model import Tables
from tests.test_changes import T0, world

CALLS = {"status": "account_status", "member": "member", "password": "password"}


def key(token):
    return hashlib.sha256(token.encode()).hexdigest()


def log_out(tables, r):
    """M14 by the loop: an open session of this token ends; there is no error."""
    held = tables.sessions.get(key(r["token"] or ""))
    if held and held["revoked_at"] is None:
        held["revoked_at"] = r["request_ts"]
        tables.note(held["user_id"], "LOGOUT", None, r["request_ts"])
        return True
    return False


def request(rnd, i, n):
    k = rnd.randrange(14)
    own = f"u{k}@d{k % 3 + 1}.test"
    row = dict.fromkeys(("user_id", "status", "company_id", "email", "op", "role", "active",
                         "token", "new_password", "new_hash", "old_ok", "same_as_old"))
    row |= {"request_id": i, "actor": f"op{i % 2}", "kind": rnd.choice(
        ["status", "status", "member", "member", "member", "logout", "password"]),
        "request_ts": T0 + timedelta(minutes=rnd.randint(0, n))}
    if row["kind"] == "status":
        row |= {"user_id": rnd.choice([own, own, "nobody", "ghostadmin"]),
                "status": rnd.choice(["ACTIVE", "DISABLED"])}
    elif row["kind"] == "member":
        row |= {"company_id": f"C{rnd.choice([k % 3, k % 3, 1]) + 1:04d}",
                "email": rnd.choice([f" {own.upper()}", own, own, "broken"]),
                "op": rnd.choice(["role", "remove", "active"]), "active": rnd.random() < 0.5,
                "role": rnd.choice(["admin", "member", "reviewer", "owner"])}
    elif row["kind"] == "logout":
        row["token"] = f"t{rnd.randrange(42)}"
    else:
        row |= {"user_id": rnd.choice([own, own, "nobody"]), "new_hash": f"h{i}",
                "new_password": rnd.choice(["Good-pass-1", "short", "Another9pass!"]),
                "old_ok": rnd.random() < 0.8, "same_as_old": rnd.random() < 0.2}
    return row


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("seed, n", [(1, 40), (2, 160), (3, 160)])
def test_mixed_batches_equal_the_loop(spark, seed, n):
    rnd = random.Random(seed)
    people, _, held, _ = world(rnd)
    held = [{**s, "session_id": key(f"t{i}")} for i, s in enumerate(held)]
    asked = [request(rnd, i, n) for i in range(n)]
    tables = Tables(people, [], held, [])
    wanted, done = {}, set()
    for r in sorted(asked, key=lambda r: (r["request_ts"], r["request_id"])):
        if r["kind"] == "logout":
            wanted[r["request_id"]] = None
            if log_out(tables, r):
                done.add(r["request_id"])
        else:
            wanted[r["request_id"]] = getattr(tables, CALLS[r["kind"]])(r)
    assert {"LAST_ADMIN", None} <= set(wanted.values()) or n < 100
    users = spark.createDataFrame(people, APP_USER)
    sessions = spark.createDataFrame(held, USER_SESSION)
    outcome = mixed.change_accounts(users, sessions, spark.createDataFrame(
        [tuple(r[c.split()[0]] for c in mixed.REQUEST.split(", ")) for r in asked],
        mixed.REQUEST))
    verdicts = outcome.verdicts.collect()
    assert {r.request_id: r.error_code for r in verdicts} == wanted
    assert {r.request_id for r in verdicts if r.done} == done
    for name, state in (("app_user", tables.users), ("user_session", tables.sessions)):
        schema = {"app_user": APP_USER, "user_session": USER_SESSION}[name]
        after = spark.createDataFrame(list(state.values()), schema)
        assert rows(outcome.tables[name]) == rows(after), name
        before = {"app_user": users, "user_session": sessions}[name]
        assert rows(outcome.changes[name]) == rows(after.exceptAll(before)), name
    told = sorted((r.user_id, r.event, r.detail or "", r["at"])
                  for r in outcome.log_rows.collect())
    assert told == sorted((u, e, d or "", t) for u, e, d, t in tables.log)


def test_an_outcome_is_committed_with_its_log(spark, tmp_path):
    root = str(tmp_path)
    people, _, held, _ = world(random.Random(5))
    versions.commit_version(spark, root, {
        "app_user": spark.createDataFrame(people, APP_USER),
        "user_session": spark.createDataFrame(held, USER_SESSION)})
    ask = "request_id long, request_ts timestamp_ntz, actor string, user_id string, status string"

    def outcome(*who):
        return accounts.set_account_status(
            versions.read_current(spark, root, "app_user"),
            versions.read_current(spark, root, "user_session"),
            spark.createDataFrame([(i, T0 + timedelta(days=9 + i), "x", u, "DISABLED")
                                   for i, u in enumerate(who)], ask))

    first, stale = outcome("u0@d1.test", "u1@d2.test"), versions.current_version(spark, root)
    assert commit_outcome(spark, root, first, batch="ops:1") == 2
    assert commit_outcome(spark, root, first, batch="ops:1") == 2
    assert commit_outcome(spark, root, outcome("nobody")) == 2
    assert commit_outcome(spark, root, outcome("u2@d3.test"), batch="ops:2") == 3
    log = versions.read_current(spark, root, "user_login_log").collect()
    assert sorted((r.log_id, r.user_id) for r in log) == [
        (1, "u0@d1.test"), (2, "u1@d2.test"), (3, "u2@d3.test")]
    stopped = versions.read_current(spark, root, "app_user").filter("approved_by = 'x'")
    assert stopped.count() == 3
    with pytest.raises(versions.StaleVersion):
        commit_outcome(spark, root, outcome("u3@d1.test"), read=stale)
    assert versions.current_version(spark, root)["number"] == 3


def test_requests_of_no_kind_are_rejected(spark):
    people, _, held, _ = world(random.Random(4))
    asked = [dict.fromkeys((c.split()[0] for c in mixed.REQUEST.split(", ")), None) | {
        "request_id": i, "request_ts": T0, "kind": k, "status": "ON", "user_id": "u1@d2.test"}
        for i, k in enumerate([None, "other", "status", "logout", "member"])]
    outcome = mixed.change_accounts(
        spark.createDataFrame(people, APP_USER), spark.createDataFrame(held, USER_SESSION),
        spark.createDataFrame([tuple(r.values()) for r in asked], mixed.REQUEST))
    got = {r.request_id: r.error_code for r in outcome.verdicts.collect()}
    assert got == {0: "INVALID_OP", 1: "INVALID_OP", 2: "INVALID_STATUS", 3: None,
                   4: "INVALID_OP"}
    assert outcome.changes["app_user"].count() == outcome.log_rows.count() == 0
