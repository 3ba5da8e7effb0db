"""Edges of the reports and of tenant isolation."""

from datetime import datetime, timedelta

import pytest

from tenantlake.operators import isolation
from tenantlake.operators.isolation import Scope
from tenantlake.plans import reports
from tenantlake.schemas import (
    ACCESS_EVENT, APP_USER, COMPANY, EVIDENCE, INVITE, USER_LOGIN_LOG, USER_SESSION)
from tests.test_changes import T0, company, invite, session, user


@pytest.fixture(scope="module")
def log(spark):
    rows = [(1, "a@d1.test", "SIGNUP", "company=C0001 role=admin", T0),
            (2, "x@else.test", "INVITE_ACCEPT", "company=C00010 role=member", T0),
            (3, "x@else.test", "INVITE_ACCEPT", "company=C0001 role=member", T0),
            (4, "a@d1.test", "LOGIN_OK", None, T0),
            (5, "a@d1.test", "ROLE_CHANGE", "member by=b by=c", T0),
            (6, "idonly", "PW_CHANGE", None, T0),
            (7, "op", "COMPANY_SUSPENDED", "C0001", T0)]
    return spark.createDataFrame(rows, USER_LOGIN_LOG)


@pytest.fixture(scope="module")
def people(spark):
    rows = [user("a@d1.test", role="admin"), user("idonly", email="other@d1.test"),
            user("nomail", email=None), user("z@d2.test", "C00010")]
    return spark.createDataFrame(rows, APP_USER)


def test_team_feed_by_whole_token(log, people):
    ids = lambda df: [r.log_id for r in df.collect()]
    assert ids(reports.team_audit(log, people, "C0001")) == [5, 3, 1]
    assert ids(reports.team_audit(log, people, "C0001", compat=True)) == [5, 3, 2, 1]
    assert ids(reports.team_audit(log, people, "C0001", limit=1)) == [5]
    newest = reports.team_audit(log, people, "C0001").first()
    assert (newest.actor, newest.text) == ("c", "a@d1.test · 역할 변경")
    every = {(r.company_id, r.log_id) for r in reports.team_audit_all(log, people).collect()}
    assert every == {("C0001", 1), ("C0001", 3), ("C0001", 5), ("C00010", 2)}


def test_summary_keeps_empty_companies(spark, people):
    firms = spark.createDataFrame([company(1), company(2)], COMPANY)
    rows = {r.company_id: r for r in reports.company_summary(firms, people).collect()}
    assert (rows["C0001"].members, rows["C0001"].admin) == (3, "a@d1.test")
    assert (rows["C0002"].members, rows["C0002"].admin) == (0, None)


def test_invite_borders_and_order(spark):
    rows = [invite("used", 1, "e", 0, T0, T0), invite("cut", 1, "e", 0, None, T0),
            invite("ends", 1, "e", 0), invite("open", 1, "e", 1),
            {**invite("forever", 1, "e"), "expires_at": None}]
    table = spark.createDataFrame(rows, INVITE)
    states = {r.token: r.status for r in reports.list_invites(table, "C0001", T0).collect()}
    assert states == {"used": "accepted", "cut": "revoked", "ends": "expired",
                      "open": "pending", "forever": "pending"}
    asked = spark.createDataFrame([(t,) for t in [*states, "none"]], "token string")
    firms = spark.createDataFrame([company(1)], COMPANY)
    codes = {r.token: r.error_code
             for r in reports.resolve_invites(asked, table, firms, T0).collect()}
    assert codes == {"used": "INVITE_USED", "cut": "INVITE_REVOKED", "ends": "INVITE_EXPIRED",
                     "open": None, "forever": None, "none": "INVITE_NOT_FOUND"}
    links = {r.invite_url for r in reports.invite_view(
        reports.all_invites(table, T0), "https://x.test//").collect()}
    assert "https://x.test/?invite=open" in links


def test_session_that_ends_now_is_dead(spark, people):
    rows = [session("a", "a@d1.test"), session("b", "a@d1.test", T0), session("c", "gone")]
    table = spark.createDataFrame(rows, USER_SESSION)
    end = T0 + timedelta(hours=8)
    assert reports.live_sessions(table, people, end).count() == 0
    before = end - timedelta(microseconds=1)
    assert [r.session_id for r in reports.live_sessions(table, people, before).collect()] == ["a"]
    assert {r.session_id: r.state for r in
            reports.session_states(table, people, end).collect()} == {
        "a": "expired", "b": "revoked"}


def test_profile_and_views(spark):
    rows = [user("op", None, is_super=True, email=""), user("p", "C0001", status="PENDING"),
            user("q", "C0001", verified=False), user("n", "C0001", verified=None)]
    people = spark.createDataFrame(rows, APP_USER)
    firms = spark.createDataFrame([company(1)], COMPANY)
    shown = {r.user_id: r for r in reports.profiles(people, firms).collect()}
    assert (shown["op"].role, shown["op"].email, shown["op"].company) == ("super", "op", None)
    listed = {r["name"]: r.status for r in reports.admin_user_list(people, firms).collect()}
    assert listed == {"op": "active", "p": "disabled", "q": "unverified", "n": "unverified"}
    without = reports.user_view(reports.all_users(people, firms).drop("verified"))
    assert {r["name"]: r.status for r in without.collect()}["q"] == "active"
    assert "password_hash" not in reports.user_by_id(people, people).columns


def test_admin_feed_limits(spark):
    rows = [(i, T0, "a", "super", "REVIEW", "E1", 1, "DENIED") for i in range(5)]
    table = spark.createDataFrame(rows, ACCESS_EVENT)
    assert reports.admin_audit(table, 0).count() == 1
    assert [r.id for r in reports.admin_audit(table, 2).collect()] == [4, 3]


def test_scope_rules():
    with pytest.raises(ValueError):
        Scope("C1' OR 1=1")
    with pytest.raises(ValueError):
        Scope("C1\n")
    with pytest.raises(ValueError):
        Scope(actor="someone")
    assert Scope(is_super=True).applies and Scope("C1").applies
    assert not isolation.UNSCOPED.applies


def test_no_foreign_rows(spark):
    evidence = spark.createDataFrame(
        [("E1", "C0001", "u"), ("E2", "C0002", "u"), ("E3", None, None)], EVIDENCE)
    other = spark.createDataFrame([("E1",), ("E2",), ("E3",), ("E4",)], "evidence_id string")
    mine, nobody, job = Scope("C0001", "u", "member"), Scope(is_super=True), Scope()
    ids = lambda df: sorted(r.evidence_id for r in df.collect())
    assert ids(isolation.scoped_rows(evidence, mine)) == ["E1"]
    assert ids(isolation.scoped_rows(evidence, nobody)) == []
    assert ids(isolation.scoped_rows(evidence, job)) == ["E1", "E2", "E3"]
    assert ids(isolation.scoped_by_evidence(other, evidence, mine)) == ["E1"]
    assert ids(isolation.scoped_by_evidence(other, evidence, nobody)) == []
    owned = lambda s: {r.evidence_id: r.owned for r in
                       isolation.ownership(other, evidence, s).collect()}
    assert owned(mine) == {"E1": True, "E2": False, "E3": False, "E4": True}
    assert set(owned(nobody).values()) == {False}
    assert set(owned(job).values()) == {True}
    passed, refused = isolation.split_by_ownership(isolation.ownership(other, evidence, mine))
    assert ids(passed) == ["E1", "E4"]
    assert {r.error_code for r in refused.collect()} == {"EVIDENCE_NOT_FOUND"}


def test_permissions_deny_the_unknown(spark):
    asked = spark.createDataFrame(
        [("admin", "delete"), ("reviewer", "delete"), ("super", "inspect"), (None, "upload"),
         ("member", "upload"), ("admin", "unknown")], "role string, action string")
    assert [r.allowed for r in isolation.check_permissions(asked.coalesce(1)).collect()] == [
        True, False, False, False, True, False]
    tried = spark.createDataFrame(
        [(datetime(2024, 1, 1), "", "super", True, "REVIEW", "E1", None),
         (datetime(2024, 1, 1), "a", "admin", False, "REVIEW", "E1", 2)],
        "occurred_at timestamp_ntz, actor string, role string, is_super boolean, "
        "action string, evidence_id string, evidence_version int")
    row, = isolation.denied_attempts(tried).collect()
    assert (row.actor, row.evidence_version, row.outcome) == ("(미로그인)", 1, "DENIED")


def test_team_page_is_gated(spark, log, people):
    tables = {"app_user": people, "user_login_log": log,
              "invite": spark.createDataFrame([invite("open", 1, "e", 1)], INVITE)}
    full = reports.team_page(tables, "C0001", "admin", T0)
    assert (full.members.count(), full.invites.count(), full.audit.count()) == (3, 1, 3)
    less = reports.team_page(tables, "C0001", "member", T0)
    assert (less.members.count(), less.invites.count(), less.audit.count()) == (3, 0, 0)
