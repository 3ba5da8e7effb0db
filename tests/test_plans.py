"""Physical plans of the operators that must scale."""

import re
from datetime import datetime

import pytest

from tenantlake.operators import accounts, companies, invites, isolation
from tenantlake.operators.isolation import Scope
from tenantlake.plans import reports
from tenantlake.plans.catalog import all_queries
from tenantlake.schemas import TABLES
from tenantlake.sources.adapters import Adapters

AS_OF = datetime(2001, 1, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, small, tmp_path_factory):
    """The identity tables as files, so that scans show what is pushed down."""
    root = str(tmp_path_factory.mktemp("stored"))
    adapters = Adapters(spark, small)
    out = {}
    for name in ("company", "app_user", "user_session", "user_login_log", "invite", "evidence",
                 "access_event"):
        adapters[name].write.parquet(f"{root}/{name}")
        out[name] = spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")
    return out


def nodes_above_scan(text, path):
    """Names of the operators between the root and the scan of a path."""
    def depth(line):
        return len(line) - len(line.lstrip(" :+-"))

    lines = text.splitlines()
    spot = next(i for i, line in enumerate(lines) if path in line)
    level, names = depth(lines[spot]), []
    for line in reversed(lines[:spot]):
        if depth(line) < level:
            level = depth(line)
            names.append(re.sub(r"^\*\(\d+\) ", "", line.lstrip(" :+-")))
    return names


def scans(text):
    return len(re.findall(r"FileScan parquet", text))


def test_summary_reads_users_once(stored):
    text = plan(reports.company_summary(stored["company"], stored["app_user"]))
    assert scans(text) == 2
    assert "partial_count" in text and "partial_min" in text
    assert "password_hash" not in text


def test_scope_is_pushed_into_the_scan(stored):
    text = plan(isolation.scoped_rows(stored["evidence"], Scope("C0001")))
    assert "EqualTo(company_id,C0001)" in text
    assert "Exchange" not in text
    assert scans(plan(isolation.scoped_rows(stored["evidence"], Scope(is_super=True)))) == 0


def test_live_sessions_push_their_conditions(stored):
    text = plan(reports.live_sessions(stored["user_session"], stored["app_user"], AS_OF))
    assert "IsNull(revoked_at)" in text and "GreaterThan(expires_at" in text
    assert "EqualTo(status,ACTIVE)" in text


@pytest.mark.parametrize("build", [
    lambda t: reports.team_audit(t["user_login_log"], t["app_user"], "C0001"),
    lambda t: reports.login_log(t["user_login_log"]),
    lambda t: reports.admin_audit(t["access_event"])])
def test_feeds_take_the_top_without_a_full_sort(stored, build):
    text = plan(build(stored))
    assert "TakeOrderedAndProject" in text
    assert "rangepartitioning" not in text


def test_feed_of_every_company_limits_before_the_shuffle(stored):
    text = plan(reports.team_audit_all(stored["user_login_log"], stored["app_user"]))
    assert "WindowGroupLimit" in text and "Partial" in text
    assert "In(event" in text


def test_large_tables_stay_where_they_are(spark, stored, small, tmp_path):
    """A batch below the broadcast threshold must not shuffle the tables it changes."""
    adapters = Adapters(spark, small)
    staged = {}
    for name in ("account_status_requests", "invite_requests", "company_signups"):
        adapters[name].coalesce(1).write.parquet(f"{tmp_path}/{name}")
        staged[name] = spark.read.parquet(f"{tmp_path}/{name}")
    big = {"app_user", "user_session", "invite"}
    status = accounts.set_account_status(
        stored["app_user"], stored["user_session"], staged["account_status_requests"])
    invited = invites.send_invites(stored["invite"], stored["company"], stored["app_user"],
                                   staged["invite_requests"])
    founded = companies.sign_up_companies(stored["company"], stored["app_user"],
                                          staged["company_signups"])
    for outcome in (status, invited, founded):
        for name in big & set(outcome.tables):
            above = nodes_above_scan(plan(outcome.tables[name]), f"/{name}]")
            assert above and not any(n.startswith("Exchange") for n in above), above


def test_python_only_where_the_order_matters(spark, small):
    allowed = ("l1_", "l2_", "l3_", "l5_", "l6_", "m6_")
    for name, run in all_queries().items():
        if name.startswith(allowed):
            continue
        text = plan(run(spark, small))
        assert not re.search(r"MapInPandas|PythonUDF|ArrowEval|FlatMapGroups", text), name
        assert "CartesianProduct" not in text, name
        assert "BroadcastNestedLoopJoin" not in text, name


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_contract_reads_its_table_once(stored):
    from tenantlake.operators.contracts import contract_findings
    from tenantlake.schemas import CONTRACTS
    text = plan(contract_findings(stored["app_user"], CONTRACTS["app_user"]))
    assert scans(text) == 1 and "partial_count" in text


def test_tokens_narrow_the_sessions_first(spark, stored, no_broadcast):
    """All live sessions are never joined with all users: each table meets asked keys."""
    tokens = spark.createDataFrame([("t",)], "token string")
    text = plan(reports.users_of_tokens(tokens, stored["user_session"], stored["app_user"],
                                        AS_OF))
    assert text.count("LeftSemi") >= 2
    above = nodes_above_scan(text, "/user_session")
    assert next(n for n in above if "Join" in n).count("LeftSemi") == 1


def test_taken_moves_matching_keys_only(spark, stored, no_broadcast):
    asked = spark.createDataFrame([(1, "a@b.test")], "request_id long, email string")
    above = nodes_above_scan(plan(reports.taken(asked, stored["app_user"], "email")),
                             "/app_user")
    assert "LeftSemi" in next(n for n in above if "Join" in n)
