"""Contracts, keyed merges, reading and committing tables."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tenantlake.operators import contracts, keyed
from tenantlake.schemas import (
    ACCESS_EVENT, APP_USER, COMPANY, CONTRACTS, TABLES, USER_SESSION)
from tenantlake.sources import tables, versions
from tests.test_changes import company, session, user


def findings(df, name):
    return {(r.rule, r.column_name, r.key_value, r.n)
            for r in contracts.contract_findings(df, CONTRACTS[name]).collect()}


def test_contract_findings(spark):
    firms = [company(1), {**company(1), "domain": "other.test"}, {**company(2), "name": None},
             {**company(3), "company_id": "Cxy", "name": "n" * 201}]
    assert findings(spark.createDataFrame(firms, COMPANY), "company") == {
        ("NOT_UNIQUE", "company_id", "C0001", 2), ("NOT_NULL", "name", "C0002", 1),
        ("TOO_LONG", "name", "Cxy", 1), ("BAD_NUMBER", "company_id", "Cxy", 1)}
    people = [user("u" * 51), user("a", email=None), user("b", email=None)]
    assert findings(spark.createDataFrame(people, APP_USER), "app_user") == {
        ("TOO_LONG", "user_id", "u" * 51, 1)}


def test_a_batch_is_checked_without_moving_the_table(spark, tmp_path):
    """Findings of a batch are those of the whole table that name its rows or values."""
    old = [user(f"o{i}", email=f"m{i}@x") for i in range(30)] + [user("o3", email="m99@x")]
    fresh = [user("o3", email="n@x"), user("n1", email="m5@x"), user("n2", email="m5@x"),
             user("n3", email=None), user("n" * 51), {**user("n5", email="z@x"), "role": None}]
    spark.createDataFrame(old, APP_USER).write.parquet(f"{tmp_path}/old")
    table, new = spark.read.parquet(f"{tmp_path}/old"), spark.createDataFrame(fresh, APP_USER)
    found = contracts.batch_findings(table, new, CONTRACTS["app_user"])
    got = {(r.rule, r.column_name, r.key_value, r.n) for r in found.collect()}
    assert got == {("NOT_UNIQUE", "user_id", "o3", 3), ("NOT_UNIQUE", "email", "m5@x", 3),
                   ("TOO_LONG", "user_id", "n" * 51, 1), ("NOT_NULL", "role", "n5", 1)}
    whole = findings(table.unionByName(new), "app_user")
    assert got <= whole
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    firms = spark.createDataFrame([company(1)], COMPANY)
    lost = contracts.batch_orphans(new.withColumn("company_id", F.when(
        F.col("user_id") == "n1", "C0007").otherwise("C0001")), firms, "company_id")
    assert [r.user_id for r in lost.collect()] == ["n1"] and lost.columns == new.columns
    watched, figures = contracts.observed(new, CONTRACTS["app_user"])
    watched.write.parquet(f"{tmp_path}/new")
    assert figures.get["rows"] == 6 and figures.get["null_role"] == 1
    assert contracts.batch_findings(table, new.filter("false"), CONTRACTS["app_user"]).count() == 0


def test_foreign_keys_and_cascade(spark):
    people = spark.createDataFrame([user("a"), user("b")], APP_USER)
    held = spark.createDataFrame([session("1", "a"), session("2", "b"), session("3", "x")],
                                 USER_SESSION)
    assert [r.session_id for r in contracts.orphans(held, people, "user_id").collect()] == ["3"]
    gone = people.filter("user_id = 'a'")
    assert {r.session_id for r in contracts.cascade_delete(held, gone, "user_id").collect()} == {
        "2", "3"}
    moved = spark.createDataFrame([("a", "z")], "old_key string, new_key string")
    assert {r.user_id for r in contracts.cascade_rename(held, moved, "user_id").collect()} == {
        "z", "b", "x"}


def test_evolution_adds_only_what_is_missing(spark):
    old = spark.createDataFrame([("E1", "keep")], "evidence_id string, company_id string")
    row = contracts.evolve(old, "evidence").first()
    assert row.asDict() == {"evidence_id": "E1", "company_id": "keep", "uploaded_by": None}
    grown = contracts.evolve(spark.createDataFrame([("u",)], "user_id string"), "app_user")
    assert grown.first().verified is False and grown.first().is_super is False


def test_preconditions(spark):
    assert contracts.missing_tables(["app_user"])[:2] == ["chunk", "company"]
    assert "app_user.email" in contracts.missing_columns(
        {"app_user": spark.createDataFrame([("u",)], "user_id string").schema})
    with pytest.raises(ValueError, match="company lacks"):
        contracts.require_columns(spark.createDataFrame([("u",)], "name string").schema,
                                  "company")


def test_upsert_keeps_unnamed_columns(spark):
    table = spark.createDataFrame([company(1), company(2)], COMPANY)
    new = spark.createDataFrame([{**company(1), "name": "NEW", "status": "SUSPENDED"},
                                 company(3)], COMPANY)
    rows = {r.company_id: (r.name, r.status)
            for r in keyed.upsert(table, new, "company_id", ["status"]).collect()}
    assert rows == {"C0001": ("N1", "SUSPENDED"), "C0002": ("N2", "ACTIVE"),
                    "C0003": ("N3", "ACTIVE")}
    kept = keyed.insert_ignore(table, new, "company_id")
    assert {r.company_id: r.name for r in kept.collect()}["C0001"] == "N1"


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 AS hot")
    got = keyed.number_rows(df, ["hot", "id"], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 1001))
    assert [(r.hot, r.id) for r in got] == sorted((i % 3, i) for i in range(1000))
    top = spark.createDataFrame([(40,)], "top long")
    assert {r.n for r in keyed.number_rows(df.limit(2), ["id"], "n", top).collect()} == {41, 42}


def test_load_checks_columns(spark, tmp_path):
    spark.createDataFrame([company(1)], COMPANY).write.parquet(f"{tmp_path}/company")
    assert tables.load(spark, str(tmp_path), "company").first().company_id == "C0001"
    spark.range(1).write.parquet(f"{tmp_path}/invite")
    with pytest.raises(ValueError):
        tables.load(spark, str(tmp_path), "invite")


def test_days_are_pruned(spark, tmp_path):
    rows = [(i, f"u{i % 3}", "LOGIN_OK", None, datetime(2024, 1, 1 + i % 4, i % 24))
            for i in range(40)]
    log = spark.createDataFrame(rows, TABLES["user_login_log"])
    tables.store(log, str(tmp_path), "user_login_log")
    day = date(2024, 1, 2)
    some = tables.load_days(spark, str(tmp_path), "user_login_log", day, day)
    assert sorted(r.log_id for r in some.collect()) == list(range(1, 40, 4))
    text = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in text and some.columns == log.columns
    whole = tables.load_days(spark, str(tmp_path), "user_login_log")
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, log.collect()))


def test_absent_audit_store_is_empty(spark, tmp_path):
    nothing = tables.load_access_events(spark, f"{tmp_path}/none")
    assert nothing.count() == 0 and nothing.schema == ACCESS_EVENT


def test_versions_are_published_together(spark, tmp_path):
    root = str(tmp_path)
    firms = spark.createDataFrame([company(1)], COMPANY)
    held = spark.createDataFrame([session("1", "a")], USER_SESSION)
    assert versions.commit_version(spark, root, {"company": firms}, {"user_session": held}) == 1
    before = versions.read_current(spark, root, "company")
    grown = before.unionByName(spark.createDataFrame([company(2)], COMPANY))
    more = spark.createDataFrame([session("2", "b")], USER_SESSION)
    assert versions.commit_version(spark, root, {"company": grown}, {"user_session": more},
                                   batch="job:7") == 2
    assert before.count() == 1
    assert versions.read_current(spark, root, "company").count() == 2
    assert versions.read_current(spark, root, "user_session").count() == 2
    # the same batch again changes nothing
    assert versions.commit_version(spark, root, {}, {"user_session": more}, batch="job:7") == 2
    assert versions.read_current(spark, root, "user_session").count() == 2
    with pytest.raises(FileNotFoundError):
        versions.read_current(spark, root, "invite")


def test_interleaved_commits_lose_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    versions.commit_version(spark, root, {"company": spark.createDataFrame(
        [company(1)], COMPANY)})
    publish, inside, steps = versions._publish, [], iter("01")

    def between(*args):
        if not inside:
            inside.append(True)
            versions.commit_version(spark, root, {}, {"user_session": spark.createDataFrame(
                [session("2", "b")], USER_SESSION)}, batch=f"other:{next(steps)}")
        return publish(*args)

    monkeypatch.setattr(versions, "_publish", between)
    one = spark.createDataFrame([session("1", "a")], USER_SESSION)
    assert versions.commit_version(spark, root, {}, {"user_session": one}, batch="own:0") == 3
    held = versions.read_current(spark, root, "user_session")
    assert {r.session_id for r in held.collect()} == {"1", "2"}
    assert versions.current_version(spark, root)["batches"] == {"other": 0, "own": 0}
    inside.clear()
    with pytest.raises(versions.StaleVersion):
        versions.commit_version(spark, root, {"company": spark.createDataFrame(
            [company(2)], COMPANY)})
    assert versions.read_current(spark, root, "company").first().company_id == "C0001"


def test_credentials_report(spark):
    good = "pbkdf2_sha256$600000$" + "s" * 22 + "$" + "h" * 43
    people = spark.createDataFrame([user("a", password_hash=good), user("b")], APP_USER)
    assert {r.finding: r.accounts for r in contracts.credential_findings(people).collect()} == {
        "OK": 1, "BAD_SHAPE": 1}
