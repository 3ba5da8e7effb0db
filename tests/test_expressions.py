"""Traps of the scalar rules."""

import hashlib
from datetime import datetime, timedelta

import pytest

from tenantlake.functions import rules, text
from tenantlake.operators.keyed import company_number
from tenantlake.plans.reports import at as now

T0 = datetime(2024, 5, 1, 10, 0, 0)


def values(spark, data, ddl, *columns):
    df = spark.createDataFrame(data, ddl).coalesce(1)
    return [tuple(r) for r in df.select(*columns).collect()]


def test_strip_follows_unicode(spark):
    raw = ["\t a b \n", "　x　", "\x1cx\x1f", " x ", "  ", None, "a\n"]
    got = values(spark, [(r,) for r in raw], "c string", text.strip("c"))
    assert [g[0] for g in got] == [(r or "").strip() for r in raw]


def test_mail_rules(spark):
    long_ok = "a" * 182 + "@ab.test"
    cases = {
        " A.b+c@X-y.CO.kr\t": ("a.b+c@x-y.co.kr", None, None),
        "　u@d.test": ("u@d.test", None, None),
        long_ok: (long_ok, None, None),
        "a" + long_ok: ("a" + long_ok, "INVALID_EMAIL", "INVALID_EMAIL"),
        "two@@d.test": ("two@@d.test", "INVALID_EMAIL", "INVALID_EMAIL"),
        "x@d.t": ("x@d.t", "INVALID_EMAIL", "INVALID_EMAIL"),
        "x@GMAIL.com": ("x@gmail.com", None, "PUBLIC_EMAIL"),
        "x@mail.gmail.com": ("x@mail.gmail.com", None, None),
        None: ("", "INVALID_EMAIL", "INVALID_EMAIL"),
    }
    assert len(long_ok) == 190
    got = values(spark, [(c,) for c in cases], "c string", rules.clean_email("c"),
                 rules.email_error("c"), rules.company_email_error("c"))
    assert got == list(cases.values())


def test_account_rules_in_order(spark):
    data = [("kim.lee", "K", "REVIEWER", None), (" 9x", "", "bad", "INVALID_USER_ID"),
            ("ab", "K", "REVIEWER", "INVALID_USER_ID"),
            ("kim@x.test", "  ", "bad", "DISPLAY_NAME_REQUIRED"),
            ("kim", "n" * 101, "bad", "DISPLAY_NAME_TOO_LONG"),
            ("kim", "n" * 100, "admin", "INVALID_ROLE"), ("kim", "n", None, "INVALID_ROLE")]
    got = values(spark, [d[:3] for d in data], "u string, d string, r string",
                 rules.account_error("u", "d", "r"))
    assert [g[0] for g in got] == [d[3] for d in data]


def test_password_policy(spark):
    data = [
        ("onlyletters", "", "TOO_FEW_KINDS"),
        ("abcdefg12", "", "TOO_SHORT"), ("abcdefg123", "", None),
        ("Abc12-x", "", "TOO_SHORT"), ("Abc12-xy", "", None),
        ("pass１ab-", "", None),              # full-width digit: digit and other
        ("abcdefg１", "", None),              # letter, digit, other: 8 is enough
        ("Xkim12-xyz", "KIM", "CONTAINS_ID"), ("Xkim12-xyz", "", None),
        ("Abaaa12-x", "", "REPEATED_CHARACTER"), ("Ab\n\n\n12-x", "", None),
        ("Ab   12-x", "", "REPEATED_CHARACTER"),
        ("\U0001f600bcd12-", "", "TOO_SHORT"), (None, "kim", None),
    ]
    got = values(spark, [d[:2] for d in data], "p string, w string",
                 rules.password_flaw("p", "w"), rules.password_error("p", "w"))
    assert [g[0] for g in got] == [d[2] for d in data]
    assert [g[1] for g in got] == [d[2] and "WEAK_PASSWORD" for d in data]


def test_hash_shape(spark):
    good = "pbkdf2_sha256$600000$" + "s" * 22 + "$" + "h" * 43
    cases = {good: None, good.replace("600000", "599999"): "FEW_ROUNDS",
             good.replace("600000", "many"): "BAD_ROUNDS", good + "$x": "BAD_SHAPE",
             good[:-1]: "BAD_DIGEST", good.replace("$s", "$"): "BAD_SALT",
             good.replace("pbkdf2", "scrypt"): "UNKNOWN_ALGORITHM", "": "BAD_SHAPE",
             None: "MISSING"}
    got = values(spark, [(c,) for c in cases], "c string", rules.hash_finding("c"))
    assert [g[0] for g in got] == list(cases.values())


def test_times(spark):
    data = [(T0,), (T0 + timedelta(microseconds=500),), (T0 + timedelta(milliseconds=500),),
            (None,)]
    got = values(spark, data, "t timestamp_ntz", text.iso_time("t"), text.day("t"))
    assert got == [(d[0] and d[0].isoformat(), d[0].strftime("%Y-%m-%d") if d[0] else "")
                   for d in data]


@pytest.mark.parametrize("raw, wanted", [
    ("2024-05-01 10:00:00.25", T0 + timedelta(microseconds=250000)),
    ("2024-05-01 10:00:00", T0), ("2024-05-01T10:00:00", None), ("2024-13-01 10:00:00", None),
    ("2024-05-01", None), ("", None), (None, None)])
def test_text_to_time(spark, raw, wanted):
    assert values(spark, [(raw,)], "c string", text.parse_time("c")) == [(wanted,)]


def test_lock_minutes(spark):
    lefts = {timedelta(seconds=59, microseconds=999999): 1, timedelta(seconds=60): 2,
             timedelta(minutes=10): 11, timedelta(microseconds=1): 1}
    got = values(spark, [(T0, T0 + d) for d in lefts], "a timestamp_ntz, l timestamp_ntz",
                 rules.lock_minutes_left("l", "a"))
    assert [g[0] for g in got] == list(lefts.values())


def test_feed_texts(spark):
    data = [("E1", 2, "REVIEW", "DENIED", "E1 v2 검토 · 거부"),
            ("E1", 0, "EXPORT", None, "E1 EXPORT ·"), ("E1", None, None, "FAILED", "E1  · 실패"),
            (None, 1, "REVIEW", "STARTED", "v1 검토 · 시작")]
    got = values(spark, [d[:4] for d in data], "e string, v int, a string, o string",
                 rules.audit_text("e", "v", "a", "o"))
    assert [g[0] for g in got] == [d[4] for d in data]


def test_actor_is_the_last_by(spark):
    data = [("role=x by=a by=b", "b"), ("nothing", "u"), (None, "u"), ("by=", "u"),
            ("goodby=z by=c\tx", "c"), ("by=a by=", "u")]
    got = values(spark, [("u", d[0]) for d in data], "u string, d string",
                 rules.team_actor("u", "d"))
    assert [g[0] for g in got] == [d[1] for d in data]


def test_detail_tokens_keep_repeated_keys(spark):
    got = values(spark, [("a=1 bare a=2=3",), (None,)], "d string", text.detail_tokens("d"))
    assert [[tuple(t) for t in g[0]] for g in got] == [
        [("a", "1"), (None, "bare"), ("a", "2=3")], []]


def test_codes_and_numbers(spark):
    got = values(spark, [("ACCOUNT_LOCKED",), ("WHATEVER",), (None,)], "c string",
                 rules.http_status("c"))
    assert [g[0] for g in got] == [423, 400, 400]
    assert values(spark, [(7,), (12345,)], "n long", company_number("n")) == [
        ("C0007",), ("C12345",)]
    assert values(spark, [("tok",)], "t string", text.token_key("t")) == [
        (hashlib.sha256(b"tok").hexdigest(),)]
    assert values(spark, [("suspended",), ("gone",), (None,)], "s string",
                  rules.company_status("s"), rules.company_status_error("s")) == [
        ("SUSPENDED", None), ("GONE", "INVALID_STATUS"), ("", "INVALID_STATUS")]


def test_as_of_keeps_microseconds(spark):
    moment = T0 + timedelta(microseconds=7)
    assert spark.range(1).select(now(moment)).first()[0] == moment
    assert spark.range(1).select(text.plus(now(T0), days=7)).first()[0] == T0 + timedelta(7)
