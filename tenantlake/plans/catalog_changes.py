"""Registered queries over batches of state changes and login attempts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tenantlake.operators import (
    accounts, companies, invites, keyed, lockout, logs, members)
from tenantlake.plans.catalog import query
from tenantlake.session import scratch_folder
from tenantlake.sources.days import apply_changes, purge_days
from tenantlake.sources.tables import load_days, store
from tenantlake.sources.versions import read_current
from tenantlake.streaming.replay import replay
from tenantlake.streaming.sinks import merge_batch

PURGE_BEFORE = datetime(1998, 1, 1, 8)


def register_outcome(prefix: str, run, tables: dict[str, str]) -> None:
    """One query for the verdicts, one for the log rows, one per changed table."""
    query(f"{prefix}_verdicts")(lambda t: run(t).verdicts)
    query(f"{prefix}_log_rows")(lambda t: run(t).log_rows)
    for table, suffix in tables.items():
        query(f"{prefix}_{suffix}")(lambda t, table=table: run(t).tables[table])


register_outcome(
    "m1_company_signup",
    lambda t: companies.sign_up_companies(t["company"], t["app_user"], t["company_signups"]),
    {"company": "companies", "app_user": "users"})
register_outcome(
    "m2_account_signup",
    lambda t: accounts.sign_up_accounts(t["app_user"], t["account_signups"]),
    {"app_user": "users"})
register_outcome(
    "m3_account_status",
    lambda t: accounts.set_account_status(t["app_user"], t["user_session"],
                                          t["account_status_requests"]),
    {"app_user": "users", "user_session": "sessions"})
register_outcome(
    "m4_account_role",
    lambda t: accounts.set_account_roles(t["app_user"], t["account_role_requests"]),
    {"app_user": "users"})
register_outcome(
    "m5_company_status",
    lambda t: companies.set_company_status(t["company"], t["app_user"], t["user_session"],
                                           t["company_status_requests"]),
    {"company": "companies", "user_session": "sessions"})
register_outcome(
    "m6_m9_member_changes",
    lambda t: members.change_members(t["app_user"], t["user_session"], t["member_requests"]),
    {"app_user": "users", "user_session": "sessions"})
register_outcome(
    "m10_send_invites",
    lambda t: invites.send_invites(t["invite"], t["company"], t["app_user"],
                                   t["invite_requests"]),
    {"invite": "invites"})
register_outcome(
    "m11_revoke_invites",
    lambda t: invites.revoke_invites(t["invite"], t["invite_token_requests"]),
    {"invite": "invites"})
register_outcome(
    "m12_extend_invites",
    lambda t: invites.extend_invites(t["invite"], t["invite_token_requests"]),
    {"invite": "invites"})
register_outcome(
    "m13_accept_invites",
    lambda t: invites.accept_invites(t["invite"], t["company"], t["app_user"],
                                     t["invite_accepts"]),
    {"invite": "invites", "app_user": "users"})
register_outcome(
    "m14_logout", lambda t: accounts.log_out(t["user_session"], t["logouts"]),
    {"user_session": "sessions"})
register_outcome(
    "m15_password_change",
    lambda t: accounts.change_passwords(t["app_user"], t["user_session"],
                                        t["password_changes"]),
    {"app_user": "users", "user_session": "sessions"})


@query("m16_purge_sessions")
def _(t):
    return accounts.purge_sessions(t["user_session"], PURGE_BEFORE)


@query("m16_purged_count")
def _(t):
    return accounts.purged_count(t["user_session"], PURGE_BEFORE)


def _sessions_by_day(t) -> str:
    root = scratch_folder(t.spark, "days")
    store(t["user_session"], root, "user_session")
    return root


@query("m16_purge_by_days")
def _(t):
    root = _sessions_by_day(t)
    purge_days(t.spark, root, PURGE_BEFORE)
    return load_days(t.spark, root, "user_session")


@query("m15_password_change_by_days")
def _(t):
    root = _sessions_by_day(t)
    apply_changes(t.spark, root, accounts.change_passwords(
        t["app_user"], load_days(t.spark, root, "user_session"), t["password_changes"]))
    return load_days(t.spark, root, "user_session")


def _staged_people(t):
    """Accounts before any operator exists."""
    return t["app_user"].filter(~F.col("is_super"))


register_outcome(
    "m17_first_operator",
    lambda t: accounts.first_operator(_staged_people(t), t["first_operator_requests"]),
    {"app_user": "users"})


@query("m17_first_admin_too_late")
def _(t):
    return accounts.first_admin(t["app_user"], t["account_signups"]).verdicts


@query("m18_next_company_numbers")
def _(t):
    asked = t["company_signups"].select("request_id", "request_ts")
    numbered = keyed.number_rows(asked, ["request_ts", "request_id"], "n",
                                 keyed.largest_number(t["company"], "company_id", prefix=1))
    return numbered.select("request_id", keyed.company_number("n").alias("company_id"))


@query("c3_append_log")
def _(t):
    rows = accounts.set_account_roles(t["app_user"], t["account_role_requests"]).log_rows
    return logs.append_log(t["user_login_log"], rows)


# --- L: login attempts -----------------------------------------------------------------
def _folded(t, gated: bool = False, **how):
    return lockout.fold_logins(t["app_user"], t["attempts"],
                               t["company"] if gated else None, **how)


@query("l1_l4_login_verdicts")
def _(t):
    return lockout.login_verdicts(_folded(t))


@query("l1_sliced_hot_accounts")
def _(t):
    # A low threshold, so that most accounts take the way meant for the few hot ones.
    return lockout.login_verdicts(_folded(t, slices=40))


@query("l1_login_log_rows")
def _(t):
    return lockout.login_log_rows(_folded(t))


@query("l2_login_sessions")
def _(t):
    return lockout.login_sessions(_folded(t))


@query("l2_login_accounts")
def _(t):
    return lockout.login_accounts(t["app_user"], _folded(t))


@query("l3_refused_company_attempts")
def _(t):
    return lockout.split_company_attempts(t["attempts"])[1]


@query("l3_company_gate_verdicts")
def _(t):
    return lockout.login_verdicts(_folded(t, gated=True))


@query("l3_company_gate_sessions")
def _(t):
    return lockout.login_sessions(_folded(t, gated=True))


@query("l3_company_gate_log_rows")
def _(t):
    return lockout.login_log_rows(_folded(t, gated=True))


def _gated_over_time(t):
    asked = companies.set_company_status(t["company"], t["app_user"], t["user_session"],
                                         t["company_changes"])
    return lockout.company_gate(_folded(t), t["app_user"], t["company"], asked.accepted)


@query("l3_company_status_over_time_verdicts")
def _(t):
    return lockout.login_verdicts(_gated_over_time(t))


@query("l3_company_status_over_time_sessions")
def _(t):
    return lockout.login_sessions(_gated_over_time(t))


@query("l5_stream_verdicts")
def _(t):
    return lockout.login_verdicts(replay(t["attempts"], t["app_user"], windows=2))


@query("l6_merged_log")
def _(t):
    """The log that the sink commits, read back from the published version."""
    root = scratch_folder(t.spark, "merged")
    folded = replay(t["attempts"], t["app_user"], windows=2)
    merge_batch(root, source="replay")(folded, 0)
    return read_current(t.spark, root, "user_login_log")


@query("l6_stream_log_rows")
def _(t):
    return lockout.login_log_rows(replay(t["attempts"], t["app_user"], windows=2))
