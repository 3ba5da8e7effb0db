"""Batches that change accounts and sessions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenantlake import config
from tenantlake.functions.rules import (
    account_error, clean_email, clean_email_error, local_part, password_error)
from tenantlake.functions.text import strip, token_key
from tenantlake.operators.keyed import Update, last_per_key, session_ends, update_by_key
from tenantlake.operators.logs import by, log_row
from tenantlake.operators.outcome import (
    ORDER, Outcome, applied_once, flag_existing, is_winner, lookup, settle, staged_text,
    user_rows, with_winner)


def _account_requests(requests: DataFrame) -> DataFrame:
    role = F.col("role") if "role" in requests.columns else F.lit("REVIEWER")
    staged = requests.select(
        "request_id", "request_ts", strip("user_id").alias("user_id"),
        strip("display_name").alias("display_name"), role.alias("role"), "password_hash",
        staged_text(requests, "password").alias("_password"))
    error = F.coalesce(account_error("user_id", "display_name", "role"),
                       password_error("_password", "user_id"))
    return staged.withColumn("_error", error).drop("_password")


@applied_once
def sign_up_accounts(users: DataFrame, requests: DataFrame) -> Outcome:
    """Plain sign-up; the account waits for approval. First clean request per id wins."""
    known = settle(flag_existing(_account_requests(requests), users, "user_id", "_exists"))
    judged = with_winner(known, F.col("_error").isNull() & ~F.col("_exists"), "user_id")
    error = F.coalesce("_error", F.when(F.col("_exists") | ~is_winner(), "USER_EXISTS"))
    verdicts = judged.select(
        "request_id", "request_ts", "user_id", "display_name", "role", "password_hash",
        error.alias("error_code"))
    accepted = verdicts.filter(F.col("error_code").isNull())
    new = user_rows(accepted, user_id=F.col("user_id"), display_name=F.col("display_name"),
                    role=F.col("role"), status=F.lit("PENDING"))
    detail = F.concat(F.lit("role="), "role", F.lit(" status=PENDING"))
    return Outcome({"app_user": users.unionByName(new)}, verdicts.drop("password_hash"),
                   accepted.select(*log_row("user_id", "SIGNUP", detail)))


@applied_once
def set_account_status(users: DataFrame, sessions: DataFrame, requests: DataFrame) -> Outcome:
    """Approve or stop accounts; also clears the failure counter and any lock.

    The last request per account decides its status. Any stopping request ends the
    sessions that were open then, even if the account is approved again later.
    """
    allowed = F.coalesce("status", F.lit("")).isin(*config.REQUESTED_STATUSES)
    error = F.when(~allowed, F.lit("INVALID_STATUS")).when(
        ~F.col("_exists"), F.lit("USER_NOT_FOUND"))
    verdicts = settle(
        flag_existing(requests, users, "user_id", "_exists").select(
            "request_id", "request_ts", "actor", "user_id", "status",
            error.alias("error_code")))
    accepted = verdicts.filter(F.col("error_code").isNull())
    final = last_per_key(accepted, ["user_id"], ORDER, ["status", "actor"])
    stopped = (accepted.filter(F.col("status") != "ACTIVE").groupBy("user_id")
               .agg(F.min("request_ts").alias("revoke_at")))
    new_users = Update(users, final, "user_id", {
        "status": F.col("c_status"), "approved_at": F.col("c_request_ts"),
        "approved_by": F.col("c_actor"), "failed_count": F.lit(0),
        "locked_until": F.lit(None).cast("timestamp_ntz")})
    event = F.when(F.col("status") == "ACTIVE", F.lit("ACTIVATE")).otherwise(F.lit("DISABLE"))
    return Outcome.of_updates(
        {"app_user": new_users, "user_session": session_ends(sessions, stopped)},
        verdicts, accepted.select(*log_row("user_id", event, by())))


@applied_once
def set_account_roles(users: DataFrame, requests: DataFrame) -> Outcome:
    """Change the account role; logged as ACTIVATE. Setting the same role is a success."""
    allowed = F.coalesce("role", F.lit("")).isin(*config.ACCOUNT_ROLES)
    error = F.when(~allowed, F.lit("INVALID_ROLE")).when(
        ~F.col("_exists"), F.lit("USER_NOT_FOUND"))
    verdicts = settle(
        flag_existing(requests, users, "user_id", "_exists").select(
            "request_id", "request_ts", "actor", "user_id", "role",
            error.alias("error_code")))
    accepted = verdicts.filter(F.col("error_code").isNull())
    final = last_per_key(accepted, ["user_id"], ORDER, ["role"])
    detail = F.concat(F.lit("role="), "role", F.lit(" "), by())
    return Outcome(
        {"app_user": update_by_key(users, final, "user_id", {"role": F.col("c_role")})},
        verdicts, accepted.select(*log_row("user_id", "ACTIVATE", detail)))


@applied_once
def log_out(sessions: DataFrame, requests: DataFrame) -> Outcome:
    """End sessions by token. `done` tells whether the request ended one; there is no error."""
    staged = requests.select("request_id", "request_ts", token_key("token").alias("session_id"))
    found = settle(lookup(staged, sessions, "session_id",
                          {"user_id": "user_id", "_ended": "revoked_at"}))
    open_now = F.col("user_id").isNotNull() & F.col("_ended").isNull()
    judged = with_winner(found, open_now, "session_id")
    verdicts = judged.select(
        "request_id", "request_ts", "session_id", "user_id",
        F.coalesce(is_winner(), F.lit(False)).alias("done"),
        F.lit(None).cast("string").alias("error_code"))
    done = verdicts.filter("done")
    ended = Update(sessions, done.select("session_id", "request_ts"), "session_id",
                   {"revoked_at": F.coalesce("revoked_at", "c_request_ts")})
    return Outcome.of_updates({"user_session": ended}, verdicts,
                              done.select(*log_row("user_id", "LOGOUT")))


@applied_once
def change_passwords(users: DataFrame, sessions: DataFrame, requests: DataFrame) -> Outcome:
    """Staging brings the new hash and what the verifier said (old_ok, same_as_old)."""
    staged = requests.withColumn("_weak", password_error(
        staged_text(requests, "new_password"), F.coalesce("user_id", F.lit(""))))
    error = F.coalesce(
        "_weak", F.when(~F.col("_exists"), F.lit("USER_NOT_FOUND"))
        .when(~F.coalesce("old_ok", F.lit(False)), F.lit("LOGIN_FAILED"))
        .when(F.col("same_as_old"), F.lit("SAME_PASSWORD")))
    verdicts = settle(
        flag_existing(staged, users, "user_id", "_exists").select(
            "request_id", "request_ts", "user_id", "new_hash", error.alias("error_code")))
    accepted = verdicts.filter(F.col("error_code").isNull())
    final = last_per_key(accepted, ["user_id"], ORDER, ["new_hash"])
    ended = accepted.groupBy("user_id").agg(F.min("request_ts").alias("revoke_at"))
    new_users = Update(users, final, "user_id", {
        "password_hash": F.col("c_new_hash"), "password_changed_at": F.col("c_request_ts")})
    return Outcome.of_updates(
        {"app_user": new_users, "user_session": session_ends(sessions, ended)},
        verdicts.drop("new_hash"), accepted.select(*log_row("user_id", "PW_CHANGE")))


def gone(cutoff: datetime) -> Column:
    limit = F.lit(cutoff.isoformat(sep=" ")).cast("timestamp_ntz")
    return (F.coalesce(F.col("expires_at") < limit, F.lit(False))
            | F.col("revoked_at").isNotNull())


def purge_sessions(sessions: DataFrame, cutoff: datetime) -> DataFrame:
    """Sessions that stay: not revoked and not ended before the cutoff (equal stays)."""
    return sessions.filter(~gone(cutoff))


def purged_count(sessions: DataFrame, cutoff: datetime) -> DataFrame:
    return sessions.filter(gone(cutoff)).agg(F.count("*").alias("purged"))


def _seed_once(requests: DataFrame, existing: DataFrame, late_error: Column,
               early_error: Column | None = None) -> DataFrame:
    """Judge seed requests: one may win, and only while `existing` has no row.

    `early_error` is checked before the seat, `late_error` after it. Whether the seat is
    taken and who came first are single values, so they are scalar subqueries.
    """
    early = F.lit(None).cast("string") if early_error is None else early_error
    taken = existing.limit(1).select(F.lit(True)).scalar()
    staged = (requests.withColumn("_early", early).withColumn("_late", late_error)
              .withColumn("_taken", F.coalesce(taken, F.lit(False))))
    clean = F.col("_early").isNull() & F.col("_late").isNull() & ~F.col("_taken")
    first = staged.filter(clean).agg(F.min(F.struct(*ORDER))).scalar()
    beaten = F.coalesce(F.struct(*ORDER) > first, F.lit(False))
    return staged.withColumn("error_code", F.coalesce(
        "_early", F.when(F.col("_taken") | beaten, F.lit("ALREADY_INITIALIZED")), "_late"))


@applied_once
def first_admin(users: DataFrame, requests: DataFrame) -> Outcome:
    """The very first account, possible only while there is none."""
    staged = requests if "role" in requests.columns else requests.withColumn(
        "role", F.lit("APPROVER"))
    staged = _account_requests(staged)
    judged = _seed_once(staged, users, F.col("_error"))
    verdicts = settle(judged.select("request_id", "request_ts", "user_id", "display_name",
                                    "role", "password_hash", "error_code"))
    accepted = verdicts.filter(F.col("error_code").isNull())
    new = user_rows(
        accepted, user_id=F.col("user_id"), display_name=F.col("display_name"),
        role=F.col("role"), status=F.lit("ACTIVE"), is_admin=F.lit(True),
        approved_at=F.col("request_ts"), approved_by=F.col("user_id"))
    signup = F.concat(F.lit("role="), "role", F.lit(" status=PENDING"))
    logs = accepted.select(*log_row("user_id", "SIGNUP", signup)).unionByName(
        accepted.select(*log_row("user_id", "ACTIVATE", F.lit("bootstrap_admin"), seq=1)))
    return Outcome({"app_user": users.unionByName(new)}, verdicts.drop("password_hash"), logs)


@applied_once
def first_operator(users: DataFrame, requests: DataFrame) -> Outcome:
    """The first operator of the service; belongs to no company."""
    name = F.col("name") if "name" in requests.columns else F.lit(config.FIRST_OPERATOR_NAME)
    staged = requests.select(
        "request_id", "request_ts", clean_email("email").alias("email"), name.alias("name"),
        "password_hash", staged_text(requests, "password").alias("_password"))
    known = flag_existing(staged, users, "email", "_exists", "user_id")
    late = F.coalesce(password_error("_password", local_part("email")),
                      F.when(F.col("_exists"), F.lit("USER_EXISTS")))
    judged = _seed_once(known, users.filter("is_super"), late, clean_email_error("email"))
    verdicts = settle(judged.select("request_id", "request_ts", "email", "name",
                                    "password_hash", "error_code"))
    accepted = verdicts.filter(F.col("error_code").isNull())
    new = user_rows(
        accepted, user_id=F.col("email"), email=F.col("email"), display_name=F.col("name"),
        role=F.lit("admin"), status=F.lit("ACTIVE"), is_admin=F.lit(True),
        is_super=F.lit(True), verified=F.lit(True), approved_at=F.col("request_ts"))
    return Outcome({"app_user": users.unionByName(new)}, verdicts.drop("password_hash"),
                   accepted.select(*log_row("email", "SIGNUP", F.lit("super"))))
