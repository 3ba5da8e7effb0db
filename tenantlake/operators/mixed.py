"""One batch of different kinds of requests on accounts and sessions (M3, M6-M8, M14, M15).

Requests of all kinds act in one order (request_ts, request_id), and they meet: stopping an
account (M3) may leave a company without an active admin for the next removal (M7), and it ends
sessions that a log-out (M14) behind it finds ended. The rules meet in three places only:

* the last-admin guard: one ordered fold for each company in which the batch touches every
  active admin, as in `members`; changes of account status take part without being judged;
* the state of an account: the last request that sets a column decides, one aggregate;
* the end of a session: the first request that ends it, by its token or by its account.

So only the guard is folded, everything else is joins and aggregates over the batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenantlake import config
from tenantlake.functions.rules import (
    clean_email, clean_email_error, company_role_error, password_error)
from tenantlake.functions.text import token_key
from tenantlake.operators.keyed import Update, session_ends
from tenantlake.operators.logs import by, log_row
from tenantlake.operators.members import (
    OPS, REMOVE, SET_ACTIVE, SET_ROLE, SET_STATUS, last_admin_verdicts)
from tenantlake.operators.outcome import ORDER, Outcome, applied_once, lookup, settle
from tenantlake.session import ship_package

STATUS, MEMBER, LOGOUT, PASSWORD = "status", "member", "logout", "password"
#: Columns of a request; those its kind does not use are NULL.
REQUEST = ("request_id bigint, request_ts timestamp_ntz, actor string, kind string, "
           "user_id string, status string, company_id string, email string, op string, "
           "role string, active boolean, token string, new_password string, new_hash string, "
           "old_ok boolean, same_as_old boolean")


def _is(kind: str) -> Column:
    return F.col("kind") == kind


def _staged(users: DataFrame, sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests with the account or session they mean and the error they have by themselves."""
    asked = requests.withColumns({
        "email": F.when(_is(MEMBER), clean_email("email")),
        "session_id": F.when(_is(LOGOUT), token_key("token"))})
    columns = {"u_company": "company_id", "u_email": "email", "u_role": "role",
               "u_status": "status"}
    by_id = lookup(asked.filter(_is(STATUS) | _is(PASSWORD)), users.withColumn(
        "_id", F.col("user_id")), "user_id", {"u_id": "_id", **columns})
    mails = users.filter(F.col("email").isNotNull())
    asked_mails = asked.filter(_is(MEMBER)).select("email").distinct()
    people = mails.join(asked_mails, "email", "left_semi").select(
        "company_id", "email", F.col("user_id").alias("u_id"),
        F.col("company_id").alias("u_company"), F.col("email").alias("u_email"),
        F.col("role").alias("u_role"), F.col("status").alias("u_status"))
    by_mail = asked.filter(_is(MEMBER)).join(people, ["company_id", "email"], "left")
    by_token = lookup(asked.filter(_is(LOGOUT)), sessions, "session_id",
                      {"u_id": "user_id", "_ended": "revoked_at"})
    other = asked.filter(~F.coalesce("kind", F.lit("")).isin(STATUS, MEMBER, LOGOUT, PASSWORD))
    known = (by_id.unionByName(by_mail, allowMissingColumns=True)
             .unionByName(by_token, allowMissingColumns=True)
             .unionByName(other, allowMissingColumns=True))
    missing = F.col("u_id").isNull()
    status_error = F.when(~F.coalesce("status", F.lit("")).isin(*config.REQUESTED_STATUSES),
                          "INVALID_STATUS").when(missing, "USER_NOT_FOUND")
    member_error = F.coalesce(
        F.when(~F.coalesce("op", F.lit("")).isin(*OPS), F.lit("INVALID_OP")),
        F.when(F.col("op") == SET_ROLE, company_role_error("role")),
        clean_email_error("email"), F.when(missing, "MEMBER_NOT_FOUND"))
    password = F.coalesce(
        password_error("new_password", F.coalesce("user_id", F.lit(""))),
        F.when(missing, F.lit("USER_NOT_FOUND"))
        .when(~F.coalesce("old_ok", F.lit(False)), F.lit("LOGIN_FAILED"))
        .when(F.col("same_as_old"), F.lit("SAME_PASSWORD")))
    error = (F.when(_is(STATUS), status_error).when(_is(MEMBER), member_error)
             .when(_is(PASSWORD), password).when(_is(LOGOUT), F.lit(None))
             .otherwise("INVALID_OP"))
    return settle(known.withColumn("_early", error).drop("new_password", "token"))


def _guarded(known: DataFrame, users: DataFrame) -> DataFrame:
    """request_id, _kept of the member requests whose company has to be folded."""
    good = known.filter(F.col("_early").isNull() & F.col("u_company").isNotNull()
                        & F.col("u_email").isNotNull() & (_is(MEMBER) | _is(STATUS)))
    steps = good.select(
        *ORDER, F.col("u_company").alias("company_id"), F.col("u_email").alias("email"),
        F.when(_is(STATUS), SET_STATUS).otherwise(F.col("op")).alias("op"),
        F.when(_is(MEMBER), F.col("role")).alias("role"),
        F.when(_is(STATUS), F.col("status") == "ACTIVE").otherwise(F.col("active"))
        .alias("active"), "u_role", "u_status")
    return last_admin_verdicts(steps, users)


@applied_once
def change_accounts(users: DataFrame, sessions: DataFrame, requests: DataFrame) -> Outcome:
    """Apply a batch of `REQUEST` rows of the kinds status, member, logout and password.

    The batch ends as if its requests had come one after another; a verdict has `done`, true
    where a log-out ended a session.
    """
    ship_package()
    known = _staged(users, sessions, requests)
    judged = known.join(_guarded(known, users), "request_id", "left")
    error = F.coalesce("_early", F.when(_is(MEMBER) & ~F.coalesce("_kept", F.lit(True)),
                                        F.lit("LAST_ADMIN")))
    on = (F.col("op") == SET_ACTIVE) & F.coalesce("active", F.lit(False))
    to = (F.when(_is(STATUS), F.col("status"))
          .when(_is(MEMBER) & F.col("op").isin(REMOVE, SET_ACTIVE),
                F.when(on, "ACTIVE").otherwise("DISABLED")))
    settled = settle(judged.withColumn("error_code", error).withColumn("_to", to))
    accepted = settled.filter(F.col("error_code").isNull())

    place = F.struct(*ORDER)
    ends = (F.col("_to") != "ACTIVE") | _is(PASSWORD)

    def last(when: Column, value: str) -> Column:
        return F.max(F.when(when, F.struct(*ORDER, F.col(value).alias("value"))))

    states = accepted.filter(~_is(LOGOUT)).groupBy(F.col("u_id").alias("user_id")).agg(
        last(F.col("_to").isNotNull(), "_to").alias("s"), last(_is(STATUS), "actor").alias("a"),
        last(_is(MEMBER) & (F.col("op") == SET_ROLE), "role").alias("r"),
        last(_is(PASSWORD), "new_hash").alias("p"), F.min(F.when(ends, place)).alias("end"))
    states = settle(states)
    approved, changed = F.col("c_a").isNotNull(), F.col("c_p").isNotNull()
    new_users = Update(users, states, "user_id", {
        "status": F.coalesce("c_s.value", "status"),
        "approved_at": F.when(approved, F.col("c_a.request_ts")).otherwise(F.col("approved_at")),
        "approved_by": F.when(approved, F.col("c_a.value")).otherwise(F.col("approved_by")),
        "failed_count": F.when(approved, 0).otherwise(F.col("failed_count")),
        "locked_until": F.when(~approved, F.col("locked_until")),
        "role": F.coalesce("c_r.value", "role"),
        "is_admin": F.coalesce(F.col("c_r.value") == "admin", F.col("is_admin")),
        "password_hash": F.when(changed, F.col("c_p.value")).otherwise(F.col("password_hash")),
        "password_changed_at": F.coalesce("c_p.request_ts", "password_changed_at")})

    open_now = accepted.filter(_is(LOGOUT) & F.col("u_id").isNotNull() & F.col("_ended").isNull())
    first = open_now.groupBy("session_id", F.col("u_id").alias("user_id")).agg(
        F.min(place).alias("out"))
    first = settle(first.join(states.select("user_id", "end"), "user_id", "left").filter(
        F.col("end").isNull() | (F.col("out") < F.col("end"))).select(
        "session_id", "user_id", F.col("out.request_ts").alias("ended_at"),
        F.col("out.request_id").alias("request_id")))
    out = Update(sessions, first.select("session_id", "ended_at"), "session_id",
                 {"revoked_at": F.coalesce("revoked_at", "c_ended_at")})
    stopped = states.filter("end is not null").select(
        "user_id", F.col("end.request_ts").alias("revoke_at"))
    rest = session_ends(out.whole(), stopped)

    done = first.select("request_id", F.lit(True).alias("_done"))
    verdicts = settled.join(done, "request_id", "left").select(
        "request_id", "request_ts", "actor", "kind", F.col("u_id").alias("user_id"),
        F.coalesce("_done", F.lit(False)).alias("done"), "error_code")
    told = accepted.join(done, "request_id", "left").filter(~_is(LOGOUT) | F.col("_done"))
    event = (F.when(_is(LOGOUT), "LOGOUT").when(_is(PASSWORD), "PW_CHANGE")
             .when(F.col("op") == SET_ROLE, "ROLE_CHANGE")
             .when(F.col("op") == REMOVE, "MEMBER_REMOVE")
             .when(F.col("_to") == "ACTIVE", "ACTIVATE").otherwise("DISABLE"))
    detail = (F.when(_is(MEMBER) & (F.col("op") == SET_ROLE), F.concat("role", F.lit(" "), by()))
              .when(_is(MEMBER) | _is(STATUS), by()))
    who = F.when(_is(MEMBER), F.col("email")).otherwise(F.col("u_id"))
    return Outcome(
        {"app_user": new_users.whole(), "user_session": rest.whole()}, verdicts,
        told.select(*log_row(who, event, detail)),
        {"app_user": new_users.rows(),
         "user_session": out.rows().unionByName(rest.rows())})
