"""Role changes, removals and on/off of company members, with the last-admin guard.

A company must keep an active admin. Whether a request would take the last one depends
on the requests before it, so the three kinds of request form one ordered fold per
company. The fold is needed for few of them, because a request is always fine when

* its member is no admin, and no request in the batch makes them one; or
* the company has an active admin from whom no request in the batch takes anything.

Both are found by joins and aggregates. Only what is left is folded: admins and
admins-to-be of companies in which the batch touches every active admin. That part runs
over sorted partitions, one Arrow batch at a time, holding the touched admins of one
company.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenantlake.functions.rules import clean_email, clean_email_error, company_role_error
from tenantlake.operators.keyed import Update, last_per_key, session_ends
from tenantlake.operators.logs import by, log_row
from tenantlake.operators.outcome import ORDER, Outcome, applied_once, settle
from tenantlake.session import ship_package

SET_ROLE, REMOVE, SET_ACTIVE = OPS = ("role", "remove", "active")
#: A change of the account's status: takes part in the fold and is not judged.
SET_STATUS = "status"
_MEMBER = ["company_id", "email"]


class _Company:
    """Admin state of one company while its requests are folded."""

    def __init__(self) -> None:
        self.role: dict[str, str] = {}
        self.active_admins: set[str] = set()
        self.enabled: dict[str, bool] = {}

    def put(self, email: str, role: str, enabled: bool) -> None:
        self.role[email], self.enabled[email] = role, enabled
        if role == "admin" and enabled:
            self.active_admins.add(email)
        else:
            self.active_admins.discard(email)

    def apply(self, email: str, op: str, role: str | None, active: bool) -> bool:
        """Apply one request; False when it would leave the company without an admin."""
        held = self.role[email]
        if op == SET_STATUS:
            self.put(email, held, active)
            return True
        takes_away = (role != "admin") if op == SET_ROLE else (op == REMOVE or not active)
        if held == "admin" and takes_away:
            others = len(self.active_admins) - (email in self.active_admins)
            if others == 0:
                return False
        if op == SET_ROLE:
            self.put(email, role, self.enabled[email])
        else:
            self.put(email, held, op == SET_ACTIVE and active)
        return True


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    current, state = None, _Company()
    for batch in batches:
        ids, ok = [], []
        for row in batch.itertuples(index=False):
            if row.company_id != current:
                current, state = row.company_id, _Company()
            if row.kind == 0:
                state.put(row.email, row.role, row.active)
            else:
                ids.append(row.request_id)
                ok.append(state.apply(row.email, row.op, row.role, bool(row.active)))
        yield pd.DataFrame({"request_id": pd.Series(ids, dtype="int64"),
                            "_kept": pd.Series(ok, dtype="bool")})


def last_admin_verdicts(valid: DataFrame, users: DataFrame) -> DataFrame:
    """request_id, _kept for the requests that need the fold. `valid`: ORDER, company_id, email,
    op, role, active, and u_role, u_status of the member before the batch."""
    makes_admin = (F.col("op") == SET_ROLE) & (F.col("role") == "admin")
    touched = valid.groupBy(*_MEMBER).agg(
        F.first("u_role").alias("u_role"), F.first("u_status").alias("u_status"),
        F.max((F.col("u_role") == "admin") | makes_admin).alias("_relevant"))
    takes_away = (F.when(F.col("op") == SET_ROLE, F.col("role") != "admin")
                  .when(F.col("op") == REMOVE, F.lit(True))
                  .otherwise(~F.coalesce("active", F.lit(False))))
    threatened = valid.filter(takes_away).select(*_MEMBER).distinct()
    companies = threatened.select("company_id").distinct()
    admins = users.filter((F.col("role") == "admin") & (F.col("status") == "ACTIVE")
                          & F.col("email").isNotNull()).select(*_MEMBER)
    secure = (admins.join(companies, "company_id", "left_semi")
              .join(threatened, _MEMBER, "left_anti")
              .select("company_id").distinct())
    watched = (touched.filter("_relevant").join(companies, "company_id", "left_semi")
               .join(secure, "company_id", "left_anti"))
    members = watched.select(
        *_MEMBER, F.lit(0).alias("kind"), F.lit(None).cast("timestamp_ntz").alias("request_ts"),
        F.lit(None).cast("bigint").alias("request_id"), F.lit(None).cast("string").alias("op"),
        F.col("u_role").alias("role"), (F.col("u_status") == "ACTIVE").alias("active"))
    asked = valid.join(watched.select(*_MEMBER), _MEMBER, "left_semi").select(
        *_MEMBER, F.lit(1).alias("kind"), "request_ts", "request_id", "op", "role",
        F.coalesce("active", F.lit(False)).alias("active"))
    ordered = (members.unionByName(asked).repartition("company_id")
               .sortWithinPartitions("company_id", "kind", *ORDER)
               .select(*_MEMBER, "kind", F.coalesce("request_id", F.lit(0)).alias("request_id"),
                       "op", "role", "active"))
    return ordered.mapInPandas(_fold, "request_id bigint, _kept boolean")


@applied_once
def change_members(users: DataFrame, sessions: DataFrame, requests: DataFrame) -> Outcome:
    """`requests`: company_id, email, op (role | remove | active), role, active.

    Removing stops the account and ends its sessions but keeps its row and role.
    Switching off does the same and can be undone; the failure counter stays.
    """
    ship_package()
    staged = requests.withColumn("email", clean_email("email")).withColumn(
        "_early", F.coalesce(
            F.when(~F.coalesce("op", F.lit("")).isin(SET_ROLE, REMOVE, SET_ACTIVE),
                   F.lit("INVALID_OP")),
            F.when(F.col("op") == SET_ROLE, company_role_error("role")),
            clean_email_error("email")))
    people = users.join(staged.select("email").distinct(), "email", "left_semi").select(
        *_MEMBER, F.col("user_id").alias("u_id"), F.col("role").alias("u_role"),
        F.col("status").alias("u_status"))
    known = staged.join(people, _MEMBER, "left").withColumn("_early", F.coalesce(
        "_early", F.when(F.col("u_id").isNull(), F.lit("MEMBER_NOT_FOUND"))))
    known = settle(known)
    folded = last_admin_verdicts(known.filter(F.col("_early").isNull()), users)
    judged = known.join(folded, "request_id", "left")
    error = F.coalesce("_early", F.when(~F.coalesce("_kept", F.lit(True)),
                                        F.lit("LAST_ADMIN")))
    verdicts = settle(judged.select(
        "request_id", "request_ts", "actor", "company_id", "email", "op", "role", "active",
        F.col("u_id").alias("user_id"), error.alias("error_code")))
    accepted = verdicts.filter(F.col("error_code").isNull())
    enabled = (F.col("op") == SET_ACTIVE) & F.coalesce("active", F.lit(False))
    roles = last_per_key(accepted.filter(F.col("op") == SET_ROLE), ["user_id"], ORDER, ["role"])
    switched = accepted.filter(F.col("op") != SET_ROLE).withColumn("_on", enabled)
    states = last_per_key(switched, ["user_id"], ORDER, ["_on"])
    changes = roles.select("user_id", "role").join(
        states.select("user_id", F.col("_on").alias("on")), "user_id", "full_outer")
    new_users = Update(users, changes, "user_id", {
        "role": F.coalesce("c_role", "role"),
        "is_admin": F.coalesce(F.col("c_role") == "admin", F.col("is_admin")),
        "status": F.when(F.col("c_on"), "ACTIVE").when(~F.col("c_on"), "DISABLED")
        .otherwise(F.col("status"))})
    ended = switched.filter(~F.col("_on")).groupBy("user_id").agg(
        F.min("request_ts").alias("revoke_at"))
    event = (F.when(F.col("op") == SET_ROLE, "ROLE_CHANGE")
             .when(F.col("op") == REMOVE, "MEMBER_REMOVE")
             .when(enabled, "ACTIVATE").otherwise("DISABLE"))
    detail = F.when(F.col("op") == SET_ROLE, F.concat("role", F.lit(" "), by())).otherwise(by())
    return Outcome.of_updates(
        {"app_user": new_users, "user_session": session_ends(sessions, ended)},
        verdicts, accepted.select(*log_row("email", event, detail)))
