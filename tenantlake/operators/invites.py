"""Batches that write, revoke, extend and accept invites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenantlake import config
from tenantlake.functions.rules import (
    clean_email, clean_email_error, company_role_error, domain_of, local_part,
    password_error)
from tenantlake.functions.text import plus, strip
from tenantlake.operators.keyed import last_per_key, update_by_key
from tenantlake.operators.logs import log_row
from tenantlake.operators.outcome import (
    ORDER, Outcome, account_ids, after_winner, applied_once, flag_existing, is_winner, lookup,
    settle, staged_text, user_rows, with_winner)
from tenantlake.plans.reports import invite_error, with_invite
from tenantlake.schemas import INVITE
from tenantlake.session import ensure_checkpoint_dir


def with_next_time(df: DataFrame, key: str, name: str) -> DataFrame:
    """Add the request_ts of the next request of the same key.

    Rows are cut into slices of a range partitioning on (key, time), so a key that owns a
    third of the batch spreads; they are ranked inside (key, slice) and linked over the first
    request of each later slice. Slices are frozen in a reliable checkpoint.
    """
    ensure_checkpoint_dir(df.sparkSession)
    rows = (df.repartitionByRange(key, *ORDER).withColumn("_slice", F.spark_partition_id())
            .checkpoint())
    inside = Window.partitionBy(key, "_slice").orderBy(*ORDER)
    across = Window.partitionBy(key).orderBy("_slice")
    firsts = rows.groupBy(key, "_slice").agg(F.min("request_ts").alias("_first"))
    following = firsts.select(key, "_slice", F.lead("_first").over(across).alias("_following"))
    return (rows.withColumn("_inside", F.lead("request_ts").over(inside))
            .join(following, [key, "_slice"])
            .withColumn(name, F.coalesce("_inside", "_following"))
            .drop("_slice", "_inside", "_following"))


def send_invites(invite: DataFrame, company: DataFrame, users: DataFrame,
                 requests: DataFrame) -> Outcome:
    """Invite people of the company's own mail domain.

    A new invite revokes every open one of the same mail in any company, expired ones
    too; inside a batch each invite is revoked by the next one of its mail.
    """
    staged = requests.withColumn("email", clean_email("email"))
    staged = lookup(staged, company, "company_id", {"_domain": "domain"})
    staged = flag_existing(staged, users, "email", "_exists")
    error = F.coalesce(
        company_role_error("role"), clean_email_error("email"),
        F.when(F.col("_domain").isNull(), F.lit("COMPANY_NOT_FOUND"))
        .when(domain_of("email") != F.col("_domain"), F.lit("DOMAIN_MISMATCH"))
        .when(F.col("_exists"), F.lit("USER_EXISTS")))
    verdicts = settle(staged.select("request_id", "request_ts", "actor", "company_id", "email",
                                    "role", "token", error.alias("error_code")))
    accepted = verdicts.filter(F.col("error_code").isNull())
    new = with_next_time(accepted, "email", "revoked_at").select(
        "token", "company_id", "email", "role", F.col("actor").alias("invited_by"),
        F.col("request_ts").alias("created_at"),
        plus("request_ts", days=config.INVITE_DAYS).alias("expires_at"),
        F.lit(None).cast("timestamp_ntz").alias("accepted_at"), "revoked_at")
    replaced = accepted.groupBy("email").agg(F.min("request_ts").alias("revoke_at"))
    old = update_by_key(invite, replaced, "email", {"revoked_at": F.when(
        F.col("accepted_at").isNull(), F.coalesce("revoked_at", "c_revoke_at")
    ).otherwise(F.col("revoked_at"))})
    detail = F.concat("email", F.lit(" role="), "role")
    return Outcome({"invite": old.unionByName(new.select(*INVITE.names))}, verdicts,
                   accepted.select(*log_row("actor", "INVITE", detail)))


def _open_invites(requests: DataFrame, invite: DataFrame) -> tuple[DataFrame, Column]:
    found = lookup(requests, invite, "token", {
        "_company": "company_id", "_accepted": "accepted_at", "_revoked": "revoked_at"})
    fits = (F.coalesce(F.col("_company") == F.col("company_id"), F.lit(False))
            & F.col("_accepted").isNull() & F.col("_revoked").isNull())
    return found, fits


@applied_once
def revoke_invites(invite: DataFrame, requests: DataFrame) -> Outcome:
    """Revoke open invites of the own company; the second request on a token fails."""
    found, fits = _open_invites(requests, invite)
    known = settle(found.withColumn("_fits", fits))
    judged = with_winner(known, F.col("_fits"), "token")
    error = F.when(~(F.col("_fits") & is_winner()), F.lit("INVITE_NOT_FOUND"))
    verdicts = judged.select("request_id", "request_ts", "actor", "company_id", "token",
                             error.alias("error_code"))
    accepted = verdicts.filter(F.col("error_code").isNull())
    changed = update_by_key(invite, accepted.select("token", "request_ts"), "token",
                            {"revoked_at": F.col("c_request_ts")})
    return Outcome({"invite": changed}, verdicts, accepted.select(
        *log_row("actor", "INVITE_REVOKE", F.substring("token", 1, 12))))


@applied_once
def extend_invites(invite: DataFrame, requests: DataFrame) -> Outcome:
    """Give open invites, also expired ones, seven days from the request; same token."""
    found, fits = _open_invites(requests, invite)
    error = F.when(~fits, F.lit("INVITE_NOT_FOUND"))
    verdicts = settle(found.select(
        "request_id", "request_ts", "actor", "company_id", "token", error.alias("error_code"),
        F.when(fits, plus("request_ts", days=config.INVITE_DAYS)).alias("expires_at")))
    accepted = verdicts.filter(F.col("error_code").isNull())
    final = last_per_key(accepted, ["token"], ORDER, ["expires_at"])
    changed = update_by_key(invite, final, "token", {"expires_at": F.col("c_expires_at")})
    return Outcome({"invite": changed}, verdicts, accepted.select(
        *log_row("actor", "INVITE_RESEND", F.substring("token", 1, 12))))


@applied_once
def accept_invites(invite: DataFrame, company: DataFrame, users: DataFrame,
                   requests: DataFrame) -> Outcome:
    """Create the invited accounts.

    The first clean request per mail wins. Later ones on its token find the invite used,
    even when they lack a name; on another token of the mail they find the account.
    """
    staged = requests.select(
        "request_id", "request_ts", "token", strip("name").alias("name"), "password_hash",
        staged_text(requests, "password").alias("_password"))
    found = with_invite(staged, invite, company)
    found = found.withColumnRenamed("i_email", "email")
    found = flag_existing(found, account_ids(users), "email", "_account")
    found = found.withColumn("_invite", invite_error(F.col("request_ts"))).withColumn(
        "_late", F.coalesce(
            F.when(F.col("name") == "", F.lit("NAME_REQUIRED")),
            password_error("_password", local_part("email")),
            F.when(F.col("_account"), F.lit("USER_EXISTS")))).drop("_password")
    found = settle(found)
    judged = with_winner(found, F.col("_invite").isNull() & F.col("_late").isNull(), "email",
                         ["token"])
    same = F.coalesce(F.col("token") == F.col("w_token"), F.lit(False))
    error = F.coalesce(
        F.when(after_winner() & same, F.lit("INVITE_USED")), "_invite", "_late",
        F.when(after_winner(), F.lit("USER_EXISTS")))
    verdicts = judged.select(
        "request_id", "request_ts", "token", "name", "email", F.col("i_role").alias("role"),
        F.col("i_company_id").alias("company_id"), "password_hash",
        error.alias("error_code"))
    accepted = verdicts.filter(F.col("error_code").isNull())
    new = user_rows(
        accepted, user_id=F.col("email"), email=F.col("email"), display_name=F.col("name"),
        role=F.col("role"), is_admin=F.col("role") == "admin", status=F.lit("ACTIVE"),
        verified=F.lit(True), company_id=F.col("company_id"), approved_at=F.col("request_ts"))
    used = update_by_key(invite, accepted.select("token", "request_ts"), "token",
                         {"accepted_at": F.col("c_request_ts")})
    detail = F.concat(F.lit("company="), "company_id", F.lit(" role="), "role")
    return Outcome({"invite": used, "app_user": users.unionByName(new)},
                   verdicts.drop("password_hash"),
                   accepted.select(*log_row("email", "INVITE_ACCEPT", detail)))
