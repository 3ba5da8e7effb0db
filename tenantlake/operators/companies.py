"""Batches that create companies and change their state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenantlake.functions.rules import (
    clean_company_email_error, clean_email, company_status, company_status_error, domain_of,
    first_error, local_part, password_error)
from tenantlake.functions.text import strip
from tenantlake.operators.keyed import (
    Update, company_number, last_per_key, largest_number, number_rows, session_ends)
from tenantlake.operators.logs import log_row
from tenantlake.operators.outcome import (
    ORDER, Outcome, account_ids, after_winner, applied_once, flag_existing, settle,
    staged_text, user_rows, with_winner)


@applied_once
def sign_up_companies(company: DataFrame, users: DataFrame, requests: DataFrame) -> Outcome:
    """Found a company together with its first admin.

    The mail domain is the tenant: the first clean request per domain founds it, later
    ones of the same mail find their account, those of other mails find the company.
    """
    staged = requests.select(
        "request_id", "request_ts", clean_email("email").alias("email"),
        strip("name").alias("name"), strip("company").alias("company"), "password_hash",
        staged_text(requests, "password").alias("_password"))
    staged = staged.withColumn("domain", domain_of("email")).withColumn("_error", F.coalesce(
        clean_company_email_error("email"),
        first_error((F.col("name") == "", "NAME_REQUIRED"),
                    (F.col("company") == "", "COMPANY_REQUIRED")),
        password_error("_password", local_part("email")))).drop("_password")
    known = flag_existing(staged, account_ids(users), "email", "_account")
    known = flag_existing(known, company, "domain", "_domain")
    taken = (F.when(F.col("_account"), F.lit("USER_EXISTS"))
             .when(F.col("_domain"), F.lit("COMPANY_EXISTS")))
    known = settle(known.withColumn("_taken", taken))
    judged = with_winner(known, F.col("_error").isNull() & F.col("_taken").isNull(), "domain",
                         ["email"])
    beaten = F.when(after_winner(), F.when(
        F.col("email") == F.col("w_email"), F.lit("USER_EXISTS")).otherwise("COMPANY_EXISTS"))
    verdicts = judged.select(
        "request_id", "request_ts", "email", "name", "company", "domain", "password_hash",
        F.coalesce("_error", "_taken", beaten).alias("error_code"))
    accepted = number_rows(verdicts.filter(F.col("error_code").isNull()), ORDER, "_n",
                           largest_number(company, "company_id", prefix=1))
    accepted = accepted.withColumn("company_id", company_number("_n")).drop("_n")
    new_companies = accepted.select(
        "company_id", F.col("company").alias("name"), "domain", F.lit("ACTIVE").alias("status"),
        F.col("request_ts").alias("created_at"), F.col("email").alias("created_by"))
    new_users = user_rows(
        accepted, user_id=F.col("email"), email=F.col("email"), display_name=F.col("name"),
        role=F.lit("admin"), is_admin=F.lit(True), status=F.lit("ACTIVE"),
        verified=F.lit(True), company_id=F.col("company_id"), approved_at=F.col("request_ts"))
    detail = F.concat(F.lit("company="), "company_id", F.lit(" role=admin"))
    return Outcome(
        {"company": company.unionByName(new_companies),
         "app_user": users.unionByName(new_users)},
        verdicts.drop("password_hash"),
        accepted.select(*log_row("email", "SIGNUP", detail)))


@applied_once
def set_company_status(company: DataFrame, users: DataFrame, sessions: DataFrame,
                       requests: DataFrame) -> Outcome:
    """Suspend or reopen companies; suspending ends the open sessions of all its people."""
    staged = flag_existing(requests, company, "company_id", "_exists")
    error = F.coalesce(company_status_error("status"),
                       F.when(~F.col("_exists"), F.lit("COMPANY_NOT_FOUND")))
    verdicts = settle(staged.select(
        "request_id", "request_ts", "actor", "company_id",
        company_status("status").alias("status"), error.alias("error_code")))
    accepted = verdicts.filter(F.col("error_code").isNull())
    final = last_per_key(accepted, ["company_id"], ORDER, ["status"])
    closed = (accepted.filter(F.col("status") != "ACTIVE").groupBy("company_id")
              .agg(F.min("request_ts").alias("revoke_at")))
    people = users.select("user_id", "company_id").join(closed, "company_id")
    return Outcome.of_updates(
        {"company": Update(company, final, "company_id", {"status": F.col("c_status")}),
         "user_session": session_ends(sessions, people)},
        verdicts,
        accepted.select(*log_row("actor", F.concat(F.lit("COMPANY_"), "status"),
                                 F.col("company_id"))))
