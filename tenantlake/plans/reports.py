"""Reports over the identity tables.

Each report is one lazy plan. Times are compared with an explicit `as_of`; nothing reads
the clock. Lists are sorted by a full order (a key breaks ties), limits always follow a
full order. The password hash is selected by none of them.
"""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenantlake import config
from tenantlake.functions.rules import audit_text, team_actor, team_text
from tenantlake.functions.text import blank_to_null, day, iso_time, token_key, words
from tenantlake.operators.isolation import can
from tenantlake.operators.keyed import matching_keys

COMPANY_COLUMNS = ("company_id", "name", "domain", "status", "created_at", "created_by")


def at(as_of: datetime) -> Column:
    return F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")


def _named_companies(company: DataFrame, *columns: str) -> DataFrame:
    return company.select("company_id", *[F.col(c).alias(f"company_{c}") for c in columns])


def shown_role() -> Column:
    return F.when(F.coalesce("is_super", F.lit(False)), F.lit("super")).otherwise(F.col("role"))


# --- companies -------------------------------------------------------------------
def companies_by_id(company: DataFrame, keys: DataFrame) -> DataFrame:
    """The companies whose id is among the keys."""
    return company.join(keys.select("company_id").distinct(), "company_id", "left_semi").select(
        *COMPANY_COLUMNS)


def companies_by_domain(company: DataFrame, keys: DataFrame) -> DataFrame:
    return company.join(keys.select("domain").distinct(), "domain", "left_semi").select(
        *COMPANY_COLUMNS[:4])


def company_summary(company: DataFrame, users: DataFrame) -> DataFrame:
    """Every company with its member count (all states) and its first active admin.

    One pass over the users with partial aggregation: a tenant with a third of all users
    leaves each map task as one row.
    """
    per_company = (
        users.filter(F.col("company_id").isNotNull()).groupBy("company_id").agg(
            F.count("user_id").alias("members"),
            F.min(F.when((F.col("role") == "admin") & (F.col("status") == "ACTIVE"),
                         F.col("email"))).alias("admin")))
    return (
        company.join(per_company, "company_id", "left")
        .select(*COMPANY_COLUMNS, F.coalesce("members", F.lit(0)).alias("members"), "admin")
        .orderBy("created_at", "company_id"))


def company_view(summary: DataFrame) -> DataFrame:
    return summary.select(
        F.col("company_id").alias("id"), "company_id", "name", "domain",
        F.coalesce(blank_to_null("admin"), F.col("created_by")).alias("admin"),
        F.coalesce("members", F.lit(0)).alias("members"),
        day("created_at").alias("created_day"),
        iso_time("created_at").alias("created_at"),
        F.lower(F.coalesce("status", F.lit(""))).alias("status"))


def admin_company_list(company: DataFrame, users: DataFrame) -> DataFrame:
    return company_view(company_summary(company, users))


# --- accounts ----------------------------------------------------------------------
def profiles(users: DataFrame, company: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Account plus company, as shown to the account itself; all accounts or some keys."""
    chosen = users if keys is None else users.join(
        keys.select("user_id").distinct(), "user_id", "left_semi")
    return (
        chosen.join(_named_companies(company, "name", "domain", "status"), "company_id", "left")
        .select(
            "user_id", F.col("display_name").alias("name"),
            F.coalesce(blank_to_null("email"), F.col("user_id")).alias("email"),
            shown_role().alias("role"), F.col("company_name").alias("company"), "company_id",
            F.col("company_domain").alias("domain"),
            F.coalesce("verified", F.lit(False)).alias("verified"), "company_status"))


def all_members(users: DataFrame) -> DataFrame:
    """Members of every company, company by company in order of joining."""
    return (
        users.filter(F.col("company_id").isNotNull())
        .select("company_id", F.col("display_name").alias("name"), "email", "role",
                F.coalesce("verified", F.lit(False)).alias("verified"), "status",
                "last_login_at", (F.col("status") == "ACTIVE").alias("active"),
                "created_at", "user_id")
        .orderBy("company_id", "created_at", "user_id"))


def members(users: DataFrame, company_id: str) -> DataFrame:
    return all_members(users.filter(F.col("company_id") == company_id))


def user_by_id(users: DataFrame, keys: DataFrame) -> DataFrame:
    return users.join(keys.select("user_id").distinct(), "user_id", "left_semi").select(
        "user_id", "display_name", "role", "is_admin", "status", "failed_count",
        "locked_until", "created_at", "approved_at", "approved_by", "last_login_at")


def list_users(users: DataFrame, status: str | None = None) -> DataFrame:
    chosen = users.filter(F.col("status") == status) if status else users
    return chosen.select("user_id", "display_name", "role", "is_admin", "status",
                         "created_at", "last_login_at").orderBy("created_at", "user_id")


def pending_users(users: DataFrame) -> DataFrame:
    return list_users(users, "PENDING")


def all_users(users: DataFrame, company: DataFrame) -> DataFrame:
    return (
        users.join(_named_companies(company, "name"), "company_id", "left")
        .orderBy("created_at", "user_id")
        .select(F.col("display_name").alias("name"), "email", shown_role().alias("role"),
                "is_super", "status", "verified", "last_login_at",
                F.col("company_name").alias("company")))


def _account_state(verified: Column) -> Column:
    return (F.when(~F.coalesce(F.col("status") == "ACTIVE", F.lit(False)), F.lit("disabled"))
            .when(F.coalesce(verified, F.lit(False)), F.lit("active"))
            .otherwise(F.lit("unverified")))


def member_view(rows: DataFrame) -> DataFrame:
    kept = [c for c in ("company_id",) if c in rows.columns]
    return rows.select(
        *kept, "name", "email", "role", _account_state(F.col("verified")).alias("status"),
        F.coalesce("verified", F.lit(False)).alias("verified"),
        F.coalesce(F.col("status") == "ACTIVE", F.lit(False)).alias("active"),
        iso_time("last_login_at").alias("last_login_at"))


def user_view(rows: DataFrame) -> DataFrame:
    """Like the member view; a table without the column counts everyone as verified."""
    verified = F.col("verified") if "verified" in rows.columns else F.lit(True)
    return rows.select("name", "email", "company", "role",
                       _account_state(verified).alias("status"),
                       iso_time("last_login_at").alias("last_login_at"))


def admin_user_list(users: DataFrame, company: DataFrame) -> DataFrame:
    return user_view(all_users(users, company))


def users_with_company(users: DataFrame, company: DataFrame,
                       email: str | None = None) -> DataFrame:
    chosen = users.filter(F.col("email") == email) if email else users
    return (
        chosen.join(_named_companies(company, "name", "domain"), "company_id")
        .select("email", "display_name", "role", "status", "verified", "company_id",
                F.col("company_name").alias("company"),
                F.col("company_domain").alias("domain")))


def taken(requests: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Requests whose key already exists; the table stays where it is."""
    return requests.join(matching_keys(table, requests, key).distinct(), key, "left_semi")


def free(requests: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return requests.join(matching_keys(table, requests, key).distinct(), key, "left_anti")


# --- invites -----------------------------------------------------------------------
def invite_status(now: Column) -> Column:
    return (F.when(F.col("accepted_at").isNotNull(), F.lit("accepted"))
            .when(F.col("revoked_at").isNotNull(), F.lit("revoked"))
            .when(F.col("expires_at") <= now, F.lit("expired"))
            .otherwise(F.lit("pending")))


def all_invites(invite: DataFrame, as_of: datetime) -> DataFrame:
    """Invites of every company with their state, newest first within the company."""
    return invite.select(
        "company_id", "token", "email", "role", "invited_by", "created_at", "expires_at",
        "accepted_at", "revoked_at", invite_status(at(as_of)).alias("status"),
    ).orderBy("company_id", F.desc("created_at"), "token")


def list_invites(invite: DataFrame, company_id: str, as_of: datetime) -> DataFrame:
    return all_invites(invite.filter(F.col("company_id") == company_id), as_of)


def invite_view(rows: DataFrame, base: str = "") -> DataFrame:
    link = F.concat(F.lit(base.rstrip("/")), F.lit("/?invite="), F.col("token"))
    kept = [c for c in ("company_id",) if c in rows.columns]
    return rows.select(*kept, "token", F.col("token").alias("id"), "email", "role", "status",
                       "invited_by", iso_time("expires_at").alias("expires_at"),
                       link.alias("invite_url"))


def company_invite_list(invite: DataFrame, company_id: str, as_of: datetime,
                        base: str = "") -> DataFrame:
    return invite_view(list_invites(invite, company_id, as_of), base)


def invite_error(now: Column) -> Column:
    """First reason why a looked-up invite cannot be used; NULL when it can."""
    return (F.when(F.col("i_company_id").isNull(), F.lit("INVITE_NOT_FOUND"))
            .when(F.col("accepted_at").isNotNull(), F.lit("INVITE_USED"))
            .when(F.col("revoked_at").isNotNull(), F.lit("INVITE_REVOKED"))
            .when(F.col("expires_at") <= now, F.lit("INVITE_EXPIRED")))


def with_invite(requests: DataFrame, invite: DataFrame, company: DataFrame) -> DataFrame:
    """Requests joined with the invite of their token, if its company exists."""
    asked = invite.join(requests.select("token").distinct(), "token", "left_semi")
    known = asked.join(_named_companies(company, "name"), "company_id").select(
        "token", F.col("email").alias("i_email"), F.col("role").alias("i_role"),
        F.col("company_id").alias("i_company_id"), F.col("company_name").alias("i_company"),
        "expires_at", "accepted_at", "revoked_at")
    return requests.join(known, "token", "left")


def resolve_invites(requests: DataFrame, invite: DataFrame, company: DataFrame,
                    as_of: datetime) -> DataFrame:
    """What each opened invite link shows: the invite, or the reason it is not valid."""
    error = invite_error(at(as_of))
    return (
        with_invite(requests, invite, company).withColumn("error_code", error)
        .select(*requests.columns, "error_code",
                *[F.when(F.col("error_code").isNull(), F.col(c)).alias(n) for c, n in (
                    ("i_email", "email"), ("i_role", "role"), ("i_company", "company"),
                    ("i_company_id", "company_id"), ("expires_at", "expires_at"))]))


# --- sessions ----------------------------------------------------------------------
def session_states(sessions: DataFrame, users: DataFrame, as_of: datetime) -> DataFrame:
    """Every session of a known account with the reason it is dead, or `alive`."""
    reason = (F.when(F.col("revoked_at").isNotNull(), F.lit("revoked"))
              .when(F.col("status") != "ACTIVE", F.lit("inactive"))
              .when(F.col("expires_at").isNull() | (F.col("expires_at") <= at(as_of)),
                    F.lit("expired"))
              .otherwise(F.lit("alive")))
    people = users.select("user_id", "display_name", "role", "is_admin", "status")
    return (sessions.select("session_id", "user_id", "expires_at", "revoked_at")
            .join(people, "user_id")
            .select("session_id", "user_id", "display_name", "role", "is_admin",
                    "expires_at", reason.alias("state")))


def live_sessions(sessions: DataFrame, users: DataFrame, as_of: datetime) -> DataFrame:
    """Sessions that still admit their user; ending exactly at `as_of` is dead."""
    open_ones = sessions.filter(F.col("revoked_at").isNull()
                                & (F.col("expires_at") > at(as_of)))
    people = users.filter(F.col("status") == "ACTIVE").select(
        "user_id", "display_name", "role", "is_admin")
    return (open_ones.select("session_id", "user_id", "expires_at").join(people, "user_id")
            .select("session_id", "user_id", "display_name", "role", "is_admin", "expires_at"))


def users_of_tokens(tokens: DataFrame, sessions: DataFrame, users: DataFrame,
                    as_of: datetime) -> DataFrame:
    """Who is behind each presented token; unknown and dead tokens give no row."""
    asked = tokens.select("token", token_key("token").alias("session_id"))
    held = sessions.join(asked.select("session_id").distinct(), "session_id", "left_semi")
    people = users.join(held.select("user_id").distinct(), "user_id", "left_semi")
    return (asked.join(live_sessions(held, people, as_of), "session_id")
            .drop("session_id"))


# --- feeds -------------------------------------------------------------------------
def login_log(log: DataFrame, user_id: str | None = None,
              limit: int = config.LOGIN_LOG_PAGE) -> DataFrame:
    chosen = log.filter(F.col("user_id") == user_id) if user_id else log
    return (chosen.select("log_id", "user_id", "event", "detail", "at")
            .orderBy(F.desc("log_id")).limit(int(limit)))


def _team_events(log: DataFrame) -> DataFrame:
    return log.filter(F.col("event").isin(*config.TEAM_EVENT_LABELS)).select(
        "log_id", "user_id", "event", "detail", "at")


def _feed_row(*extra: str) -> list[Column]:
    return [*[F.col(c) for c in extra], F.col("log_id"),
            team_text("user_id", "event").alias("text"),
            team_actor("user_id", "detail").alias("actor"), iso_time("at").alias("at")]


def team_audit(log: DataFrame, users: DataFrame, company_id: str,
               limit: int = config.TEAM_AUDIT_PAGE, compat: bool = False) -> DataFrame:
    """Newest changes of rights in one company.

    A row belongs to the company when its account is the mail of a member or its detail
    names the company. By default the name must be a whole token; `compat` accepts any
    substring, under which C0001 also matches C00010.
    """
    mails = (users.filter((F.col("company_id") == company_id) & F.col("email").isNotNull())
             .select(F.col("email").alias("user_id")).distinct()
             .withColumn("_member", F.lit(True)))
    mark = f"company={company_id}"
    if compat:
        like = "%" + mark + "%"
        named = F.coalesce(F.col("detail").like(like), F.lit(False))
    else:
        named = F.array_contains(words("detail"), mark)
    return (
        _team_events(log).join(mails, "user_id", "left")
        .filter(F.col("_member").isNotNull() | named)
        .orderBy(F.desc("log_id")).limit(int(limit))
        .select(*_feed_row()))


def team_audit_all(log: DataFrame, users: DataFrame,
                   limit: int = config.TEAM_AUDIT_PAGE) -> DataFrame:
    """The exact team feed of every company at once.

    The rank filter is applied per task before the shuffle (window group limit), so a
    company that owns a third of the log sends at most `limit` rows per task.
    """
    rows = _team_events(log)
    homes = (users.filter(F.col("email").isNotNull() & F.col("company_id").isNotNull())
             .select(F.col("email").alias("user_id"), F.col("company_id").alias("_home")))
    hits = F.filter(words("detail"), lambda w: w.startswith("company="))
    named = F.transform(hits, lambda w: F.substring(
        w, F.lit(len("company=") + 1), F.length(w)))
    owners = F.array_distinct(F.array_compact(F.concat(F.array("_home"), named)))
    newest = Window.partitionBy("company_id").orderBy(F.desc("log_id"))
    return (
        rows.join(homes, "user_id", "left")
        .select(*rows.columns, F.explode(owners).alias("company_id"))
        .withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= int(limit))
        .select(*_feed_row("company_id")))


def admin_audit(access_event: DataFrame, limit: int = config.ADMIN_AUDIT_PAGE) -> DataFrame:
    """Newest accesses of operators to tenant evidence, with their text."""
    size = max(1, min(int(limit), config.ADMIN_AUDIT_MAX))
    return access_event.orderBy(F.desc("id")).limit(size).select(
        "id", "occurred_at", "actor", "role", "action", "evidence_id", "evidence_version",
        "outcome",
        audit_text("evidence_id", "evidence_version", "action", "outcome").alias("text"),
        F.col("occurred_at").alias("at"))


class TeamPage(NamedTuple):
    members: DataFrame
    invites: DataFrame
    audit: DataFrame


def team_page(tables: dict[str, DataFrame], company_id: str, role: str, as_of: datetime,
              base: str = "") -> TeamPage:
    """Members for everyone; open invites and the feed only for roles that manage."""
    invites = company_invite_list(tables["invite"], company_id, as_of, base).filter(
        F.col("status") == "pending")
    audit = team_audit(tables["user_login_log"], tables["app_user"], company_id)
    if not can(role, "team"):
        invites, audit = invites.filter(F.lit(False)), audit.filter(F.lit(False))
    return TeamPage(member_view(members(tables["app_user"], company_id)), invites, audit)
