"""Every operator as a named query over a folder of the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenantlake import config
from tenantlake.functions import rules, text
from tenantlake.operators import contracts, isolation, keyed
from tenantlake.operators.isolation import Scope
from tenantlake.plans import reports
from tenantlake.schemas import CONTRACTS
from tenantlake.session import scratch_folder
from tenantlake.sources.adapters import Adapters
from tenantlake.sources.tables import load, load_access_events
from tenantlake.streaming import feeds

Query = Callable[[SparkSession, str], DataFrame]

INVITES_AS_OF = datetime(2001, 1, 1)
SESSIONS_AS_OF = datetime(1998, 1, 1, 8)
FEED_CUT = datetime(1995, 1, 1)
COMPANY = "C0003"
LINK_BASE = "https://team.test/"

_QUERIES: dict[str, Query] = {}


def query(name: str):
    """Register a function of Adapters as the query `name`."""

    def register(fn: Callable[[Adapters], DataFrame]):
        _QUERIES[name] = lambda spark, folder: fn(Adapters(spark, folder))
        return fn

    return register


def all_queries() -> dict[str, Query]:
    from tenantlake.plans import catalog_changes  # noqa: F401  (registers its queries)

    return dict(_QUERIES)


# --- R: reports ----------------------------------------------------------------------
@query("r1_companies_by_id")
def _(t):
    return reports.companies_by_id(t["company"], t["evidence"])


@query("r2_companies_by_domain")
def _(t):
    mails = t["invite"].select(rules.domain_of("email").alias("domain"))
    return reports.companies_by_domain(t["company"], mails)


@query("r3_company_summary")
def _(t):
    return reports.company_summary(t["company"], t["app_user"])


@query("r4_profiles")
def _(t):
    return reports.profiles(t["app_user"], t["company"])


@query("r5_members_of_every_company")
def _(t):
    return reports.all_members(t["app_user"])


@query("r5_members_of_one_company")
def _(t):
    return reports.members(t["app_user"], COMPANY)


@query("r6_invites_of_every_company")
def _(t):
    return reports.all_invites(t["invite"], INVITES_AS_OF)


@query("r6_invites_of_one_company")
def _(t):
    return reports.list_invites(t["invite"], COMPANY, INVITES_AS_OF)


@query("r7_resolve_invite_tokens")
def _(t):
    asked = t["invite_token_requests"].select("request_id", "token")
    return reports.resolve_invites(asked, t["invite"], t["company"], SESSIONS_AS_OF)


@query("r8_team_audit_of_one_company")
def _(t):
    return reports.team_audit(t["user_login_log"], t["app_user"], COMPANY)


@query("r8_team_audit_compat")
def _(t):
    return reports.team_audit(t["user_login_log"], t["app_user"], COMPANY, compat=True)


@query("r8_team_audit_of_every_company")
def _(t):
    return reports.team_audit_all(t["user_login_log"], t["app_user"])


@query("r8_team_feeds_kept_beside_the_log")
def _(t):
    """The log arrives in two batches; the second writes the whole state."""
    log = t["user_login_log"]
    later = F.coalesce(F.col("at") >= F.lit(FEED_CUT), F.lit(False))
    root = scratch_folder(log.sparkSession, "feeds")
    for number, rows in enumerate((log.filter(~later), log.filter(later))):
        feeds.keep_feeds(root, every=2)(rows, number)
    return feeds.team_feeds(feeds.read_kept(log.sparkSession, root), t["app_user"])


@query("r9_all_users")
def _(t):
    return reports.all_users(t["app_user"], t["company"])


@query("r10_users_by_id")
def _(t):
    return reports.user_by_id(t["app_user"], t["user_session"])


@query("r11_list_users")
def _(t):
    return reports.list_users(t["app_user"])


@query("r12_pending_users")
def _(t):
    return reports.pending_users(t["app_user"])


@query("r13_login_log")
def _(t):
    return reports.login_log(t["user_login_log"])


@query("r14_live_sessions")
def _(t):
    return reports.live_sessions(t["user_session"], t["app_user"], SESSIONS_AS_OF)


@query("r14_session_states")
def _(t):
    return reports.session_states(t["user_session"], t["app_user"], SESSIONS_AS_OF)


@query("r14_users_of_tokens")
def _(t):
    return reports.users_of_tokens(t["logouts"].select("request_id", "token"),
                                   t["user_session"], t["app_user"], SESSIONS_AS_OF)


@query("r15_admin_audit")
def _(t):
    return reports.admin_audit(t["access_event"])


@query("r16_member_view")
def _(t):
    return reports.member_view(reports.all_members(t["app_user"]))


@query("r17_user_view")
def _(t):
    rows = reports.all_users(t["app_user"], t["company"]).drop("verified")
    return reports.user_view(rows)


@query("r18_company_view")
def _(t):
    return reports.company_view(reports.company_summary(t["company"], t["app_user"]))


@query("r19_invite_view")
def _(t):
    return reports.invite_view(reports.all_invites(t["invite"], INVITES_AS_OF), LINK_BASE)


@query("r20_team_page_members")
def _(t):
    return reports.team_page(t, COMPANY, "admin", INVITES_AS_OF, LINK_BASE).members


@query("r20_team_page_invites")
def _(t):
    return reports.team_page(t, COMPANY, "admin", INVITES_AS_OF, LINK_BASE).invites


@query("r20_team_page_audit")
def _(t):
    return reports.team_page(t, COMPANY, "admin", INVITES_AS_OF, LINK_BASE).audit


@query("r21_company_invite_list")
def _(t):
    return reports.company_invite_list(t["invite"], COMPANY, INVITES_AS_OF)


@query("r22_admin_company_list")
def _(t):
    return reports.admin_company_list(t["company"], t["app_user"])


@query("r23_admin_user_list")
def _(t):
    return reports.admin_user_list(t["app_user"], t["company"])


def _asked_mails(t):
    return t["company_signups"].select("request_id", rules.clean_email("email").alias("email"))


@query("r24_mail_taken")
def _(t):
    return reports.taken(_asked_mails(t), t["app_user"], "email")


@query("r24_domain_free")
def _(t):
    asked = _asked_mails(t).withColumn("domain", rules.domain_of("email"))
    return reports.free(asked, t["company"], "domain")


@query("r25_users_with_company")
def _(t):
    return reports.users_with_company(t["app_user"], t["company"])


# --- I, P: isolation and permissions ----------------------------------------------------
@query("i2_scoped_evidence")
def _(t):
    return isolation.scoped_rows(t["evidence"], Scope(COMPANY, "a@b.test", "admin"))


@query("i2_super_sees_nothing")
def _(t):
    return isolation.scoped_rows(t["evidence"], Scope(is_super=True))


@query("i2_unscoped_job_sees_all")
def _(t):
    return isolation.scoped_rows(t["evidence"], isolation.UNSCOPED)


@query("i3_scoped_results")
def _(t):
    return isolation.scoped_by_evidence(t["evidence_result"], t["evidence"], Scope(COMPANY))


def _evidence_requests(t):
    return t["access_event"].select("id", "evidence_id")


@query("i4_ownership")
def _(t):
    return isolation.ownership(_evidence_requests(t), t["evidence"], Scope(COMPANY))


@query("i4_ownership_per_request")
def _(t):
    asked = t["user_login_log"].select(
        F.col("log_id").alias("request_id"),
        F.concat(F.lit("E"), F.floor(F.col("log_id") / 9)).alias("evidence_id"),
        F.format_string("C%04d", F.col("log_id") % 25 + 1).alias("company_id"),
        (F.col("log_id") % 50 == 0).alias("is_super"))
    return isolation.ownership_per_request(asked, t["evidence"])


@query("i5_rejected_evidence")
def _(t):
    checked = isolation.ownership(_evidence_requests(t), t["evidence"], Scope(COMPANY))
    return isolation.split_by_ownership(checked)[1]


@query("p1_permissions")
def _(t):
    wanted = F.element_at(F.array(*[F.lit(a) for a in (*config.PERMISSIONS, "export")]),
                          (F.col("id") % 6 + 1).cast("int"))
    return isolation.check_permissions(t["access_event"].select(
        "id", "role", wanted.alias("action")))


@query("p2_evidence_grants")
def _(t):
    return isolation.check_grants(t["access_event"].select("id", "role", "action"))


@query("p3_denied_attempts")
def _(t):
    tried = t["access_event"].withColumn("is_super", F.col("role") == "super")
    return isolation.denied_attempts(tried)


# --- F: scalar functions -------------------------------------------------------------------
@query("f1_f3_company_mail")
def _(t):
    mail = rules.clean_email("email")
    return t["company_signups"].select(
        "request_id", mail.alias("mail"), rules.email_error("email").alias("email_error"),
        F.when(rules.email_error("email").isNull(), rules.domain_of(mail)).alias("domain"),
        rules.company_email_error("email").alias("company_email_error"))


@query("f4_account_rules")
def _(t):
    return t["account_signups"].select(
        "request_id", rules.account_error("user_id", "display_name", "role")
        .alias("error_code"))


@query("f5_password_findings")
def _(t):
    staged = t["company_signups"].withColumn(
        "who", rules.local_part(rules.clean_email("email")))
    return contracts.password_findings(staged, "password", "who")


@query("f6_token_keys")
def _(t):
    return t["logouts"].select("request_id", text.token_key("token").alias("session_id"))


@query("f7_credential_findings")
def _(t):
    return contracts.credential_findings(t["app_user"])


@query("f8_f9_times")
def _(t):
    return t["user_login_log"].select("log_id", text.iso_time("at").alias("iso"),
                                      text.day("at").alias("day"))


@query("f10_audit_text")
def _(t):
    return t["access_event"].select("id", rules.audit_text(
        "evidence_id", "evidence_version", "action", "outcome").alias("text"))


@query("f11_team_text")
def _(t):
    return t["user_login_log"].select(
        "log_id", rules.team_text("user_id", "event").alias("text"),
        rules.team_actor("user_id", "detail").alias("actor"))


@query("f12_company_status")
def _(t):
    return t["company_status_requests"].select(
        "request_id", rules.company_status("status").alias("status"),
        rules.company_status_error("status").alias("error_code"))


@query("f13_http_status")
def _(t):
    code = F.coalesce(rules.company_email_error("email"), F.when(
        F.col("name") == "", "NAME_REQUIRED"), F.lit("USER_EXISTS"))
    return (t["company_signups"].select(code.alias("error_code"))
            .groupBy("error_code").agg(F.count("*").alias("n"))
            .select("error_code", rules.http_status("error_code").alias("http_status"), "n"))


@query("f14_lock_minutes")
def _(t):
    until = text.plus("at", mins=config.LOCK_MINUTES)
    asked = text.plus("at", mins=3)
    return t["attempts"].select("attempt_id",
                                rules.lock_minutes_left(until, asked).alias("minutes_left"))


@query("f15_parse_times")
def _(t):
    raw = F.element_at(F.array(
        F.col("at").cast("string"), F.date_format("at", "yyyy-MM-dd HH:mm:ss"),
        F.date_format("at", "yyyy/MM/dd HH:mm"), F.lit("")),
        (F.col("log_id") % 4 + 1).cast("int"))
    return t["user_login_log"].select("log_id", text.parse_time(raw).alias("parsed"))


@query("f16_ends")
def _(t):
    return t["invite"].select(
        "token", text.plus("created_at", days=config.INVITE_DAYS).alias("invite_end"),
        text.plus("created_at", hours=config.SESSION_HOURS).alias("session_end"),
        text.plus("created_at", mins=config.LOCK_MINUTES).alias("lock_end"))


@query("l7_detail_tokens")
def _(t):
    return (t["user_login_log"].select("log_id", F.posexplode(text.detail_tokens("detail")))
            .select("log_id", F.col("pos").cast("bigint").alias("pos"), "col.key", "col.value"))


# --- C: contracts, sources, keyed merges --------------------------------------------------
def stored(t: Adapters, name: str) -> str:
    """Folder with the derived table written as files."""
    root = scratch_folder(t.spark, "stored")
    t[name].write.parquet(f"{root}/{name}")
    return root


@query("c1_identity_tables")
def _(t):
    return load(t.spark, stored(t, "app_user"), "app_user")


@query("c2_access_events")
def _(t):
    return load_access_events(t.spark, f"{stored(t, 'access_event')}/access_event")


def _broken_users(t):
    """The same mails twice and cut-off names show every kind of finding."""
    return t["app_user"].withColumn("email", F.concat("company_id", F.lit("@x.test"))) \
        .withColumn("display_name", F.nullif("display_name", F.lit("Customer#000000007")))


@query("c4_contract_company_user")
def _(t):
    return contracts.contract_findings(_broken_users(t), CONTRACTS["app_user"])


@query("c4_contract_of_new_users")
def _(t):
    """Accounts that were never signed in are the batch, the others the table."""
    users = _broken_users(t)
    new = F.col("last_login_at").isNull()
    return contracts.batch_findings(users.filter(~new), users.filter(new),
                                    CONTRACTS["app_user"])


@query("c4_contract_invite")
def _(t):
    return contracts.contract_findings(t["invite"].withColumn(
        "token", F.concat("email", F.lit("-padded-to-be-longer-than-allowed"))),
        CONTRACTS["invite"])


@query("c5_orphan_sessions")
def _(t):
    active = t["app_user"].filter(F.col("status") == "ACTIVE")
    return contracts.orphans(t["user_session"], active, "user_id")


@query("c6_cascade_delete")
def _(t):
    closed = t["company"].filter(F.col("status") == "SUSPENDED")
    return contracts.cascade_delete(t["invite"], closed, "company_id")


@query("c6_cascade_rename")
def _(t):
    moved = t["app_user"].filter(F.col("role") == "admin").select(
        F.col("user_id").alias("old_key"), F.upper("user_id").alias("new_key"))
    return contracts.cascade_rename(t["user_session"], moved, "user_id")


@query("c7_evolve")
def _(t):
    old = t["app_user"].drop("email", "company_id", "verified", "is_super", "password_hash")
    return contracts.evolve(old, "app_user")


def _incoming_companies(t):
    first = F.struct("request_ts", "request_id")
    clean = t["company_signups"].filter(rules.company_email_error("email").isNull())
    return clean.select(
        rules.domain_of(rules.clean_email("email")).alias("domain"),
        text.strip("company").alias("name"),
        "request_id", "request_ts").groupBy("domain").agg(
        F.min_by("name", first).alias("name"), F.min("request_ts").alias("created_at"))


@query("c9_insert_ignore")
def _(t):
    new = _incoming_companies(t).select(
        F.concat(F.lit("X-"), "domain").alias("company_id"), "name", "domain",
        F.lit("ACTIVE").alias("status"), "created_at",
        F.lit(None).cast("string").alias("created_by"))
    return keyed.insert_ignore(t["company"], new, "domain")


@query("c9_upsert")
def _(t):
    new = _incoming_companies(t).select(
        F.concat(F.lit("X-"), "domain").alias("company_id"), "name", "domain",
        F.lit("ACTIVE").alias("status"), "created_at",
        F.lit("seed").alias("created_by"))
    return keyed.upsert(t["company"], new, "domain", ["status", "created_by"])
