"""Identity tables and staged request batches derived from the given star-schema tables.

Every derived table is one projection over one base: a list of (column, expression).
The expressions are the same text for Spark and for the SQL used to check it, apart from
the few marked pairs. Every base row becomes a row; nothing is sampled or cut off.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DUCK, SPARK = 1, 0

_CUSTOMER_OF_ORDER = ("customer", "c_custkey = o_custkey")
BASES: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "nation": ("nation", []),
    "customer": ("customer", []),
    "documents": ("documents", []),
    "labels": ("labels", []),
    "events_only": ("events", []),
    "orders": ("orders", [_CUSTOMER_OF_ORDER]),
    "events": ("events", [("customer", "c_custkey = user_id")]),
    # five events address the invite of one order
    "events_invites": ("events", [("orders", "o_orderkey = event_id - event_id % 5"),
                                  _CUSTOMER_OF_ORDER]),
}


def _ts(text: str) -> tuple[str, str]:
    return f"TIMESTAMP_NTZ '{text}'", f"TIMESTAMP '{text}'"


_DAY0 = _ts("2024-01-01 00:00:00")


def _pair(template: str) -> tuple[str, str]:
    """Fill {day0} and {sha}(x) for both dialects."""
    out = []
    for side in (SPARK, DUCK):
        text = template.replace("{day0}", _DAY0[side])
        while "{sha}" in text:
            start = text.index("{sha}")
            end = text.index("{/sha}")
            inner = text[start + 5:end]
            call = f"sha2({inner}, 256)" if side == SPARK else f"sha256({inner})"
            text = text[:start] + call + text[end + 6:]
        out.append(text)
    return out[0], out[1]


def _mail(user: str, nation: str) -> str:
    return f"concat('user', {user}, '@nation', {nation}, '.test')"


_CUSTOMER_MAIL = _mail("c_custkey", "c_nationkey")

_USER_ROLE = ("CASE WHEN c_custkey % 10 = 0 THEN 'admin' "
              "WHEN c_custkey % 10 IN (1, 2) THEN 'reviewer' ELSE 'member' END")
_USER_STATUS = ("CASE WHEN c_custkey % 11 = 3 THEN 'DISABLED' "
                "WHEN c_custkey % 13 = 4 THEN 'PENDING' ELSE 'ACTIVE' END")
_CREATED = "{day0} + c_custkey * INTERVAL '1' MINUTE"
_COMPANY_OF_CUSTOMER = "concat('C', lpad(CAST(c_nationkey + 1 AS VARCHAR(9)), 4, '0'))"
_EVENT_NAMES = ("SIGNUP,ACTIVATE,DISABLE,LOGIN_OK,LOGIN_FAIL,LOCKED,LOGOUT,PW_CHANGE,"
                "COMPANY_ACTIVE,COMPANY_SUSPENDED,ROLE_CHANGE,MEMBER_REMOVE,INVITE,"
                "INVITE_REVOKE,INVITE_ACCEPT,INVITE_RESEND,OTHER")
_ATTEMPT_AT = (
    "timestampadd(MICROSECOND, timestampdiff(MICROSECOND, {d}, ts) DIV 300, {d})"
    .replace("{d}", _DAY0[SPARK]),
    "{d} + to_microseconds(date_diff('microsecond', {d}, ts) // 300)"
    .replace("{d}", _DAY0[DUCK]),
)
_ORDER_TOKEN = "substr({sha}concat('invite-', o_orderkey){/sha}, 1, 43)"
_ORDER_MAIL = ("CASE WHEN o_orderkey % 3 = 0 THEN " + _CUSTOMER_MAIL +
               " ELSE concat('guest', o_custkey, '@nation', c_nationkey, '.test') END")
_ORDER_ROLE = ("CASE WHEN o_orderkey % 7 = 0 THEN 'admin' "
               "WHEN o_orderkey % 7 IN (1, 2) THEN 'reviewer' ELSE 'member' END")
_PASSWORD = ("CASE event_id % 7 WHEN 0 THEN 'short1' WHEN 1 THEN 'Xguest8_BOSS1' "
             "WHEN 2 THEN 'aaaBBB1!!' WHEN 3 THEN 'onlyletters' "
             "ELSE concat('Str0ng-pass', event_id) END")
_REQUEST = [("request_id", "event_id"), ("request_ts", "ts"),
            ("actor", "concat('ops', event_id % 3, '@nation', c_nationkey, '.test')")]
#: Every 61st request comes under the number of the request before it.
_TWICE = [("request_id", "event_id - CASE WHEN event_id % 61 = 1 THEN 1 ELSE 0 END"),
          *_REQUEST[1:]]
_NEAR_INVITE = ("o_orderdate + (event_id % 9) * INTERVAL '1' DAY "
                "+ (event_id % 86400) * INTERVAL '1' SECOND")
_EVENT_TOKEN = ("CASE WHEN event_id % 31 = 0 THEN concat('missing-', event_id) ELSE "
                + _ORDER_TOKEN + " END")

TABLES: dict[str, tuple[str, list[tuple[str, str | tuple[str, str]]]]] = {
    "company": ("nation", [
        ("company_id", "concat('C', lpad(CAST(n_nationkey + 1 AS VARCHAR(9)), 4, '0'))"),
        ("name", "n_name"),
        ("domain", "concat('nation', n_nationkey, '.test')"),
        ("status", "CASE WHEN n_nationkey % 7 = 3 THEN 'SUSPENDED' ELSE 'ACTIVE' END"),
        ("created_at", _pair("{day0} + n_nationkey * INTERVAL '1' DAY")),
        ("created_by", "CASE WHEN n_nationkey % 2 = 1 THEN "
                       "concat('founder', n_nationkey, '@nation', n_nationkey, '.test') END"),
    ]),
    "app_user": ("customer", [
        ("user_id", _CUSTOMER_MAIL),
        ("display_name", "c_name"),
        ("password_hash", _pair(
            "concat('pbkdf2_sha256$', CASE WHEN c_custkey % 9 = 0 THEN '260000' ELSE "
            "'600000' END, '$', substr({sha}concat('salt', c_custkey){/sha}, 1, 22), '$', "
            "substr({sha}concat('hash', c_custkey){/sha}, 1, 43))")),
        ("role", _USER_ROLE),
        ("is_admin", "c_custkey % 10 = 0"),
        ("is_super", "c_custkey = 0"),
        ("status", _USER_STATUS),
        ("failed_count", "CAST(0 AS INT)"),
        ("locked_until", ("CAST(NULL AS TIMESTAMP_NTZ)", "CAST(NULL AS TIMESTAMP)")),
        ("created_at", _pair(_CREATED)),
        ("approved_at", _pair(f"CASE WHEN c_custkey % 13 <> 4 THEN {_CREATED} END")),
        ("approved_by", "CAST(NULL AS VARCHAR(50))"),
        ("password_changed_at", _pair(_CREATED)),
        ("last_login_at", _pair(
            f"CASE WHEN c_custkey % 4 <> 0 THEN {_CREATED} + INTERVAL '1' DAY END")),
        ("email", f"CASE WHEN c_custkey % 97 <> 5 THEN {_CUSTOMER_MAIL} END"),
        ("company_id", f"CASE WHEN c_custkey <> 0 THEN {_COMPANY_OF_CUSTOMER} END"),
        ("verified", "c_custkey % 5 <> 0"),
    ]),
    "user_session": ("orders", [
        ("session_id", _pair("{sha}CAST(o_orderkey AS VARCHAR(20)){/sha}")),
        ("user_id", _CUSTOMER_MAIL),
        ("created_at", "o_orderdate"),
        ("expires_at", "o_orderdate + INTERVAL '8' HOUR"),
        ("revoked_at", "CASE WHEN o_orderstatus = 'F' THEN o_orderdate + "
                       "INTERVAL '1' HOUR END"),
    ]),
    "invite": ("orders", [
        ("token", _pair(_ORDER_TOKEN)),
        ("company_id", _COMPANY_OF_CUSTOMER),
        ("email", _ORDER_MAIL),
        ("role", _ORDER_ROLE),
        ("invited_by", "concat('founder@nation', c_nationkey, '.test')"),
        ("created_at", "o_orderdate"),
        ("expires_at", "o_orderdate + INTERVAL '7' DAY"),
        ("accepted_at", "CASE WHEN o_orderstatus = 'F' THEN o_orderdate + "
                        "INTERVAL '1' DAY END"),
        ("revoked_at", "CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN "
                       "o_orderdate + INTERVAL '2' DAY END"),
    ]),
    "user_login_log": ("events", [
        ("log_id", "event_id"),
        ("user_id", _CUSTOMER_MAIL),
        ("event", f"split_part('{_EVENT_NAMES}', ',', CAST(event_id % 17 + 1 AS INT))"),
        ("detail", "CASE event_id % 4 WHEN 0 THEN concat('role=member by=x by=', "
                   "'ops', event_id % 5, '@nation', c_nationkey, '.test') "
                   "WHEN 1 THEN concat('company=C', lpad(CAST(event_id % 25 + 1 AS "
                   "VARCHAR(9)), 4, '0'), ' role=admin') WHEN 2 THEN 'super' END"),
        ("at", "ts"),
    ]),
    "attempts": ("events", [
        ("attempt_id", "event_id"),
        ("user_id", "CASE WHEN user_id % 15 = 14 THEN concat('ghost', user_id) ELSE "
                    + _CUSTOMER_MAIL + " END"),
        ("at", _ATTEMPT_AT),
        ("password_ok", "event_type IN ('purchase', 'signup')"),
    ]),
    "evidence": ("documents", [
        ("evidence_id", "concat('E', doc_id)"),
        ("company_id", "CASE WHEN doc_id % 17 <> 0 THEN concat('C', lpad(CAST("
                       "doc_id % 25 + 1 AS VARCHAR(9)), 4, '0')) END"),
        ("uploaded_by", "CASE WHEN doc_id % 17 <> 0 THEN concat('uploader', doc_id % 10, "
                        "'@nation', doc_id % 25, '.test') END"),
    ]),
    "evidence_result": ("labels", [
        ("evidence_id", "concat('E', doc_id)"),
        ("quality", "quality"),
        ("toxic", "toxic"),
    ]),
    "access_event": ("events_only", [
        ("id", "event_id"),
        ("occurred_at", "ts"),
        ("actor", "concat('actor', user_id)"),
        ("role", "split_part('super,admin,reviewer,member', ',', "
                 "CAST(user_id % 4 + 1 AS INT))"),
        ("action", "split_part('VIEW_ORIGINAL,DOWNLOAD_ORIGINAL,REVIEW,EXPORT', ',', "
                   "CAST(event_id % 4 + 1 AS INT))"),
        # every document about nine times, and as many that were never stored
        ("evidence_id", ("concat('E', event_id DIV 9 + event_id % 11 DIV 10)",
                         "concat('E', event_id // 9 + event_id % 11 // 10)")),
        ("evidence_version", "CAST(event_id % 3 AS INT)"),
        ("outcome", "CASE WHEN event_id % 29 <> 0 THEN split_part("
                    "'STARTED,SUCCEEDED,FAILED,DENIED', ',', "
                    "CAST(event_id % 4 + 1 AS INT)) END"),
    ]),
    # --- staged requests, one per event ---------------------------------------
    "company_signups": ("events", [
        *_REQUEST,
        ("company", "CASE WHEN event_id % 23 = 0 THEN '  ' ELSE "
                    "concat(' Org ', user_id * 7 + event_id % 11, ' ') END"),
        ("name", "CASE WHEN event_id % 19 = 0 THEN '' ELSE concat('Founder ', event_id) END"),
        ("email", "CASE event_id % 13 WHEN 0 THEN 'not-a-mail' "
                  "WHEN 1 THEN concat('some', event_id, '@gmail.com') "
                  f"WHEN 2 THEN {_CUSTOMER_MAIL} "
                  "WHEN 3 THEN concat('new', event_id, '@nation', c_nationkey, '.test') "
                  "ELSE concat('  Boss', event_id % 3, '@ORG', user_id * 7 + event_id % 11, "
                  "'.test ') END"),
        ("password", _PASSWORD),
        ("password_hash", "concat('staged-', event_id)"),
    ]),
    "account_signups": ("events", [
        *_REQUEST,
        ("user_id", "CASE event_id % 11 WHEN 0 THEN '9lead' "
                    f"WHEN 1 THEN {_CUSTOMER_MAIL} "
                    "ELSE concat(' acct', user_id, '_', event_id % 40, ' ') END"),
        ("display_name", "CASE event_id % 17 WHEN 0 THEN '  ' WHEN 1 THEN "
                         "repeat('n', 101) ELSE concat('Name ', event_id) END"),
        ("role", "CASE event_id % 9 WHEN 0 THEN 'admin' WHEN 1 THEN 'APPROVER' "
                 "ELSE 'REVIEWER' END"),
        ("password", _PASSWORD),
        ("password_hash", "concat('staged-', event_id)"),
    ]),
    "account_status_requests": ("events", [
        *_TWICE,
        ("user_id", f"CASE WHEN user_id % 15 = 14 THEN 'nobody' ELSE {_CUSTOMER_MAIL} END"),
        ("status", "CASE WHEN event_id % 47 = 0 THEN 'active' WHEN event_id % 53 = 0 THEN NULL "
                   "WHEN event_type IN ('error', 'view') THEN 'DISABLED' ELSE 'ACTIVE' END"),
    ]),
    "account_role_requests": ("events", [
        *_REQUEST,
        ("user_id", f"CASE WHEN user_id % 15 = 14 THEN 'nobody' ELSE {_CUSTOMER_MAIL} END"),
        ("role", "CASE event_id % 3 WHEN 0 THEN 'REVIEWER' WHEN 1 THEN 'APPROVER' "
                 "ELSE 'admin' END"),
    ]),
    "company_status_requests": ("events", [
        *_REQUEST,
        ("company_id", "CASE WHEN event_id % 41 = 0 THEN 'C9999' ELSE concat('C', lpad("
                       "CAST(event_id % 20 + 1 AS VARCHAR(9)), 4, '0')) END"),
        ("status", "CASE event_id % 5 WHEN 0 THEN 'suspended' WHEN 1 THEN 'PENDING' "
                   "ELSE 'Active' END"),
    ]),
    # changes among the log-in attempts of the same days
    "company_changes": ("events", [
        ("request_id", "event_id"), ("request_ts", _ATTEMPT_AT), ("actor", "'ops'"),
        ("company_id", "CASE WHEN event_id % 41 = 0 THEN 'C9999' ELSE concat('C', lpad("
                       "CAST(event_id % 23 + 1 AS VARCHAR(9)), 4, '0')) END"),
        ("status", "CASE event_id % 4 WHEN 0 THEN 'suspended' WHEN 1 THEN 'PENDING' "
                   "ELSE 'Active' END"),
    ]),
    "invite_requests": ("events", [
        *_REQUEST,
        ("company_id", f"CASE WHEN event_id % 37 = 0 THEN 'C9999' ELSE {_COMPANY_OF_CUSTOMER}"
                       " END"),
        ("email", "CASE event_id % 12 WHEN 0 THEN 'broken@' "
                  "WHEN 1 THEN concat('guest', user_id, '@elsewhere.test') "
                  f"WHEN 2 THEN {_CUSTOMER_MAIL} "
                  "ELSE concat(' Guest', user_id, '@Nation', c_nationkey, '.test') END"),
        ("role", "CASE event_id % 10 WHEN 0 THEN 'owner' WHEN 1 THEN 'admin' ELSE 'member' "
                 "END"),
        ("token", _pair("substr({sha}concat('fresh-', event_id){/sha}, 1, 43)")),
    ]),
    "invite_token_requests": ("events_invites", [
        ("request_id", "event_id"),
        ("request_ts", _NEAR_INVITE),
        ("actor", "concat('ops', event_id % 3, '@nation', c_nationkey, '.test')"),
        ("company_id", f"CASE WHEN event_id % 7 = 0 THEN 'C9999' ELSE {_COMPANY_OF_CUSTOMER}"
                       " END"),
        ("token", _pair(_EVENT_TOKEN)),
    ]),
    "invite_accepts": ("events_invites", [
        ("request_id", "event_id"),
        ("request_ts", _NEAR_INVITE),
        ("actor", "CAST(NULL AS VARCHAR(50))"),
        ("token", _pair(_EVENT_TOKEN)),
        ("name", "CASE WHEN event_id % 6 = 0 THEN ' ' ELSE concat(' Guest ', event_id) END"),
        ("password", _PASSWORD),
        ("password_hash", "concat('staged-', event_id)"),
    ]),
    "member_requests": ("events", [
        *_TWICE,
        ("company_id", _COMPANY_OF_CUSTOMER),
        ("email", "CASE WHEN event_id % 43 = 0 THEN 'broken' WHEN event_id % 44 = 0 THEN "
                  "concat('stranger@nation', c_nationkey, '.test') ELSE "
                  f"{_CUSTOMER_MAIL} END"),
        ("op", "CASE WHEN event_id % 47 = 0 THEN 'promote' WHEN event_id % 53 = 0 THEN NULL ELSE "
               "split_part('role,remove,active', ',', CAST(event_id % 3 + 1 AS INT)) END"),
        ("role", "CASE WHEN event_id % 3 = 0 THEN split_part('admin,reviewer,member,owner', "
                 "',', CAST(event_id % 4 + 1 AS INT)) END"),
        ("active", "CASE WHEN event_id % 3 = 2 THEN event_id % 2 = 0 END"),
    ]),
    "first_operator_requests": ("events", [
        ("request_id", "event_id"),
        ("request_ts", "ts"),
        ("email", "CASE WHEN event_id % 4 = 0 THEN 'operator' ELSE concat('Operator', "
                  "event_id, '@service.test') END"),
        ("name", "concat('Operator ', event_id)"),
        ("password", _PASSWORD),
        ("password_hash", "concat('staged-', event_id)"),
    ]),
    "logouts": ("events", [
        *_TWICE,
        # known, repeated (every tenth with the one before it) and unknown tokens
        ("token", "CASE WHEN event_id % 17 = 0 THEN concat('unknown-', event_id) ELSE CAST("
                  "event_id - CASE WHEN event_id % 10 = 9 THEN 1 ELSE 0 END AS VARCHAR(20)) "
                  "END"),
    ]),
    "password_changes": ("events", [
        *_REQUEST,
        ("user_id", f"CASE WHEN user_id % 15 = 14 THEN 'nobody' ELSE {_CUSTOMER_MAIL} END"),
        ("new_password", _PASSWORD),
        ("new_hash", "concat('staged-', event_id)"),
        ("old_ok", "event_type <> 'error'"),
        ("same_as_old", "event_type = 'view'"),
    ]),
}


def sql_text(name: str, side: int = DUCK) -> str:
    """`SELECT ... FROM ...` that derives one table."""
    base, columns = TABLES[name]
    table, joins = BASES[base]
    picked = ", ".join(f"{e if isinstance(e, str) else e[side]} AS {c}" for c, e in columns)
    joined = "".join(f" JOIN {other} ON {on}" for other, on in joins)
    return f"SELECT {picked} FROM {table}{joined}"


class Adapters:
    """Derived tables over one folder of the given parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        base, columns = TABLES[name]
        table, joins = BASES[base]
        df = self.given(table)
        for other, on in joins:
            df = df.join(self.given(other), F.expr(on))
        return df.selectExpr(*[
            f"{e if isinstance(e, str) else e[SPARK]} AS {c}" for c, e in columns])
