"""SQL for the batches of state changes and the login attempts."""

from __future__ import annotations

from tenantlake.verification.oracle import (
    _ASKED, ACCOUNT_ERROR, PUBLIC, email_bad, oracle, password_flaw)

_BY = "concat('by=', actor)"


def _once(table: str, *columns: str) -> str:
    """The earliest of the rows with one request_id."""
    order = ", ".join(f"{c} NULLS FIRST" for c in ("request_ts", *columns))
    return (f"(SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY request_id "
            f"ORDER BY {order}) = 1)")



def outcome(prefix: str, tables: str, extra: str, **bodies: str) -> None:
    for suffix, body in bodies.items():
        oracle(f"{prefix}_{suffix}", tables, body, extra)


def _log(user: str, event: str, detail: str = "CAST(NULL AS VARCHAR)", source: str = "ok",
         seq: int = 0) -> str:
    return (f"SELECT request_id, {seq} AS seq, {user} AS user_id, {event} AS event, {detail} "
            f"AS detail, request_ts AS \"at\" FROM {source}")


def _weak(p: str, who: str) -> str:
    return f"(({password_flaw(p, who)}) IS NOT NULL)"


_NEW_USER = (
    "SELECT {user_id}, {name}, password_hash, {role}, {is_admin}, {is_super}, '{status}', 0, "
    "NULL, request_ts, {approved_at}, NULL, request_ts, NULL, {email}, {company}, {verified} "
    "FROM ok")

# --- M1 -------------------------------------------------------------------------------
_M1 = _ASKED + (
    ", staged AS (SELECT s.request_id, s.request_ts, a.email, trim(s.name) AS name, "
    "trim(s.company) AS company, s.password_hash, s.password, split_part(a.email, '@', -1) AS "
    "domain FROM company_signups s JOIN asked a USING (request_id)), checked AS (SELECT *, "
    f"CASE WHEN {email_bad('email')} THEN 'INVALID_EMAIL' WHEN domain {PUBLIC} THEN "
    "'PUBLIC_EMAIL' WHEN name = '' THEN 'NAME_REQUIRED' WHEN company = '' THEN "
    f"'COMPANY_REQUIRED' WHEN {_weak('password', 'split_part(email, chr(64), 1)')} THEN "
    "'WEAK_PASSWORD' WHEN email IN (SELECT email FROM app_user WHERE email IS NOT NULL UNION "
    "SELECT user_id FROM app_user) THEN 'USER_EXISTS' WHEN domain IN (SELECT domain FROM "
    "company) THEN 'COMPANY_EXISTS' END AS code FROM staged), ranked AS (SELECT *, row_number() "
    "OVER (PARTITION BY domain, code IS NULL ORDER BY request_ts, request_id) AS r, "
    "first_value(email) OVER (PARTITION BY domain, code IS NULL ORDER BY request_ts, "
    "request_id) AS first_mail FROM checked), judged AS (SELECT *, CASE WHEN code IS NOT NULL "
    "THEN code WHEN r = 1 THEN NULL WHEN email = first_mail THEN 'USER_EXISTS' ELSE "
    "'COMPANY_EXISTS' END AS error_code FROM ranked), ok AS (SELECT *, concat('C', lpad(CAST("
    "(SELECT count(*) FROM company) + row_number() OVER (ORDER BY request_ts, request_id) AS "
    "VARCHAR), 4, '0')) AS company_id FROM judged WHERE error_code IS NULL)")
outcome("m1_company_signup", "company app_user company_signups", _M1,
        verdicts="SELECT request_id, request_ts, email, name, company, domain, error_code FROM "
                 "judged",
        log_rows=_log("email", "'SIGNUP'", "concat('company=', company_id, ' role=admin')"),
        companies="SELECT * FROM company UNION ALL SELECT company_id, company, domain, "
                  "'ACTIVE', request_ts, email FROM ok",
        users="SELECT * FROM app_user UNION ALL " + _NEW_USER.format(
            user_id="email", name="name", role="'admin'", is_admin="true", is_super="false",
            status="ACTIVE", approved_at="request_ts", email="email", company="company_id",
            verified="true"))

# --- M2 -------------------------------------------------------------------------------
_M2 = (
    "checked AS (SELECT request_id, request_ts, trim(user_id) AS user_id, trim(display_name) "
    f"AS display_name, role, password_hash, CASE WHEN ({ACCOUNT_ERROR}) IS NOT NULL THEN "
    f"({ACCOUNT_ERROR}) WHEN {_weak('password', 'trim(user_id)')} THEN 'WEAK_PASSWORD' WHEN "
    "trim(user_id) IN (SELECT user_id FROM app_user) THEN 'USER_EXISTS' END AS code FROM "
    "account_signups), judged AS (SELECT *, CASE WHEN code IS NULL AND row_number() OVER "
    "(PARTITION BY user_id, code IS NULL ORDER BY request_ts, request_id) > 1 THEN "
    "'USER_EXISTS' ELSE code END AS error_code FROM checked), ok AS (SELECT * FROM judged "
    "WHERE error_code IS NULL)")
outcome("m2_account_signup", "app_user account_signups", _M2,
        verdicts="SELECT request_id, request_ts, user_id, display_name, role, error_code FROM "
                 "judged",
        log_rows=_log("user_id", "'SIGNUP'", "concat('role=', role, ' status=PENDING')"),
        users="SELECT * FROM app_user UNION ALL " + _NEW_USER.format(
            user_id="user_id", name="display_name", role="role", is_admin="false",
            is_super="false", status="PENDING", approved_at="NULL", email="NULL",
            company="NULL", verified="false"))

# --- M3, M4 -----------------------------------------------------------------------------
_M3 = (
    "judged AS (SELECT request_id, request_ts, actor, user_id, status, CASE WHEN coalesce("
    "status, '') NOT IN ('ACTIVE', 'DISABLED') THEN 'INVALID_STATUS' WHEN user_id NOT IN ("
    "SELECT user_id FROM app_user) THEN 'USER_NOT_FOUND' END AS error_code FROM "
    + _once("account_status_requests", "actor", "user_id", "status") + " AS q), ok AS (SELECT * FROM judged WHERE error_code IS NULL), final AS "
    "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY request_ts DESC, request_id "
    "DESC) AS r FROM ok), stopped AS (SELECT user_id, min(request_ts) AS t FROM ok WHERE "
    "status = 'DISABLED' GROUP BY user_id)")
_ENDED = ("SELECT s.session_id, s.user_id, s.created_at, s.expires_at, coalesce(s.revoked_at, "
          "x.t) AS revoked_at FROM user_session s LEFT JOIN {x} x ON x.user_id = s.user_id")
outcome("m3_account_status", "app_user user_session account_status_requests", _M3,
        verdicts="SELECT * FROM judged",
        log_rows=_log("user_id", "CASE WHEN status = 'ACTIVE' THEN 'ACTIVATE' ELSE 'DISABLE' "
                      "END", _BY),
        users="SELECT u.* REPLACE (coalesce(f.status, u.status) AS status, coalesce("
              "f.request_ts, u.approved_at) AS approved_at, coalesce(f.actor, u.approved_by) "
              "AS approved_by) FROM app_user u LEFT JOIN (SELECT user_id, status, request_ts, "
              "actor FROM final WHERE r = 1) f ON f.user_id = u.user_id",
        sessions=_ENDED.format(x="stopped"))
_M4 = (
    "judged AS (SELECT request_id, request_ts, actor, user_id, role, CASE WHEN role NOT IN "
    "('REVIEWER', 'APPROVER') THEN 'INVALID_ROLE' WHEN user_id NOT IN (SELECT user_id FROM "
    "app_user) THEN 'USER_NOT_FOUND' END AS error_code FROM account_role_requests), ok AS "
    "(SELECT * FROM judged WHERE error_code IS NULL), final AS (SELECT user_id, arg_max(role, "
    "row(request_ts, request_id)) AS role FROM ok GROUP BY user_id)")
outcome("m4_account_role", "app_user account_role_requests", _M4,
        verdicts="SELECT * FROM judged",
        log_rows=_log("user_id", "'ACTIVATE'", f"concat('role=', role, ' ', {_BY})"),
        users="SELECT u.* REPLACE (coalesce(f.role, u.role) AS role) FROM app_user u LEFT JOIN "
              "final f ON f.user_id = u.user_id")
oracle("c3_append_log", "app_user user_login_log account_role_requests",
       "SELECT log_id, user_id, event, detail, \"at\" FROM user_login_log UNION ALL SELECT "
       "(SELECT max(log_id) FROM user_login_log) + row_number() OVER (ORDER BY request_ts, "
       f"request_id), user_id, 'ACTIVATE', concat('role=', role, ' ', {_BY}), request_ts FROM "
       "ok", _M4)

# --- M5 -------------------------------------------------------------------------------
_M5 = (
    "judged AS (SELECT request_id, request_ts, actor, company_id, upper(status) AS status, "
    "CASE WHEN upper(status) NOT IN ('ACTIVE', 'SUSPENDED') THEN 'INVALID_STATUS' WHEN "
    "company_id NOT IN (SELECT company_id FROM company) THEN 'COMPANY_NOT_FOUND' END AS "
    "error_code FROM company_status_requests), ok AS (SELECT * FROM judged WHERE error_code "
    "IS NULL), final AS (SELECT company_id, arg_max(status, row(request_ts, request_id)) AS "
    "status FROM ok GROUP BY company_id), closed AS (SELECT u.user_id, min(o.request_ts) AS t "
    "FROM ok o JOIN app_user u ON u.company_id = o.company_id WHERE o.status = 'SUSPENDED' "
    "GROUP BY u.user_id)")
outcome("m5_company_status", "company app_user user_session company_status_requests", _M5,
        verdicts="SELECT * FROM judged",
        log_rows=_log("actor", "concat('COMPANY_', status)", "company_id"),
        companies="SELECT c.* REPLACE (coalesce(f.status, c.status) AS status) FROM company c "
                  "LEFT JOIN final f ON f.company_id = c.company_id",
        sessions=_ENDED.format(x="closed"))

# --- M10 ------------------------------------------------------------------------------
_M10 = (
    "staged AS (SELECT request_id, request_ts, actor, company_id, lower(trim(email)) AS email, "
    "role, token FROM invite_requests), judged AS (SELECT s.*, CASE WHEN role NOT IN ('admin', "
    f"'reviewer', 'member') THEN 'INVALID_ROLE' WHEN {email_bad('email')} THEN 'INVALID_EMAIL' "
    "WHEN c.company_id IS NULL THEN 'COMPANY_NOT_FOUND' WHEN split_part(email, '@', 2) <> "
    "c.domain THEN 'DOMAIN_MISMATCH' WHEN email IN (SELECT email FROM app_user WHERE email IS "
    "NOT NULL) THEN 'USER_EXISTS' END AS error_code FROM staged s LEFT JOIN (SELECT "
    "company_id, domain FROM company) c ON c.company_id = s.company_id), ok AS (SELECT *, "
    "lead(request_ts) OVER (PARTITION BY email ORDER BY request_ts, request_id) AS "
    "next_ts FROM judged WHERE error_code IS NULL)")
outcome("m10_send_invites", "company app_user invite invite_requests", _M10,
        verdicts="SELECT * FROM judged",
        log_rows=_log("actor", "'INVITE'", "concat(email, ' role=', role)"),
        invites="SELECT i.* REPLACE (CASE WHEN i.accepted_at IS NULL THEN coalesce("
                "i.revoked_at, n.t) ELSE i.revoked_at END AS revoked_at) FROM invite i LEFT JOIN "
                "(SELECT email AS m, min(request_ts) AS t FROM ok GROUP BY email) n ON n.m = "
                "i.email UNION ALL SELECT token, company_id, email, role, actor, request_ts, "
                "request_ts + INTERVAL '7' DAY, NULL, next_ts FROM ok")

# --- M11, M12 ---------------------------------------------------------------------------
_FITS = (
    "fits AS (SELECT r.*, coalesce(i.company_id = r.company_id AND i.accepted_at IS NULL AND "
    "i.revoked_at IS NULL, false) AS fit FROM invite_token_requests r LEFT JOIN invite i ON "
    "i.token = r.token)")
_M11 = _FITS + (
    ", judged AS (SELECT request_id, request_ts, actor, company_id, token, CASE WHEN fit AND "
    "row_number() OVER (PARTITION BY token, fit ORDER BY request_ts, request_id) = 1 THEN NULL "
    "ELSE 'INVITE_NOT_FOUND' END AS error_code FROM fits), ok AS (SELECT * FROM judged WHERE "
    "error_code IS NULL)")
outcome("m11_revoke_invites", "invite invite_token_requests", _M11,
        verdicts="SELECT * FROM judged",
        log_rows=_log("actor", "'INVITE_REVOKE'", "substr(token, 1, 12)"),
        invites="SELECT i.* REPLACE (coalesce(i.revoked_at, o.request_ts) AS revoked_at) FROM "
                "invite i LEFT JOIN (SELECT token AS k, request_ts FROM ok) o ON o.k = i.token")
_M12 = _FITS + (
    ", judged AS (SELECT request_id, request_ts, actor, company_id, token, CASE WHEN fit THEN "
    "NULL ELSE 'INVITE_NOT_FOUND' END AS error_code, CASE WHEN fit THEN request_ts + INTERVAL "
    "'7' DAY END AS expires_at FROM fits), ok AS (SELECT * FROM judged WHERE error_code IS "
    "NULL)")
outcome("m12_extend_invites", "invite invite_token_requests", _M12,
        verdicts="SELECT * FROM judged",
        log_rows=_log("actor", "'INVITE_RESEND'", "substr(token, 1, 12)"),
        invites="SELECT i.* REPLACE (coalesce(o.t, i.expires_at) AS expires_at) FROM invite i "
                "LEFT JOIN (SELECT token AS k, max(expires_at) AS t FROM ok GROUP BY token) o "
                "ON o.k = i.token")

# --- M13 ------------------------------------------------------------------------------
_M13 = (
    "found AS (SELECT a.request_id, a.request_ts, a.token, trim(a.name) AS name, a.password, "
    "a.password_hash, i.email, i.role, c.company_id, CASE WHEN c.company_id IS NULL THEN "
    "'INVITE_NOT_FOUND' WHEN i.accepted_at IS NOT NULL THEN 'INVITE_USED' WHEN i.revoked_at IS "
    "NOT NULL THEN 'INVITE_REVOKED' WHEN i.expires_at <= a.request_ts THEN 'INVITE_EXPIRED' "
    "END AS link FROM invite_accepts a LEFT JOIN (invite i JOIN company c ON c.company_id = "
    "i.company_id) ON i.token = a.token), checked AS (SELECT *, CASE WHEN link IS NOT NULL "
    f"THEN link WHEN name = '' THEN 'NAME_REQUIRED' WHEN "
    f"{_weak('password', 'split_part(email, chr(64), 1)')} THEN 'WEAK_PASSWORD' WHEN email IN "
    "(SELECT email FROM app_user WHERE email IS NOT NULL UNION SELECT user_id FROM app_user) "
    "THEN 'USER_EXISTS' END AS code FROM found), winners AS (SELECT email AS w_mail, min(row("
    "request_ts, request_id, token)) AS w FROM checked WHERE code IS NULL GROUP BY email), "
    "judged AS (SELECT c.*, CASE WHEN w IS NOT NULL AND (request_ts > w[1] OR (request_ts = "
    "w[1] AND request_id > w[2])) THEN CASE WHEN token = w[3] THEN 'INVITE_USED' ELSE "
    "coalesce(code, 'USER_EXISTS') END ELSE code END AS error_code FROM checked c LEFT JOIN "
    "winners ON w_mail = email), ok AS (SELECT * FROM judged WHERE error_code IS NULL)")
outcome("m13_accept_invites", "company app_user invite invite_accepts", _M13,
        verdicts="SELECT request_id, request_ts, token, name, email, role, company_id, "
                 "error_code FROM judged",
        log_rows=_log("email", "'INVITE_ACCEPT'",
                      "concat('company=', company_id, ' role=', role)"),
        invites="SELECT i.* REPLACE (coalesce(i.accepted_at, o.request_ts) AS accepted_at) FROM "
                "invite i LEFT JOIN (SELECT token AS k, request_ts FROM ok) o ON o.k = i.token",
        users="SELECT * FROM app_user UNION ALL " + _NEW_USER.format(
            user_id="email", name="name", role="role", is_admin="role = 'admin'",
            is_super="false", status="ACTIVE", approved_at="request_ts", email="email",
            company="company_id", verified="true"))

# --- M14, M15, M16 ----------------------------------------------------------------------
_M14 = (
    "judged AS (SELECT q.request_id, q.request_ts, sha256(q.token) AS session_id, s.user_id, "
    "s.session_id IS NOT NULL AND s.revoked_at IS NULL AND row_number() OVER (PARTITION BY "
    "q.token ORDER BY q.request_ts, q.request_id) = 1 AS done, CAST(NULL AS VARCHAR) AS "
    "error_code FROM " + _once("logouts", "actor", "token") + " q LEFT JOIN user_session s ON s.session_id = sha256(q.token)), ok "
    "AS (SELECT * FROM judged WHERE done)")
outcome("m14_logout", "user_session logouts", _M14,
        verdicts="SELECT * FROM judged",
        log_rows=_log("user_id", "'LOGOUT'"),
        sessions="SELECT s.* REPLACE (coalesce(s.revoked_at, o.request_ts) AS revoked_at) FROM "
                 "user_session s LEFT JOIN (SELECT session_id AS k, request_ts FROM ok) o ON "
                 "o.k = s.session_id")
_M15 = (
    "judged AS (SELECT request_id, request_ts, user_id, new_hash, CASE WHEN "
    f"{_weak('new_password', 'user_id')} THEN 'WEAK_PASSWORD' WHEN user_id NOT IN (SELECT "
    "user_id FROM app_user) THEN 'USER_NOT_FOUND' WHEN NOT old_ok THEN 'LOGIN_FAILED' WHEN "
    "same_as_old THEN 'SAME_PASSWORD' END AS error_code FROM password_changes), ok AS (SELECT "
    "* FROM judged WHERE error_code IS NULL), final AS (SELECT user_id, arg_max(new_hash, "
    "row(request_ts, request_id)) AS h, max(request_ts) AS last, min(request_ts) AS t FROM ok "
    "GROUP BY user_id)")
outcome("m15_password_change", "app_user user_session password_changes", _M15,
        verdicts="SELECT request_id, request_ts, user_id, error_code FROM judged",
        log_rows=_log("user_id", "'PW_CHANGE'"),
        users="SELECT u.* REPLACE (coalesce(f.h, u.password_hash) AS password_hash, coalesce("
              "f.last, u.password_changed_at) AS password_changed_at) FROM app_user u LEFT JOIN "
              "final f ON f.user_id = u.user_id",
        sessions=_ENDED.format(x="final"))
oracle("m15_password_change_by_days", "app_user user_session password_changes",
       _ENDED.format(x="final"), _M15)
_GONE = "expires_at < TIMESTAMP '1998-01-01 08:00:00' OR revoked_at IS NOT NULL"
for _name in ("m16_purge_sessions", "m16_purge_by_days"):
    oracle(_name, "user_session", f"SELECT * FROM user_session WHERE NOT ({_GONE})")
oracle("m16_purged_count", "user_session",
       f"SELECT count(*) AS purged FROM user_session WHERE {_GONE}")

# --- M17, M18 ---------------------------------------------------------------------------
_M17 = (
    "people AS (SELECT * FROM app_user WHERE NOT is_super), checked AS (SELECT request_id, "
    "request_ts, lower(email) AS email, name, password_hash, "
    f"{email_bad('lower(email)')} AS bad, "
    f"{_weak('password', 'split_part(lower(email), chr(64), 1)')} AS weak FROM "
    "first_operator_requests), winner AS (SELECT min(row(request_ts, request_id)) AS w FROM "
    "checked WHERE NOT bad AND NOT weak), judged AS (SELECT request_id, request_ts, email, "
    "name, password_hash, CASE WHEN bad THEN 'INVALID_EMAIL' WHEN row(request_ts, request_id) "
    "> (SELECT w FROM winner) THEN 'ALREADY_INITIALIZED' WHEN weak THEN 'WEAK_PASSWORD' END AS "
    "error_code FROM checked), ok AS (SELECT * FROM judged WHERE error_code IS NULL)")
outcome("m17_first_operator", "app_user first_operator_requests", _M17,
        verdicts="SELECT request_id, request_ts, email, name, error_code FROM judged",
        log_rows=_log("email", "'SIGNUP'", "'super'"),
        users="SELECT * FROM people UNION ALL " + _NEW_USER.format(
            user_id="email", name="name", role="'admin'", is_admin="true", is_super="true",
            status="ACTIVE", approved_at="request_ts", email="email", company="NULL",
            verified="true"))
oracle("m17_first_admin_too_late", "account_signups",
       "SELECT request_id, request_ts, trim(user_id) AS user_id, trim(display_name) AS "
       "display_name, role, 'ALREADY_INITIALIZED' AS error_code FROM account_signups")
oracle("m18_next_company_numbers", "company company_signups",
       "SELECT request_id, CASE WHEN n < 10000 THEN concat('C', lpad(CAST(n AS VARCHAR), 4, "
       "'0')) ELSE concat('C', n) END AS company_id FROM (SELECT request_id, (SELECT count(*) "
       "FROM company) + row_number() OVER (ORDER BY request_ts, request_id) AS n FROM "
       "company_signups)")

# --- L: the lockout rules as a recursion over the attempts of each account ---------------
_LOCK = (
    "tries AS (SELECT a.attempt_id, a.user_id, a.\"at\" AS t, a.password_ok AS ok, u.status, "
    "coalesce(c.status = 'SUSPENDED', false) AS closed, row_number() OVER (PARTITION BY "
    "a.user_id ORDER BY a.\"at\", a.attempt_id) AS rn FROM attempts a LEFT JOIN app_user u ON "
    "u.user_id = a.user_id LEFT JOIN company c ON c.company_id = u.company_id), steps AS ("
    "SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS INT) AS failed, CAST(NULL AS "
    "TIMESTAMP) AS locked, CAST(NULL AS BIGINT) AS attempt_id, CAST(NULL AS TIMESTAMP) AS t, "
    "CAST(NULL AS VARCHAR) AS what, false AS closed FROM (SELECT DISTINCT user_id FROM tries) "
    "UNION ALL SELECT user_id, rn, CASE what WHEN 'wrong' THEN failed + 1 WHEN 'ok' THEN 0 "
    "ELSE failed END, CASE WHEN what = 'wrong' AND failed + 1 >= 5 THEN t + INTERVAL '10' "
    "MINUTE WHEN what = 'ok' THEN NULL ELSE locked END, attempt_id, t, what, closed FROM ("
    "SELECT s.user_id, s.rn, f.failed, f.locked, s.attempt_id, s.t, s.closed, CASE WHEN "
    "s.status IS NULL THEN 'stranger' WHEN f.locked > s.t THEN 'locked' WHEN NOT s.ok THEN "
    "'wrong' WHEN s.status = 'PENDING' THEN 'pending' WHEN s.status <> 'ACTIVE' THEN "
    "'disabled' ELSE 'ok' END AS what FROM steps f JOIN tries s ON s.user_id = f.user_id AND "
    "s.rn = f.rn + 1)), folded AS (SELECT attempt_id, user_id, t AS \"at\", CASE WHEN what = "
    "'ok' THEN 'LOGIN_OK' WHEN what = 'wrong' AND failed >= 5 THEN 'LOCKED' ELSE 'LOGIN_FAIL' "
    "END AS event, CASE what WHEN 'stranger' THEN 'no such user' WHEN 'wrong' THEN concat("
    "'failed=', failed) WHEN 'ok' THEN NULL ELSE what END AS detail, CASE what WHEN 'locked' "
    "THEN 'ACCOUNT_LOCKED' WHEN 'pending' THEN 'ACCOUNT_PENDING' WHEN 'disabled' THEN "
    "'ACCOUNT_DISABLED' WHEN 'ok' THEN CASE WHEN closed AND {gated} THEN 'COMPANY_SUSPENDED' "
    "END ELSE 'LOGIN_FAILED' END AS error_code, CASE WHEN what = 'locked' THEN CAST(date_diff("
    "'microsecond', t, locked) // 60000000 + 1 AS BIGINT) END AS minutes_left, failed, locked, "
    "rn FROM steps WHERE rn > 0)")


def _lock(name: str, body: str, gated: bool = False) -> None:
    oracle(name, "attempts app_user company", body,
           _LOCK.replace("{gated}", "true" if gated else "false"), recursive=True)


_VERDICTS = ("SELECT attempt_id, user_id, \"at\", event, detail, error_code, minutes_left FROM "
             "folded")
_SESSIONS = (
    "SELECT sha256(concat('login-', attempt_id)) AS session_id, user_id, \"at\" AS created_at, "
    "\"at\" + INTERVAL '8' HOUR AS expires_at, CASE WHEN error_code = 'COMPANY_SUSPENDED' THEN "
    "\"at\" END AS revoked_at FROM folded WHERE event = 'LOGIN_OK'")
_LOGGED = (
    "SELECT attempt_id AS request_id, 0 AS seq, user_id, event, detail, \"at\" FROM folded UNION "
    "ALL SELECT attempt_id, 1, user_id, 'LOGOUT', NULL, \"at\" FROM folded WHERE error_code = "
    "'COMPANY_SUSPENDED'")
_lock("l1_l4_login_verdicts", _VERDICTS)
_lock("l1_sliced_hot_accounts", _VERDICTS)
_lock("l1_login_log_rows", _LOGGED)
_lock("l2_login_sessions", _SESSIONS)
_lock("l2_login_accounts",
      "SELECT u.* REPLACE (coalesce(f.failed, u.failed_count) AS failed_count, f.locked AS "
      "locked_until, coalesce(g.t, u.last_login_at) AS last_login_at) FROM app_user u LEFT JOIN "
      "(SELECT user_id AS k, failed, locked FROM (SELECT *, row_number() OVER (PARTITION BY "
      "user_id ORDER BY rn DESC) AS r FROM folded) WHERE r = 1) f ON f.k = u.user_id LEFT "
      "JOIN (SELECT user_id AS "
      "k, max(\"at\") AS t FROM folded WHERE event = 'LOGIN_OK' GROUP BY user_id) g ON g.k = "
      "u.user_id")
_lock("l3_company_gate_verdicts", _VERDICTS, gated=True)
_lock("l3_company_gate_sessions", _SESSIONS, gated=True)
_lock("l3_company_gate_log_rows", _LOGGED, gated=True)
_OVER_TIME = (
    ", facts AS (SELECT company_id, TIMESTAMP '1900-01-01' AS t, status FROM company UNION ALL "
    "SELECT company_id, request_ts, arg_max(upper(status), request_id) FROM company_changes WHERE "
    "upper(status) IN ('ACTIVE', 'SUSPENDED') AND company_id IN (SELECT company_id FROM company) "
    "GROUP BY company_id, request_ts), ends AS (SELECT company_id, request_ts AS t FROM "
    "company_changes WHERE upper(status) = 'SUSPENDED'), placed AS (SELECT f.*, u.company_id AS "
    "firm FROM folded f LEFT JOIN app_user u ON u.user_id = f.user_id), seen AS (SELECT p.*, "
    "p.event = 'LOGIN_OK' AND coalesce(x.status = 'SUSPENDED', false) AS shut FROM placed p ASOF "
    "LEFT JOIN facts x ON x.company_id = p.firm AND p.\"at\" >= x.t), timed AS (SELECT s.*, e.t "
    "AS next_end FROM seen s ASOF LEFT JOIN ends e ON e.company_id = s.firm AND s.\"at\" < e.t)")
for _suffix, _body in (
        ("verdicts", "SELECT attempt_id, user_id, \"at\", event, detail, CASE WHEN shut THEN "
                     "'COMPANY_SUSPENDED' ELSE error_code END AS error_code, minutes_left FROM "
                     "timed"),
        ("sessions", "SELECT sha256(concat('login-', attempt_id)) AS session_id, user_id, \"at\" "
                     "AS created_at, \"at\" + INTERVAL '8' HOUR AS expires_at, CASE WHEN shut "
                     "THEN \"at\" ELSE next_end END AS revoked_at FROM timed WHERE event = "
                     "'LOGIN_OK'")):
    oracle(f"l3_company_status_over_time_{_suffix}", "attempts app_user company company_changes",
           _body, (_LOCK + _OVER_TIME).replace("{gated}", "false"), recursive=True)
_lock("l5_stream_verdicts", _VERDICTS)
_lock("l6_stream_log_rows", _LOGGED)
_lock("l6_merged_log",
      "SELECT row_number() OVER (ORDER BY \"at\", request_id, seq) AS log_id, user_id, event, "
      f"substring(detail, 1, 200) AS detail, \"at\" FROM ({_LOGGED})")

# --- M6 to M9: one request after another per company, as a recursion ----------------------
_TAKES = ("(op = 'remove' OR (op = 'role' AND role <> 'admin') OR (op = 'active' AND NOT "
          "active))")
_M6 = (
    "asked AS (SELECT request_id, request_ts, actor, company_id, lower(trim(email)) AS email, "
    "op, role, active FROM " + _once("member_requests", "actor", "company_id", "email", "op",
                                     "role", "active") + " AS q), early AS (SELECT a.*, "
    "u.user_id, CASE WHEN coalesce(op, '') NOT IN ('role', 'remove', 'active') THEN "
    "'INVALID_OP' WHEN op = 'role' AND a.role NOT IN ('admin', 'reviewer', 'member') THEN 'INVALID_ROLE' WHEN "
    f"{email_bad('a.email')} THEN 'INVALID_EMAIL' WHEN u.user_id IS NULL THEN "
    "'MEMBER_NOT_FOUND' END AS code FROM asked a LEFT JOIN (SELECT user_id, email, company_id "
    "FROM app_user) u ON u.email = a.email AND u.company_id = a.company_id), valid AS (SELECT "
    "*, row_number() OVER (PARTITION BY company_id ORDER BY request_ts, request_id) AS rn FROM "
    "early WHERE code IS NULL), steps AS (SELECT company_id, CAST(0 AS BIGINT) AS rn, coalesce("
    "list(email) FILTER (WHERE role = 'admin'), []) AS admins, coalesce(list(email) FILTER ("
    "WHERE status = 'ACTIVE'), []) AS enabled, CAST(NULL AS BIGINT) AS request_id, true AS kept "
    "FROM app_user WHERE email IS NOT NULL AND company_id IS NOT NULL GROUP BY company_id UNION "
    "ALL SELECT company_id, rn, CASE WHEN NOT kept OR op <> 'role' THEN admins WHEN role = "
    "'admin' THEN list_distinct(list_append(admins, email)) ELSE list_filter(admins, lambda x: "
    "x <> email) END, CASE WHEN NOT kept OR op = 'role' THEN enabled WHEN op = 'active' AND "
    "active THEN list_distinct(list_append(enabled, email)) ELSE list_filter(enabled, lambda x: "
    "x <> email) END, request_id, kept FROM (SELECT v.company_id, v.rn, s.admins, s.enabled, "
    "v.request_id, v.email, v.op, v.role, v.active, NOT (list_contains(s.admins, v.email) AND "
    f"{_TAKES.replace('op', 'v.op').replace('role ', 'v.role ').replace('active)', 'v.active)')}"
    " AND len(list_filter(s.admins, lambda x: x <> v.email AND list_contains(s.enabled, x))) = "
    "0) AS kept FROM steps s JOIN valid v ON v.company_id = s.company_id AND v.rn = s.rn + 1)), "
    "judged AS (SELECT e.request_id, e.request_ts, e.actor, e.company_id, e.email, e.op, e.role, "
    "e.active, e.user_id, CASE WHEN e.code IS NOT NULL THEN e.code WHEN NOT s.kept THEN "
    "'LAST_ADMIN' END AS error_code FROM early e LEFT JOIN (SELECT request_id AS k, kept FROM "
    "steps WHERE rn > 0) s ON s.k = e.request_id), ok AS (SELECT *, op = 'active' AND active AS "
    "turned_on FROM judged WHERE error_code IS NULL), roles AS (SELECT user_id, arg_max(role, "
    "row(request_ts, request_id)) AS role FROM ok WHERE op = 'role' GROUP BY user_id), states "
    "AS (SELECT user_id, arg_max(coalesce(turned_on, false), row(request_ts, request_id)) AS o, "
    "min(request_ts) FILTER (WHERE NOT coalesce(turned_on, false)) AS t FROM ok WHERE op <> "
    "'role' GROUP BY user_id)")
for _suffix, _body in (
        ("verdicts", "SELECT * FROM judged"),
        ("log_rows", _log(
            "email", "CASE WHEN op = 'role' THEN 'ROLE_CHANGE' WHEN op = 'remove' THEN "
            "'MEMBER_REMOVE' WHEN turned_on THEN 'ACTIVATE' ELSE 'DISABLE' END",
            f"CASE WHEN op = 'role' THEN concat(role, ' ', {_BY}) ELSE {_BY} END")),
        ("users", "SELECT u.* REPLACE (coalesce(r.role, u.role) AS role, CASE WHEN r.role IS "
                  "NULL THEN u.is_admin ELSE r.role = 'admin' END AS is_admin, CASE WHEN s.o IS "
                  "NULL THEN u.status WHEN s.o THEN 'ACTIVE' ELSE 'DISABLED' END AS status) FROM "
                  "app_user u LEFT JOIN roles r ON r.user_id = u.user_id LEFT JOIN states s ON "
                  "s.user_id = u.user_id"),
        ("sessions", _ENDED.format(x="states"))):
    oracle(f"m6_m9_member_changes_{_suffix}", "app_user user_session member_requests", _body,
           _M6, recursive=True)
oracle("l3_refused_company_attempts", "attempts",
       "SELECT attempt_id, lower(trim(user_id)) AS user_id, \"at\", password_ok, "
       f"'INVALID_EMAIL' AS error_code FROM attempts WHERE {email_bad('lower(trim(user_id))')}")
