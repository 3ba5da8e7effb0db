"""SQL that computes the same answers as the registered queries, for DuckDB."""

from __future__ import annotations

from tenantlake import config
from tenantlake.sources.adapters import sql_text

ORACLES: dict[str, str] = {}

COMPANY = "C0003"
AT = '"at"'
INVITES_AS_OF = "TIMESTAMP '2001-01-01 00:00:00'"
SESSIONS_AS_OF = "TIMESTAMP '1998-01-01 08:00:00'"


def with_tables(*names: str, extra: str = "") -> str:
    parts = [f"{n} AS ({sql_text(n)})" for n in names]
    if extra:
        parts.append(extra)
    return "WITH " + ", ".join(parts) + " "


def oracle(name: str, tables: str, body: str, extra: str = "",
           recursive: bool = False) -> None:
    text = with_tables(*tables.split(), extra=extra) + body
    ORACLES[name] = text.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else text


def iso(c: str) -> str:
    return (f"CASE WHEN microsecond({c}) % 1000000 = 0 THEN strftime({c}, "
            f"'%Y-%m-%dT%H:%M:%S') ELSE strftime({c}, '%Y-%m-%dT%H:%M:%S.%f') END")


def labels(c: str, table: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE {c} {cases} ELSE {c} END"


def text_list(items) -> str:
    return ", ".join(f"'{x}'" for x in items)


# --- R ------------------------------------------------------------------------------
oracle("r1_companies_by_id", "company evidence",
       "SELECT * FROM company WHERE company_id IN (SELECT company_id FROM evidence)")
oracle("r2_companies_by_domain", "company invite",
       "SELECT company_id, name, domain, status FROM company c WHERE EXISTS (SELECT 1 FROM "
       "invite i WHERE split_part(i.email, '@', 2) = c.domain)")
_SUMMARY = (
    "summary AS (SELECT c.company_id, c.name, c.domain, c.status, c.created_at, "
    "c.created_by, count(u.user_id) AS members, (SELECT min(a.email) FROM app_user a WHERE "
    "a.company_id = c.company_id AND a.role = 'admin' AND a.status = 'ACTIVE') AS admin "
    "FROM company c LEFT JOIN app_user u ON u.company_id = c.company_id GROUP BY ALL)")
oracle("r3_company_summary", "company app_user", "SELECT * FROM summary", _SUMMARY)
_VIEW = (
    "SELECT company_id AS id, company_id, name, domain, CASE WHEN admin <> '' THEN admin "
    "ELSE created_by END AS admin, members, strftime(created_at, '%Y-%m-%d') AS created_day, "
    f"{iso('created_at')} AS created_at, lower(status) AS status FROM summary")
oracle("r18_company_view", "company app_user", _VIEW, _SUMMARY)
oracle("r22_admin_company_list", "company app_user", _VIEW, _SUMMARY)
oracle("r4_profiles", "company app_user",
       "SELECT u.user_id, u.display_name AS name, coalesce(u.email, u.user_id) AS email, "
       "CASE WHEN u.is_super THEN 'super' ELSE u.role END AS role, c.name AS company, "
       "u.company_id, c.domain, u.verified, c.status AS company_status FROM app_user u "
       "LEFT JOIN company c USING (company_id)")
_MEMBERS = ("SELECT company_id, display_name AS name, email, role, verified, status, "
            "last_login_at, status = 'ACTIVE' AS active, created_at, user_id FROM app_user "
            "WHERE company_id IS NOT NULL")
oracle("r5_members_of_every_company", "app_user", _MEMBERS)
oracle("r5_members_of_one_company", "app_user", f"{_MEMBERS} AND company_id = '{COMPANY}'")
_INVITES = (
    "SELECT *, CASE WHEN accepted_at IS NOT NULL THEN 'accepted' WHEN revoked_at IS NOT NULL "
    f"THEN 'revoked' WHEN expires_at <= {INVITES_AS_OF} THEN 'expired' ELSE 'pending' END AS "
    "status FROM invite")
oracle("r6_invites_of_every_company", "invite", _INVITES)
oracle("r6_invites_of_one_company", "invite", f"{_INVITES} WHERE company_id = '{COMPANY}'")
_RESOLVED = (
    "found AS (SELECT r.request_id, r.token, i.email, i.role, c.name AS company, "
    "c.company_id, i.expires_at, CASE WHEN c.company_id IS NULL THEN 'INVITE_NOT_FOUND' WHEN "
    "i.accepted_at IS NOT NULL THEN 'INVITE_USED' WHEN i.revoked_at IS NOT NULL THEN "
    f"'INVITE_REVOKED' WHEN i.expires_at <= {SESSIONS_AS_OF} THEN 'INVITE_EXPIRED' END AS "
    "error_code FROM invite_token_requests r LEFT JOIN (invite i JOIN company c ON "
    "c.company_id = i.company_id) ON i.token = r.token)")
oracle("r7_resolve_invite_tokens", "company invite invite_token_requests",
       "SELECT request_id, token, error_code, " + ", ".join(
           f"CASE WHEN error_code IS NULL THEN {c} END AS {c}"
           for c in ("email", "role", "company", "company_id", "expires_at")) + " FROM found",
       _RESOLVED)
_TEAM_TEXT = f"concat(user_id, ' · ', {labels('event', config.TEAM_EVENT_LABELS)})"
_BY = ("list_filter(string_split(coalesce(detail, ''), ' '), lambda w: "
       "starts_with(w, 'by='))")
_ACTOR = f"coalesce(nullif(substr({_BY}[-1], 4), ''), user_id)"
_TEAM_EVENTS = f"event IN ({text_list(config.TEAM_EVENT_LABELS)})"
_FEED = (f"SELECT log_id, {_TEAM_TEXT} AS text, {_ACTOR} AS actor, {iso(AT)} AS \"at\" FROM "
         "user_login_log")
for _name, _match in (
        ("r8_team_audit_of_one_company",
         f"list_contains(string_split(detail, ' '), 'company={COMPANY}')"),
        ("r8_team_audit_compat", f"detail LIKE '%company={COMPANY}%'"),
        ("r20_team_page_audit",
         f"list_contains(string_split(detail, ' '), 'company={COMPANY}')")):
    oracle(_name, "app_user user_login_log",
           f"{_FEED} WHERE {_TEAM_EVENTS} AND (user_id IN (SELECT email FROM app_user WHERE "
           f"company_id = '{COMPANY}') OR {_match}) ORDER BY log_id DESC LIMIT 50")
oracle("r8_team_audit_of_every_company", "app_user company user_login_log",
       f"SELECT company_id, log_id, {_TEAM_TEXT} AS text, {_ACTOR} AS actor, {iso(AT)} AS "
       "\"at\" FROM ranked WHERE r <= 50",
       "tagged AS (SELECT u.company_id, l.* FROM user_login_log l JOIN app_user u ON u.email "
       f"= l.user_id WHERE {_TEAM_EVENTS} AND u.company_id IS NOT NULL UNION SELECT "
       "substr(w, 9) AS company_id, log_id, user_id, event, detail, \"at\" FROM (SELECT *, "
       "unnest(string_split(detail, ' ')) AS w FROM user_login_log) WHERE "
       f"{_TEAM_EVENTS} AND starts_with(w, 'company=')), ranked AS (SELECT *, row_number() "
       "OVER (PARTITION BY company_id ORDER BY log_id DESC) AS r FROM tagged)")
ORACLES["r8_team_feeds_kept_beside_the_log"] = ORACLES["r8_team_audit_of_every_company"]
_ALL_USERS = (
    "everyone AS (SELECT u.display_name AS name, u.email, CASE WHEN u.is_super THEN 'super' "
    "ELSE u.role END AS role, u.is_super, u.status, u.verified, u.last_login_at, c.name AS "
    "company FROM app_user u LEFT JOIN company c ON c.company_id = u.company_id)")
oracle("r9_all_users", "app_user company", "SELECT * FROM everyone", _ALL_USERS)
oracle("r10_users_by_id", "app_user user_session",
       "SELECT user_id, display_name, role, is_admin, status, failed_count, locked_until, "
       "created_at, approved_at, approved_by, last_login_at FROM app_user WHERE user_id IN "
       "(SELECT user_id FROM user_session)")
_LIST = ("SELECT user_id, display_name, role, is_admin, status, created_at, last_login_at "
         "FROM app_user")
oracle("r11_list_users", "app_user", _LIST)
oracle("r12_pending_users", "app_user", f"{_LIST} WHERE status = 'PENDING'")
oracle("r13_login_log", "user_login_log",
       "SELECT * FROM user_login_log ORDER BY log_id DESC LIMIT 100")
_LIVE = (
    "live AS (SELECT s.session_id, s.user_id, u.display_name, u.role, u.is_admin, "
    "s.expires_at FROM user_session s JOIN app_user u ON u.user_id = s.user_id WHERE "
    f"s.revoked_at IS NULL AND u.status = 'ACTIVE' AND s.expires_at > {SESSIONS_AS_OF})")
oracle("r14_live_sessions", "app_user user_session", "SELECT * FROM live", _LIVE)
oracle("r14_users_of_tokens", "app_user user_session logouts",
       "SELECT r.token, r.user_id, r.display_name, r.role, r.is_admin, r.expires_at FROM "
       "(SELECT q.token, l.* FROM logouts q JOIN live l ON l.session_id = sha256(q.token)) r",
       _LIVE)
oracle("r14_session_states", "app_user user_session",
       "SELECT s.session_id, s.user_id, u.display_name, u.role, u.is_admin, s.expires_at, "
       "CASE WHEN s.revoked_at IS NOT NULL THEN 'revoked' WHEN u.status <> 'ACTIVE' THEN "
       f"'inactive' WHEN s.expires_at <= {SESSIONS_AS_OF} THEN 'expired' ELSE 'alive' END AS "
       "state FROM user_session s JOIN app_user u ON u.user_id = s.user_id")
_AUDIT_TEXT = (
    "trim(concat(evidence_id, CASE WHEN evidence_version <> 0 THEN concat(' v', "
    f"evidence_version) ELSE '' END, ' ', {labels('action', config.ACTION_LABELS)}, ' · ', "
    f"coalesce({labels('outcome', config.OUTCOME_LABELS)}, '')))")
oracle("r15_admin_audit", "access_event",
       f"SELECT *, {_AUDIT_TEXT} AS text, occurred_at AS \"at\" FROM access_event ORDER BY id DESC "
       "LIMIT 200")
_STATE = ("CASE WHEN status <> 'ACTIVE' THEN 'disabled' WHEN {v} THEN 'active' ELSE "
          "'unverified' END")
_MEMBER_VIEW = (
    f"SELECT company_id, display_name AS name, email, role, {_STATE.format(v='verified')} AS "
    f"status, verified, status = 'ACTIVE' AS active, {iso('last_login_at')} AS last_login_at "
    "FROM app_user WHERE company_id IS NOT NULL")
oracle("r16_member_view", "app_user", _MEMBER_VIEW)
oracle("r20_team_page_members", "app_user", f"{_MEMBER_VIEW} AND company_id = '{COMPANY}'")
for _name, _verified in (("r17_user_view", "true"), ("r23_admin_user_list", "verified")):
    oracle(_name, "app_user company",
           f"SELECT name, email, company, role, {_STATE.format(v=_verified)} AS status, "
           f"{iso('last_login_at')} AS last_login_at FROM everyone", _ALL_USERS)


def _invite_view(base: str) -> str:
    return (f"SELECT company_id, token, token AS id, email, role, status, invited_by, "
            f"{iso('expires_at')} AS expires_at, concat('{base}', '/?invite=', token) AS "
            f"invite_url FROM ({_INVITES})")


oracle("r19_invite_view", "invite", _invite_view("https://team.test"))
oracle("r20_team_page_invites", "invite", _invite_view("https://team.test") +
       f" WHERE company_id = '{COMPANY}' AND status = 'pending'")
oracle("r21_company_invite_list", "invite", _invite_view("") +
       f" WHERE company_id = '{COMPANY}'")
_ASKED = "asked AS (SELECT request_id, lower(trim(email)) AS email FROM company_signups)"
oracle("r24_mail_taken", "app_user company_signups",
       "SELECT email, request_id FROM asked WHERE email IN (SELECT email FROM app_user WHERE "
       "email IS NOT NULL)", _ASKED)
oracle("r24_domain_free", "company company_signups",
       "SELECT request_id, email, split_part(email, '@', -1) AS domain FROM asked WHERE "
       "split_part(email, '@', -1) NOT IN (SELECT domain FROM company)", _ASKED)
oracle("r25_users_with_company", "app_user company",
       "SELECT u.email, u.display_name, u.role, u.status, u.verified, c.company_id, c.name AS "
       "company, c.domain FROM app_user u JOIN company c ON c.company_id = u.company_id")

# --- I, P ---------------------------------------------------------------------------
oracle("i2_scoped_evidence", "evidence",
       f"SELECT * FROM evidence WHERE company_id = '{COMPANY}'")
oracle("i2_super_sees_nothing", "evidence", "SELECT * FROM evidence WHERE 1 = 0")
oracle("i2_unscoped_job_sees_all", "evidence", "SELECT * FROM evidence WHERE 1 = 1")
oracle("i3_scoped_results", "evidence evidence_result",
       "SELECT * FROM evidence_result WHERE evidence_id IN (SELECT evidence_id FROM evidence "
       f"WHERE company_id = '{COMPANY}')")
_OWNED = ("SELECT a.id, a.evidence_id, CASE WHEN e.evidence_id IS NULL THEN true ELSE "
          f"coalesce(e.company_id = '{COMPANY}', false) END AS owned FROM access_event a LEFT "
          "JOIN evidence e ON e.evidence_id = a.evidence_id")
oracle("i4_ownership", "evidence access_event", _OWNED)
oracle("i5_rejected_evidence", "evidence access_event",
       "SELECT id, evidence_id, 'EVIDENCE_NOT_FOUND' AS error_code FROM "
       f"({_OWNED}) WHERE NOT owned")
oracle("i4_ownership_per_request", "evidence user_login_log",
       "SELECT r.request_id, r.evidence_id, r.company_id, r.is_super, CASE WHEN r.is_super "
       "THEN false WHEN e.evidence_id IS NULL THEN true ELSE coalesce(e.company_id = "
       "r.company_id, false) END AS owned FROM (SELECT log_id AS request_id, concat('E', "
       "log_id // 9) AS evidence_id, concat('C', lpad(CAST(log_id % 25 + 1 AS VARCHAR), 4, "
       "'0')) AS company_id, log_id % 50 = 0 AS is_super FROM user_login_log) r LEFT JOIN "
       "evidence e ON e.evidence_id = r.evidence_id")
_MAY = " OR ".join(f"(action = '{a}' AND role IN ({text_list(r)}))"
                   for a, r in config.PERMISSIONS.items())
oracle("p1_permissions", "access_event",
       f"SELECT id, role, action, ({_MAY}) AS allowed FROM (SELECT id, role, split_part("
       f"'{','.join(config.PERMISSIONS)},export', ',', CAST(id % 6 + 1 AS INT)) AS action "
       "FROM access_event)")
_GRANT = " OR ".join(f"(role = '{r}' AND action IN ({text_list(a)}))"
                     for r, a in config.EVIDENCE_GRANTS.items() if a)
oracle("p2_evidence_grants", "access_event",
       f"SELECT id, role, action, ({_GRANT}) AS allowed FROM access_event")
oracle("p3_denied_attempts", "access_event",
       "SELECT occurred_at, actor, role, action, evidence_id, evidence_version, 'DENIED' AS "
       "outcome FROM access_event WHERE role = 'super'")

# --- F ------------------------------------------------------------------------------
EMAIL_OK = "regexp_full_match({c}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')"
PUBLIC = f"IN ({text_list(config.PUBLIC_DOMAINS)})"


def email_bad(c: str) -> str:
    return f"(NOT {EMAIL_OK.replace('{c}', c)} OR length({c}) > 190)"


def password_flaw(p: str, who: str) -> str:
    kinds = (f"(CAST(regexp_matches({p}, '[A-Za-z]') AS INT) + CAST(regexp_matches({p}, "
             f"'\\p{{Nd}}') AS INT) + CAST(regexp_matches({p}, '[^A-Za-z0-9]') AS INT))")
    triple = (f"len(list_filter(range(1, greatest(length({p}) - 1, 1)), lambda i: substr({p}, "
              f"i, 1) = substr({p}, i + 1, 1) AND substr({p}, i, 1) = substr({p}, i + 2, 1) "
              f"AND substr({p}, i, 1) <> chr(10))) > 0 AND length({p}) > 2")
    return (f"CASE WHEN {kinds} < 2 THEN 'TOO_FEW_KINDS' WHEN length({p}) < CASE WHEN {kinds} "
            f">= 3 THEN 8 ELSE 10 END THEN 'TOO_SHORT' WHEN {who} <> '' AND contains(lower("
            f"{p}), lower({who})) THEN 'CONTAINS_ID' WHEN {triple} THEN 'REPEATED_CHARACTER' "
            "END")


oracle("f1_f3_company_mail", "company_signups",
       f"SELECT request_id, email AS mail, CASE WHEN {email_bad('email')} THEN "
       f"'INVALID_EMAIL' END AS email_error, CASE WHEN NOT {email_bad('email')} THEN "
       "split_part(email, '@', 2) END AS domain, CASE WHEN "
       f"{email_bad('email')} THEN 'INVALID_EMAIL' WHEN split_part(email, '@', 2) {PUBLIC} "
       "THEN 'PUBLIC_EMAIL' END AS company_email_error FROM asked", _ASKED)
ACCOUNT_ERROR = (
    "CASE WHEN length(trim(user_id)) > 190 OR NOT regexp_matches(trim(user_id), "
    "'^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}$"
    "|^[A-Za-z][A-Za-z0-9_.-]{2,49}$') THEN 'INVALID_USER_ID' WHEN trim(display_name) = '' "
    "THEN 'DISPLAY_NAME_REQUIRED' WHEN length(trim(display_name)) > 100 THEN "
    "'DISPLAY_NAME_TOO_LONG' WHEN role NOT IN ('REVIEWER', 'APPROVER') THEN 'INVALID_ROLE' "
    "END")
oracle("f4_account_rules", "account_signups",
       f"SELECT request_id, {ACCOUNT_ERROR} AS error_code FROM account_signups")
oracle("f5_password_findings", "company_signups",
       "SELECT coalesce(f, 'OK') AS finding, count(*) AS passwords FROM (SELECT "
       f"{password_flaw('password', 'who')} AS f FROM (SELECT password, split_part(lower("
       "trim(email)), '@', 1) AS who FROM company_signups)) GROUP BY 1")
oracle("f6_token_keys", "logouts",
       "SELECT request_id, sha256(token) AS session_id FROM logouts")
oracle("f7_credential_findings", "app_user",
       "SELECT CASE WHEN CAST(split_part(password_hash, '$', 2) AS BIGINT) < 600000 THEN "
       "'FEW_ROUNDS' ELSE 'OK' END AS finding, count(*) AS accounts FROM app_user GROUP BY 1")
oracle("f8_f9_times", "user_login_log",
       f"SELECT log_id, {iso(AT)} AS iso, strftime({AT}, '%Y-%m-%d') AS day FROM "
       "user_login_log")
oracle("f10_audit_text", "access_event", f"SELECT id, {_AUDIT_TEXT} AS text FROM access_event")
oracle("f11_team_text", "user_login_log",
       f"SELECT log_id, {_TEAM_TEXT} AS text, {_ACTOR} AS actor FROM user_login_log")
oracle("f12_company_status", "company_status_requests",
       "SELECT request_id, upper(status) AS status, CASE WHEN upper(status) NOT IN ('ACTIVE', "
       "'SUSPENDED') THEN 'INVALID_STATUS' END AS error_code FROM company_status_requests")
oracle("f13_http_status", "company_signups",
       "SELECT error_code, CASE WHEN error_code = 'USER_EXISTS' THEN 409 ELSE 400 END AS "
       "http_status, count(*) AS n FROM (SELECT CASE WHEN "
       f"{email_bad('lower(trim(email))')} THEN 'INVALID_EMAIL' WHEN split_part(lower(trim("
       f"email)), '@', 2) {PUBLIC} THEN 'PUBLIC_EMAIL' WHEN name = '' THEN 'NAME_REQUIRED' "
       "ELSE 'USER_EXISTS' END AS error_code FROM company_signups) GROUP BY 1, 2")
oracle("f14_lock_minutes", "attempts",
       f"SELECT attempt_id, CAST(date_diff('microsecond', {AT} + INTERVAL '3' MINUTE, {AT} + "
       "INTERVAL '10' MINUTE) // 60000000 + 1 AS BIGINT) AS minutes_left FROM attempts")
oracle("f15_parse_times", "user_login_log",
       f"SELECT log_id, CASE log_id % 4 WHEN 0 THEN {AT} WHEN 1 THEN date_trunc('second', "
       f"{AT}) END AS parsed FROM user_login_log")
oracle("f16_ends", "invite",
       "SELECT token, created_at + INTERVAL '7' DAY AS invite_end, created_at + INTERVAL '8' "
       "HOUR AS session_end, created_at + INTERVAL '10' MINUTE AS lock_end FROM invite")
oracle("l7_detail_tokens", "user_login_log",
       "SELECT log_id, pos, CASE WHEN contains(w, '=') THEN split_part(w, '=', 1) END AS key, "
       "CASE WHEN contains(w, '=') THEN substr(w, strpos(w, '=') + 1) ELSE w END AS value "
       "FROM (SELECT log_id, CAST(generate_subscripts(string_split(detail, ' '), 1) - 1 AS "
       "BIGINT) AS pos, unnest(string_split(detail, ' ')) AS w FROM user_login_log)")

# --- C ------------------------------------------------------------------------------
oracle("c1_identity_tables", "app_user", "SELECT * FROM app_user")
oracle("c2_access_events", "access_event", "SELECT * FROM access_event")


def _long(table: str, source: str, key: str, lengths: dict[str, int]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, 'TOO_LONG' AS rule, '{c}' AS column_name, "
        f"CAST({key} AS VARCHAR) AS key_value, CAST(1 AS BIGINT) AS n FROM {source} WHERE "
        f"length({c}) > {n}" for c, n in lengths.items())


def _repeated(table: str, source: str, c: str) -> str:
    return (f"SELECT '{table}', 'NOT_UNIQUE', '{c}', {c}, count(*) FROM {source} WHERE {c} IS "
            f"NOT NULL GROUP BY {c} HAVING count(*) > 1")


_USER_LENGTHS = {"user_id": 50, "display_name": 100, "password_hash": 255, "role": 20,
                 "status": 20, "approved_by": 50, "email": 190, "company_id": 50}
_BROKEN = ("broken AS (SELECT * REPLACE (CASE WHEN company_id IS NOT NULL THEN concat("
           "company_id, '@x.test') END AS email, nullif(display_name, 'Customer#000000007') AS "
           "display_name) FROM app_user)")
oracle("c4_contract_company_user", "app_user",
       _long("app_user", "broken", "user_id", _USER_LENGTHS) +
       " UNION ALL SELECT 'app_user', 'NOT_NULL', 'display_name', user_id, 1 FROM broken WHERE "
       "display_name IS NULL UNION ALL " + _repeated("app_user", "broken", "user_id") +
       " UNION ALL " + _repeated("app_user", "broken", "email"), _BROKEN)
oracle("c4_contract_of_new_users", "app_user",
       _long("app_user", "fresh", "user_id", _USER_LENGTHS) +
       " UNION ALL SELECT 'app_user', 'NOT_NULL', 'display_name', user_id, 1 FROM fresh WHERE "
       "display_name IS NULL" + "".join(
           f" UNION ALL SELECT * FROM ({_repeated('app_user', 'broken', c)}) AS x(t, r, c, v, n) "
           f"WHERE v IN (SELECT {c} FROM fresh)" for c in ("user_id", "email")),
       _BROKEN + ", fresh AS (SELECT * FROM broken WHERE last_login_at IS NULL)")
oracle("c4_contract_invite", "invite",
       _long("invite", "broken", "token", {"token": 43, "company_id": 50, "email": 190,
                                           "role": 20, "invited_by": 190}) +
       " UNION ALL " + _repeated("invite", "broken", "token"),
       "broken AS (SELECT * REPLACE (concat(email, '-padded-to-be-longer-than-allowed') AS "
       "token) FROM invite)")
oracle("c5_orphan_sessions", "app_user user_session",
       "SELECT s.user_id, s.session_id, s.created_at, s.expires_at, s.revoked_at FROM "
       "user_session s WHERE NOT EXISTS (SELECT 1 FROM app_user u WHERE u.user_id = s.user_id "
       "AND u.status = 'ACTIVE')")
oracle("c6_cascade_delete", "company invite",
       "SELECT * FROM invite WHERE company_id NOT IN (SELECT company_id FROM company WHERE "
       "status = 'SUSPENDED')")
oracle("c6_cascade_rename", "app_user user_session",
       "SELECT s.session_id, CASE WHEN u.role = 'admin' THEN upper(s.user_id) ELSE s.user_id "
       "END AS user_id, s.created_at, s.expires_at, s.revoked_at FROM user_session s JOIN "
       "app_user u ON u.user_id = s.user_id")
oracle("c7_evolve", "app_user",
       "SELECT user_id, display_name, role, is_admin, status, failed_count, locked_until, "
       "created_at, approved_at, approved_by, password_changed_at, last_login_at, CAST(NULL "
       "AS VARCHAR) AS email, CAST(NULL AS VARCHAR) AS company_id, false AS verified, false "
       "AS is_super FROM app_user")
_INCOMING = _ASKED + (
    f", incoming AS (SELECT split_part(a.email, '@', 2) AS domain, arg_min(trim(s.company), "
    "row(s.request_ts, s.request_id)) AS name, min(s.request_ts) AS created_at FROM asked a "
    f"JOIN company_signups s USING (request_id) WHERE NOT {email_bad('a.email')} AND "
    f"split_part(a.email, '@', 2) NOT {PUBLIC} GROUP BY 1)")
oracle("c9_insert_ignore", "company company_signups",
       "SELECT * FROM company UNION ALL SELECT concat('X-', domain), name, domain, 'ACTIVE', "
       "created_at, NULL FROM incoming WHERE domain NOT IN (SELECT domain FROM company)",
       _INCOMING)
oracle("c9_upsert", "company company_signups",
       "SELECT c.company_id, c.name, c.domain, CASE WHEN i.domain IS NULL THEN c.status ELSE "
       "'ACTIVE' END AS status, c.created_at, CASE WHEN i.domain IS NULL THEN c.created_by "
       "ELSE 'seed' END AS created_by FROM company c LEFT JOIN incoming i ON i.domain = "
       "c.domain UNION ALL SELECT concat('X-', domain), name, domain, 'ACTIVE', created_at, "
       "'seed' FROM incoming WHERE domain NOT IN (SELECT domain FROM company)", _INCOMING)


def all_oracles() -> dict[str, str]:
    from tenantlake.verification import oracle_changes  # noqa: F401  (adds its entries)

    return dict(ORACLES)
