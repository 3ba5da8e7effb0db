"""Table schemas and the contracts that go with them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

_TS = T.TimestampNTZType()
_S = T.StringType()
_B = T.BooleanType()
_I = T.IntegerType()
_L = T.LongType()


def _table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns])


COMPANY = _table(
    ("company_id", _S), ("name", _S), ("domain", _S), ("status", _S),
    ("created_at", _TS), ("created_by", _S),
)
APP_USER = _table(
    ("user_id", _S), ("display_name", _S), ("password_hash", _S), ("role", _S),
    ("is_admin", _B), ("is_super", _B), ("status", _S), ("failed_count", _I),
    ("locked_until", _TS), ("created_at", _TS), ("approved_at", _TS),
    ("approved_by", _S), ("password_changed_at", _TS), ("last_login_at", _TS),
    ("email", _S), ("company_id", _S), ("verified", _B),
)
USER_SESSION = _table(
    ("session_id", _S), ("user_id", _S), ("created_at", _TS), ("expires_at", _TS),
    ("revoked_at", _TS),
)
USER_LOGIN_LOG = _table(
    ("log_id", _L), ("user_id", _S), ("event", _S), ("detail", _S), ("at", _TS),
)
INVITE = _table(
    ("token", _S), ("company_id", _S), ("email", _S), ("role", _S), ("invited_by", _S),
    ("created_at", _TS), ("expires_at", _TS), ("accepted_at", _TS), ("revoked_at", _TS),
)
EVIDENCE = _table(("evidence_id", _S), ("company_id", _S), ("uploaded_by", _S))
ACCESS_EVENT = _table(
    ("id", _L), ("occurred_at", _TS), ("actor", _S), ("role", _S), ("action", _S),
    ("evidence_id", _S), ("evidence_version", _I), ("outcome", _S),
)
ATTEMPTS = _table(("attempt_id", _L), ("user_id", _S), ("at", _TS), ("password_ok", _B))

TABLES = {
    "company": COMPANY,
    "app_user": APP_USER,
    "user_session": USER_SESSION,
    "user_login_log": USER_LOGIN_LOG,
    "invite": INVITE,
    "evidence": EVIDENCE,
    "access_event": ACCESS_EVENT,
    "attempts": ATTEMPTS,
}


@dataclass(frozen=True)
class Contract:
    """What the storage layer used to enforce for one table."""

    table: str
    primary_key: str
    unique: tuple[str, ...] = ()
    not_null: tuple[str, ...] = ()
    max_length: dict[str, int] = field(default_factory=dict)
    numbered_id: str | None = None


# Keys, unique columns, NOT NULL columns and lengths of the declared tables.
CONTRACTS = {
    "company": Contract(
        "company", "company_id", ("domain",),
        ("company_id", "name", "domain", "status", "created_at"),
        {"company_id": 50, "name": 200, "domain": 100, "status": 20, "created_by": 190},
        numbered_id="company_id",
    ),
    "app_user": Contract(
        "app_user", "user_id", ("email",),
        ("user_id", "display_name", "password_hash", "role", "is_admin", "is_super",
         "status", "failed_count", "created_at", "password_changed_at", "verified"),
        {"user_id": 50, "display_name": 100, "password_hash": 255, "role": 20,
         "status": 20, "approved_by": 50, "email": 190, "company_id": 50},
    ),
    "user_session": Contract(
        "user_session", "session_id", (),
        ("session_id", "user_id", "created_at", "expires_at"),
        {"session_id": 64, "user_id": 50},
    ),
    "user_login_log": Contract(
        "user_login_log", "log_id", (),
        ("log_id", "user_id", "event", "at"),
        {"user_id": 50, "event": 20, "detail": 200},
    ),
    "invite": Contract(
        "invite", "token", (),
        ("token", "company_id", "email", "role", "invited_by", "created_at", "expires_at"),
        {"token": 43, "company_id": 50, "email": 190, "role": 20, "invited_by": 190},
    ),
}

# Columns an older table version may lack, with the value existing rows get.
EVOLUTION = {
    "app_user": (("email", _S, None), ("company_id", _S, None),
                 ("verified", _B, False), ("is_super", _B, False)),
    "evidence": (("company_id", _S, None), ("uploaded_by", _S, None)),
    "evidence_history": (("company_id", _S, None), ("uploaded_by", _S, None)),
}

# Tables and columns that must be there before any job starts.
REQUIRED_TABLES = (
    "app_user", "chunk", "company", "evidence", "evidence_history", "invite",
    "phase1_mapping", "phase1_mapping_citation", "phase2_excluded", "phase2_result",
    "review_history", "user_login_log", "user_session",
)
REQUIRED_COLUMNS = (
    ("app_user", "email"), ("app_user", "company_id"), ("app_user", "verified"),
    ("app_user", "is_super"), ("evidence", "company_id"), ("evidence", "uploaded_by"),
    ("evidence_history", "company_id"), ("evidence_history", "uploaded_by"),
)
