"""Validation rules as column expressions that yield an error code or NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenantlake import config
from tenantlake.functions.text import blank_to_null, col, detail_value, labelled, strip


def first_error(*rules: tuple[Column, str]) -> Column:
    """Code of the first rule that is broken; a NULL condition counts as not broken."""
    return F.coalesce(*(F.when(broken, F.lit(code)) for broken, code in rules),
                      F.lit(None).cast("string"))


def clean_email(c: Column | str) -> Column:
    return F.lower(strip(c))


def email_error(c: Column | str) -> Column:
    return clean_email_error(clean_email(c))


def clean_email_error(mail: Column | str) -> Column:
    """The same for an address that was normalised before."""
    bad = ~col(mail).rlike(config.EMAIL_PATTERN) | (F.length(mail) > config.ID_LENGTH)
    return F.when(bad, F.lit("INVALID_EMAIL"))


def domain_of(clean: Column | str) -> Column:
    return F.substring_index(col(clean), "@", -1)


def local_part(clean: Column | str) -> Column:
    return F.substring_index(col(clean), "@", 1)


def company_email_error(c: Column | str) -> Column:
    return clean_company_email_error(clean_email(c))


def clean_company_email_error(mail: Column | str) -> Column:
    public = domain_of(mail).isin(*config.PUBLIC_DOMAINS)
    return F.coalesce(clean_email_error(mail), F.when(public, F.lit("PUBLIC_EMAIL")))


def account_error(user_id: Column | str, display_name: Column | str,
                  role: Column | str) -> Column:
    uid, name = strip(user_id), strip(display_name)
    return first_error(
        ((F.length(uid) > config.ID_LENGTH) | ~uid.rlike(config.LOGIN_ID_PATTERN),
         "INVALID_USER_ID"),
        (name == "", "DISPLAY_NAME_REQUIRED"),
        (F.length(name) > config.NAME_LENGTH, "DISPLAY_NAME_TOO_LONG"),
        (~F.coalesce(col(role), F.lit("")).isin(*config.ACCOUNT_ROLES), "INVALID_ROLE"),
    )


def password_kinds(password: Column | str) -> Column:
    """How many of letter / digit / other occur; a non-ASCII digit is digit and other."""
    p = col(password)
    return sum((p.rlike(kind).cast("int")
                for kind in ("[A-Za-z]", r"\p{Nd}", "[^A-Za-z0-9]")), F.lit(0))


def password_flaw(password: Column | str, login_id: Column | str) -> Column:
    """First broken part of the policy; NULL when fine or when no text was staged."""
    p, who = col(password), col(login_id)
    kinds = password_kinds(p)
    need = F.when(kinds >= 3, config.MIN_LENGTH_THREE_KINDS).otherwise(
        config.MIN_LENGTH_TWO_KINDS)
    return first_error(
        (kinds < 2, "TOO_FEW_KINDS"),
        (F.length(p) < need, "TOO_SHORT"),
        ((who != "") & F.lower(p).contains(F.lower(who)), "CONTAINS_ID"),
        (p.rlike(r"([^\n])\1\1"), "REPEATED_CHARACTER"),
    )


def password_error(password: Column | str, login_id: Column | str) -> Column:
    return F.when(password_flaw(password, login_id).isNotNull(), F.lit("WEAK_PASSWORD"))


def hash_finding(stored: Column | str) -> Column:
    """Shape problems of a stored password hash; says nothing about the password."""
    parts = F.split(col(stored), r"\$", -1)

    def part(i: int) -> Column:
        return F.try_element_at(parts, F.lit(i))

    rounds = part(2).try_cast("bigint")
    return first_error(
        (col(stored).isNull(), "MISSING"),
        (F.size(parts) != 4, "BAD_SHAPE"),
        (part(1) != config.HASH_ALGORITHM, "UNKNOWN_ALGORITHM"),
        (rounds.isNull(), "BAD_ROUNDS"),
        (rounds < config.HASH_ROUNDS, "FEW_ROUNDS"),
        (F.length(part(3)) != 22, "BAD_SALT"),
        (F.length(part(4)) != 43, "BAD_DIGEST"),
    )


def company_status(c: Column | str) -> Column:
    return F.upper(F.coalesce(col(c), F.lit("")))


def company_status_error(c: Column | str) -> Column:
    return F.when(~company_status(c).isin(*config.COMPANY_STATUSES),
                  F.lit("INVALID_STATUS"))


def company_role_error(c: Column | str) -> Column:
    return F.when(~F.coalesce(col(c), F.lit("")).isin(*config.COMPANY_ROLES),
                  F.lit("INVALID_ROLE"))


def http_status(code: Column | str) -> Column:
    pairs = [F.lit(x) for kv in config.HTTP_STATUS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(code)),
                      F.lit(config.HTTP_STATUS_DEFAULT))


def lock_minutes_left(locked_until: Column | str, at: Column | str) -> Column:
    micros = F.timestamp_diff("MICROSECOND", col(at), col(locked_until))
    return F.floor(micros / F.lit(60_000_000)) + 1


def audit_text(evidence: Column | str, version: Column | str, action: Column | str,
               outcome: Column | str) -> Column:
    """`E7 v2 action · outcome`; the version is left out when NULL or 0."""
    def shown(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    where = shown(col(evidence))
    where = F.when(col(version) != 0, F.concat(where, F.lit(" v"), col(version).cast("string"))
                   ).otherwise(where)
    return strip(F.concat(
        where, F.lit(" "), shown(labelled(action, config.ACTION_LABELS)),
        F.lit(" · "), shown(labelled(outcome, config.OUTCOME_LABELS))))


def team_text(user_id: Column | str, event: Column | str) -> Column:
    return F.concat(col(user_id), F.lit(" · "), labelled(event, config.TEAM_EVENT_LABELS))


def team_actor(user_id: Column | str, detail: Column | str) -> Column:
    """Who did it: the last `by=` of the detail, else the account itself."""
    return F.coalesce(blank_to_null(detail_value(detail, "by")), col(user_id))
