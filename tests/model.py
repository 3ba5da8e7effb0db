"""The account rules applied to one request at a time, on plain dicts.

Only for tests: a batch of N requests must end like N single requests in order.
"""

from __future__ import annotations

import re
from datetime import timedelta

MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
PUBLIC = {"gmail.com", "naver.com"}


def weak(password, who):
    if password is None:
        return False
    kinds = sum(bool(re.search(k, password)) for k in (r"[A-Za-z]", r"\d", r"[^A-Za-z0-9]"))
    return (kinds < 2 or len(password) < (8 if kinds == 3 else 10)
            or bool(who) and who.lower() in password.lower()
            or re.search(r"(.)\1\1", password) is not None)


def bad_mail(mail):
    return not MAIL.fullmatch(mail) or len(mail) > 190


class Tables:
    def __init__(self, users, companies, sessions, invites):
        self.users = {u["user_id"]: dict(u) for u in users}
        self.companies = {c["company_id"]: dict(c) for c in companies}
        self.sessions = {s["session_id"]: dict(s) for s in sessions}
        self.invites = {i["token"]: dict(i) for i in invites}
        self.log = []

    def note(self, user, event, detail, at):
        self.log.append((user, event, detail, at))

    def by_mail(self, mail):
        return next((u for u in self.users.values() if u["email"] == mail), None)

    def end_sessions(self, user_ids, at):
        for s in self.sessions.values():
            if s["user_id"] in user_ids and s["revoked_at"] is None:
                s["revoked_at"] = at

    def add_user(self, user_id, at, **columns):
        self.users[user_id] = {
            "user_id": user_id, "is_admin": False, "is_super": False, "failed_count": 0,
            "locked_until": None, "created_at": at, "approved_at": None, "approved_by": None,
            "password_changed_at": at, "last_login_at": None, "email": None,
            "company_id": None, "verified": False, **columns}

    # --- one request each; the result is an error code or None ---------------------
    def company_signup(self, r):
        mail, at = r["email"].strip().lower(), r["request_ts"]
        if bad_mail(mail):
            return "INVALID_EMAIL"
        domain = mail.split("@")[1]
        if domain in PUBLIC:
            return "PUBLIC_EMAIL"
        if not r["name"].strip():
            return "NAME_REQUIRED"
        if not r["company"].strip():
            return "COMPANY_REQUIRED"
        if weak(r["password"], mail.split("@")[0]):
            return "WEAK_PASSWORD"
        if self.by_mail(mail) or mail in self.users:
            return "USER_EXISTS"
        if any(c["domain"] == domain for c in self.companies.values()):
            return "COMPANY_EXISTS"
        number = max((int(c[1:]) for c in self.companies), default=0) + 1
        cid = f"C{number:04d}"
        self.companies[cid] = {"company_id": cid, "name": r["company"].strip(),
                               "domain": domain, "status": "ACTIVE", "created_at": at,
                               "created_by": mail}
        self.add_user(mail, at, display_name=r["name"].strip(), role="admin", is_admin=True,
                      password_hash=r["password_hash"], status="ACTIVE", approved_at=at,
                      email=mail, company_id=cid, verified=True)
        self.note(mail, "SIGNUP", f"company={cid} role=admin", at)
        return None

    def account_status(self, r):
        u, at = self.users.get(r["user_id"]), r["request_ts"]
        if u is None:
            return "USER_NOT_FOUND"
        u.update(status=r["status"], approved_at=at, approved_by=r["actor"], failed_count=0,
                 locked_until=None)
        if r["status"] != "ACTIVE":
            self.end_sessions({r["user_id"]}, at)
        self.note(r["user_id"], "ACTIVATE" if r["status"] == "ACTIVE" else "DISABLE",
                  f"by={r['actor']}", at)
        return None

    def company_status(self, r):
        status, c = r["status"].upper(), self.companies.get(r["company_id"])
        if status not in ("ACTIVE", "SUSPENDED"):
            return "INVALID_STATUS"
        if c is None:
            return "COMPANY_NOT_FOUND"
        c["status"] = status
        if status == "SUSPENDED":
            self.end_sessions({u["user_id"] for u in self.users.values()
                               if u["company_id"] == r["company_id"]}, r["request_ts"])
        self.note(r["actor"], "COMPANY_" + status, r["company_id"], r["request_ts"])
        return None

    def member(self, r):
        op, at, mail = r["op"], r["request_ts"], r["email"].strip().lower()
        if op == "role" and r["role"] not in ("admin", "reviewer", "member"):
            return "INVALID_ROLE"
        if bad_mail(mail):
            return "INVALID_EMAIL"
        u = next((x for x in self.users.values()
                  if x["email"] == mail and x["company_id"] == r["company_id"]), None)
        if u is None:
            return "MEMBER_NOT_FOUND"
        loses = {"role": r["role"] != "admin", "remove": True, "active": not r["active"]}[op]
        if u["role"] == "admin" and loses and not any(
                x["role"] == "admin" and x["status"] == "ACTIVE" and x["email"] not in (
                    None, mail) and x["company_id"] == r["company_id"]
                for x in self.users.values()):
            return "LAST_ADMIN"
        if op == "role":
            u.update(role=r["role"], is_admin=r["role"] == "admin")
            self.note(mail, "ROLE_CHANGE", f"{r['role']} by={r['actor']}", at)
            return None
        on = op == "active" and r["active"]
        u["status"] = "ACTIVE" if on else "DISABLED"
        if not on:
            self.end_sessions({u["user_id"]}, at)
        event = "MEMBER_REMOVE" if op == "remove" else "ACTIVATE" if on else "DISABLE"
        self.note(mail, event, f"by={r['actor']}", at)
        return None

    def invite(self, r):
        mail, at, c = r["email"].strip().lower(), r["request_ts"], self.companies.get(
            r["company_id"])
        if r["role"] not in ("admin", "reviewer", "member"):
            return "INVALID_ROLE"
        if bad_mail(mail):
            return "INVALID_EMAIL"
        if c is None:
            return "COMPANY_NOT_FOUND"
        if mail.split("@")[1] != c["domain"]:
            return "DOMAIN_MISMATCH"
        if self.by_mail(mail):
            return "USER_EXISTS"
        for i in self.invites.values():
            if i["email"] == mail and i["accepted_at"] is None and i["revoked_at"] is None:
                i["revoked_at"] = at
        self.invites[r["token"]] = {
            "token": r["token"], "company_id": r["company_id"], "email": mail,
            "role": r["role"], "invited_by": r["actor"], "created_at": at,
            "expires_at": at + timedelta(days=7), "accepted_at": None, "revoked_at": None}
        self.note(r["actor"], "INVITE", f"{mail} role={r['role']}", at)
        return None

    def _open(self, r):
        i = self.invites.get(r["token"])
        return i if i and i["company_id"] == r["company_id"] and not (
            i["accepted_at"] or i["revoked_at"]) else None

    def revoke(self, r):
        i = self._open(r)
        if i is None:
            return "INVITE_NOT_FOUND"
        i["revoked_at"] = r["request_ts"]
        self.note(r["actor"], "INVITE_REVOKE", r["token"][:12], r["request_ts"])
        return None

    def extend(self, r):
        i = self._open(r)
        if i is None:
            return "INVITE_NOT_FOUND"
        i["expires_at"] = r["request_ts"] + timedelta(days=7)
        self.note(r["actor"], "INVITE_RESEND", r["token"][:12], r["request_ts"])
        return None

    def accept(self, r):
        i, at = self.invites.get(r["token"]), r["request_ts"]
        if i is None or i["company_id"] not in self.companies:
            return "INVITE_NOT_FOUND"
        if i["accepted_at"]:
            return "INVITE_USED"
        if i["revoked_at"]:
            return "INVITE_REVOKED"
        if i["expires_at"] <= at:
            return "INVITE_EXPIRED"
        if not r["name"].strip():
            return "NAME_REQUIRED"
        mail = i["email"]
        if weak(r["password"], mail.split("@")[0]):
            return "WEAK_PASSWORD"
        if self.by_mail(mail) or mail in self.users:
            return "USER_EXISTS"
        self.add_user(mail, at, display_name=r["name"].strip(), role=i["role"],
                      is_admin=i["role"] == "admin", password_hash=r["password_hash"],
                      status="ACTIVE", approved_at=at, email=mail,
                      company_id=i["company_id"], verified=True)
        i["accepted_at"] = at
        self.note(mail, "INVITE_ACCEPT", f"company={i['company_id']} role={i['role']}", at)
        return None

    def password(self, r):
        u, at = self.users.get(r["user_id"]), r["request_ts"]
        if weak(r["new_password"], r["user_id"]):
            return "WEAK_PASSWORD"
        if u is None:
            return "USER_NOT_FOUND"
        if not r["old_ok"]:
            return "LOGIN_FAILED"
        if r["same_as_old"]:
            return "SAME_PASSWORD"
        u.update(password_hash=r["new_hash"], password_changed_at=at)
        self.end_sessions({r["user_id"]}, at)
        self.note(r["user_id"], "PW_CHANGE", None, at)
        return None
