"""Tenant isolation and permissions on any DataFrame."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenantlake import config


@dataclass(frozen=True)
class Scope:
    """Whose rows may be seen. Passed explicitly: a lazy plan outlives any context.

    No company and no super: an unscoped batch job, nothing is filtered.
    Super: an operator of the service, who never sees tenant rows.
    """

    company_id: str | None = None
    actor: str | None = None
    role: str | None = None
    is_super: bool = False

    def __post_init__(self) -> None:
        if self.company_id and not re.fullmatch(config.COMPANY_ID_PATTERN, self.company_id):
            raise ValueError(f"not a company id: {self.company_id!r}")
        if not self.company_id and not self.is_super and (self.actor or self.role):
            raise ValueError("a person without a company has no scope")

    @property
    def company(self) -> str | None:
        return self.company_id or None

    @property
    def applies(self) -> bool:
        """Is there anything to filter? True for super, although super has no company."""
        return self.is_super or self.company is not None


UNSCOPED = Scope()


def scoped_rows(df: DataFrame, scope: Scope, column: str = "company_id") -> DataFrame:
    """Rows of a table that carries the company itself; a NULL company is nobody's."""
    if scope.is_super:
        return df.filter(F.lit(False))
    if scope.company is None:
        return df
    return df.filter(F.col(column) == scope.company)


def scoped_by_evidence(df: DataFrame, evidence: DataFrame, scope: Scope,
                       column: str = "evidence_id") -> DataFrame:
    """Rows of a table that belongs to a company only through its evidence."""
    if scope.is_super:
        return df.filter(F.lit(False))
    if scope.company is None:
        return df
    own = scoped_rows(evidence, scope).select(F.col("evidence_id").alias(column))
    return df.join(own, column, "left_semi")


def _asked_for(requests: DataFrame, evidence: DataFrame) -> DataFrame:
    """The evidence the requests name; the rest of the table is not moved."""
    keys = requests.select("evidence_id").distinct()
    return evidence.select("evidence_id", "company_id").join(keys, "evidence_id", "left_semi")


def ownership(requests: DataFrame, evidence: DataFrame, scope: Scope) -> DataFrame:
    """`requests` plus `owned`. Unknown evidence counts as owned, so that the later
    not-found answer is the same for missing and for foreign ids."""
    if scope.is_super:
        return requests.withColumn("owned", F.lit(False))
    if scope.company is None:
        return requests.withColumn("owned", F.lit(True))
    owners = _asked_for(requests, evidence).groupBy("evidence_id").agg(
        F.max(F.coalesce(F.col("company_id") == scope.company, F.lit(False))).alias("_mine"))
    return (requests.join(owners, "evidence_id", "left")
            .withColumn("owned", F.coalesce("_mine", F.lit(True))).drop("_mine")
            .select(*requests.columns, "owned"))


def ownership_per_request(requests: DataFrame, evidence: DataFrame) -> DataFrame:
    """The same check when each request brings its own company_id and is_super."""
    wanted = requests.select("evidence_id", "company_id").distinct()
    held = _asked_for(requests, evidence).join(
        wanted.withColumnRenamed("company_id", "_asking"), "evidence_id").groupBy(
        "evidence_id", "_asking").agg(F.max(F.coalesce(
            F.col("company_id") == F.col("_asking"), F.lit(False))).alias("_mine"))
    owned = (
        F.when(F.coalesce("is_super", F.lit(False)), F.lit(False))
        .when(F.col("company_id").isNull(), F.lit(True))
        .otherwise(F.coalesce("_mine", F.lit(True))))
    found = requests.join(held.withColumnRenamed("_asking", "company_id"),
                          ["evidence_id", "company_id"], "left")
    return found.withColumn("owned", owned).select(*requests.columns, "owned")


def split_by_ownership(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(owned, rejected); rejected rows carry the error code."""
    rejected = checked.filter(~F.col("owned")).drop("owned")
    return (checked.filter("owned").drop("owned"),
            rejected.withColumn("error_code", F.lit("EVIDENCE_NOT_FOUND")))


def _permitted(matrix: dict[str, tuple[str, ...]], outer: str, inner: str) -> Column:
    """A permission matrix is a dozen constants, so it is an expression, not a join."""
    cells = [(F.col(outer) == o) & F.col(inner).isin(*allowed)
             for o, allowed in matrix.items() if allowed]
    return F.coalesce(reduce(or_, cells), F.lit(False))


def check_permissions(requests: DataFrame) -> DataFrame:
    """Add `allowed`: may this role do this action? Unknown roles and actions, super: no."""
    return requests.withColumn("allowed", _permitted(config.PERMISSIONS, "action", "role"))


def check_grants(requests: DataFrame) -> DataFrame:
    """Add `allowed`: may this role touch evidence in this way?"""
    return requests.withColumn("allowed",
                               _permitted(config.EVIDENCE_GRANTS, "role", "action"))


def can(role: str, action: str) -> bool:
    return role in config.PERMISSIONS.get(action, ())


def denied_attempts(attempts: DataFrame) -> DataFrame:
    """Audit rows for operators who tried to touch tenant evidence.

    `attempts` has occurred_at, actor, role, is_super, action, evidence_id and
    evidence_version; only rows of operators without a grant become audit rows.
    """
    tried = attempts.filter(F.coalesce("is_super", F.lit(False)))
    return check_grants(tried).filter(~F.col("allowed")).select(
        "occurred_at",
        F.coalesce(F.nullif("actor", F.lit("")), F.lit(config.ANONYMOUS_ACTOR)).alias("actor"),
        F.coalesce("role", F.lit("")).alias("role"),
        "action", "evidence_id",
        F.coalesce("evidence_version", F.lit(1)).alias("evidence_version"),
        F.lit("DENIED").alias("outcome"))
