"""Committing what a batch of requests gives: its tables and its log rows as one version."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tenantlake.operators.keyed import largest_number
from tenantlake.operators.logs import new_log_rows
from tenantlake.operators.outcome import Outcome
from tenantlake.sources.versions import commit_version, current_version, read_current

LOG = "user_login_log"


def last_log_number(spark: SparkSession, root: str, version: dict | None) -> int:
    """Kept with the version; read from the log only before the first batch."""
    if version is None or LOG not in version["tables"]:
        return 0
    if LOG in version["marks"]:
        return version["marks"][LOG]
    return largest_number(read_current(spark, root, LOG), "log_id").first().top


def commit_outcome(spark: SparkSession, root: str, outcome: Outcome, read: dict | None = None,
                   batch: str | None = None) -> int:
    """Publish the changed tables and the numbered log rows of a batch together.

    `read` is the version whose tables the batch was judged on (default: the current one). If
    another writer has published since, StaleVersion is raised, nothing has changed, and the
    batch has to be judged again. A `batch` ("source:number") counts once. Nothing is committed
    where every request was rejected: the version stays as it is.
    """
    before = read or current_version(spark, root)
    n = outcome.log_rows.count()
    if n == 0:
        return before["number"] if before else 0
    last = last_log_number(spark, root, before)
    return commit_version(
        spark, root, outcome.tables, {LOG: new_log_rows(None, outcome.log_rows, last)},
        batch=batch, marks={LOG: last + n}, read=before)
