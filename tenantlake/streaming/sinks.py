"""Where the folded login stream goes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tenantlake.operators.lockout import (
    login_log_rows, login_sessions, login_states, with_login_states)
from tenantlake.operators.logs import new_log_rows
from tenantlake.schemas import USER_SESSION
from tenantlake.sources.outcomes import LOG, last_log_number
from tenantlake.sources.tables import BY_DAY
from tenantlake.sources.versions import (
    StaleVersion, commit_version, current_version, read_current)

SESSIONS, USERS, STATES = "user_session", "app_user", "login_state"


def append_log_files(log_rows: DataFrame, path: str, checkpoint: str,
                     **trigger) -> StreamingQuery:
    """Log rows as files, exactly once; numbers are given when the log is merged."""
    return (log_rows.writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(**trigger).start())


def _query_id(spark: SparkSession) -> str:
    """Id of the streaming query that runs the batch; it lives in the query's checkpoint."""
    found = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not found:
        raise ValueError("outside a streaming query name the source of the batch numbers")
    return found


def merge_batch(root: str, tokens: DataFrame | None = None, source: str | None = None,
                gate: Callable[[DataFrame], DataFrame] | None = None
                ) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: log, sessions and account states of a micro-batch become
    one version. Only new files are written: the account table is not rewritten, the
    states are laid over it on reading (`current_accounts`) and folded into it now and
    then (`compact_accounts`). A batch replayed after a failure is not applied twice; a
    query with a new checkpoint is another source.

    `tokens` (attempt_id, token) are the staged secrets of the attempts. A session is
    stored under the hash of its token, so without tokens no sessions are written. `gate`
    judges the log-ins of a batch by what is known of their companies (`company_gate`)."""

    def apply(folded: DataFrame, batch_id: int) -> None:
        own = source or _query_id(folded.sparkSession)
        folded = (gate(folded) if gate else folded).persist()
        try:
            while not _merged(folded, root, tokens, f"{own}:{batch_id}"):
                pass  # another stream took these log numbers; it has published, so this ends
        finally:
            folded.unpersist()

    return apply


def _merged(folded: DataFrame, root: str, tokens: DataFrame | None, batch: str) -> bool:
    """One attempt to publish a batch, numbered after the log as it is now."""
    spark = folded.sparkSession
    version = current_version(spark, root)
    last = last_log_number(spark, root, version)
    rows = login_log_rows(folded)
    states = login_states(folded).withColumn(
        "batch", F.lit((version or {"number": 0})["number"] + 1).cast("bigint"))
    added = {LOG: new_log_rows(None, rows, last), STATES: states}
    if tokens is not None:
        added[SESSIONS] = login_sessions(folded, tokens).select(*USER_SESSION.names)
    try:
        commit_version(spark, root, {}, added, batch=batch,
                       marks={LOG: last + rows.count()}, read=version)
    except StaleVersion:
        return False
    return True


def current_accounts(spark: SparkSession, root: str,
                     version: dict | None = None) -> DataFrame:
    """The account table with the latest login state of each account laid over it."""
    version = version or current_version(spark, root)
    users = read_current(spark, root, USERS, version)
    if STATES not in version["tables"]:
        return users
    newest = F.max(F.struct("batch", "failed_count", "locked_until"))
    states = read_current(spark, root, STATES, version).groupBy("user_id").agg(
        newest.alias("s"), F.max("login_at").alias("login_at"))
    return with_login_states(users, states.select(
        "user_id", "s.failed_count", "s.locked_until", "login_at"))


def compact_accounts(spark: SparkSession, root: str) -> int:
    """Write the overlaid accounts as a new snapshot and drop the states that are in it. States
    of batches that are merged meanwhile stay, so a busy stream does not stop it; if the
    account table itself is replaced meanwhile, StaleVersion is raised and nothing changes."""
    version = current_version(spark, root)
    return commit_version(spark, root, {USERS: current_accounts(spark, root, version)},
                          folded=(STATES,), read=version)


def compact_appended(spark: SparkSession, root: str, names: tuple[str, ...] = (LOG, SESSIONS)
                     ) -> int:
    """Write tables that were appended to as one snapshot each, sorted by account and time, so
    an account with a third of the rows is many tasks. Files added meanwhile stay."""
    version = current_version(spark, root)
    held = [n for n in names if n in version["tables"]]
    whole = {}
    for n in held:
        time, account = BY_DAY[n]
        whole[n] = (read_current(spark, root, n, version).repartitionByRange(account, time)
                    .sortWithinPartitions(account, time))
    return commit_version(spark, root, {}, whole, read=version, folded=tuple(held))


def merge_logins(folded: DataFrame, root: str, checkpoint: str,
                 tokens: DataFrame | None = None,
                 gate: Callable[[DataFrame], DataFrame] | None = None,
                 **trigger) -> StreamingQuery:
    return (folded.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
            .foreachBatch(merge_batch(root, tokens, gate=gate)).trigger(**trigger).start())
