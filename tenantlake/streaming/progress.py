"""What a running stream says about itself: rows that came too late, and its state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tenantlake.operators.lockout import NEVER, account_states

_LATE = ("query_id string, run_id string, batch_id bigint, started string, watermark string, "
         "rows_read bigint, rows_late bigint")


class LateRows(StreamingQueryListener):
    """Writes for every micro-batch how many rows it read and how many came after the
    watermark and were dropped. Register it with `spark.streams.addListener`; one listener
    serves all streams of the session. A batch that is run again is written again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        if p.numInputRows or late:
            row = (str(p.id), str(p.runId), p.batchId, p.timestamp,
                   p.eventTime.get("watermark"), p.numInputRows, late)
            self.spark.createDataFrame([row], _LATE).coalesce(1).write.mode("append").parquet(
                self.path)

    def onQueryTerminated(self, event) -> None:
        pass


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """One row for every batch of every query; of a batch that was run again the last run."""
    last = F.max_by(F.struct("started", "watermark", "rows_read", "rows_late"), "started")
    return (spark.read.schema(_LATE).parquet(path).groupBy("query_id", "batch_id")
            .agg(last.alias("run")).select("query_id", "batch_id", "run.*"))


def stored_state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """A state variable of the log-in stream as its checkpoint holds it, "account" or "pending":
    user_id and value, the latter for each account or each waiting row.

    The session must name the state store of the stream (`logins.STATE_STORE`).
    """
    found = (spark.read.format("statestore").option("path", checkpoint)
             .option("stateVarName", name).load())
    if name == "pending":
        rows = found.select(F.explode("user_map_value.rows").alias("value"))
        return rows.select("value.user_id", "value")
    return found.select("user_map_key.user_id", F.col("user_map_value").alias("value"))


def state_differences(spark: SparkSession, checkpoint: str, users: DataFrame) -> DataFrame:
    """Accounts whose counter or lock in the state of the stream differs from the table, and
    ids that are only in one of them (`side` state or table). Empty after a replay whose
    results were merged into `users`."""
    own = stored_state(spark, checkpoint, "account").select(
        F.col("user_id").alias("in_state"), F.col("value.failed").alias("state_failed"),
        F.col("value.locked").alias("state_locked"), F.col("value.status").alias("state_status"))
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"),
                              F.col("locked_until"))
    table = account_states(users).select(
        "user_id", "status", "failed_count",
        F.coalesce(micros, F.lit(NEVER)).alias("locked"))
    same = ((F.col("state_failed") == F.col("failed_count"))
            & (F.col("state_locked") == F.col("locked"))
            & F.col("state_status").eqNullSafe(F.col("status")))
    both = own.join(table, own["in_state"] == table["user_id"], "full")
    side = F.when(F.col("user_id").isNull(), "state").when(
        F.col("in_state").isNull(), "table").when(~same, "both")
    return both.withColumn("side", side).filter("side is not null").select(
        F.coalesce("user_id", "in_state").alias("user_id"), "side", "state_failed",
        "failed_count", "state_locked", "locked", "state_status", "status")
