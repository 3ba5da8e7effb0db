"""Feeding stored attempts through the streaming fold, one time window after another."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenantlake.operators.lockout import FOLD_SCHEMA
from tenantlake.schemas import ATTEMPTS
from tenantlake.session import scratch_folder
from tenantlake.streaming.logins import STATE_STORE, stream_logins

CLOSING_ID = -1


def _streaming_session(spark: SparkSession, partitions: int | None) -> SparkSession:
    """Same application, own settings: the state store must be RocksDB.

    The number of state partitions is fixed by a stream's first start and every one is a task
    in every micro-batch, so it is chosen for the accounts, not for the cluster of the day:
    `partitions`, or the shuffle partitions of the session.
    """
    other = spark.newSession()
    other.conf.set("spark.sql.ansi.enabled", spark.conf.get("spark.sql.ansi.enabled"))
    other.conf.set("spark.sql.shuffle.partitions",
                   str(partitions or spark.conf.get("spark.sql.shuffle.partitions")))
    for key, value in STATE_STORE.items():
        other.conf.set(key, value)
    return other


def replay(attempts: DataFrame, users: DataFrame, windows: int = 3,
           delay: str = "15 minutes", state_partitions: int | None = None) -> DataFrame:
    """All attempts folded by the stream.

    Each window is appended to the source folder and the query is started again from its
    checkpoint. A last attempt, a day later, moves the watermark past everything before
    it; being the newest, it stays in the state and gives no row.
    """
    spark = attempts.sparkSession
    folder = scratch_folder(spark, "replay")
    source, sink, progress = f"{folder}/in", f"{folder}/out", f"{folder}/progress"
    rows = attempts.select(*ATTEMPTS.names)
    first, last = rows.agg(F.min("at"), F.max("at")).first()
    if first is None:
        return spark.createDataFrame([], FOLD_SCHEMA)
    edges = [first + (last - first) * i / windows for i in range(1, windows)]
    inside = [(None if i == 0 else edges[i - 1], edges[i] if i < windows - 1 else None)
              for i in range(windows)]
    accounts = f"{folder}/users"
    users.write.parquet(accounts)
    session = _streaming_session(spark, state_partitions)
    parts = []
    for low, high in inside:
        piece = rows
        if low is not None:
            piece = piece.filter(F.col("at") >= F.lit(low))
        if high is not None:
            piece = piece.filter(F.col("at") < F.lit(high))
        parts.append(piece)
    closing = spark.createDataFrame(
        [(CLOSING_ID, "closing", last + timedelta(days=1), False)], ATTEMPTS)
    for piece in (*parts, closing):
        piece.write.mode("append").parquet(source)
        stream = session.readStream.schema(ATTEMPTS).parquet(source)
        folded = stream_logins(stream, session.read.parquet(accounts), delay=delay)
        (folded.writeStream.format("parquet").outputMode("append").option("path", sink)
         .option("checkpointLocation", progress).trigger(availableNow=True).start()
         .awaitTermination())
    return spark.read.schema(FOLD_SCHEMA).parquet(sink)
