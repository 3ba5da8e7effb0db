"""The append-only account activity log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenantlake import config
from tenantlake.functions.text import blank_to_null
from tenantlake.operators.keyed import largest_number, number_rows

LOG_COLUMNS = ("log_id", "user_id", "event", "detail", "at")


def log_row(user_id: Column | str, event: Column | str, detail: Column | None = None,
            seq: int = 0, at: str = "request_ts") -> list[Column]:
    """Columns of one log row that belongs to a request; `event` may be a plain code."""
    user = F.col(user_id) if isinstance(user_id, str) else user_id
    code = F.lit(event) if isinstance(event, str) else event
    text = F.lit(None).cast("string") if detail is None else detail
    return [F.col("request_id"), F.lit(seq).alias("seq"), user.alias("user_id"),
            code.alias("event"), text.alias("detail"), F.col(at).alias("at")]


def by(actor: Column | str = "actor") -> Column:
    """`by=<actor>`; a request without an actor says so in the same place."""
    who = F.col(actor) if isinstance(actor, str) else actor
    return F.concat(F.lit("by="), F.coalesce(who, F.lit("None")))


def new_log_rows(log: DataFrame | None, rows: DataFrame, last: int | None = None) -> DataFrame:
    """The rows with their numbers, continuing the log in (at, request_id, seq) order.

    The last number is read from the log unless the caller keeps it.
    """
    if last is None:
        top = largest_number(log, "log_id")
    else:
        top = rows.sparkSession.range(last, last + 1).withColumnRenamed("id", "top")
    return number_rows(rows, ["at", "request_id", "seq"], "log_id", top).select(
        "log_id", "user_id", "event",
        blank_to_null(F.substring("detail", 1, config.DETAIL_LENGTH)).alias("detail"), "at")


def append_log(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The log with the rows added; to store it, append `new_log_rows` instead."""
    return log.select(*LOG_COLUMNS).unionByName(new_log_rows(log, rows))
