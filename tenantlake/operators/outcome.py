"""What applying a batch of requests gives, and the steps all batches share.

A batch is judged as a whole but must end as if its requests had been applied one after
another in (request_ts, request_id) order. The winner of a key is therefore the earliest
request that is clean by itself; it is found by an aggregate, never by ranking a group.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenantlake.functions.rules import http_status
from tenantlake.operators.keyed import Update, first_per_key, matching_keys
from tenantlake.schemas import APP_USER
from tenantlake.session import scratch_folder

ORDER = ["request_ts", "request_id"]


@dataclass(frozen=True)
class Outcome:
    """`tables`: new versions of the changed tables. `verdicts`: every request with its
    `error_code`, NULL when accepted. `log_rows`: what the accepted ones log. `changes`: where
    the batch only changes rows (M3, M5-M8, M14, M15), those rows alone with their new values,
    so that a store can rewrite the days that hold them and nothing else."""

    tables: dict[str, DataFrame]
    verdicts: DataFrame
    log_rows: DataFrame
    changes: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def of_updates(cls, updates: dict[str, Update], verdicts: DataFrame,
                   log_rows: DataFrame) -> Outcome:
        return cls({name: u.whole() for name, u in updates.items()}, verdicts, log_rows,
                   {name: u.rows() for name, u in updates.items()})

    @property
    def accepted(self) -> DataFrame:
        return self.verdicts.filter(F.col("error_code").isNull())

    @property
    def rejected(self) -> DataFrame:
        return self.verdicts.filter(F.col("error_code").isNotNull()).withColumn(
            "http_status", http_status("error_code"))


def once(requests: DataFrame) -> DataFrame:
    """Each request_id once: of repeated deliveries the earliest, as all columns order it."""
    rest = [c for c in requests.columns if c not in ORDER]
    return first_per_key(requests, ["request_id"], ["request_ts"], rest).select(
        *requests.columns)


def applied_once(operator: Callable[..., Outcome]) -> Callable[..., Outcome]:
    """The operator with every staged request taken once."""
    signature = inspect.signature(operator)

    @wraps(operator)
    def run(*args, **kwargs) -> Outcome:
        given = signature.bind(*args, **kwargs)
        given.arguments["requests"] = once(given.arguments["requests"])
        return operator(*given.args, **given.kwargs)

    return run


def settle(requests: DataFrame) -> DataFrame:
    """Write a batch with what was looked up for it to the shared folder and read it back.

    Finding winners and writing the outputs (tables, log, rejects) then read the batch,
    which is small, and not the tables it was checked against, which are not. A written
    table also has a known size, so Spark broadcasts what comes from it exactly while it
    is small enough, and the large tables stay where they are; a checkpointed plan would
    keep the size estimate of its joins.
    """
    spark = requests.sparkSession
    path = scratch_folder(spark, "batch")
    requests.write.parquet(path)
    return spark.read.schema(requests.schema).parquet(path)


def flag_existing(requests: DataFrame, table: DataFrame, key: str, flag: str,
                  table_key: str | None = None) -> DataFrame:
    """Mark requests whose key is in the table, without moving the table."""
    column = table_key or key
    keys = table.select(F.col(column).alias(key)).filter(F.col(key).isNotNull())
    found = matching_keys(keys, requests, key).distinct().withColumn(flag, F.lit(True))
    return (requests.join(found, key, "left")
            .withColumn(flag, F.coalesce(flag, F.lit(False))))


def account_ids(users: DataFrame) -> DataFrame:
    """Every mail and every id an account goes by, in one column `email` from one scan."""
    return users.select(F.explode(F.array("email", "user_id")).alias("email"))


def lookup(requests: DataFrame, table: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Requests with columns (new name -> table column) of the row with their key."""
    wanted = table.join(requests.select(key).distinct(), key, "left_semi")
    return requests.join(
        wanted.select(key, *[F.col(c).alias(n) for n, c in columns.items()]), key, "left")


def with_winner(requests: DataFrame, clean: Column, key: str,
                keep: list[str] = ()) -> DataFrame:
    """Add w_request_ts, w_request_id (and w_<keep>) of the first clean request per key."""
    winners = first_per_key(requests.filter(clean), [key], ORDER, list(keep))
    return requests.join(
        winners.select(key, *[F.col(c).alias(f"w_{c}") for c in (*ORDER, *keep)]), key, "left")


def is_winner() -> Column:
    return F.col("request_id") == F.col("w_request_id")


def after_winner() -> Column:
    return F.coalesce(F.struct(*ORDER) > F.struct("w_request_ts", "w_request_id"),
                      F.lit(False))


def user_rows(accepted: DataFrame, **columns: Column) -> DataFrame:
    """New account rows: given columns, `request_ts` as creation time, defaults."""
    values = {
        "is_admin": F.lit(False), "is_super": F.lit(False), "failed_count": F.lit(0),
        "created_at": F.col("request_ts"), "password_changed_at": F.col("request_ts"),
        "password_hash": F.col("password_hash"), "verified": F.lit(False), **columns}
    return accepted.select(*[
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in APP_USER])


def staged_text(requests: DataFrame, column: str) -> Column:
    """A column staging may leave out (passwords), NULL then."""
    return F.col(column) if column in requests.columns else F.lit(None).cast("string")
