"""Team feeds kept up to date beside the log, so that a report never reads the log again.

Kept are the newest rows of every owner: of each account, and of each company that a detail
names. The newest rows of a company are among those of its people and its own, so feeds stay
exact when people change their company, without going back to the log. What is kept has at
most `limit` rows an owner, however long the log is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenantlake import config
from tenantlake.functions.text import words
from tenantlake.plans.reports import _feed_row, _team_events
from tenantlake.sources.versions import _path

KEPT = ("owner_kind string, owner string, log_id bigint, user_id string, event string, "
        "detail string, at timestamp_ntz")


def _newest(rows: DataFrame, owner: list[str], limit: int) -> DataFrame:
    newest = Window.partitionBy(*owner).orderBy(F.desc("log_id"))
    return (rows.dropDuplicates([*owner, "log_id"])
            .withColumn("_r", F.row_number().over(newest))
            .filter(F.col("_r") <= int(limit)).drop("_r"))


def kept_rows(log: DataFrame, limit: int = config.TEAM_AUDIT_PAGE) -> DataFrame:
    """The newest team events of every owner in these log rows."""
    mark = "company="
    named = F.transform(F.filter(words("detail"), lambda w: w.startswith(mark)),
                        lambda w: F.struct(F.lit("company").alias("owner_kind"), F.substring(
                            w, F.lit(len(mark) + 1), F.length(w)).alias("owner")))
    account = F.array(F.struct(F.lit("account").alias("owner_kind"),
                               F.col("user_id").alias("owner")))
    rows = _team_events(log).withColumn("_o", F.explode(F.array_distinct(
        F.concat(account, F.coalesce(named, F.array().cast(
            "array<struct<owner_kind: string, owner: string>>"))))))
    owned = rows.select("_o.*", "log_id", "user_id", "event", "detail", "at").filter(
        F.col("owner").isNotNull())
    return _newest(owned, ["owner_kind", "owner"], limit)


def merged(*parts: DataFrame, limit: int = config.TEAM_AUDIT_PAGE) -> DataFrame:
    """Kept rows of several stretches of the log together; a stretch given twice counts once."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return _newest(whole, ["owner_kind", "owner"], limit)


def team_feeds(kept: DataFrame, users: DataFrame,
               limit: int = config.TEAM_AUDIT_PAGE) -> DataFrame:
    """The feed of every company from kept rows, with the people it has now."""
    homes = (users.filter(F.col("email").isNotNull() & F.col("company_id").isNotNull())
             .select(F.col("email").alias("owner"), "company_id"))
    people = kept.filter(F.col("owner_kind") == "account").join(homes, "owner")
    named = kept.filter(F.col("owner_kind") == "company").withColumn(
        "company_id", F.col("owner"))
    columns = ["company_id", "log_id", "user_id", "event", "detail", "at"]
    rows = people.select(*columns).unionByName(named.select(*columns))
    return _newest(rows, ["company_id"], limit).select(*_feed_row("company_id"))


def _finished(spark: SparkSession, root: str) -> dict[str, list[int]]:
    """Batches whose folders are complete: of one batch, and of everything up to one."""
    found = {}
    for kind in ("whole", "part"):
        fs, path = _path(spark, f"{root.rstrip('/')}/{kind}")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        found[kind] = sorted(int(n) for n in names if n.isdigit() and fs.exists(
            _path(spark, f"{root.rstrip('/')}/{kind}/{n}/_SUCCESS")[1]))
    return found


def read_kept(spark: SparkSession, root: str, before: int | None = None,
              limit: int = config.TEAM_AUDIT_PAGE) -> DataFrame:
    """What is kept below `root`: the last whole state and the batches after it."""
    done = _finished(spark, root)
    wholes, parts = ([b for b in done[k] if before is None or b < before]
                     for k in ("whole", "part"))
    start = wholes[-1] if wholes else -1
    paths = [f"{root.rstrip('/')}/part/{b}" for b in parts if b > start]
    if wholes:
        paths.append(f"{root.rstrip('/')}/whole/{start}")
    if not paths:
        return spark.createDataFrame([], KEPT)
    return merged(spark.read.schema(KEPT).parquet(*paths), limit=limit)


def keep_feeds(root: str, every: int = 50, limit: int = config.TEAM_AUDIT_PAGE
               ) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for new log rows. A batch writes its own newest rows, each
    `every`-th one the whole state, so a reader opens at most `every` folders. Folders are
    named by batch: one that is repeated after a failure writes the same again. One query
    owns `root`, and a query with a new checkpoint needs a new one."""

    def apply(rows: DataFrame, batch_id: int) -> None:
        part, spark = kept_rows(rows, limit), rows.sparkSession
        kind = "part"
        if (batch_id + 1) % every == 0:
            kind = "whole"
            part = merged(read_kept(spark, root, batch_id, limit), part, limit=limit)
        part.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{kind}/{batch_id}")

    return apply
