"""Changing tables that are stored by day: only the days that hold changed rows are written.

New files of a day are written beside the old ones and take their place when the job commits
(dynamic partition overwrite), so a failed job changes nothing. Days are exchanged one by one
then; readers that must not see a mixture read a published version instead.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenantlake.operators.accounts import gone
from tenantlake.operators.outcome import Outcome, settle
from tenantlake.schemas import TABLES
from tenantlake.sources.tables import BY_DAY, by_day

KEYS = {"user_session": "session_id", "user_login_log": "log_id", "access_event": "id"}
_NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def _stored(spark: SparkSession, root: str, name: str) -> DataFrame:
    schema = T.StructType([*TABLES[name].fields, T.StructField("day", T.DateType())])
    return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{name}")


def _among(days: list[date | None]) -> Column:
    known = [F.lit(d) for d in days if d is not None]
    inside = F.col("day").isin(known) if known else F.lit(False)
    return (inside | F.col("day").isNull()) if None in days else inside


def _rewrite(rows: DataFrame, root: str, name: str) -> None:
    """Exchange the days of these rows. They are settled first, since they come from there."""
    settled = settle(rows.drop("day"))
    (by_day(settled, name).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("day").parquet(f"{root.rstrip('/')}/{name}"))


def replace_rows(spark: SparkSession, root: str, name: str, rows: DataFrame) -> list[date]:
    """Put new values of known rows in place; returns the days that were written.

    A row's time, which gives its day, stays. Days without a changed row are neither read nor
    written. The list has one entry for each stored day at most.
    """
    time, key = BY_DAY[name][0], KEYS[name]
    new = settle(rows)
    days = [r.day for r in new.select(F.to_date(time).alias("day")).distinct().collect()]
    if days:
        held = _stored(spark, root, name).filter(_among(days)).drop("day")
        kept = held.join(new.select(key).distinct(), key, "left_anti")
        _rewrite(kept.unionByName(new.select(*kept.columns)), root, name)
    return sorted(days, key=lambda d: (d is not None, d))


def apply_changes(spark: SparkSession, root: str, outcome: Outcome) -> dict[str, list[date]]:
    """Write what a batch changed in the tables that are stored by day."""
    return {name: replace_rows(spark, root, name, rows)
            for name, rows in outcome.changes.items() if name in BY_DAY}


@dataclass(frozen=True)
class Purged:
    """Days whose folder went, days that were rewritten, and the sessions removed."""

    dropped: list[date | None]
    rewritten: list[date | None]
    sessions: int


def purge_days(spark: SparkSession, root: str, cutoff: datetime,
               name: str = "user_session") -> Purged:
    """M16 on sessions stored by day: days on which every session is over go with their folder,
    days on which some are over are rewritten, the others are not touched.

    Which are which comes from one scan of two columns, a count for each day.
    """
    stored = _stored(spark, root, name)
    counts = stored.groupBy("day").agg(
        F.count("*").alias("n"), F.count_if(gone(cutoff)).alias("over")).filter("over > 0")
    found = sorted(counts.collect(), key=lambda r: (r.day is not None, r.day))
    border = [r.day for r in found if r.over < r.n]
    if border:
        _rewrite(stored.filter(_among(border)).filter(~gone(cutoff)), root, name)
    whole = [r.day for r in found if r.over == r.n]
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for day in whole:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(path, f"day={day or _NO_DAY}"), True)
    return Purged(whole, border, sum(r.over for r in found))
