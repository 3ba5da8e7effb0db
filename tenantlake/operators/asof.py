"""As-of look-up: the last fact of a key before an event, and the first one after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenantlake.session import ensure_checkpoint_dir

_FACT, _EVENT = 0, 1


def with_facts_around(events: DataFrame, facts: DataFrame, key: str, at: str, tie: str,
                      later: str = "true") -> DataFrame:
    """Add `before`, the last fact of the event's key at or before its time, and `after`, the
    first later one for which the SQL expression `later` holds; NULL where there is none.

    Facts with no time come before everything; of facts with one time the highest `tie` is the
    last. Events and facts are cut together into slices of a range partitioning on (key, time),
    so a key that owns a third of the rows spreads. The last and first facts of the slices,
    one row for each key in a slice, are carried over to the slices beside them. Events without
    a key get neither. Other columns of the events are kept, whatever their names.
    """
    ensure_checkpoint_dir(events.sparkSession)
    fact = F.struct(*facts.columns)
    known = facts.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(_FACT).alias("_side"),
        F.col(tie).cast("bigint").alias("_tie"), fact.alias("_fact"),
        F.when(F.expr(later), fact).alias("_later"))
    asked = events.select(
        F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(_EVENT).alias("_side"),
        F.lit(0).cast("bigint").alias("_tie"), F.struct(*events.columns).alias("_event"))
    order = ["_key", "_at", "_side", "_tie"]
    cut = (asked.unionByName(known, allowMissingColumns=True).repartitionByRange(*order)
           .withColumn("_slice", F.spark_partition_id()).checkpoint())
    inside, place = Window.partitionBy("_key", "_slice"), ["_at", "_side", "_tie"]
    # Frames that grow: one that shrinks is read again from every row to its end.
    own_before = F.last("_fact", ignorenulls=True).over(
        inside.orderBy(*place).rowsBetween(Window.unboundedPreceding, 0))
    own_after = F.last("_later", ignorenulls=True).over(
        inside.orderBy(*map(F.desc, place)).rowsBetween(Window.unboundedPreceding, 0))
    moment = F.struct("_at", "_tie")
    ends = cut.groupBy("_key", "_slice").agg(
        F.max_by("_fact", F.when(F.col("_fact").isNotNull(), moment)).alias("_last"),
        F.min_by("_later", F.when(F.col("_later").isNotNull(), moment)).alias("_first"))
    across = Window.partitionBy("_key")
    earlier = across.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    further = across.orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        F.col("_key").alias("_k"), F.col("_slice").alias("_s"),
        F.last("_last", ignorenulls=True).over(earlier).alias("_from"),
        F.last("_first", ignorenulls=True).over(further).alias("_to"))
    placed = cut.withColumn("_before", own_before).withColumn("_after", own_after).filter(
        F.col("_side") == _EVENT)
    same = (F.col("_key").eqNullSafe(F.col("_k"))) & (F.col("_slice") == F.col("_s"))
    return placed.join(carried, same, "left").select(
        "_event.*", F.coalesce("_before", "_from").alias("before"),
        F.coalesce("_after", "_to").alias("after"))
