"""Keyed table operations that every state change is built from.

The tables are large and the change sets small, so nothing here shuffles a whole table
unless the change set is large too: updates are left joins with at most one row per key
on the right (broadcast by Spark itself while it is below its size threshold), inserts
are looked up through the matching keys only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenantlake.session import ensure_checkpoint_dir


def first_per_key(df: DataFrame, keys: list[str], order: list[str],
                  keep: list[str] = ()) -> DataFrame:
    """Earliest row per key as an aggregate, so hot keys shrink before the shuffle."""
    picked = F.min(F.struct(*order, *keep))
    return df.groupBy(*keys).agg(picked.alias("_p")).select(*keys, "_p.*")


def last_per_key(df: DataFrame, keys: list[str], order: list[str],
                 keep: list[str] = ()) -> DataFrame:
    picked = F.max(F.struct(*order, *keep))
    return df.groupBy(*keys).agg(picked.alias("_p")).select(*keys, "_p.*")


def matching_keys(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The wanted keys that exist in the table; reads one column, keeps the match only.

    The wanted keys are made distinct first: a key repeated by a third of the batch
    would otherwise sit in one partition of the side that a semi join cannot split.
    """
    return table.select(key).join(wanted.select(key).distinct(), key, "left_semi")


def insert_ignore(table: DataFrame, new: DataFrame, key: str,
                  order: list[str] | None = None) -> DataFrame:
    """Add rows whose key is neither in the table nor earlier in the batch."""
    rest = [c for c in new.columns if c != key and c not in (order or [])]
    rows = first_per_key(new, [key], order or [], rest)
    fresh = rows.join(matching_keys(table, rows, key), key, "left_anti")
    return table.unionByName(fresh.select(*table.columns))


def update_by_key(table: DataFrame, changes: DataFrame, key: str,
                  setters: dict[str, Column]) -> DataFrame:
    """Overwrite some columns of the rows that have a change; one change per key.

    A setter may use table columns and, prefixed `c_`, the columns of the change.
    """
    renamed = changes.select(
        F.col(key), F.lit(True).alias("_hit"),
        *[F.col(c).alias(f"c_{c}") for c in changes.columns if c != key])
    joined = table.join(renamed, key, "left")
    return joined.select(*[
        F.when(F.col("_hit"), setters[c]).otherwise(F.col(c)).alias(c)
        if c in setters else F.col(c) for c in table.columns])


@dataclass(frozen=True)
class Update:
    """New values for some columns of the rows that have a change; see `update_by_key`."""

    table: DataFrame
    changes: DataFrame
    key: str
    setters: dict[str, Column]

    def whole(self) -> DataFrame:
        """The whole table after the change."""
        return update_by_key(self.table, self.changes, self.key, self.setters)

    def rows(self) -> DataFrame:
        """Only the rows that are not what they were, with their new values."""
        renamed = self.changes.select(F.col(self.key), *[
            F.col(c).alias(f"c_{c}") for c in self.changes.columns if c != self.key])
        joined = self.table.join(renamed, self.key)
        changed = [f"n_{c}" for c in self.setters]
        new = joined.select(*self.table.columns, *[
            value.alias(f"n_{c}") for c, value in self.setters.items()])
        differs = F.lit(False)
        for c in self.setters:
            differs = differs | ~F.col(c).eqNullSafe(F.col(f"n_{c}"))
        kinds = {f.name: f.dataType for f in self.table.schema}
        return new.filter(differs).select(*[
            F.col(f"n_{c}").cast(kinds[c]).alias(c) if f"n_{c}" in changed else F.col(c)
            for c in self.table.columns])


def upsert(table: DataFrame, new: DataFrame, key: str, update: list[str]) -> DataFrame:
    """Insert new keys; for known keys overwrite only the named columns."""
    kept = update_by_key(table, new.select(key, *update), key,
                         {c: F.col(f"c_{c}") for c in update})
    fresh = new.join(matching_keys(table, new, key), key, "left_anti")
    return kept.unionByName(fresh.select(*table.columns))


def session_ends(sessions: DataFrame, users: DataFrame) -> Update:
    """End the open sessions of users; `users` has user_id, revoke_at, one row each."""
    return Update(sessions, users.select("user_id", "revoke_at"), "user_id",
                  {"revoked_at": F.coalesce("revoked_at", "c_revoke_at")})


def number_rows(df: DataFrame, order: list[str], name: str,
                after: DataFrame | None = None) -> DataFrame:
    """Add 1, 2, 3 ... in the given total order without a single-task window.

    Rows are range-partitioned on the whole order (so one repeated leading value still
    spreads), sorted, and numbered within their slice. The slices are then frozen in a
    reliable checkpoint and shifted by the row counts of the slices before them; that
    table has one row per slice, which bounds both the window and the broadcast below.
    `after` is one row `top`: numbering goes on from there.
    """
    ensure_checkpoint_dir(df.sparkSession)
    cut = (
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_m", F.monotonically_increasing_id())
        .checkpoint()
    )
    slice_no = F.shiftright("_m", 33)
    within = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = cut.groupBy(slice_no.alias("_s")).agg((F.max(within) + 1).alias("_n"))
    if after is not None:
        sizes = sizes.unionByName(after.select(
            F.lit(-1).cast("bigint").alias("_s"), F.col("top").alias("_n")))
    earlier = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_s", F.coalesce(F.sum("_n").over(earlier), F.lit(0))
                          .alias("_before"))
    return (
        cut.withColumn("_s", slice_no).join(F.broadcast(before), "_s")
        .withColumn(name, F.col("_before") + within + 1)
        .drop("_m", "_s", "_before")
    )


def largest_number(table: DataFrame, column: str, prefix: int = 0) -> DataFrame:
    """One row `top`: the largest number in a column (after a prefix), 0 when empty."""
    whole = F.col(column).cast("string")
    text = F.substring(whole, F.lit(prefix + 1), F.length(whole))
    return table.agg(F.coalesce(F.max(text.try_cast("bigint")), F.lit(0)).alias("top"))


def company_number(n: Column | str) -> Column:
    """C0001 ... C9999, C10000; never cut off."""
    return F.format_string("C%04d", F.col(n) if isinstance(n, str) else n)
