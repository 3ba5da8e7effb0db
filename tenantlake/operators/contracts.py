"""Table contracts: keys, lengths, references, schema evolution, credential hygiene."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenantlake.functions.rules import hash_finding, password_flaw
from tenantlake.operators.keyed import matching_keys
from tenantlake.operators.outcome import settle
from tenantlake.schemas import EVOLUTION, REQUIRED_COLUMNS, REQUIRED_TABLES, TABLES, Contract


def _counted(df: DataFrame, contract: Contract) -> DataFrame:
    """Broken row rules, one group each, and every unique value with how often it comes."""
    key = contract.primary_key
    checks = [F.when(F.col(c).isNull(), F.struct(F.lit("NOT_NULL").alias("rule"),
                                                 F.lit(c).alias("column_name")))
              for c in contract.not_null]
    checks += [F.when(F.length(c) > n, F.struct(F.lit("TOO_LONG").alias("rule"),
                                                F.lit(c).alias("column_name")))
               for c, n in contract.max_length.items()]
    if contract.numbered_id:
        whole = F.col(contract.numbered_id)
        number = F.substring(whole, F.lit(2), F.length(whole)).try_cast("bigint")
        checks.append(F.when(
            F.col(contract.numbered_id).isNotNull() & number.isNull(),
            F.struct(F.lit("BAD_NUMBER").alias("rule"),
                     F.lit(contract.numbered_id).alias("column_name"))))
    nothing = F.lit(None).cast("string")
    broken = [F.when(check.isNotNull(), F.struct(
        check["rule"].alias("rule"), check["column_name"].alias("column_name"),
        F.col(key).cast("string").alias("key_value"))) for check in checks]
    unique = [F.when(F.col(c).isNotNull(), F.struct(
        nothing.alias("rule"), F.lit(c).alias("column_name"),
        F.col(c).cast("string").alias("key_value"))) for c in (key, *contract.unique)]
    each = df.select(F.explode(F.array_compact(F.array(*broken, *unique))).alias("b")).select(
        "b.*", F.when(F.col("b.rule").isNotNull(), F.monotonically_increasing_id()).alias("row"))
    return each.groupBy("rule", "column_name", "key_value", "row").agg(F.count("*").alias("n"))


def contract_findings(df: DataFrame, contract: Contract) -> DataFrame:
    """One row per broken rule and key, from one scan and one aggregate.

    Each row yields the row rules it breaks (NOT NULL, length, malformed number), mostly
    none, and its value of every unique column. Values are counted with combining on the
    map side, so one repeated a billion times reaches the shuffle as one row a task; a
    broken row keeps a group of its own.
    """
    return _findings(_counted(df, contract), contract)


def _findings(counted: DataFrame, contract: Contract) -> DataFrame:
    return counted.filter("rule is not null or n > 1").select(
        F.lit(contract.table).alias("table_name"),
        F.coalesce("rule", F.lit("NOT_UNIQUE")).alias("rule"), "column_name", "key_value", "n")


def batch_findings(table: DataFrame, new: DataFrame, contract: Contract) -> DataFrame:
    """What `contract_findings` of the table with the new rows says about the new rows: their
    row rules, and their unique values that are then there twice or more, with the count.

    The table is only asked for the values of the new rows, one column after another and by
    semi joins on distinct values, so it does not move while the batch is small.
    """
    counted = settle(_counted(new, contract))
    values = counted.filter("rule is null").select("column_name", "key_value")
    known = []
    for c in (contract.primary_key, *contract.unique):
        asked = values.filter(F.col("column_name") == c).select(
            F.col("key_value").cast(table.schema[c].dataType).alias(c))
        known.append(matching_keys(table, asked, c).groupBy(c).agg(
            F.count("*").alias("held")).select(
            F.lit(c).alias("column_name"), F.col(c).cast("string").alias("key_value"), "held"))
    held = reduce(DataFrame.unionByName, known)
    total = counted.join(held, ["column_name", "key_value"], "left").withColumn(
        "n", F.col("n") + F.when(F.col("rule").isNull(), F.coalesce("held", F.lit(0)))
        .otherwise(0))
    return _findings(total, contract)


def batch_orphans(new: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """New child rows whose key is set but has no parent row; the parents do not move."""
    asked = new.filter(F.col(key).isNotNull())
    return asked.join(matching_keys(parent, asked, key).distinct(), key, "left_anti").select(
        *new.columns)


def observed(new: DataFrame, contract: Contract, name: str = "batch"
             ) -> tuple[DataFrame, Observation]:
    """The batch, and its figures (`rows`, `null_<column>`), which are there once the batch was
    written; taking them needs no further pass over it."""
    figures = Observation(name)
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in contract.not_null]
    return new.observe(figures, F.count(F.lit(1)).alias("rows"), *nulls), figures


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose key is set but has no parent row."""
    return (child.filter(F.col(key).isNotNull())
            .join(parent.select(key), key, "left_anti"))


def cascade_delete(child: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """The child table after its parents with these keys were deleted."""
    return child.join(deleted.select(key), key, "left_anti").select(*child.columns)


def cascade_rename(child: DataFrame, renamed: DataFrame, key: str) -> DataFrame:
    """The child table after parent keys changed; `renamed` has old_key, new_key."""
    moved = renamed.select(F.col("old_key").alias(key), F.col("new_key").alias("_new"))
    return (child.join(moved, key, "left")
            .withColumn(key, F.coalesce("_new", key)).select(*child.columns))


def evolve(df: DataFrame, table: str) -> DataFrame:
    """Add the columns later versions brought, with the value old rows get."""
    for name, kind, default in EVOLUTION.get(table, ()):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(default).cast(kind))
    return df


def missing_tables(names: list[str]) -> list[str]:
    return [t for t in REQUIRED_TABLES if t not in set(names)]


def missing_columns(schemas: dict[str, T.StructType]) -> list[str]:
    return [f"{t}.{c}" for t, c in REQUIRED_COLUMNS
            if t in schemas and c not in schemas[t].names]


def require_columns(schema: T.StructType, table: str) -> None:
    """Fail before any job when a declared column is not in the files."""
    absent = [f.name for f in TABLES[table] if f.name not in schema.names]
    if absent:
        raise ValueError(f"{table} lacks {', '.join(absent)}")


def credential_findings(users: DataFrame) -> DataFrame:
    """Accounts per finding on the stored hash; the hash itself never leaves the scan."""
    return (users.select(F.coalesce(hash_finding("password_hash"), F.lit("OK"))
                         .alias("finding"))
            .groupBy("finding").agg(F.count("*").alias("accounts")))


def password_findings(staged: DataFrame, password: str, login_id: str) -> DataFrame:
    """Staged passwords per broken part of the policy; the text is never output."""
    return (staged.select(F.coalesce(password_flaw(password, login_id), F.lit("OK"))
                          .alias("finding"))
            .groupBy("finding").agg(F.count("*").alias("passwords")))
