"""Reading the identity tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenantlake.operators.contracts import require_columns
from tenantlake.schemas import ACCESS_EVENT, TABLES


def load(spark: SparkSession, root: str, name: str, fmt: str = "parquet") -> DataFrame:
    """One identity table with its declared schema; missing columns fail at once."""
    schema = TABLES[name]
    path = f"{root.rstrip('/')}/{name}"
    found = spark.read.format(fmt).load(path)
    require_columns(found.schema, name)
    return spark.read.schema(schema).format(fmt).load(path)


#: Tables that are stored by day, with the time that gives the day and the order inside.
BY_DAY = {"user_login_log": ("at", "user_id"), "user_session": ("created_at", "user_id"),
          "access_event": ("occurred_at", "actor")}


def store(df: DataFrame, root: str, name: str, mode: str = "append") -> None:
    """Write a table in its layout: feeds and sessions in folders by day, sorted by account
    inside, so that days are pruned and row groups skipped. A day is split over tasks by the
    account, so one large day or account does not meet in one task."""
    path = f"{root.rstrip('/')}/{name}"
    if name not in BY_DAY:
        df.write.mode(mode).parquet(path)
        return
    by_day(df, name).write.mode(mode).partitionBy("day").parquet(path)


def by_day(df: DataFrame, name: str) -> DataFrame:
    """Rows with their day, dealt and sorted as they are stored."""
    time, order = BY_DAY[name]
    return (df.withColumn("day", F.to_date(time)).repartitionByRange("day", order, time)
            .sortWithinPartitions("day", order, time))


def load_days(spark: SparkSession, root: str, name: str, since: date | None = None,
              until: date | None = None) -> DataFrame:
    """Rows of a table stored by day, `until` included; other days are not read."""
    schema = T.StructType([*TABLES[name].fields, T.StructField("day", T.DateType())])
    found = spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{name}")
    if since is not None:
        found = found.filter(F.col("day") >= F.lit(since))
    if until is not None:
        found = found.filter(F.col("day") <= F.lit(until))
    return found.drop("day")


def load_table(spark: SparkSession, path: str, schema: T.StructType,
               fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def load_jdbc(spark: SparkSession, url: str, name: str, partition_column: str,
              lower: str, upper: str, partitions: int, **options: str) -> DataFrame:
    """The same table straight from a database, read in parallel key or time ranges."""
    reader = (
        spark.read.format("jdbc").option("url", url).option("dbtable", name)
        .option("partitionColumn", partition_column)
        .option("lowerBound", lower).option("upperBound", upper)
        .option("numPartitions", partitions).option("preferTimestampNTZ", "true")
    )
    table = reader.options(**options).load()
    require_columns(table.schema, name)
    return table.select(*[table[f.name].cast(f.dataType).alias(f.name)
                          for f in TABLES[name]])


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path)


def load_access_events(spark: SparkSession, path: str) -> DataFrame:
    """Access audit; a store that was never written is empty, other errors are raised."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], ACCESS_EVENT)
    return load_table(spark, path, ACCESS_EVENT)
