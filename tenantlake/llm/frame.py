"""What the operators of this package share on the side of Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenantlake.session import scratch_folder, ship_package

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def remainder(doc_id: str | Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo `divisor`; 0 for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % divisor, F.lit(0))


def row_key(*columns: str) -> Column:
    """A 64-bit key of a row; rows that agree in all these columns share it."""
    marked = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]
    return F.xxhash64(*marked)


def settled(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: what follows no longer depends on
    recomputing `df`, so it is the same rows after a lost executor."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    ship_package()
    return df.mapInArrow(function, schema)


class Bits:
    """A set of 64-bit hashes as bits at their lowest places: members always pass."""

    def __init__(self, bits: int):
        self.bits = bits
        self.data = np.zeros(1 << (bits - 3), np.uint8)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = self.places(hashes)
        return (self.data[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def bit_filter(hashes: DataFrame, column: str, bits: int):
    """The hashes of a column as `Bits` on all executors: 2 ** bits bits at every size of the
    input, put together in pieces of 4 KB."""
    place = F.col(column).bitwiseAND((1 << bits) - 1) + 1
    pieces = (hashes.select(F.bitmap_bucket_number(place).alias("piece"),
                            F.bitmap_bit_position(place).alias("bit"))
              .groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bitmap")))
    out = Bits(bits)
    for row in pieces.toLocalIterator():
        low = (row.piece - 1) * len(row.bitmap)
        out.data[low:low + len(row.bitmap)] = np.frombuffer(row.bitmap, np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(out)
