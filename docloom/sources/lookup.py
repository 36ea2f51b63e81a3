"""Stored tables for look-ups by key: a point or a list of keys reads the buckets that can hold them.

Rows are bucketed and sorted by the key, with a Bloom filter for each row group. A join with any number of keys deals out the
keys alone, as the stored side lies by key already; a single key reads one bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def store(rows: DataFrame, name: str, key: str, path: str, buckets: int = BUCKETS) -> None:
    """Writes the rows as the table ``name`` in the session's catalogue, with its files under ``path``."""
    dealt = rows.repartition(buckets, key)  # one file for each bucket
    writer = dealt.write.bucketBy(buckets, key).sortBy(key).option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.option("path", path).saveAsTable(name)


def look_up(spark: SparkSession, name: str, key: str, keys: DataFrame) -> DataFrame:
    """The stored rows whose key is among the keys (a column of the same name); keys that are not stored give nothing."""
    wanted = keys.select(F.col(key)).where(F.col(key).isNotNull()).distinct()
    return spark.table(name).join(wanted, key, "left_semi")


def point(spark: SparkSession, name: str, key: str, value: object) -> DataFrame:
    """The rows of one key."""
    return spark.table(name).where(F.col(key) == F.lit(value))
