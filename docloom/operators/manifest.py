"""The documents' manifest: versions with the time in which they held, their status, and the chunks that belong to them.

Functions on DataFrames compute what the manifest says; ``Manifest`` keeps it in versioned tables, where each call is one
change that readers see whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.plans.registry import query
from docloom.session import table
from docloom.sources.versioned import VersionedTable

STATUS = ("pending", "current", "superseded", "failed", "deleted")
VERSIONS = "source string, version string, digest string, valid_from timestamp, valid_to timestamp, is_current boolean, status string, error string"
CHUNKS = "source string, version string, chunk_no long, content string"


def history(events: DataFrame, key: str = "source", time: str = "at", version: str = "version", digest: str = "digest") -> DataFrame:
    """Key, version, digest, valid_from, valid_to, is_current: the versions of each document and when they held.

    A document's events are taken by time, then version. An event with the digest of the one before it changes nothing.
    A version holds until the next one begins; the last one holds on and is the only current one.
    """
    own = Window.partitionBy(key).orderBy(time, version)
    changed = events.select(key, version, digest, time).withColumn("_before", F.lag(digest).over(own)).withColumn("_n", F.row_number().over(own))
    changed = changed.where((F.col("_n") == 1) | ~F.col(digest).eqNullSafe(F.col("_before"))).drop("_before", "_n")
    following = F.lead(time).over(own)
    return changed.select(key, version, digest, F.col(time).alias("valid_from"), following.alias("valid_to"), following.isNull().alias("is_current"))


def as_of(versions: DataFrame, moments: DataFrame, key: str = "source") -> DataFrame:
    """moments (key, at, …) with the version of the key that held then; those before its first version are left out."""
    v = versions.select(F.col(key).alias("_k"), "version", "valid_from", "valid_to")
    held = (F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    return moments.join(v, (F.col(key) == F.col("_k")) & held).drop("_k", "valid_from", "valid_to")


class Manifest:
    """Versions and chunks of documents under ``root``. All rows of a document lie in one bucket of each table."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 32):
        self.versions = VersionedTable(spark, f"{root}/versions", VERSIONS, ["source"], buckets)
        self.chunks = VersionedTable(spark, f"{root}/chunks", CHUNKS, ["source"], buckets)

    def register(self, new: DataFrame) -> int:
        """Adds versions (source, version, digest, at) and closes those that they follow.

        Versions may come late: the whole history of the documents concerned is laid out again. A version that is
        registered again with the same digest changes nothing, deleted documents that come back get a new version.
        """

        def merged(old: DataFrame) -> DataFrame:
            kept = old.select("source", "version", "digest", F.col("valid_from").alias("at"), "status", "error")
            given = new.select("source", "version", "digest", "at").dropDuplicates(["source", "version"])
            given = given.join(old.where("status <> 'deleted'").select("source", "version", "digest"), ["source", "version", "digest"], "left_anti")
            kept = kept.join(given.select("source", "version"), ["source", "version"], "left_anti")
            every = kept.unionByName(given.withColumns({"status": F.lit("current"), "error": F.lit("")}))
            own = Window.partitionBy("source").orderBy("at", "version")
            following = F.lead("at").over(own)
            status = F.when(F.col("status").isin("failed", "deleted", "pending"), F.col("status")).otherwise(F.when(following.isNull(), "current").otherwise("superseded"))
            return every.select(
                "source", "version", "digest", F.col("at").alias("valid_from"), following.alias("valid_to"), (status == "current").alias("is_current"), status.alias("status"), "error"
            )

        return self.versions.change(new, merged)

    def set_status(self, which: DataFrame, status: str, error: str = "") -> int:
        """Gives the versions (source, version) a status; only a current one is shown as such."""
        if status not in STATUS:
            raise ValueError(f"no such status: {status}")
        keys = which.select("source", "version").distinct().withColumn("_hit", F.lit(True))

        def marked(old: DataFrame) -> DataFrame:
            hit = F.col("_hit").isNotNull()
            return (
                old.join(keys, ["source", "version"], "left")
                .withColumns({"status": F.when(hit, status).otherwise(F.col("status")), "error": F.when(hit, error).otherwise(F.col("error"))})
                .withColumn("is_current", (F.col("status") == "current") & F.col("valid_to").isNull())
                .drop("_hit")
            )

        return self.versions.change(which, marked)

    def soft_delete(self, sources: DataFrame) -> tuple[int, int]:
        """How many current versions the sources had, and the number of the new version of the table."""
        own = self.versions.read().join(sources.select("source").distinct(), "source", "left_semi").where("is_current")
        n = own.count()
        return n, self.set_status(own, "deleted") if n else self.versions.manifest()["version"]

    def replace_chunks(self, rows: DataFrame) -> int:
        """Puts the chunks (source, version, chunk_no, content) in place of all that their versions had."""
        keys = rows.select("source", "version").distinct()
        return self.chunks.change(keys, lambda old: old.join(keys, ["source", "version"], "left_anti").unionByName(rows.select(*old.columns)))

    def shown(self) -> DataFrame:
        """Current versions, the newest first."""
        return self.versions.read().where("is_current").orderBy(F.desc("valid_from"), "source")

    def shown_chunks(self) -> DataFrame:
        """The chunks of current versions."""
        return self.chunks.read().join(self.versions.read().where("is_current").select("source", "version"), ["source", "version"], "left_semi")


_EVENTS = "SELECT user_id AS source, event_id AS version, event_type AS digest, ts AS t FROM events"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.col("event_id").alias("version"), F.col("event_type").alias("digest"), F.col("ts").cast("timestamp").alias("at"))


_HISTORY_SQL = f"""SELECT source, version, digest, t AS valid_from, lead(t) OVER (PARTITION BY source ORDER BY t, version) AS valid_to FROM (
  SELECT * FROM ({_EVENTS}) QUALIFY coalesce(lag(digest) OVER (PARTITION BY source ORDER BY t, version) <> digest, true))"""


@query(
    "version_history",
    f"SELECT source, version, digest, epoch_us(valid_from) AS from_us, epoch_us(valid_to) AS to_us, valid_to IS NULL AS is_current FROM ({_HISTORY_SQL})",
)
def q_history(spark, sf_dir):
    h = history(_events(spark, sf_dir))
    return h.select("source", "version", "digest", F.unix_micros("valid_from").alias("from_us"), F.unix_micros("valid_to").alias("to_us"), "is_current")


@query(
    "version_as_of",
    f"""SELECT e.version AS asked, h.version FROM ({_EVENTS}) e JOIN ({_HISTORY_SQL}) h ON h.source = e.source
AND h.valid_from <= e.t - INTERVAL 1 HOUR AND (h.valid_to IS NULL OR e.t - INTERVAL 1 HOUR < h.valid_to)""",
)
def q_as_of(spark, sf_dir):
    """The version that held an hour before each event."""
    events = _events(spark, sf_dir)
    moments = events.select("source", F.col("version").alias("asked"), (F.col("at") - F.expr("INTERVAL 1 HOUR")).alias("at"))
    return as_of(history(events), moments).select("asked", "version")
