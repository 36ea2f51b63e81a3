"""Events of an object store applied to an index: created objects appear, removed ones are hidden but stay.

Events may come late, twice and out of order. A watermark bounds how late; within it events of one id count once; the
index keeps the time and number of the event that decided about each object, and older ones change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.plans.registry import query
from docloom.session import table
from docloom.sources.versioned import VersionedTable

INDEX = "object string, digest string, at timestamp, seq long, is_deleted boolean"
CREATED, REMOVED = "created", "removed"


def event_kind(kind: Column) -> Column:
    """created or removed; null for kinds that don't concern the index."""
    removed = F.contains(kind, F.lit("Removed")) | F.contains(kind, F.lit("Delete")) | (kind == REMOVED)
    created = F.contains(kind, F.lit("Created")) | F.contains(kind, F.lit("Put")) | (kind == CREATED)
    return F.when(removed, REMOVED).when(created, CREATED)


def decisive(events: DataFrame) -> DataFrame:
    """The last event of each object as a row of the index; events (object, kind, digest, at, seq) by time, then number."""
    order = Window.partitionBy("object").orderBy(F.desc("at"), F.desc("seq"))
    known = events.withColumn("kind", event_kind(F.col("kind"))).where("kind is not null and object is not null")
    last = known.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return last.select("object", "digest", "at", "seq", (F.col("kind") == REMOVED).alias("is_deleted"))


def apply_batch(index: VersionedTable, events: DataFrame, batch_id: int, run: str = "events") -> int:
    """Brings the index up to the events of a micro-batch, in one change; a batch that was applied already is left out.

    A removed object keeps the digest that it had. An object that is only removed is listed as deleted, so that an older
    creation that comes later doesn't bring it back.
    """
    base = index.manifest()
    if base["properties"].get(run, -1) >= batch_id:
        return base["version"]
    new = decisive(events)

    def merged(old: DataFrame) -> DataFrame:
        o = old.select("object", *[F.col(c).alias(f"_{c}") for c in ("digest", "at", "seq", "is_deleted")])
        newer = F.col("_at").isNull() | (F.struct("at", "seq") > F.struct("_at", "_seq"))
        both = o.join(new, "object", "full_outer")
        take = F.col("at").isNotNull() & newer
        digest = F.when(take & ~F.col("is_deleted"), F.col("digest")).otherwise(F.coalesce("_digest", "digest"))
        rest = [F.when(take, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in ("at", "seq", "is_deleted")]
        return both.select("object", digest.alias("digest"), *rest)

    return index.change(new, merged, base, **{run: batch_id})


def stream_events(events: DataFrame, index: VersionedTable, checkpoint: str, delay: str = "1 hour", run: str = "events") -> StreamingQuery:
    """Starts applying a stream of events (event_id, object, kind, digest, at, seq) to the index until all that is there is taken.

    Events that come more than ``delay`` behind the newest one are dropped, and repeated ids within it count once.
    """
    once = events.withWatermark("at", delay).dropDuplicatesWithinWatermark(["event_id"])
    return (
        once.writeStream.foreachBatch(lambda batch, i: apply_batch(index, batch, i, run) and None)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def visible(index: DataFrame) -> DataFrame:
    """Objects that a search may show."""
    return index.where("not is_deleted")


@query(
    "object_events",
    """SELECT user_id::VARCHAR AS object, event_id AS seq, epoch_us(ts) AS at_us, event_type = 'error' AS is_deleted FROM events
WHERE event_type <> 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def q_events(spark, sf_dir):
    """What the events leave behind when errors remove an object, views don't concern it and all others create it."""
    kind = F.when(F.col("event_type") == "error", "ObjectRemoved:Delete").when(F.col("event_type") != "view", "ObjectCreated:Put").otherwise("ObjectAccessed:Get")
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("object"), kind.alias("kind"), F.col("props").alias("digest"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq")
    )
    return decisive(events).select("object", "seq", F.unix_micros("at").alias("at_us"), "is_deleted")
