"""Continuous ingestion: a file stream, near copies told by state, micro-batches that commit once, and a dead-letter side.

Every fingerprint seen stands in the state store under its keys, so a micro-batch touches the state of its own keys and
nothing else that was ever committed. Each micro-batch writes one folder named by its batch id; a batch that is run again
after a failure overwrites its own folder, so nothing is committed twice. Intake is bounded by files a trigger instead
of rejecting work.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from docloom.operators.ingest import fingerprint_keys, with_simhash
from docloom.plans.registry import query
from docloom.session import table

DAY_MS = 86_400_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
JUDGED = "doc_id long, simhash long, near long"


def judge(batch: DataFrame) -> DataFrame:
    """The batch with its content hash and an error for rows that cannot be ingested."""
    error = F.when(F.col("doc_id").isNull(), "no id").when(F.coalesce(F.length("text"), F.lit(0)) == 0, "no text")
    return batch.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256)).withColumn("error", error)


class SeenBefore(StatefulProcessor):
    """Of each key of fingerprints: the fingerprints seen and the first document that had them.

    A row (doc_id, simhash) gets the smallest id among the earlier rows of the key that are near, or null. Rows of one
    micro-batch are taken by id. Fingerprints are forgotten ``ttl_ms`` after they were first seen; None keeps them.
    """

    def __init__(self, distance: int, ttl_ms: int | None):
        self.distance, self.ttl_ms = distance, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "simhash long", "doc_id long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {int(k[0]): int(v[0]) for k, v in self.seen.iterator()}
        batch = pd.concat(list(rows)).sort_values(["doc_id", "simhash"])
        near = []
        for doc, h in zip(batch["doc_id"].tolist(), batch["simhash"].tolist(), strict=True):
            found = [d for s, d in known.items() if d != doc and ((s ^ h) & (1 << 64) - 1).bit_count() <= self.distance]
            near.append(min(found, default=None))
            if h not in known:
                known[h] = doc
                self.seen.updateValue((h,), (doc,))
        yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "simhash": batch["simhash"].to_numpy(), "near": pd.array(near, dtype="Int64")})

    def close(self) -> None:
        pass


def near_earlier(hashed: DataFrame, distance: int = 3, ttl_ms: int | None = None) -> DataFrame:
    """doc_id, simhash, near: a row for each document (doc_id, simhash) of a stream and each of its keys."""
    if not 0 <= distance <= 3:
        raise ValueError("keys tell up to three bits apart")
    hashed.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    keyed = hashed.select("doc_id", "simhash", F.explode(fingerprint_keys(F.col("simhash"))).alias("_key"))
    return keyed.groupBy("_key").transformWithStateInPandas(SeenBefore(distance, ttl_ms), JUDGED, "Append", "ProcessingTime" if ttl_ms else "None")


def stream_documents(
    spark: SparkSession, source: str, schema, out: str, dead: str, checkpoint: str, files: int = 100, distance: int = 3, ttl_ms: int | None = 30 * DAY_MS
) -> StreamingQuery:
    """Starts the ingestion of Parquet files under ``source``; stops when all that is there has been taken.

    Rows without id or text go to ``dead``. Of documents whose fingerprints are within ``distance`` bits the first one seen
    is committed, by micro-batch and then by id, and so is its row; the decisions are kept beside, in ``<out>/near``, with
    the document that each copy resembles. Documents of one id are told apart by their fingerprint.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    judged = with_simhash(judge(stream))
    good = near_earlier(judged.where("error is null").select("doc_id", "simhash"), distance, ttl_ms)

    def commit(decided: DataFrame, batch_id: int) -> None:
        first = decided.groupBy("doc_id", "simhash").agg(F.min("near").alias("near"))
        first.write.mode("overwrite").parquet(f"{out}/near/batch={batch_id}")

    def set_aside(bad: DataFrame, batch_id: int) -> None:
        bad.write.mode("overwrite").parquet(f"{dead}/batch={batch_id}")

    names = [*stream.columns, "sha", "error"]
    aside = judged.where("error is not null").select(*names).writeStream.foreachBatch(set_aside)
    aside.option("checkpointLocation", f"{checkpoint}/dead").trigger(availableNow=True).start().awaitTermination()
    # state that expires by the clock asks for another batch without data for ever; a query keeps the setting it starts with
    idle, before = "spark.sql.streaming.noDataMicroBatches.enabled", spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled")
    spark.conf.set(idle, "false")
    try:
        return good.writeStream.outputMode("append").foreachBatch(commit).option("checkpointLocation", f"{checkpoint}/near").trigger(availableNow=True).start()
    finally:
        spark.conf.set(idle, before)


def accepted(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, simhash, batch of the documents that the stream has committed."""
    return spark.read.option("basePath", f"{out}/near").parquet(f"{out}/near").where("near is null").drop("near")


@query("ingest_accepted", "SELECT sha256(text) AS sha, min(doc_id) AS doc_id FROM documents WHERE length(text) > 0 AND doc_id IS NOT NULL GROUP BY ALL")
def q_accepted(spark, sf_dir):
    """What one batch over the documents commits."""
    good = judge(table(spark, sf_dir, "documents")).where("error is null")
    return good.groupBy("sha").agg(F.min("doc_id").alias("doc_id"))
