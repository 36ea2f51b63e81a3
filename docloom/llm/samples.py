"""Bounded samples of labelled documents for the classifiers that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_texts(documents: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, max_bytes: int) -> list[tuple[str, int]]:
    """Texts with labels 0 and 1, at most ``per_class`` of each, chosen by a hash of the id.

    ``learn`` is a condition on doc_id. Texts beyond ``max_bytes`` and null texts are not learned from. At most
    ``2 * per_class`` ids are broadcast and at most that many bounded texts come to the driver.
    """
    kept = labels.where(learn & F.col(label).isin(0, 1)).select(
        F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label"), F.xxhash64("doc_id").alias("_h")
    )
    chosen = None
    for value in (0, 1):
        part = kept.where(F.col("_label") == value).orderBy("_h", "_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = (
        documents.select("doc_id", "text")
        .where(F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes))
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
        .select("_h", "_id", "_label", "text")
        .limit(4 * per_class)
        .collect()
    )
    return [(r["text"], r["_label"]) for r in sorted(rows, key=lambda r: (r["_h"], r["_id"], r["_label"], r["text"]))]
