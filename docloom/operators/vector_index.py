"""Approximate dense top-k over an inverted file of cells, beside the exact scan of ``retrieval.dense``.

Centroids are fitted on a bounded sample of the corpus; every vector is stored under its nearest centroid. A query is sent to
the cells whose centroids are nearest to it. Cells and the queries that ask for them meet in a cogroup; a cell with many
vectors is dealt over several groups, so neither a hot cell nor a hot query is one task's work. How many cells a query
asks for is measured: the least number that finds the wanted share of the true neighbours inside the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.retrieval import _unit, query_vectors, ranked, vectors
from docloom.plans.registry import query

CELLS, PROBES = 128, 10
SAMPLE = 16_384  # vectors on which the centroids are fitted
PROBE_QUERIES = 256  # of the sample, to measure recall with
ROUNDS = 12
GROUP_ROWS = 20_000  # vectors of a cell in one group


@dataclass(frozen=True)
class Centroids:
    """Unit vectors of the cells, and how many cells a query asks for."""

    points: np.ndarray
    probes: int

    def nearest(self, m: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each unit vector, best first, ties by number."""
        return np.argsort(-np.round(m @ self.points.T, 9), axis=1, kind="stable")[:, :n]


def _matrix(column: pd.Series) -> np.ndarray:
    return _unit(np.stack(column.to_numpy()).astype(float))


def _cells_of(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means; the first centres are spread over the sample by farthest-first steps."""
    at = [0]
    near = sample @ sample[0]
    while len(at) < cells:
        at.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[at[-1]])
    points = sample[at].copy()
    for _ in range(ROUNDS):
        own = (sample @ points.T).argmax(axis=1)
        sums = np.zeros_like(points)
        np.add.at(sums, own, sample)
        filled = np.bincount(own, minlength=cells) > 0
        points[filled] = _unit(sums[filled])
    return points


def _probes_for(sample: np.ndarray, points: np.ndarray, k: int, recall: float) -> int:
    """The least number of cells in which queries from the sample find ``recall`` of their k nearest."""
    own = (sample @ points.T).argmax(axis=1)
    asked = sample[:: max(1, len(sample) // PROBE_QUERIES)][:PROBE_QUERIES]
    true = np.argsort(-(asked @ sample.T), axis=1, kind="stable")[:, :k]
    place = np.empty((len(asked), len(points)), np.int64)  # of each cell in a query's order
    np.put_along_axis(place, np.argsort(-(asked @ points.T), axis=1, kind="stable"), np.arange(len(points))[None, :].repeat(len(asked), 0), axis=1)
    need = np.sort(np.take_along_axis(place, own[true], axis=1).ravel()) + 1
    return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))))])


def fit(corpus: DataFrame, cells: int = CELLS, probes: int | None = None, k: int = 10, recall: float = 0.97) -> Centroids:
    """Centroids from at most ``SAMPLE`` vectors, chosen by a hash of the id; no more than one cell for eight of them.

    probes: a fixed number of cells for each query; by default measured, and not below ``PROBES``.
    """
    some = corpus.select("doc_id", "vector").where("vector is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).toPandas()
    if not len(some):
        return Centroids(np.zeros((1, 1)), 1)
    sample = _matrix(some["vector"])
    points = _cells_of(sample, max(1, min(cells, len(sample) // 8)))
    if probes is None:
        probes = max(PROBES, _probes_for(sample, points, k, recall))
    return Centroids(points, min(probes, len(points)))


def assign(corpus: DataFrame, centroids: Centroids) -> DataFrame:
    """doc_id, vector, cell of every vector; what ``store`` writes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(cell=centroids.nearest(_matrix(batch["vector"]), 1)[:, 0])

    rows = corpus.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")
    return rows.mapInPandas(run, "doc_id long, vector array<double>, cell long")


def store(index: DataFrame, path: str) -> None:
    """Writes the cells as partitions, so a search reads those that are asked for; a large cell is several files."""
    index.repartition("cell", F.pmod(F.xxhash64("doc_id"), F.lit(16))).write.partitionBy("cell").parquet(path)


def search(index: DataFrame, centroids: Centroids, queries: DataFrame, k: int) -> DataFrame:
    """qid, pos, doc_id, score: the k best of the cells that each query (qid, vector) asks for."""

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(cell=[*centroids.nearest(_matrix(batch["vector"]), centroids.probes)])

    def best(found: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(found) or not len(asking):
            return pd.DataFrame({"qid": [], "doc_id": [], "score": []})
        docs, m = found["doc_id"].to_numpy(), _matrix(found["vector"])
        rows = []
        for qid, q in zip(asking["qid"].tolist(), _matrix(asking["vector"]), strict=True):
            s = np.round(m @ q, 6)
            top = np.lexsort((docs, -s))[:k]
            rows.append(pd.DataFrame({"qid": qid, "doc_id": docs[top], "score": s[top]}))
        return pd.concat(rows)

    probes = queries.select(F.col("qid").cast("long").alias("qid"), F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")
    probes = probes.mapInPandas(asked, "qid long, vector array<double>, cell array<long>").select("qid", "vector", F.explode("cell").alias("cell"))
    parts = index.groupBy("cell").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("parts"))  # one row a cell
    dealt = index.join(parts, "cell").select("cell", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"), "doc_id", "vector")
    every = parts.select(F.col("cell").alias("asked"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("piece"))
    sent = probes.join(every, F.col("cell") == F.col("asked")).select(F.col("asked").alias("cell"), F.col("piece").alias("part"), "qid", "vector")
    met = dealt.groupBy("cell", "part").cogroup(sent.groupBy("cell", "part")).applyInPandas(best, "qid long, doc_id long, score double")
    return ranked(met, k).select("qid", "pos", "doc_id", "score")


@query("dense_ivf")
def q_ivf(spark, sf_dir):
    """The ten nearest of every vector whose id is divisible by 50; tests compare it with the exact scan."""
    corpus = vectors(spark, sf_dir)
    centroids = fit(corpus)
    return search(assign(corpus, centroids), centroids, query_vectors(spark, sf_dir), 10)
