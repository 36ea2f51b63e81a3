"""Evaluation runs beyond single metrics: composite scores, arms, largest changes, rates, pairs, and vectors of text pieces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.evaluation import _PAIR_SQL, _runs
from docloom.plans.registry import query
from docloom.session import table

#: Weights of the metrics, for each tier and for all others. Fixed values.
WEIGHTS = {
    "L1": {"answer_correctness": 0.15, "faithfulness": 0.15, "answer_relevancy": 0.10, "context_recall": 0.10, "context_precision": 0.10, "hit_rate": 0.20, "mrr": 0.10, "ndcg": 0.10},
    "L2": {"answer_correctness": 0.30, "faithfulness": 0.25, "answer_relevancy": 0.15, "context_recall": 0.15, "context_precision": 0.10, "hit_rate": 0.05},
    "L3": {"negative_rejection": 0.40, "faithfulness": 0.20, "answer_correctness": 0.15, "answer_relevancy": 0.15, "context_precision": 0.10},
    "all": {"answer_correctness": 0.30, "faithfulness": 0.20, "answer_relevancy": 0.15, "context_recall": 0.15, "context_precision": 0.10, "hit_rate": 0.10},
}
ENOUGH, MAX_ROUNDS = 0.3, 3
BREAK_BELOW = 0.45
LEAST_PASSAGE = 100


def composite_score(metrics: Column, tier: str = "all") -> Column:
    """Weighted mean of the metrics (a map) that are there; missing and null ones lose their weight. 0 without any."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, w in WEIGHTS.get(tier, WEIGHTS["all"]).items():
        value = F.try_element_at(metrics, F.lit(name))
        total = total + F.coalesce(value * w, F.lit(0.0))
        weight = weight + F.when(value.isNotNull(), w).otherwise(0.0)
    return F.when(weight > 0, F.round(total / weight, 4)).otherwise(0.0)


def compare_arms(a: DataFrame, b: DataFrame) -> DataFrame:
    """metric, arm_a, arm_b, delta, relative_pct, winner for the metrics (metric, value) of two arms."""
    both = a.select("metric", F.col("value").alias("arm_a")).join(b.select("metric", F.col("value").alias("arm_b")), "metric", "full_outer")
    delta = F.col("delta")
    return (
        both.withColumn("delta", F.round(F.col("arm_b") - F.col("arm_a"), 4))
        .withColumn("relative_pct", F.when(F.col("arm_a") != 0, F.round(delta / F.col("arm_a") * 100, 2)))
        .withColumn("winner", F.when(delta > 0, "B").when(delta < 0, "A").when(delta == 0, "tie"))
    )


def largest_changes(a: DataFrame, b: DataFrame, n: int = 5) -> DataFrame:
    """The n cases (case_id, tier, m) of each tier whose metric changed most; ties go to the smaller id."""
    x = a.select("case_id", "tier", F.col("m").alias("ma"))
    changed = x.join(b.select("case_id", F.col("m").alias("mb")), "case_id").withColumn("delta", F.col("mb") - F.col("ma"))
    order = Window.partitionBy("tier").orderBy(F.abs("delta").desc(), "case_id")
    return changed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("tier", "place", "case_id", "delta")


def answer_rates(answers: DataFrame, by: str) -> DataFrame:
    """Rates by group: traceable and evidence_in_sources of the answerable cases, refusal of the negative ones."""
    answerable = ~F.col("negative")

    def rate(c: str, among: Column) -> Column:
        return F.round(F.avg(F.when(among, F.col(c).cast("int"))), 4).alias(f"{c}_rate")

    return answers.groupBy(by).agg(F.count("*").alias("n"), rate("traceable", answerable), rate("in_sources", answerable), rate("refused", F.col("negative")))


def search_rounds(queries: DataFrame, retrieve: Callable[[DataFrame], DataFrame], rewrite: Callable[[DataFrame], DataFrame], rounds: int = 2) -> DataFrame:
    """Hits (qid, doc_id, pos, score) with the round that settled them.

    A query is settled when its hits' mean score reaches ``ENOUGH`` or the rounds are over; only the others are
    rewritten and searched again. Each round is a plan on the queries left, so nothing comes to the driver; rounds are
    held to between 1 and ``MAX_ROUNDS``.
    """
    rounds = max(1, min(rounds, MAX_ROUNDS))
    out, left = None, queries
    for r in range(1, rounds + 1):
        hits = retrieve(left)
        if r < rounds:
            good = hits.groupBy("qid").agg(F.avg("score").alias("mean")).where(F.col("mean") >= ENOUGH).select("qid")
            settled = hits.join(good, "qid", "left_semi")
            left = rewrite(left.join(good, "qid", "left_anti"))
        else:
            settled = hits
        settled = settled.select("qid", "doc_id", "pos", "score", F.lit(r).alias("round"))
        out = settled if out is None else out.unionByName(settled)
    return out


def cosine(a: Column, b: Column) -> Column:
    """0 where one of the vectors is zero."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def breakpoints(pieces: DataFrame, group: str, order: str, embedding: str, length: str) -> DataFrame:
    """Adds similarity to the piece before and whether a new passage begins: where the two are unlike and the passage so far
    is long enough. The first piece of a group begins none.

    The passage's length starts again at each break, so the pieces are passed through in order, in batches; a batch hands
    its last group and length to the next one, and no group is held whole.
    """
    before = F.lag(embedding).over(Window.partitionBy(group).orderBy(order))
    alike = pieces.repartition(group).withColumn("similarity", cosine(F.col(embedding), before)).sortWithinPartitions(group, order)
    made = alike.withColumn("is_break", F.lit(False))

    def passages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, so_far = None, 0
        for batch in batches:
            found = []
            for g, s, n in zip(batch[group], batch["similarity"], batch[length].fillna(0), strict=True):
                first = last is None or not (last[0] == g or (pd.isna(last[0]) and pd.isna(g)))
                starts = not first and s < BREAK_BELOW and so_far >= LEAST_PASSAGE
                so_far = n if first or starts else so_far + n
                last = (g,)
                found.append(starts)
            yield batch.assign(is_break=found)

    return alike.mapInPandas(passages, made.schema)


def mean_pooled(pieces: DataFrame, group: str, embedding: str) -> DataFrame:
    """group, embedding: the mean of each group's vectors, scaled to length one. Sums are combined before the shuffle."""
    means = pieces.select(group, F.posexplode(embedding).alias("at", "v")).groupBy(group, "at").agg(F.avg(F.col("v").cast("double")).alias("v"))
    pooled = means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("e"))
    size = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, v: s + v * v))
    return pooled.withColumn("size", size).select(group, F.when(F.col("size") == 0, F.col("e")).otherwise(F.transform("e", lambda v: v / F.col("size"))).alias("embedding"))


_METRICS = ["answer_correctness", "faithfulness", "answer_relevancy", "context_recall", "context_precision", "hit_rate"]
_VALUES = [f"CASE WHEN o_orderkey % {i + 3} > 0 THEN (o_orderkey % {i + 97}) / CAST({i + 97} AS DOUBLE) END" for i in range(6)]
_W = WEIGHTS["L2"]


@query(
    "composite_score",
    f"""SELECT o_orderkey, coalesce(round(({" + ".join(f"coalesce(m{i} * {_W[m]}::DOUBLE, 0)" for i, m in enumerate(_METRICS))}) / nullif({" + ".join(f"CASE WHEN m{i} IS NULL THEN 0 ELSE {_W[m]}::DOUBLE END" for i, m in enumerate(_METRICS))}, 0), 4), 0) AS composite
FROM (SELECT o_orderkey, {", ".join(f"{v} AS m{i}" for i, v in enumerate(_VALUES))} FROM orders)""",
)
def q_composite(spark, sf_dir):
    metrics = F.create_map(*[x for m, v in zip(_METRICS, _VALUES, strict=True) for x in (F.lit(m), F.expr(v))])
    return table(spark, sf_dir, "orders").select("o_orderkey", composite_score(metrics, "L2").alias("composite"))


@query(
    "compare_arms",
    """SELECT metric, delta, CASE WHEN a <> 0 THEN round(delta / a * 100, 2) END AS relative_pct, CASE WHEN delta > 0 THEN 'B' WHEN delta < 0 THEN 'A' WHEN delta = 0 THEN 'tie' END AS winner
FROM (SELECT metric, a, round(b - a, 4) AS delta FROM (SELECT o_orderpriority AS metric, avg(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END) / 1000 AS a, avg(CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice END) / 1000 AS b FROM orders GROUP BY 1))""",
)
def q_arms(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a, b = (o.where(F.col("o_orderkey") % 2 == r).groupBy(F.col("o_orderpriority").alias("metric")).agg((F.avg("o_totalprice") / 1000).alias("value")) for r in (0, 1))
    return compare_arms(a, b).select("metric", "delta", "relative_pct", "winner")


@query(
    "largest_changes",
    _PAIR_SQL + ", c AS (SELECT a.tier, a.case_id, b.m - a.m AS delta FROM a JOIN b USING (case_id)) SELECT tier, place, case_id, round(delta, 4) AS delta FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY abs(delta) DESC, case_id) AS place FROM c) WHERE place <= 5",
)
def q_changes(spark, sf_dir):
    return largest_changes(*_runs(spark, sf_dir)).withColumn("delta", F.round("delta", 4))


@query(
    "answer_rates",
    """SELECT o_orderpriority, count(*) AS n, round(avg(CASE WHEN o_orderkey % 8 > 0 THEN (o_orderkey % 3 > 0)::INT END), 4) AS traceable_rate,
 round(avg(CASE WHEN o_orderkey % 8 > 0 THEN (o_orderkey % 5 > 0)::INT END), 4) AS in_sources_rate, round(avg(CASE WHEN o_orderkey % 8 = 0 THEN (o_orderkey % 7 > 0)::INT END), 4) AS refused_rate FROM orders GROUP BY o_orderpriority""",
)
def q_rates(spark, sf_dir):
    k = F.col("o_orderkey")
    made = table(spark, sf_dir, "orders").select("o_orderpriority", (k % 8 == 0).alias("negative"), (k % 3 > 0).alias("traceable"), (k % 5 > 0).alias("in_sources"), (k % 7 > 0).alias("refused"))
    return answer_rates(made, "o_orderpriority")


@query(
    "semantic_breakpoints",
    """WITH RECURSIVE s AS MATERIALIZED (SELECT vec_id, label, 20 + vec_id % 60 AS n, row_number() OVER w AS place,
 list_cosine_similarity(embedding::DOUBLE[], (lag(embedding) OVER w)::DOUBLE[]) AS s FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
f AS (SELECT vec_id, label, place, s, n AS so_far, false AS is_break FROM s WHERE place = 1
 UNION ALL SELECT s.vec_id, s.label, s.place, s.s, CASE WHEN s.s < 0.45::DOUBLE AND f.so_far >= 100 THEN s.n ELSE f.so_far + s.n END, coalesce(s.s < 0.45::DOUBLE, false) AND f.so_far >= 100
 FROM f JOIN s ON s.label = f.label AND s.place = f.place + 1)
SELECT vec_id, round(s, 5) AS similarity, is_break FROM f""",
)
def q_breaks(spark, sf_dir):
    pieces = table(spark, sf_dir, "embeddings").withColumn("n", 20 + F.col("vec_id") % 60)
    found = breakpoints(pieces, "label", "vec_id", "embedding", "n")
    return found.select("vec_id", F.round("similarity", 5).alias("similarity"), "is_break")


@query(
    "mean_pooled",
    """WITH m AS (SELECT label, k, avg(v) AS v FROM (SELECT label, unnest(embedding::DOUBLE[]) AS v, unnest(range(64)) AS k FROM embeddings) GROUP BY label, k)
SELECT label, k::INT AS place, round(v / sqrt(sum(v * v) OVER (PARTITION BY label)), 6) AS v FROM m""",
)
def q_pooled(spark, sf_dir):
    pooled = mean_pooled(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return pooled.select("label", F.posexplode("embedding").alias("place", "v")).withColumn("v", F.round("v", 6))
