"""Retrieval evaluation: rank metrics, token overlap, run summaries, paired comparison, samples and gates."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.text import BOILERPLATE_WORDS, COMPLEX_HINTS, IMAGE_START, complexity, is_boilerplate
from docloom.operators.answers import _units_sql, text_units, unit_f1
from docloom.operators.ingest import TABLE_LIMIT, TABLE_NOTE
from docloom.operators.quality import located
from docloom.operators.retrieval import _bm25_sql, _dense_sql, bm25, dense, query_vectors, vectors
from docloom.operators.tables import page_label
from docloom.plans.registry import query
from docloom.session import table
from docloom.sources.scratch import stored


def rank_metrics(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """recall, precision, mrr, ndcg at k by query, from hits (qid, pos, hit) and the count of relevant rows (qid, n).

    ``ndcg`` counts each hit once; precision divides by k whatever was returned.
    """
    gain = F.when(F.col("hit"), 1 / F.log2(F.col("pos") + 1)).otherwise(0.0)
    agg = hits.where(F.col("pos") <= k).groupBy("qid").agg(
        F.sum(F.col("hit").cast("int")).alias("h"), F.min(F.when(F.col("hit"), F.col("pos"))).alias("first"), F.sum(gain).alias("dcg")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n")).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return relevant.where("n > 0").join(agg, "qid", "left").select(
        "qid",
        F.round(F.coalesce("h", F.lit(0)) / F.col("n"), 6).alias("recall"),
        F.round(F.coalesce("h", F.lit(0)) / k, 6).alias("precision"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 6).alias("ndcg"),
    )


def _label_hits(spark: SparkSession, sf_dir: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Dense hits with whether labels agree, and how many relevant rows each query has (itself excluded)."""
    v = vectors(spark, sf_dir)
    labels = v.select("doc_id", "label")
    asked = v.where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), F.col("label").alias("ql"))
    hits = dense(v, query_vectors(spark, sf_dir), k + 1).where("qid <> doc_id")
    again = F.row_number().over(Window.partitionBy("qid").orderBy("pos")).alias("pos")
    hits = hits.select("qid", "doc_id", again).where(F.col("pos") <= k).join(labels, "doc_id").join(asked, "qid")
    sizes = labels.groupBy(F.col("label").alias("ql")).agg((F.count("*") - 1).alias("n"))
    return hits.select("qid", "pos", (F.col("label") == F.col("ql")).alias("hit")), asked.join(sizes, "ql").select("qid", "n")


_HITS = _dense_sql(11) + """, others AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY pos) AS place, label = qlabel AS hit FROM dense WHERE qid <> doc_id),
hits AS (SELECT qid, place AS pos, hit FROM others WHERE place <= 10),
rel AS (SELECT q.vec_id AS qid, s.n FROM v q JOIN (SELECT label, count(*) - 1 AS n FROM v GROUP BY label) s USING (label) WHERE q.vec_id % 50 = 0),
agg AS (SELECT qid, sum(hit::INT) AS h, min(CASE WHEN hit THEN pos END) AS fst, sum(CASE WHEN hit THEN 1 / log2(pos + 1) ELSE 0 END) AS dcg FROM hits GROUP BY qid),
metrics AS (SELECT rel.qid, round(coalesce(h, 0) / n, 6) AS recall, round(coalesce(h, 0) / 10, 6) AS precision, round(coalesce(1 / fst, 0), 6) AS mrr,
  round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(10, n) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM rel LEFT JOIN agg USING (qid) WHERE n > 0)
"""


def label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_metrics(*_label_hits(spark, sf_dir, 10), 10)


@query("rank_metrics", _HITS + "SELECT qid, recall, precision, mrr, ndcg FROM metrics")
def q_rank_metrics(spark, sf_dir):
    return label_metrics(spark, sf_dir)


@query("run_summary", _HITS + "SELECT count(*) AS n, round(avg(recall), 5) AS recall, round(avg(precision), 5) AS precision, round(avg(mrr), 5) AS mrr, round(avg(ndcg), 5) AS ndcg FROM metrics")
def q_run_summary(spark, sf_dir):
    m = label_metrics(spark, sf_dir)
    return m.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 5).alias(c) for c in ("recall", "precision", "mrr", "ndcg")])


@query("by_type_summary", _HITS + "SELECT CASE WHEN qid % 100 = 0 THEN 'single_hop' ELSE 'multi_hop' END AS question_type, count(*) AS n, round(avg(mrr), 5) AS mrr FROM metrics GROUP BY ALL")
def q_by_type(spark, sf_dir):
    kind = F.when(F.col("qid") % 100 == 0, "single_hop").otherwise("multi_hop").alias("question_type")
    return label_metrics(spark, sf_dir).groupBy(kind).agg(F.count("*").alias("n"), F.round(F.avg("mrr"), 5).alias("mrr"))


@query("sweep_grid", _HITS + """SELECT k, round(avg(CASE WHEN h > 0 THEN 1 ELSE 0 END), 5) AS hit, round(avg(coalesce(1 / fst, 0)), 5) AS mrr FROM
(SELECT rel.qid, g.k, count(CASE WHEN hit THEN 1 END) AS h, min(CASE WHEN hit THEN pos END) AS fst FROM rel CROSS JOIN (VALUES (1), (3), (5), (10)) g(k)
 LEFT JOIN hits ON hits.qid = rel.qid AND hits.pos <= g.k GROUP BY ALL) GROUP BY k""")
def q_sweep(spark, sf_dir):
    hits, rel = _label_hits(spark, sf_dir, 10)
    ks = F.array(*[F.lit(k) for k in (1, 3, 5, 10)])
    first = hits.groupBy("qid").agg(F.min(F.when(F.col("hit"), F.col("pos"))).alias("first"))
    grid = rel.join(first, "qid", "left").select("first", F.explode(ks).alias("k"))
    within = F.col("first") <= F.col("k")
    return grid.groupBy("k").agg(
        F.round(F.avg(F.when(within, 1).otherwise(0)), 5).alias("hit"), F.round(F.avg(F.when(within, 1 / F.col("first")).otherwise(0.0)), 5).alias("mrr")
    )


@query("evidence_ranks", _dense_sql(10) + "SELECT qid, doc_id, max(pos) AS evidence_rank FROM dense WHERE label = qlabel GROUP BY qid, doc_id")
def q_evidence_ranks(spark, sf_dir):
    v = vectors(spark, sf_dir)
    labels = v.select("doc_id", "label")
    asked = v.select(F.col("doc_id").alias("qid"), F.col("label").alias("ql"))
    hits = dense(v, query_vectors(spark, sf_dir), 10).join(labels, "doc_id").join(asked, "qid").where("label = ql")
    return hits.groupBy("qid", "doc_id").agg(F.max("pos").alias("evidence_rank"))


_PAIR_SQL = """
WITH a AS (SELECT o_orderkey AS case_id, o_orderpriority AS tier, o_totalprice AS m FROM orders WHERE o_orderkey % 3 <> 0),
b AS (SELECT o_orderkey AS case_id, o_orderpriority AS tier, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice ELSE o_totalprice * (1 + (o_orderkey % 5 - 2) / 100::DOUBLE) END AS m FROM orders WHERE o_orderkey % 7 <> 0),
j AS (SELECT coalesce(a.tier, b.tier) AS tier, a.m AS ma, b.m AS mb FROM a FULL JOIN b ON a.case_id = b.case_id),
p AS (SELECT tier, count(*) AS cases, count(CASE WHEN ma IS NOT NULL AND mb IS NOT NULL THEN 1 END) AS n, round(avg(CASE WHEN mb IS NOT NULL AND ma IS NOT NULL THEN mb - ma END), 2) AS delta,
  count(CASE WHEN mb > ma THEN 1 END) AS wins, count(CASE WHEN mb < ma THEN 1 END) AS losses, count(CASE WHEN mb = ma THEN 1 END) AS ties FROM j GROUP BY 1)
"""


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Paired comparison of two runs (case_id, tier, m) by tier; unpaired cases count as cases only."""
    x = a.select("case_id", F.col("tier").alias("ta"), F.col("m").alias("ma"))
    y = b.select("case_id", F.col("tier").alias("tb"), F.col("m").alias("mb"))
    j = x.join(y, "case_id", "full_outer")

    def n(c: Column) -> Column:
        return F.count(F.when(c, 1))

    return j.groupBy(F.coalesce("ta", "tb").alias("tier")).agg(
        F.count("*").alias("cases"),
        n(F.col("ma").isNotNull() & F.col("mb").isNotNull()).alias("n"),
        F.round(F.avg(F.col("mb") - F.col("ma")), 2).alias("delta"),
        n(F.col("mb") > F.col("ma")).alias("wins"),
        n(F.col("mb") < F.col("ma")).alias("losses"),
        n(F.col("mb") == F.col("ma")).alias("ties"),
    )


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("tier"), F.col("o_totalprice").alias("m"))
    moved = F.when(F.col("case_id") % 4 == 0, F.col("m")).otherwise(F.col("m") * (1 + (F.col("case_id") % 5 - 2) / 100))
    return o.where("case_id % 3 <> 0"), o.where("case_id % 7 <> 0").withColumn("m", moved)


@query("paired_compare", _PAIR_SQL + "SELECT * FROM p")
def q_paired(spark, sf_dir):
    return compare_runs(*_runs(spark, sf_dir))


def bootstrap_interval(differences: np.ndarray, seed: str, resamples: int = 10_000) -> tuple[float, float]:
    """The 95 % percentile interval of the mean of resampled differences, which stand in the order of their cases.

    The draws are those of the standard library's generator with this seed: its raw numbers are made in blocks, of each
    the upper bits count, and numbers beyond the last case are drawn again.
    """
    n = len(differences)
    state = random.Random(seed).getstate()[1]
    source = np.random.MT19937()
    source.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[:-1], np.uint32), "pos": state[-1]}}
    means, left, per = [], np.empty(0, np.int64), max(1, (1 << 20) // n)
    while len(means) < resamples:
        wanted = n * min(per, resamples - len(means))
        while len(left) < wanted:
            raw = (source.random_raw(wanted) >> np.uint64(32 - n.bit_length())).astype(np.int64)
            left = np.append(left, raw[raw < n])
        means.extend(differences[left[:wanted]].reshape(-1, n).mean(axis=1).tolist())
        left = left[wanted:]
    low, high = np.percentile(means, [2.5, 97.5])
    return float(low), float(high)


def verdict(n: Column, low: Column, high: Column) -> Column:
    """By the interval of the mean difference: wholly above zero, wholly below, or neither."""
    return F.when(n == 0, "no_data").when(low > 0, "improvement").when(high < 0, "regression").otherwise("inconclusive")


def bootstrap(pairs: DataFrame, resamples: int = 10_000, seed: int = 7) -> DataFrame:
    """Mean difference and its interval by (tier, metric) of pairs (tier, metric, case_id, delta).

    One group is one evaluation run's cases for one metric, which is small; the seed is that of the tier and the metric.
    """

    def interval(batch: pd.DataFrame) -> pd.DataFrame:
        tier, metric = batch["tier"].iloc[0], batch["metric"].iloc[0]
        d = batch.sort_values("case_id")["delta"].to_numpy()
        low, high = bootstrap_interval(d, f"{seed}:{tier}:{metric}", resamples)
        return pd.DataFrame([(tier, metric, len(d), d.mean(), low, high)], columns=["tier", "metric", "n", "delta", "lo", "hi"])

    return pairs.groupBy("tier", "metric").applyInPandas(interval, "tier string, metric string, n long, delta double, lo double, hi double")


def paired_cases(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases by tier, and the pairs (tier, metric, case_id, before, after) of two runs (case_id, tier, metrics: a map).

    A case of two different tiers belongs to none; of a metric that only one run has finite, the pair has a null. Two
    records of one case are an error.
    """
    for run in (a, b):
        if not run.groupBy("case_id").count().where("count > 1 or case_id is null").isEmpty():
            raise ValueError("a run has two records of one case, or one without an id")
    x = a.select("case_id", F.col("tier").alias("ta"), F.col("metrics").alias("ma"))
    y = b.select("case_id", F.col("tier").alias("tb"), F.col("metrics").alias("mb"))
    cases = x.join(y, "case_id", "full_outer").withColumn("tier", F.coalesce("ta", "tb"))
    cases = cases.where(F.coalesce(F.col("ta") == F.col("tb"), F.lit(True)))
    none = F.create_map().cast("map<string,double>")
    keys = F.array_union(F.map_keys(F.coalesce("ma", none)), F.map_keys(F.coalesce("mb", none)))
    pairs = cases.select("tier", "case_id", "ma", "mb", F.explode(keys).alias("metric"))

    def of(m: str) -> Column:
        v = F.try_element_at(F.col(m), F.col("metric"))
        return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)

    return cases.select("case_id", "tier"), pairs.select("tier", "metric", "case_id", of("ma").alias("before"), of("mb").alias("after"))


def paired_means(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """tier, metric, n, coverage, baseline, candidate, delta, wins, losses, ties of two runs, and the differences behind them."""
    cases, pairs = paired_cases(a, b)
    both = F.col("before").isNotNull() & F.col("after").isNotNull()
    diff = F.when(both, F.col("after") - F.col("before"))

    def n(c: Column) -> Column:
        return F.count(F.when(c, 1))

    summed = pairs.groupBy("tier", "metric").agg(
        n(both).alias("n"),
        F.round(F.avg(F.when(both, F.col("before"))), 4).alias("baseline"),
        F.round(F.avg(F.when(both, F.col("after"))), 4).alias("candidate"),
        F.round(F.avg(diff), 4).alias("delta"),
        n(diff > 0).alias("wins"),
        n(diff < 0).alias("losses"),
        n(diff == 0).alias("ties"),
    )
    sizes = cases.groupBy("tier").agg(F.count("*").alias("cases"))
    joined = summed.join(sizes, "tier").withColumn("coverage", F.round(F.col("n") / F.col("cases"), 4)).drop("cases")
    return joined, pairs.where(both).select("tier", "metric", "case_id", diff.alias("delta"))


def compare_metrics(a: DataFrame, b: DataFrame, resamples: int = 10_000, seed: int = 7) -> DataFrame:
    """The paired means of two runs with lo and hi, the interval of the mean difference, and the verdict by it."""
    means, differences = paired_means(a, b)
    drawn = bootstrap(differences, resamples, seed).select("tier", "metric", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))
    return means.join(drawn, ["tier", "metric"], "left").withColumn("verdict", verdict(F.col("n"), F.col("lo"), F.col("hi")))


def decide(compared: DataFrame, primary: str, guardrails: list[str], least_coverage: float = 0.95) -> DataFrame:
    """One row with the decision on the gold tier: no_decision, fail, pass or inconclusive."""
    needed = [primary, *guardrails]
    gold = compared.where((F.col("tier") == "gold") & F.col("metric").isin(needed))
    found = gold.agg(
        F.count(F.when(F.col("coverage") >= least_coverage, 1)).alias("covered"),
        F.max(F.when(F.col("metric") == primary, F.col("verdict"))).alias("primary"),
        F.count(F.when(F.col("metric").isin(guardrails) & (F.col("verdict") == "regression"), 1)).alias("failed"),
    )
    lacking = (F.col("covered") < len(set(needed))) | F.col("primary").isNull() | (F.col("primary") == "no_data")
    decision = F.when(lacking, "no_decision").when((F.col("primary") == "regression") | (F.col("failed") > 0), "fail")
    return found.select(decision.when(F.col("primary") == "improvement", "pass").otherwise("inconclusive").alias("decision"))


def _metric_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two runs over labelled documents: some cases in one run only, some of another tier in it, metrics that lack or are no number."""
    d = table(spark, sf_dir, "labels").select("doc_id", "quality")
    tier = F.when(F.col("doc_id") % 3 == 0, "gold").otherwise("silver")
    value = (F.col("doc_id") % 11) / 10
    mrr = F.create_map(F.lit("mrr"), value, F.lit("recall"), F.when(F.col("doc_id") % 5 == 0, float("nan")).otherwise(value / 2))
    other = F.create_map(F.lit("mrr"), value + (F.col("doc_id") % 4) / 10 - 0.1, F.lit("recall"), F.when(F.col("doc_id") % 7 > 0, value / 2), F.lit("late"), value)
    case = F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("case_id")
    moved = F.when(F.col("doc_id") % 13 == 0, "none").otherwise(tier)
    return d.where("doc_id % 10 <> 1").select(case, tier.alias("tier"), mrr.alias("metrics")), d.where("doc_id % 10 <> 2").select(case, moved.alias("tier"), other.alias("metrics"))


_METRIC_SQL = """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'gold' ELSE 'silver' END AS tier, (doc_id % 11) / 10 AS v FROM labels),
c AS (SELECT *, doc_id % 10 <> 1 AS a, doc_id % 10 <> 2 AS b, CASE WHEN doc_id % 10 = 1 AND doc_id % 13 = 0 THEN 'none' ELSE tier END AS t FROM d WHERE NOT (doc_id % 13 = 0 AND doc_id % 10 <> 1 AND doc_id % 10 <> 2)),
p AS (SELECT t AS tier, 'mrr' AS metric, CASE WHEN a THEN v END AS x, CASE WHEN b THEN v + (doc_id % 4) / 10 - 0.1::DOUBLE END AS y FROM c
 UNION ALL SELECT t, 'recall', CASE WHEN a AND doc_id % 5 <> 0 THEN v / 2 END, CASE WHEN b AND doc_id % 7 > 0 THEN v / 2 END FROM c
 UNION ALL SELECT t, 'late', NULL, v FROM c WHERE b),
n AS (SELECT t AS tier, count(*) AS cases FROM c GROUP BY 1),
q AS (SELECT tier, metric, count(y - x) AS n, round(avg(CASE WHEN y IS NOT NULL THEN x END), 4) AS baseline, round(avg(CASE WHEN x IS NOT NULL THEN y END), 4) AS candidate,
 round(avg(y - x), 4) AS delta, count(CASE WHEN y > x THEN 1 END) AS wins, count(CASE WHEN y < x THEN 1 END) AS losses, count(CASE WHEN y = x THEN 1 END) AS ties FROM p GROUP BY ALL)
SELECT tier, metric, n, round(n / cases, 4) AS coverage, baseline, candidate, delta, wins, losses, ties FROM q JOIN n USING (tier)"""


@query("run_comparison", _METRIC_SQL)
def q_run_comparison(spark, sf_dir):
    return paired_means(*_metric_runs(spark, sf_dir))[0]


@query("bootstrap_ci")
def q_bootstrap(spark, sf_dir):
    """On the rank metrics of dense lists: the difference of mrr and recall by query, 10,000 resamples."""
    m = label_metrics(spark, sf_dir).withColumn("tier", F.when(F.col("qid") % 100 == 0, "gold").otherwise("silver"))
    pairs = m.select("tier", F.lit("mrr_less_recall").alias("metric"), F.col("qid").alias("case_id"), (F.col("mrr") - F.col("recall")).alias("delta"))
    return bootstrap(pairs)


@query("verdicts")
def q_verdicts(spark, sf_dir):
    return compare_metrics(*_metric_runs(spark, sf_dir)).select("tier", "metric", "n", "lo", "hi", "verdict")


_F1 = f"""WITH t AS (SELECT b.item_id, {{}} AS r, {{}} AS a FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
s AS (SELECT item_id, len(list_intersect(r, a)) AS c, len(r) AS nr, len(a) AS na FROM t)"""


@query("token_f1", _F1.format(_units_sql("b.text || '[3] 风险提示'"), _units_sql("d.text || '提示函'")) + " SELECT item_id, round(CASE WHEN c = 0 THEN 0 ELSE 2 * (c / na) * (c / nr) / ((c / na) + (c / nr)) END, 6) AS f1 FROM s")
def q_token_f1(spark, sf_dir):
    """Overlap of the distinct units of an answer (a document) and of its reference (a benchmark passage)."""
    r = table(spark, sf_dir, "benchmark").select("item_id", F.concat("text", F.lit("[3] 风险提示")).alias("r"))
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.concat("text", F.lit("提示函")).alias("a"))
    both = r.join(a, "item_id")  # only texts that have a partner are cut into units
    return both.select("item_id", F.round(unit_f1(text_units(F.col("r")), text_units(F.col("a"))), 6).alias("f1"))


@query("quota_gate", "SELECT quality, toxic, count(*) AS n, count(*) >= 50 AS enough FROM labels GROUP BY ALL")
def q_quota(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"), (F.count("*") >= 50).alias("enough"))


@query("source_share_gate", "SELECT source, round(count(*) / sum(count(*)) OVER (), 6) AS share, count(*) / sum(count(*)) OVER () <= 0.2::DOUBLE AS passes FROM documents GROUP BY source")
def q_source_share(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    share = F.col("n") / F.col("total")
    return counts.join(F.broadcast(total)).select("source", F.round(share, 6).alias("share"), (share <= 0.2).alias("passes"))


@query("stratified_sample", "SELECT quality, doc_id FROM labels QUALIFY row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR), doc_id) <= 20")
def q_stratified(spark, sf_dir):
    """Twenty rows of each class by a hash of the id, which serves as the seeded order."""
    order = Window.partitionBy("quality").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    return table(spark, sf_dir, "labels").withColumn("n", F.row_number().over(order)).where("n <= 20").select("quality", "doc_id")


def evidence_diagnostics(evidence: DataFrame, ranked_hits: DataFrame, chunks: DataFrame, top: int = 5) -> DataFrame:
    """One row: how much of the evidence the results hold, and what takes their places.

    evidence (qid, doc_id) is looked for among ranked_hits (qid, pos, doc_id), which is the whole pool: in its first ``top``
    rows (exact_hit), its first three (rank3), anywhere (pool_hit), and by its source among those of the first ones (doc_hit).
    chunks (doc_id, source, block_type, text) say what the first rows are: notices, images, tables or other texts.
    """
    first = ranked_hits.where(F.col("pos") <= top)
    known = chunks.select("doc_id", "source")
    found = evidence.select("qid", "doc_id").distinct().join(ranked_hits.select("qid", "doc_id", "pos"), ["qid", "doc_id"], "left").join(known, "doc_id", "left")
    shown = first.join(known, "doc_id").select("qid", "source", F.lit(True).alias("_shown")).where("source <> ''").distinct()
    judged = found.join(shown, ["qid", "source"], "left")

    def n(c: Column) -> Column:
        return F.count(F.when(c, 1))

    totals = judged.agg(
        F.count("*").alias("evidence"), n(F.col("pos") <= top).alias("exact_hit"), n(F.col("pos") <= min(3, top)).alias("rank3"),
        n(F.col("pos").isNotNull()).alias("pool_hit"), n(F.col("_shown")).alias("doc_hit"),
    )
    kind = F.coalesce(F.col("block_type"), F.lit(""))
    notice = is_boilerplate(F.coalesce("text", F.lit("")), F.col("block_type"))
    slots = first.select("qid", "doc_id").join(chunks.select("doc_id", "block_type", "text"), "doc_id", "left").select(
        F.when(notice & (kind != "image"), "boilerplate").when(notice, "image").when(kind == "table", "table").otherwise("text").alias("slot")
    )
    names = ("boilerplate", "image", "table", "text")
    parts = slots.agg(F.count("*").alias("slots"), *[n(F.col("slot") == x).alias(f"{x}_slots") for x in names])
    return totals.join(F.broadcast(parts))  # one row each


_KIND = "CASE WHEN doc_id % 7 = 0 THEN 'image' WHEN doc_id % 5 = 0 THEN 'table' ELSE 'text' END"
_CHUNK = "CASE WHEN doc_id % 9 = 0 THEN '资料来源：' || text ELSE text END"


@query(
    "boilerplate_diagnostics",
    _bm25_sql(k=20)
    + f""", k AS (SELECT doc_id, source, {_KIND} AS bt, {_CHUNK} AS text FROM documents),
e AS (SELECT b.item_id AS qid, d.doc_id, d.source FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
j AS (SELECT e.*, h.pos, EXISTS (SELECT 1 FROM bm25 x JOIN k USING (doc_id) WHERE x.qid = e.qid AND x.pos <= 5 AND k.source = e.source) AS shown FROM e LEFT JOIN bm25 h ON h.qid = e.qid AND h.doc_id = e.doc_id),
t AS (SELECT count(*) AS evidence, count(CASE WHEN pos <= 5 THEN 1 END) AS exact_hit, count(CASE WHEN pos <= 3 THEN 1 END) AS rank3, count(pos) AS pool_hit, count(CASE WHEN shown THEN 1 END) AS doc_hit FROM j),
s AS (SELECT CASE WHEN bt = 'image' OR regexp_matches(trim(text), '{IMAGE_START}') THEN CASE WHEN bt = 'image' THEN 'image' ELSE 'boilerplate' END
 WHEN regexp_matches(left(text, 120), '{"|".join(BOILERPLATE_WORDS)}') OR length(trim(text)) < 40 AND regexp_matches(text, '{"|".join(BOILERPLATE_WORDS)}') THEN 'boilerplate' WHEN bt = 'table' THEN 'table' ELSE 'text' END AS slot FROM bm25 JOIN k USING (doc_id) WHERE pos <= 5),
p AS (SELECT count(*) AS slots, count(CASE WHEN slot = 'boilerplate' THEN 1 END) AS boilerplate_slots, count(CASE WHEN slot = 'image' THEN 1 END) AS image_slots, count(CASE WHEN slot = 'table' THEN 1 END) AS table_slots, count(CASE WHEN slot = 'text' THEN 1 END) AS text_slots FROM s)
SELECT * FROM t, p""",
)
def q_diagnostics(spark, sf_dir):
    """The documents that hold a benchmark passage are its evidence; some documents stand for images, tables and notices."""
    docs = table(spark, sf_dir, "documents")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    evidence = located(items, docs.select("doc_id", "text")).select(F.col("item_id").alias("qid"), "doc_id").distinct()
    pool = stored(bm25(docs, items.select(F.col("item_id").alias("qid"), F.col("quote").alias("text")), 20), "pool")  # read three times
    text = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("资料来源："), "text")).otherwise(F.col("text")).alias("text")
    kind = F.when(F.col("doc_id") % 7 == 0, "image").when(F.col("doc_id") % 5 == 0, "table").otherwise("text").alias("block_type")
    return evidence_diagnostics(evidence, pool, docs.select("doc_id", "source", kind, text))


#: Questions of all lengths, with hint words and question marks, from the names of parts.
ASKED = "concat(CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN p_name ELSE concat(p_name, ' ', p_type, ' ', p_brand) END, CASE WHEN p_partkey % 4 = 0 THEN '如何' WHEN p_partkey % 4 = 1 THEN '对比？' WHEN p_partkey % 4 = 2 THEN '原因?？' ELSE ' ' END)"


@query(
    "query_complexity",
    f"""SELECT p_partkey, CASE WHEN length(q) <= 15 AND h = 0 AND m <= 1 THEN 'simple' WHEN length(q) > 40 OR h >= 2 OR m >= 2 THEN 'complex' ELSE 'normal' END AS complexity
FROM (SELECT p_partkey, q, length(q) - length(replace(replace(q, '?', ''), '？', '')) AS m, list_sum(list_transform({COMPLEX_HINTS}, lambda w: contains(q, w)::INT)) AS h
FROM (SELECT p_partkey, trim({ASKED}) AS q FROM part))""",
)
def q_complexity(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", complexity(F.expr(ASKED)).alias("complexity"))


@query(
    "history_window",
    """WITH r AS (SELECT conv_id, turn, role, substring(text, 1, 200) AS t FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) <= 6)
SELECT conv_id, md5(string_agg(coalesce(role, '') || ': ' || coalesce(t, ''), chr(10) ORDER BY turn, role, t)) AS history, count(*) AS turns FROM r GROUP BY conv_id""",
)
def q_history(spark, sf_dir):
    """The last six turns of a conversation, two hundred characters each, as one text."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text")
    rows = table(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(order)).where("n <= 6")
    rows = rows.select("conv_id", "turn", "role", F.substring("text", 1, 200).alias("t"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "t"))), lambda x: F.concat(F.coalesce(x["role"], F.lit("")), F.lit(": "), F.coalesce(x["t"], F.lit(""))))
    return rows.groupBy("conv_id").agg(F.md5(F.array_join(lines, "\n")).alias("history"), F.count("*").alias("turns"))


TEXT_LIMIT = 2000  # characters of a part that is no table
#: Labels of a context's parts. Fixed values.
BLOCK_LABELS = {"table": "表格", "image": "图片"}
NOTHING_FOUND = "（未检索到相关文档）"


def context_part(hit: dict[str, Column]) -> Column:
    """Header and content of one hit (pos, title, content, date, start_page, end_page, block_type, truncated)."""
    kind = F.coalesce(hit["block_type"], F.lit("text"))
    label = F.lit(None).cast("string")
    for name, said in BLOCK_LABELS.items():
        label = F.when(kind == name, f"类型：{said}").otherwise(label)
    page = page_label(hit["start_page"], hit["end_page"])
    labels = F.array_compact(F.array(F.when(hit["date"] != "", F.concat(F.lit("报告日期："), hit["date"])), F.when(page != "", page), label))
    said = F.when(F.size(labels) > 0, F.concat(F.lit("（"), F.array_join(labels, "，"), F.lit("）"))).otherwise("")
    content = F.substring(F.coalesce(hit["content"], F.lit("")), F.lit(1), F.when(kind == "table", TABLE_LIMIT).otherwise(TEXT_LIMIT))
    note = F.when((kind == "table") & F.coalesce(hit["truncated"], F.lit(False)), TABLE_NOTE).otherwise("")
    return F.concat(F.lit("["), hit["pos"], F.lit("] 来源："), hit["title"], said, F.lit("\n"), content, note)


def build_context(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """qid, context: the parts of each query's hits in list order; a fixed remark where nothing was found."""
    names = ["pos", "title", "content", "date", "start_page", "end_page", "block_type", "truncated"]
    part = F.struct("pos", context_part({c: F.col(c) for c in names}).alias("x"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["x"]), "\n\n---\n\n")
    made = hits.groupBy("qid").agg(joined.alias("context"))
    return queries.select("qid").join(made, "qid", "left").withColumn("context", F.coalesce("context", F.lit(NOTHING_FOUND)))


@query("context_build", _bm25_sql() + f"""SELECT q.item_id AS qid, coalesce(md5(string_agg(CASE WHEN b.doc_id IS NOT NULL THEN '[' || b.pos || '] 来源：' || d.source
 || CASE d.doc_id % 4 WHEN 0 THEN '（报告日期：2024-01-02，页码：3-5，类型：表格）' WHEN 1 THEN '（页码：1，类型：图片）' WHEN 2 THEN '' ELSE '（页码：3）' END
 || chr(10) || left(d.text, CASE WHEN d.doc_id % 4 = 0 THEN {TABLE_LIMIT} ELSE 2000 END) || CASE WHEN d.doc_id % 8 = 0 THEN '{TABLE_NOTE}' ELSE '' END END, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY b.pos)), md5('{NOTHING_FOUND}')) AS context
FROM (SELECT item_id FROM benchmark UNION ALL SELECT -1) q LEFT JOIN bm25 b ON b.qid = q.item_id LEFT JOIN documents d USING (doc_id) GROUP BY q.item_id""")
def q_context(spark, sf_dir):
    """Documents as hits of all kinds; one query without any."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    k = F.col("doc_id") % 4
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("title"), F.col("text").alias("content"),
        F.when(k == 0, "2024-01-02").when(k == 1, "").alias("date"), F.when(k == 1, 1).when(k == 2, 0).otherwise(3).alias("start_page"),
        F.when(k == 0, 5).when(k == 1, 0).otherwise(3).alias("end_page"), F.when(k == 0, "table").when(k == 1, "image").alias("block_type"),
        (F.col("doc_id") % 8 <= 3).alias("truncated"),
    )
    hits = bm25(table(spark, sf_dir, "documents"), q, 5).select("qid", "doc_id", "pos").join(docs, "doc_id")
    asked = q.select("qid").union(spark.createDataFrame([(-1,)], "qid long"))
    return build_context(asked, hits).select("qid", F.md5("context").alias("context"))


def rows_by_query(hits: DataFrame) -> Iterator:
    """Driver-side access for small results: rows in query and list order, one partition at a time."""
    return hits.orderBy("qid", "pos").toLocalIterator()
