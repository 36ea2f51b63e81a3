"""Headings, blocks, run comparisons and contexts on literal cases and against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import evaluation, headings, requests


def plain_interval(d, seed, resamples):
    rng = random.Random(seed)
    means = sorted(sum(d[rng.randrange(len(d))] for _ in range(len(d))) / len(d) for _ in range(resamples))

    def at(p):
        place = p * (resamples - 1)
        low = int(place)
        return means[low] * (1 - place + low) + means[min(low + 1, resamples - 1)] * (place - low)

    return at(0.025), at(0.975)


@pytest.mark.parametrize("n", [1, 2, 7, 64, 100])
def test_interval_draws_as_the_standard_library(n):
    d = np.random.default_rng(n).normal(0.1, 1, n)
    got = evaluation.bootstrap_interval(d, "7:gold:mrr", 1000)
    assert np.allclose(got, plain_interval(d.tolist(), "7:gold:mrr", 1000), atol=1e-12)


def runs(spark, moves):
    schema = "case_id string, tier string, metrics map<string,double>"
    a = [(f"c{i}", "gold", {"mrr": 0.5, "recall": 0.5}) for i in range(len(moves))]
    b = [(f"c{i}", "gold", {"mrr": 0.5 + m, "recall": 0.5 + r}) for i, (m, r) in enumerate(moves)]
    return spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)


def test_decisions(spark):
    def decided(moves, **kw):
        return evaluation.decide(evaluation.compare_metrics(*runs(spark, moves), 200), "mrr", ["recall"], **kw).first()[0]

    assert decided([(0.1, 0.0)] * 8) == "pass"
    assert decided([(0.1, -0.1)] * 8) == "fail" and decided([(-0.1, 0.0)] * 8) == "fail"
    assert decided([(0.1, 0.0), (-0.1, 0.0)] * 4) == "inconclusive"
    assert decided([(0.1, float("nan"))] + [(0.1, 0.0)] * 7) == "no_decision"
    a, b = runs(spark, [(0.1, 0.0)] * 3)
    got = {r.metric: r for r in evaluation.compare_metrics(a, b, 50).collect()}
    assert (got["mrr"].n, got["mrr"].coverage, got["mrr"].delta, got["mrr"].wins, got["mrr"].verdict) == (3, 1.0, 0.1, 3, "improvement")
    with pytest.raises(ValueError):
        evaluation.compare_metrics(a.union(a), b)


def injected(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(headings.inject_headings(F.col("t"))).first()[0]


def test_headings(spark):
    text = "标题\n第一章 总则\n一、目的\n（一）范围\n正文\n```\n一、不是\n```\n第一条 内容"
    made = injected(spark, text)
    assert made == "标题\n## 第一章 总则\n#### 一、目的\n##### （一）范围\n正文\n```\n一、不是\n```\n### 第一条 内容"
    assert injected(spark, made) == made
    assert injected(spark, "# Own\n1. a\n1.1 b\n1.5倍\n") == "# Own\n## 1. a\n### 1.1 b\n1.5倍\n"
    assert injected(spark, "### Own\n1、a") == "### Own\n#### 1、a"
    assert injected(spark, "no marks\n~~~\n1. x") == "no marks\n~~~\n1. x" and injected(spark, "") == "" and injected(spark, None) is None
    long = "一、" + "x" * 90
    assert injected(spark, long) == long


def test_blocks():
    assert headings.merge_pieces(["aa", "bb", "cccc", "d"], 6) == ["aa\n\nbb", "cccc", "d"]
    assert headings.merge_pieces([], 5) == []
    text = "intro words\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |\nafter the table"
    got = headings.text_blocks(text, 40, 0)
    assert [(k, t) for k, t, _ in got] == [("text", "intro words"), ("table", "a | b\n1 | 2"), ("text", "after the table")]
    assert got[1][2].endswith("| 3 | 4 |") and headings.text_blocks("") == []


def test_cleaning(spark):
    text = "Head\n第 3 页\n12 / 40\n版权所有 2024\nbody [x](http://y) [z](w.md)\n目录内容 ...... 3\nHead\n\n\n\nend\ufffd"
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(T.clean_text(F.col("t"))).collect()
    assert [r[0] for r in got] == ["body x [z](w.md)\n\nend", None, ""]


def test_requests(spark):
    row = spark.range(1).select(
        requests.stem(F.lit("a/b.c/r.2024.pdf")), requests.stem(F.lit("plain")), requests.resolved_date(F.lit(None).cast("string"), F.lit("x.pdf"), F.lit("none"), F.lit(None).cast("timestamp")),
        F.array_join(requests.distinct_in_order(F.array(F.lit(" b"), F.lit("a"), F.lit("b "), F.lit("")), 5), "|"), requests.dynamic_k(F.lit("why"), 9, 8, False),
    ).first()
    assert tuple(row) == ("r.2024", "plain", "", "b|a", (9, 8))


def test_located_quotes(spark):
    from docloom.operators.quality import located

    docs = [(1, "one two three four five six"), (2, "zero one two three four five"), (3, "xone two yfour"), (4, None), (5, "")]
    quotes = [(1, "e two three four fi"), (2, "one two thr"), (3, "two"), (4, "three  four five"), (5, "wo y"), (6, "none of these are there")]
    got = located(spark.createDataFrame(quotes, "item_id int, quote string"), spark.createDataFrame(docs, "doc_id int, text string")).collect()
    assert sorted((r.item_id, r.doc_id) for r in got) == sorted((q, d) for q, a in quotes for d, t in docs if t and a in t)


def test_hamming_links_find_all(spark):
    from docloom.operators.ingest import hamming_links

    rng = np.random.default_rng(8)
    base = rng.integers(-(1 << 63), 1 << 63, 30, dtype=np.int64).tolist()
    made = base + [int(np.int64(np.uint64(b & (1 << 64) - 1) ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, int(k), replace=False))))) for b in base for k in rng.integers(1, 6, 4)]
    rows = list(enumerate(dict.fromkeys(made)))
    want = {(a, b) for a, x in rows for b, y in rows if a < b and bin((x ^ y) & (1 << 64) - 1).count("1") <= 3}
    got = hamming_links(spark.createDataFrame(rows, "doc_id long, simhash long")).collect()
    assert {(r.id_a, r.id_b) for r in got} == want and len(want) > 50
