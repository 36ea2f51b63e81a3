"""Answers, metadata and runs on literal cases."""

import hashlib
import hmac
import struct

from pyspark.sql import functions as F

from docloom.operators import answers, metadata, runs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_answers(spark):
    assert one(spark, answers.is_refusal(F.lit("检索到的内容未提供数据"))) == 1.0 == one(spark, answers.is_refusal(F.lit(None).cast("string")))
    assert one(spark, answers.is_refusal(F.lit("营收增长"))) == 0.0
    assert sorted(one(spark, answers.text_units(F.lit("Up 3% [1] 银行业 股")))) == ["3", "up", "股", "行业", "银行"]
    units = F.array(answers.text_units(F.lit("rates rise fast")))
    assert one(spark, answers.support(answers.claim_sentences(F.lit("rates rise; ok; other words")), units)) == round((0.8 + 0) / 2, 4)
    assert one(spark, answers.support(answers.claim_sentences(F.lit("")), units)) == 0.0
    for given, want in [((0, None, 0, None), (True, False)), ((1, 0.2, 0, None), (True, False)), ((1, 0.9, 1, 0.4), (True, False)), ((1, 0.9, 1, 0.7), (False, True)), ((1, None, 0, 0.1), (False, False))]:
        got = answers.refusal_policy(*[F.lit(x).cast("double") for x in given])
        assert tuple(one(spark, c) for c in got) == want, given


def jpeg(width, height):
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xff\xc2\x00\x0b\x08" + struct.pack(">HH", height, width) + b"\x01" * 8


def test_metadata(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 7, 9)
    cases = {png: (7, 9), b"GIF89a" + struct.pack("<HH", 3, 4): (3, 4), jpeg(640, 480): (640, 480), jpeg(1, 1)[:12]: None, png[:18]: None, b"": None, b"text": None}
    rows = [(i, x) for i, x in enumerate([*cases, None])]
    got = {r.i: (r.width, r.height) for r in metadata.with_image_size(spark.createDataFrame(rows, "i int, content binary")).collect()}
    assert got == {i: size or (None, None) for i, size in enumerate([*cases.values(), None])}
    for secret in (b"k", b"long" * 40):
        assert one(spark, metadata.hmac_sha256(F.lit("é body"), secret)) == hmac.new(secret, "é body".encode(), hashlib.sha256).hexdigest()
    assert one(spark, metadata.json_payload(F.lit("no braces"))) is None
    assert one(spark, metadata.json_payload(F.lit('x {"a": 1} y'))) == {"a": "1"}
    assert one(spark, metadata.filename_date(F.lit("a_2024年3月5日.pdf"))) == "2024-03-05" and one(spark, metadata.filename_date(F.lit("v1.2"))) is None
    assert one(spark, metadata.filled(F.lit(""), F.lit("guess"))) == "guess"


def test_rounds(spark):
    asked = spark.createDataFrame([(1, 0.9), (2, 0.1), (3, 0.2)], "qid long, level double")

    def retrieve(q):
        return q.select("qid", F.lit(5).alias("doc_id"), F.lit(1).alias("pos"), F.col("level").alias("score"))

    got = runs.search_rounds(asked, retrieve, lambda q: q.withColumn("level", F.col("level") + 0.15), 9)
    assert sorted((r.qid, r.round) for r in got.collect()) == [(1, 1), (2, 3), (3, 2)]


def test_runs(spark):
    a = spark.createDataFrame([("m", 0.0), ("n", 2.0)], "metric string, value double")
    b = spark.createDataFrame([("m", 1.0), ("n", 2.0), ("o", 1.0)], "metric string, value double")
    got = {r.metric: (r.delta, r.relative_pct, r.winner) for r in runs.compare_arms(a, b).collect()}
    assert got == {"m": (1.0, None, "B"), "n": (0.0, 0.0, "tie"), "o": (None, None, None)}
    none = F.create_map(F.lit("x"), F.lit(1.0))
    assert one(spark, runs.composite_score(none)) == 0.0
