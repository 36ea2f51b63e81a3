"""Operators on small literal cases."""

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import ingest, retrieval, runs


def cut(spark, scores, **kw):
    rows = [(1, i + 1, i, float(s)) for i, s in enumerate(scores)]
    return retrieval.cut_cliff(spark.createDataFrame(rows, "qid int, pos int, doc_id int, score double"), **kw).count()


def test_cliff(spark):
    assert cut(spark, [1.0, 0.95, 0.2, 0.05]) == 3
    assert cut(spark, [0.95, 0.90, 0.88, 0.85], floor=1) == 4
    assert cut(spark, [0.95, 0.92, 0.90, 0.30, 0.25], floor=1) == 3
    assert cut(spark, [0.95, 0.10], floor=2) == 2
    assert cut(spark, [0.95, 0.55, 0.40], floor=1) == 1
    assert cut(spark, [0.95, 0.55, 0.40], threshold=0.7, floor=1) == 3
    assert cut(spark, [0.95] + [0.005] * 19) == 3
    assert cut(spark, [0.9, 0.1], threshold=0) == 2


def test_split_text():
    assert ingest.split_text("abcdefgh\n\nijkl", 4, 0)[:2] == ["abcd", "efgh"]
    text = "第一段。" * 900
    parts = ingest.split_text(text, 200, 20)
    assert all(len(p) <= 200 for p in parts) and len(parts) > 10
    assert ingest.split_text("", 10, 2) == []


def test_sections_and_tables():
    found = ingest.sections("intro\n# A\nx\n## B\ny\n```\n# no\n```\n# C\nz")
    assert [s[1] for s in found] == ["", "A", "A > B", "C"]
    long = "\n".join("| row |" for _ in range(2000))
    short = ingest.truncate_table(long)
    assert len(short) <= ingest.TABLE_LIMIT and short.endswith(ingest.TABLE_NOTE)
    assert ingest.truncate_table("| a |") == "| a |"


def test_simhash_and_paragraphs(spark):
    a = "the quick brown fox jumps over the lazy dog and runs away from here " * 2
    assert ingest.simhash("") == 0
    assert ingest.paragraphs_once(f"{a}\n\n{a}\n\nshort").split("\n\n") == [a, "short"]
    rows = spark.createDataFrame([(1, 0), (2, 7), (3, 1 << 20 | 3), (4, 0)], "doc_id long, simhash long")
    assert {(r.id_a, r.id_b, r.ids_a) for r in ingest.hamming_links(rows).collect()} == {(1, 2, 2), (1, 3, 2), (2, 3, 1)}


def test_text_functions(spark):
    row = spark.range(1).select(
        T.date_of(F.lit("发布于 2024年3月5日")).alias("a"),
        T.date_of(F.lit("report 2023-13")).alias("b"),
        T.version_of(F.lit("report_v1.2.pdf")).alias("c"),
        T.security_code(F.lit("代码 600519 于 20240101")).alias("d"),
        T.citation_score(F.lit("yes [1] no [9]"), F.lit(3)).alias("e"),
        T.strip_links(F.lit("see [here](http://x)")).alias("f"),
        T.squeeze(F.lit("　a\n\n\n\nb ")).alias("g"),
    ).first()
    assert tuple(row) == ("2024-03-05", None, "1.2", "600519", 0.5, "see here", "a\n\nb")


def test_members_of_fingerprints(spark, tmp_path):
    rows = [(1, "the same text here"), (2, "another one of these"), (3, "the same text here"), (4, "the same text here"), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = ingest.q_near_pairs(spark, str(tmp_path)).where("same").collect()
    assert {(r.id_b, r.id_a, r.ids_a) for r in got} == {(1, 1, 3), (2, 2, 1), (3, 1, 3), (4, 1, 3), (5, 5, 1)} and len(got) == 5


def test_han_words_are_pairs(spark):
    row = spark.range(1).select(*[retrieval.tokens(F.lit(x)).alias(str(i)) for i, x in enumerate(["A股市场 2024年", "Plain text", None, "的"])]).first()
    assert list(row) == [["a", "股市", "市场", "2024", "年"], ["plain", "text"], [], ["的"]]


def test_breaks_need_a_long_passage(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [("d", 1, a, 60), ("d", 2, b, 50), ("d", 3, a, 10), ("d", 4, b, 95), ("d", 5, a, 5), ("e", 1, b, 200), ("e", 2, [0.0, 0.0], 1), (None, 1, a, 1), (None, 2, b, 1)]
    frame = spark.createDataFrame(rows, "g string, i int, v array<double>, n int")
    got = {(r.g, r.i): r.is_break for r in runs.breakpoints(frame, "g", "i", "v", "n").collect()}
    assert {k for k, v in got.items() if v} == {("d", 3), ("d", 5), ("e", 2)} and len(got) == len(rows)
