"""Rewritings, rows of the chunk store, and look-ups whose plans leave the stored side where it is."""

import uuid

from pyspark.sql import functions as F

from docloom.operators import chunk_rows
from docloom.operators.rewriting import parse_rewrite, sub_queries
from docloom.sources import lookup


def test_rewriting(spark):
    def parse(raw, fallback=("x", "y")):
        row = spark.createDataFrame([(raw, "q", list(fallback))], "raw string, q string, f array<string>").select(parse_rewrite(F.col("raw"), F.col("q"), F.col("f")).alias("p")).first().p
        return row.rewritten, row.keywords, row.sub_queries

    full = " 关键词：a, b ,, c\n改写查询：new: one\n\n子查询1：s1\n子查询2：\n子查询3: s3"
    assert parse(full) == ("one", ["a", "b", "c"], ["s1", "s3"])
    assert parse("关键字:a\n改写：") == ("q", ["a"], ["q"])
    assert parse("关键词：,\n关键词的改写：z") == ("q", ["z"], ["q"])  # a line that begins with the label is one of keywords
    assert parse(None) == ("q", ["x", "y"], ["xy", "yx"]) and parse("", ()) == ("q", [], ["q"])
    made = spark.range(1).select(*[sub_queries(F.lit("m"), F.array(*map(F.lit, "abcd"[:n])).cast("array<string>")).alias(str(n)) for n in range(5)]).first()
    assert list(made) == [["m"], ["m"], ["ab", "ba"], ["ab", "bc", "ca"], ["ab", "bc", "cd"]]


def test_rows_are_cut_and_filled(spark):
    rows = spark.createDataFrame([(1, "b" * 99, None, "7", None), (2, None, "image", "x", True)], "id long, broker string, block_type string, start_page string, needs_review boolean")
    a, b = chunk_rows.stored_rows(rows).orderBy("id").collect()
    assert (len(a.broker), a.block_type, a.start_page, a.end_page, a.needs_review, a.industry_l2) == (64, "text", 7, 0, False, "")
    assert (b.broker, b.block_type, b.start_page, b.needs_review) == ("", "image", 0, True)
    hit = chunk_rows.shown_hits(rows.withColumn("title", F.lit("")), "Document").orderBy("id").first()
    assert (hit.title, hit.chunk_key, hit.category, hit.date) == ("Document", "1", "", "")


def test_categories_tenants_and_index(spark):
    rows = spark.createDataFrame([({"category": "a", "k": "v"}, "b"), ({"category": "a"}, ""), ({}, None), (None, "c")], "m map<string,string>, c string")
    got = [r[0] for r in rows.select(chunk_rows.with_category(F.col("m"), F.col("c"))).collect()]
    assert got == [{"k": "v", "category": "b"}, {"category": "a"}, {"category": ""}, {"category": "c"}]
    tenants = spark.createDataFrame([("t", 1), ("u", 2), (None, 3)], "tenant_id string, n int")
    assert [r.n for r in chunk_rows.of_tenant(tenants, "t").collect()] == [1] and chunk_rows.of_tenant(tenants, "").count() == 0
    chunks = spark.createDataFrame([(10, "a/b c.pdf", "x\ny" * 200, 2, 3, "text"), (9, "a/b c.pdf", "t", 2, 2, "table"), (1, None, None, 1, 1, "text")], "id long, source string, content string, start_page int, end_page int, block_type string")
    assert {(r.source, r.chunks, r.file) for r in chunk_rows.dump_index(chunks).collect()} == {("a/b c.pdf", 2, "a_b_c.pdf.txt"), ("", 1, ".txt")}
    lines = [r.line for r in chunk_rows.chunk_dump(chunks, 5).orderBy("source", "page", "place").collect()]
    assert lines == ["[1] p1-1 text len=0\n    ", "[10] p2-3 text len=600\n    x yx ", "[9] p2-2 table len=1\n    t"]


def test_lookups_leave_the_stored_side_alone(spark, tmp_path):
    name = f"stored_{uuid.uuid4().hex}"
    rows = spark.range(1000).select(F.concat(F.lit("k"), F.col("id") % 300).alias("k"), F.col("id").alias("v"))
    lookup.store(rows, name, "k", f"file://{tmp_path}/t", 8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        keys = spark.createDataFrame([("k1",), ("k1",), ("k299",), ("none",), (None,)], "k string")
        found = lookup.look_up(spark, name, "k", keys)
        plan = found._jdf.queryExecution().executedPlan().toString()
        stored_side = plan.split("SortMergeJoin")[1].split("LocalTableScan")[0].split("Exchange")[0]
        assert "SortMergeJoin" in plan and "FileScan parquet" in stored_side  # no exchange stands above the stored rows
        assert sorted(r.v for r in found.collect()) == [1, 299, 301, 599, 601, 899, 901]
        one = lookup.point(spark, name, "k", "k7")
        assert sorted(r.v for r in one.collect()) == [7, 307, 607, 907]
        scan = one._jdf.queryExecution().executedPlan().collectLeaves().head()
        assert scan.optionalBucketSet().get().cardinality() == 1  # of eight
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
