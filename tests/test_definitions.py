"""Dates by label first, whole lines of tables, and deletion, renaming and correction with their guards."""

import pytest
from pyspark.sql import functions as F

from docloom.functions.text import date_of
from docloom.operators import catalog, ingest


@pytest.mark.parametrize(
    "text, day",
    [
        ("2020-01-02 报告日期：2024年5月1日", "2024-05-01"), ("发布时间 2024.5", "2024-05-01"), ("公布日期:2024/13/1 then 2023-2-3", None), ("日期：1999-01-01, 2021年7月", "2021-07-01"),
        ("on 2024 - 05 - 06", "2024-05-06"), ("2024-05", None), ("2024年5月", "2024-05-01"), ("2024-5-40 2024年5月", "2024-05-01"), ("", None), (None, None), ("x" * 3000 + "2024-05-06", None),
    ],
)
def test_date_of(spark, text, day):
    assert spark.createDataFrame([(text,)], "t string").select(date_of(F.col("t"))).first()[0] == day


def test_table_note_and_room():
    table = "\n".join(f"| {i:04d} |" for i in range(1000))
    short = ingest.truncate_table(table, 200)
    lines = short.removesuffix(ingest.TABLE_NOTE).split("\n")
    assert short.endswith("\n\n（表已截断，可点击查看完整表）") and lines == table.split("\n")[: len(lines)]
    assert sum(len(x) + 1 for x in lines) <= 200 - len(ingest.TABLE_NOTE) < sum(len(x) + 1 for x in [*lines, "| 0000 |"])


def test_delete_counts_before(spark):
    rows = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("a", None, 3), ("b", "1", 4), (None, "1", 5)], "source string, version string, n int")
    left, taken = catalog.delete_sources(rows, spark.createDataFrame([("a", "1"), ("a", "1"), ("b", None), ("z", None), ("a", "9")], "source string, version string"))
    assert sorted(r.n for r in left.collect()) == [2, 3, 5]
    assert {(r.source, r.version): r.deleted for r in taken.collect()} == {("a", "1"): 1, ("b", None): 1, ("z", None): 0, ("a", "9"): 0}
    left, taken = catalog.delete_sources(rows, spark.createDataFrame([("a", None), ("a", "1")], "source string, version string"))
    assert sorted(r.n for r in left.collect()) == [4, 5] and {r.version: r.deleted for r in taken.collect()} == {None: 3, "1": 1}


def test_rename_guards(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("default", 3), (None, 4), ("c", 5)], "category string, n int")
    registry = spark.createDataFrame([("a",), ("b",), ("c",), ("default",), ("empty",)], "category string")
    asked = [("a", "new"), ("b", "two"), ("c", "two"), ("default", "x"), ("zz", "y"), ("empty", "a b"), ("empty", "a")]
    renamed, said = catalog.rename_categories(rows, registry, spark.createDataFrame(asked, "old string, new string"))
    assert {r.n: r.category for r in renamed.collect()} == {1: "new", 2: "b", 3: "default", 4: None, 5: "c"}
    assert {(r.old, r.new): r.status for r in said.collect()} == {
        ("a", "new"): "renamed", ("b", "two"): "ambiguous", ("c", "two"): "ambiguous", ("default", "x"): "default", ("zz", "y"): "missing", ("empty", "a b"): "invalid", ("empty", "a"): "exists",
    }


def test_patches(spark):
    rows = spark.createDataFrame([("a", "2000-01-01", "", False, 1), ("a", "2000-01-01", "", False, 2), ("b", "2000-01-01", "600000", True, 3), (None, "2000-01-01", "", None, 4)], "source string, date string, security_code string, is_manual boolean, n int")
    patches = [("a", "date", "2024"), ("a", "security_code", " 000001 "), ("b", "security_code", ""), ("b", "date", "yesterday"), ("a", "owner", "x"), ("q", "date", "2024"), ("a", "broker", "y")]
    made, said = catalog.patch_metadata(rows, spark.createDataFrame(patches, "source string, field string, value string"))
    assert made.columns == rows.columns[:3] + ["n", "is_manual"]
    got = {r.n: (r.date, r.security_code, r.is_manual) for r in made.collect()}
    assert got == {1: ("2024-01-01", "000001", True), 2: ("2024-01-01", "000001", True), 3: ("2000-01-01", "", True), 4: ("2000-01-01", "", False)}
    verdicts = {(r.source, r.field): r.verdict for r in said.collect()}
    assert verdicts[("b", "date")] == "invalid value" and verdicts[("q", "date")] == "unknown key" and verdicts[("a", "broker")] == verdicts[("a", "owner")] == "unknown field"
