"""Merged metadata and versions on literal cases."""

import json

import pytest
from pyspark.sql import functions as F

from docloom.operators import report_metadata as rm

TAXONOMY = {"银行": ["国有大行", "股份行"], "电子": []}
CASES = [
    # name, title, reply, what is expected of (code, name, l1, l2, kind, broker, source, review, rejected)
    ("贵州茅台(600519)-中信证券.pdf", "", None, ("600519", "贵州茅台", "", "", "个股", "中信证券", "regex", True, [])),
    ("note.pdf", None, "no object", ("", "", "", "", "", "", "regex", True, [])),
    (
        "note.pdf",
        "",
        {"security_code": " 000001 ", "security_name": "平安银行", "industry_l1": "银行", "industry_l2": "股份行", "report_type": "个股", "broker": "b" * 90},
        ("000001", "平安银行", "银行", "股份行", "个股", "b" * 64, "llm", False, []),
    ),
    ("note.pdf", "", {"industry_l1": "银行", "industry_l2": "半导体"}, ("", "", "银行", "", "", "", "llm", True, ["industry_l2"])),
    ("note.pdf", "", {"industry_l1": "食品", "industry_l2": "股份行"}, ("", "", "", "", "", "", "regex", True, ["industry_l1"])),
    ("note.pdf", "", {"industry_l1": "电子", "report_type": "个股"}, ("", "", "电子", "", "个股", "", "llm", True, [])),
    ("行业周报.pdf", "", {"metadata": {"industry_l1": "电子", "report_type": "个股", "security_code": "202608"}}, ("", "", "电子", "", "行业", "", "llm", True, ["security_code"])),
    (None, None, {"industry_l1": None, "industry_l2": "股份行"}, ("", "", "", "", "", "", "regex", True, [])),
]


def test_merged(spark):
    rows = [(i, n, t, r if r is None or isinstance(r, str) else f"Sure {json.dumps(r, ensure_ascii=False)} done", "x") for i, (n, t, r, _) in enumerate(CASES)]
    reports = spark.createDataFrame(rows, "id int, filename string, title string, reply string, broker string")
    got = {r.id: tuple(r)[1:] for r in rm.merged_metadata(reports, TAXONOMY).collect()}
    assert got == {i: want for i, (*_, want) in enumerate(CASES)}
    bare = rm.merged_metadata(reports, {}).where("industry_l1 <> ''")
    assert bare.isEmpty() and rm.merged_metadata(reports.where(F.lit(False)), TAXONOMY).isEmpty()


@pytest.mark.parametrize(
    ("explicit", "name", "want"),
    [
        (None, "report_v1.2.pdf", "1.2"), (" 3 ", "report_v1.2.pdf", "3"), ("", "报告（V2）.docx", "2"), (None, "report-v10 ).md", "10"), (None, "v7.pdf", "7"),
        (None, "report_v1_final.pdf", ""), (None, "dir_v4/report.pdf", ""), (None, None, ""), (None, "", ""), (None, "x v1.2.3.tar", "1.2.3"),
    ],
)
def test_version(spark, explicit, name, want):
    row = spark.createDataFrame([(explicit, name)], "e string, n string")
    assert row.select(rm.document_version(F.col("e"), F.col("n")).alias("v")).first().v == want
