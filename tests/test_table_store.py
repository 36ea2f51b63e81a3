"""Tables found in sections and taken apart, on literal cases and against a plain reading of their lines."""

import re

from pyspark.sql import functions as F

from docloom.operators import table_store as ts

HTML = "<table><tr><td colspan='2'>Balance sheet</td></tr><tr><th>Item</th><th>2024</th></tr><tr><td>Cash&nbsp;&amp; more</td><td>12</td></tr></table>"
PIPE = "| Item | 2024 |\n|---|---|\n| Cash | 12 |\n| Debt | 3 |\n"


def test_parts():
    assert ts.table_parts(HTML) == (
        "| Balance sheet |  |\n| --- | --- |\n| Item | 2024 |\n| Cash & more | 12 |",
        [["Balance sheet"], ["Item", "2024"], ["Cash & more", "12"]],
        "| Item | 2024 |\n| --- | --- |\n| Cash & more | 12 |",
    )
    assert ts.table_parts(PIPE) == (PIPE.strip(), [["Item", "2024"], ["Cash", "12"], ["Debt", "3"]], "| Item | 2024 |\n| Cash | 12 |")
    assert ts.table_parts("| a | b |\n| c | d |") == ("| a | b |\n| c | d |", [["a", "b"], ["c", "d"]], "| a | b |\n| c | d |")
    assert ts.table_parts("<table></table>") == ("<table></table>", [], "") and ts.headed([["a"], ["b"]]) == [["b"]]


def test_sections(spark):
    texts = [
        f"Words\n{PIPE}more | words\n{HTML} end",
        "no | table\n|open",
        None,
        "",
        f"  | one line |\t\nword\r\n| two |\r\n| lines |\r\n{HTML.upper()}",
        "<table><tr><td>never closed",
        "".join(f"| {i} | x |\n" for i in range(30_000)) + "|last|",
    ]
    sections = spark.createDataFrame([(f"p{i}", "src", t) for i, t in enumerate(texts)], "parent_id string, source string, content string")
    got = ts.stored_tables(sections).collect()
    line = re.compile(r"((?:^[ \t]*\|.*\|[ \t]*(?:\r?\n|$))+)", re.M)
    want = {}
    for i, t in enumerate(texts):
        both = [*line.finditer(t or ""), *re.finditer(r"<table\b.*?</table>", t or "", re.S | re.I)]
        want |= {(f"p{i}", k): ts.table_parts(m[0]) for k, m in enumerate(sorted(both, key=lambda m: m.start()))}
    assert {(r.parent_id, r.place): (r.markdown, r.payload, r.summary) for r in got} == want and len(want) == 6
    assert all(r.row_count == max(0, len(r.payload) - 1) and r.source == "src" for r in got) and len({r.id for r in got}) == 6
    again = ts.stored_tables(sections.repartition(3)).select("id")
    assert {r.id for r in again.collect()} == {r.id for r in got}
    rest = {r.parent_id: r.content for r in ts.without_tables(sections).collect()}
    assert rest["p0"] == "Words\n\nmore | words\n\n end" and rest["p2"] == "" and rest["p1"] == texts[1]
    assert ts.stored_tables(sections.where(F.lit(False))).isEmpty()
