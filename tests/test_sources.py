"""Readers, writers, tables and filter checks on small literal cases."""

import json

from pyspark.sql import functions as F

from docloom.operators import tables
from docloom.sources import files


def test_texts_and_parsers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.md").write_bytes("# é".encode())
    (tmp_path / "a/y.TXT").write_bytes(b"bad \xff byte")
    (tmp_path / "a/z.pdf").write_bytes(b"%PDF")
    (tmp_path / "a/w.docx").write_bytes(b"broken")
    (tmp_path / "a/v.docx").write_bytes(b"")
    got = {r.source: r.text for r in files.read_texts(spark, f"file://{tmp_path}/a").collect()}
    assert got == {"x.md": "# é", "y.TXT": "bad � byte"}

    def parser(content, path):
        if content[:1] != b"%":
            raise ValueError("no document")
        return content.decode()

    parsed = {r.source: (r.text, r.error) for r in files.read_parsed(spark, f"file://{tmp_path}/a", parser).collect()}
    assert parsed == {"z.pdf": ("%PDF", None), "w.docx": (None, "ValueError: no document")}


def test_markdown_choice_and_blocks(spark):
    rows = spark.createDataFrame([("d", "o/x/b.md"), ("d", "o/c.md"), ("d", "o/a.json"), ("e", "o/y.markdown")], "doc string, path string")
    assert {r.doc: r.path for r in files.main_markdown(rows, "doc").collect()} == {"d": "o/c.md", "e": "o/y.markdown"}
    blocks = [
        {"type": "text", "text": " one ", "page_idx": 0}, {"type": "table", "text": "", "table_body": "<table>", "page_idx": 1},
        {"type": "image", "img_caption": [" "], "table_caption": ["c ", "d"], "chart_caption": ["e"], "page_idx": 2}, {"text": "before", "page_idx": -1}, {"type": "text", "text": "lost"}, {"type": "text", "text": " ", "page_idx": 3},
    ]
    row = spark.range(1).select(
        files.page_blocks(F.lit(json.dumps(blocks))).alias("a"), files.page_blocks(F.lit("no json")).alias("b"), files.stem(F.lit("d/r.v1.pdf")).alias("c")
    ).first()
    assert [(x.text, x.page) for x in row.a] == [("one", 1), ("<table>", 2), ("c d", 3)] and row.b == [] and row.c == "r.v1"


def test_content_lists_and_fallback(spark):
    paths = ["o/x/D_content_list.json", "o/D_content_list_v2.json", "o/y/A_content_list.json", "o/z/w/content_list.json"]
    rows = spark.createDataFrame([("d", p) for p in paths] + [("e", "o/other.json")], "doc string, path string")
    assert {r.doc: r.path for r in files.content_list_of(rows, "doc").collect()} == {"d": "o/x/D_content_list.json"}
    kind = "array<struct<text:string,page:int>>"
    cases = spark.createDataFrame([([("a", 1)], [("b", 2)]), ([], [("b", 2)]), (None, None)], f"p {kind}, q {kind}")
    got = [r.c for r in cases.select(files.chosen_blocks(F.col("p"), F.col("q")).alias("c")).collect()]
    assert [(c.origin, [b.text for b in c.blocks]) for c in got] == [("content_list", ["a"]), ("pdf_text", ["b"]), ("none", [])]


def test_questions_are_read_as_they_were_written(spark, tmp_path):
    rows = [(i, f"Question {i}?", {"type": "single", "a b": f"v {i}"}, f"answer {i}\n\nsecond line") for i in range(1, 25)] + [(25, "Last", None, None)]
    made = spark.createDataFrame(rows, "number int, query string, meta map<string,string>, answer string")
    files.write_questions(made, f"file://{tmp_path}/set", 3)
    texts = spark.read.text(f"file://{tmp_path}/set", wholetext=True).select(F.input_file_name().alias("source"), F.col("value").alias("text"))
    got = sorted((r.number, r.query, json.loads(r.meta), r.answer) for r in files.read_questions(texts).collect())
    assert got == [(n, q, m or {}, a or "") for n, q, m, a in rows] and texts.count() == 3


def test_cases_review_and_resume(spark, tmp_path):
    path = f"file://{tmp_path}"
    rows = [json.dumps({"id": i, "query": 'say "x",\ny', "evidence": [{"source": "s", "quote": "q"}], "review_status": "pending"}) for i in ("1", "2")]
    spark.createDataFrame([(r,) for r in rows], "value string").write.text(f"{path}/cases")
    cases = files.read_cases(spark, f"{path}/cases")
    assert {r.id: r.evidence[0].quote for r in cases.collect()} == {"1": "q", "2": "q"}
    files.write_review(cases.where("id = '1'").withColumn("review_status", F.lit("approved")), f"{path}/review")
    assert {r.id: r.review_status for r in files.apply_review(spark, cases, f"{path}/review").collect()} == {"1": "approved", "2": "pending"}
    done = spark.createDataFrame([("1", "completed"), ("2", "failed")], "case_id string, status string")
    files.append_json(done, f"{path}/records")
    files.append_json(done.limit(0), f"{path}/records")
    assert [r.id for r in files.remaining_cases(cases, files.read_records(spark, f"{path}/records")).collect()] == ["2"]


def test_questions(spark):
    text = "# set\n## 1. What?\n- **type**: single\n### 标准答案\nline a\n\nline b\n---\n## 2. Why?\n"
    got = files.read_questions(spark.createDataFrame([("s", text), ("t", None)], "source string, text string")).orderBy("number").collect()
    assert [(r.query, json.loads(r.meta), r.answer) for r in got] == [("What?", {"type": "single"}, "line a\n\nline b"), ("Why?", {}, "")]


def test_tables():
    rows = tables.html_rows("<table><tr><th>A<th>B &amp; C</tr><tr><td><b>1</b></td><td></td><td>2|3</td></tr></table>")
    assert rows == [["A", "B & C"], ["1", "2|3"]]
    assert tables.to_markdown(rows + [["x"]]) == "| A | B & C |\n| --- | --- |\n| 1 | 2\\|3 |\n| x |  |" and tables.to_markdown([]) == ""
    assert tables.pipe_rows(tables.to_markdown(rows)) == rows
    text = "intro\n| a | b |\n| --- | --- |\n| 1 | 2 |\nthen <table><tr><td>x</table> end\n| alone |"
    assert [(text[s:e][:5], k) for s, e, k in tables.table_units(text)] == [("| a |", "pipe"), ("<tabl", "html")]
    assert tables.table_summary([["Title"], ["h", "i"], ["1", "2"], ["3", "4"]]) == "h | i\n1 | 2"
    blocks = [("the first block", 1), ("the second\nblock", 2), ("x", 9)]
    assert tables.page_of("the first block the second block", blocks) == (1, 2)
    assert tables.page_of("# the second block", blocks) == (2, 2) and tables.page_of("none at all", blocks) == (0, 0)
    assert tables.page_of("the second block of", [("the second block of many words", 4)]) == (4, 4) and tables.page_of("second block", blocks) == (0, 0)


def test_filters(spark):
    tree = {"bank": ["city bank"], "food": ["drinks"]}
    check = lambda **f: tables.checked_filters(f, tree, {"news"})
    assert check(security_code="600519") == {"security_code": ["600519"]}
    assert check(security_code="202608") == {} and check(security_code=["600519", "000001"]) == {}
    assert check(date={"gte": "2024", "lt": "2025"}) == {"date": {"gte": "2024-01-01"}} and check(date="soon") == {}
    assert check(industry_l1="bank", industry_l2=["city bank", "drinks"]) == {"industry_l1": ["bank"], "industry_l2": ["city bank"]}
    assert check(industry_l2="drinks") == {"industry_l2": ["drinks"]} and check(category=["news", "zz"], odd=1) == {"category": ["news"]}
    row = spark.range(1).select(
        tables.page_label(F.lit(1), F.lit(3)), tables.page_label(F.lit(2), F.lit(None)), tables.category_name_valid(F.lit("研报_1")), tables.category_deletable(F.lit("a"), F.lit(None))
    ).first()
    assert tuple(row) == ("页码：1-3", "页码：2", True, True)
