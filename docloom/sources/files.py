"""Files that the engine reads and writes: texts, parser output, evaluation cases, run records and audit lines.

Every reader takes any path that Spark reads and has a fixed schema, so no file is scanned twice to find it out. Files
of no bytes give no row: Spark's file scan passes over them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_SUFFIXES = ("md", "markdown", "txt")
BINARY_SUFFIXES = ("pdf", "docx", "pptx", "xlsx", "xls")
EVIDENCE = "array<struct<source:string,document_version:string,chunk_id:string,quote:string>>"
CASES = (
    "id string, query string, question_type string, difficulty string, answer_type string, reference_answer string, required_facts array<string>, "
    f"evidence {EVIDENCE}, expected_behavior string, tier string, review_status string, reviewer string, review_note string, provenance map<string,string>"
)
RECORDS = (
    "case_id string, tier string, question_type string, query string, status string, metrics map<string,double>, "
    "diagnostics struct<candidate_chunk_ids:array<string>,top5_chunk_ids:array<string>,evidence_ranks:map<string,int>,cliff_triggered:boolean,"
    "pre_cliff_depth:int,post_cliff_depth:int>, answer string, latency_ms double, error string"
)
REVIEW = ["id", "query", "reference_answer", "review_status", "reviewer", "review_note"]
#: Fields of a block that hold its text, and its captions where there is none, in the order in which they count. Fixed values.
BLOCK_TEXTS = ["text", "table_body", "code_body"]
BLOCK_CAPTIONS = ["img_caption", "table_caption", "chart_caption"]
BLOCKS = "array<struct<type:string," + "".join(f"{c}:string," for c in BLOCK_TEXTS) + "".join(f"{c}:array<string>," for c in BLOCK_CAPTIONS) + "page_idx:int>>"
CONTENT_LIST = "content_list.json"


def _binary(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*suffixes))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """source, text, sha256, modified of every Markdown and text file; bytes that are no UTF-8 become replacement marks."""
    return _binary(spark, path, TEXT_SUFFIXES).select(
        file_name(F.col("path")).alias("source"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified")
    )


def read_parsed(spark: SparkSession, path: str, parser: Callable[[bytes, str], str]) -> DataFrame:
    """source, text, error of office documents and PDFs by the caller's parser; a file that it fails on has the error instead."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path_, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows.append((path_, parser(bytes(content), path_), None))
                except Exception as e:  # one bad file must not stop the others
                    rows.append((path_, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    parsed = _binary(spark, path, BINARY_SUFFIXES).select("path", "content").mapInPandas(run, "path string, text string, error string")
    return parsed.select(file_name(F.col("path")).alias("source"), "text", "error")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The file name without its last suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def main_markdown(files: DataFrame, group: str, path: str = "path") -> DataFrame:
    """The Markdown file of each group: the shallowest, then the first by name."""
    found = files.where(F.lower(path).rlike(r"\.(md|markdown)$"))
    return found.groupBy(group).agg(F.min_by(path, F.struct(F.size(F.split(path, "/")), F.col(path))).alias(path))


def content_list_of(files: DataFrame, group: str, path: str = "path") -> DataFrame:
    """The content list of each group: of files whose names end like one, the shallowest, then the first by name.

    Names carry the document's before the ending; lists of the second kind end otherwise and are never taken.
    """
    found = files.where(F.col(path).endswith(CONTENT_LIST))
    return found.groupBy(group).agg(F.min_by(path, F.struct(F.size(F.split(path, "/")), F.col(path))).alias(path))


def page_blocks(content_list: Column) -> Column:
    """array<struct<text, page>> of a parser's content list in JSON; entries without text or a page that can be are left out.

    The first text that is not blank counts, else the first list of captions that has any.
    """

    def text_of(b: Column) -> Column:
        filled = [F.nullif(F.trim(b[c]), F.lit("")) for c in BLOCK_TEXTS]
        trimmed = [F.filter(F.transform(F.coalesce(b[c], F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "") for c in BLOCK_CAPTIONS]
        return F.coalesce(*filled, *[F.nullif(F.array_join(x, " "), F.lit("")) for x in trimmed])

    made = F.transform(F.from_json(content_list, BLOCKS), lambda b: F.struct(text_of(b).alias("text"), (b["page_idx"] + 1).alias("page")))
    kept = F.filter(made, lambda b: b["text"].isNotNull() & (b["page"] >= 1))
    return F.coalesce(kept, F.array().cast("array<struct<text:string,page:int>>"))


def chosen_blocks(parsed: Column, plain: Column) -> Column:
    """blocks and origin: the parser's own blocks where there are any, else those of the plain text, else none."""
    none = F.array().cast("array<struct<text:string,page:int>>")
    own, other = F.coalesce(parsed, none), F.coalesce(plain, none)
    origin = F.when(F.size(own) > 0, "content_list").when(F.size(other) > 0, "pdf_text").otherwise("none")
    return F.struct(F.when(F.size(own) > 0, own).otherwise(other).alias("blocks"), origin.alias("origin"))


def object_key_accepted(key: Column) -> Column:
    return key.startswith("docs/") & ~key.startswith("docs/_internal/")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases, one JSON object a line."""
    return spark.read.schema(CASES).json(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORDS).json(path)


def remaining_cases(cases: DataFrame, records: DataFrame) -> DataFrame:
    """Cases without a completed record: what a run that was broken off still has to do."""
    done = records.where("status = 'completed'").select(F.col("case_id").alias("id")).distinct()
    return cases.join(done, "id", "left_anti")


def append_json(rows: DataFrame, path: str) -> None:
    """Appends run records or audit lines."""
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_review(cases: DataFrame, path: str) -> None:
    """The columns that reviewers look at, as CSV."""
    cases.select(*REVIEW).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def apply_review(spark: SparkSession, cases: DataFrame, path: str) -> DataFrame:
    """Cases with the decisions of a reviewed CSV; cases that it doesn't name stay as they are."""
    schema = ", ".join(f"{c} string" for c in REVIEW)
    seen = spark.read.schema(schema).option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    decided = ["review_status", "reviewer", "review_note"]
    new = seen.select("id", *[F.col(c).alias(f"_{c}") for c in decided]).dropDuplicates(["id"])
    joined = cases.join(new, "id", "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in decided else F.col(c) for c in cases.columns])


def parse_questions(markdown: str) -> list[dict]:
    """Questions of a Markdown test set: ``## N. question``, lines ``- **name**: value``, then the reference answer."""
    out: list[dict] = []
    answering = False
    for line in markdown.split("\n"):
        if head := re.match(r"##\s+(\d+)\.\s+(.+?)\s*$", line):
            out.append({"number": int(head[1]), "query": head[2], "meta": {}, "answer": []})
            answering = False
        elif not out:
            continue
        elif re.match(r"###\s*(标准答案|Reference answer)\s*$", line):
            answering = True
        elif line.strip() == "---":
            answering = False
        elif answering:
            out[-1]["answer"].append(line)
        elif field := re.match(r"[-*]\s*\*{0,2}([^:：*]+?)\*{0,2}\s*[:：]\s*\*{0,2}\s*(.*?)\s*$", line):
            out[-1]["meta"][field[1]] = field[2]
    for q in out:
        q["answer"] = "\n".join(q["answer"]).strip()
    return out


def question_markdown(number: Column, question: Column, meta: Column, answer: Column) -> Column:
    """A question as ``parse_questions`` reads it: meta is a map, whose fields are listed by name."""
    names = F.array_sort(F.map_keys(F.coalesce(meta, F.create_map().cast("map<string,string>"))))
    fields = F.transform(names, lambda k: F.concat(F.lit("- **"), k, F.lit("**: "), F.coalesce(F.try_element_at(meta, k), F.lit(""))))
    head = F.concat(F.lit("## "), number.cast("string"), F.lit(". "), question)
    return F.concat(F.array_join(F.concat(F.array(head), fields), "\n"), F.lit("\n### 标准答案\n"), F.coalesce(answer, F.lit("")), F.lit("\n---\n"))


def write_questions(questions: DataFrame, path: str, parts: int = 1) -> None:
    """Writes questions (number, query, meta, answer) as Markdown, in order; more parts are files of ranges of numbers."""
    lines = questions.select("number", question_markdown(F.col("number"), F.col("query"), F.col("meta"), F.col("answer")).alias("value"))
    lines.repartitionByRange(parts, "number").sortWithinPartitions("number").select("value").write.mode("overwrite").text(path)


def read_questions(texts: DataFrame) -> DataFrame:
    """source, number, query, meta (JSON), answer of all questions in Markdown texts (source, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (s, q["number"], q["query"], json.dumps(q["meta"], ensure_ascii=False), q["answer"])
                for s, t in zip(b["source"], b["text"], strict=True)
                for q in parse_questions(t)
            ]
            yield pd.DataFrame(rows, columns=["source", "number", "query", "meta", "answer"])

    schema = "source string, number int, query string, meta string, answer string"
    return texts.select("source", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, schema)
