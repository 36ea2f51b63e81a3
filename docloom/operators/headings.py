"""Heading marks of numbered documents, the structure that they imply, and pieces of text joined into blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import UNICODE, let, stripped
from docloom.operators.ingest import CHUNK, OVERLAP, split_text
from docloom.operators.tables import html_rows, pipe_rows, table_summary, table_units
from docloom.plans.registry import query
from docloom.session import table

#: Digits of numbered headings. Fixed values.
HAN_DIGITS, DIGITS = "一二三四五六七八九十百千万零〇两", "0-9０-９"
#: Units of legal texts, summaries, and the marks that only lines of fewer than LONGEST characters can bear, in the order
#: in which they are recognised. Fixed values.
UNIT_MARKS = {"编": "bian", "章": "zhang", "节": "jie", "条": "tiao", "款": "kuan", "项": "xiang"}
SUMMARY_MARK = "^综[　\\s]*述$"
LINE_MARKS = {
    "cn_item": rf"^[{HAN_DIGITS}]+\s*[、.．]",
    "paren_cn": rf"^[（(]\s*[{HAN_DIGITS}]+\s*[）)]",
    "paren_arabic": rf"^[（(]\s*[{DIGITS}]+\s*[）)]",
    "arabic_dot2": rf"^[{DIGITS}]+\.[{DIGITS}]+(\s|$)",
    "arabic_dot3": rf"^[{DIGITS}]+(\.[{DIGITS}]+){{2,}}(\s|$)",
    "arabic_dot": rf"^[{DIGITS}]+\s*[、.．:：]([^{DIGITS}]|$)",
}
LONGEST = 80
#: Marks from the outermost to the innermost. Fixed values.
NESTING = "bian summary zhang jie tiao kuan xiang cn_item paren_cn arabic_dot arabic_dot2 arabic_dot3 paren_arabic".split()
HEADING = r"^(#{1,6})\s+(.*)$"


def marker_of(line: Column) -> Column:
    """The kind of heading mark at the begin of a trimmed line, or null."""
    out = F.lit(None).cast("string")
    short = F.length(line) < LONGEST
    for name, pattern in reversed(LINE_MARKS.items()):
        out = F.when(short & line.rlike(UNICODE + pattern), name).otherwise(out)
    out = F.when(line.rlike(UNICODE + SUMMARY_MARK), "summary").otherwise(out)
    for unit, name in UNIT_MARKS.items():
        out = F.when(line.rlike(rf"{UNICODE}^第\s*[{HAN_DIGITS}{DIGITS}]+\s*{unit}"), name).otherwise(out)
    return out


def inject_headings(markdown: Column) -> Column:
    """The text with its marked lines as headings; the marks that occur are nested from ## (or below the text's own) on.

    Lines inside fences stay. A text is cut at its fence lines, so every second part behind the first one is inside.
    """

    def lines(part: Column, k: Column) -> Column:
        def read(x: Column, j: Column) -> Column:
            s = stripped(x)
            level = F.length(F.regexp_extract(s, UNICODE + HEADING, 1))
            body = F.when(level > 0, stripped(F.regexp_extract(s, UNICODE + HEADING, 2))).otherwise(s)
            plain = (k % 2 == 0) & ((k == 0) | (j > 0))
            mark = let(body, lambda b: F.when(plain, marker_of(b)))
            return F.struct(x.alias("x"), body.alias("body"), F.when(plain, level).otherwise(0).alias("level"), mark.alias("mark"))

        return F.transform(F.split(part, "\n"), read)

    def rewritten(parts: Column) -> Column:
        every = F.flatten(parts)
        present = F.array_compact(F.array_distinct(F.transform(every, lambda x: x["mark"])))
        own = F.array_max(F.transform(F.filter(every, lambda x: x["mark"].isNull() & (x["level"] > 0)), lambda x: x["level"]))
        used = let(present, lambda p: F.filter(F.array(*[F.lit(m) for m in NESTING]), lambda m: F.array_contains(p, m)))
        below = F.greatest(F.lit(2), own + 1)

        def put(order: Column) -> Column:
            base = F.when(own.isNotNull() & (below + F.size(order) - 1 <= 6), below).otherwise(2)

            def line(b: Column, x: Column) -> Column:
                level = F.least(F.lit(6), b + F.array_position(order, x["mark"]).cast("int") - 1)
                return F.when(x["mark"].isNull(), x["x"]).otherwise(F.concat(F.repeat(F.lit("#"), level), F.lit(" "), x["body"]))

            joined = lambda b: F.array_join(F.transform(parts, lambda p: F.array_join(F.transform(p, lambda x: line(b, x)), "\n")), "")
            return let(base, joined)

        return let(used, put)

    cut = F.split(F.concat(F.lit("\n"), markdown), r"(?<=\n)(?=[ \t　]*(?:```|~~~))")
    return F.substr(let(F.transform(cut, lines), rewritten), F.lit(2))


def merge_pieces(pieces: list[str], most: int) -> list[str]:
    """Neighbouring pieces joined by blank lines while they stay within ``most`` characters."""
    out: list[str] = []
    for piece in pieces:
        if out and len(out[-1]) + len(piece) + 2 <= most:
            out[-1] += "\n\n" + piece
        else:
            out.append(piece)
    return out


def text_blocks(content: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[str, str, str | None]]:
    """Kind, indexed text and, for a table, its whole text: tables stand alone, the text between them is split and merged."""
    found: list[tuple[str, str, str | None]] = []

    def add(text: str) -> None:
        pieces = [p.strip() for p in split_text(text, size, overlap) if p.strip()]
        found.extend(("text", x, None) for x in merge_pieces(pieces, size))

    at = 0
    for begin, end, _ in table_units(content):
        add(content[at:begin])
        whole = content[begin:end].strip()
        rows = html_rows(whole) if "<table" in whole.lower() else pipe_rows(whole)
        if summary := table_summary(rows):
            found.append(("table", summary, whole))
        at = end
    add(content[at:])
    return found


def blocks(documents: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n, kind, text, full_text of the blocks of each document (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, n, *b) for i, t in zip(batch["doc_id"], batch["text"], strict=True) for n, b in enumerate(text_blocks(t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "n", "kind", "text", "full_text"])

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id long, n long, kind string, text string, full_text string")


_KIND = "(i + doc_id) % 10"
#: What is put before the lines of a text, by the number of the line and the id; "" leaves the line.
_BEFORE = ["第1章 ", "一、", "（1）", "```", "## ", "1.2 ", "### 3. ", "第二节 ", "（三）", ""]


def _marked(spark, sf_dir):
    before = F.array(*[F.lit(x) for x in _BEFORE])
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.get(before, ((i + 1 + F.col("doc_id")) % 10).cast("int")), x))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))


_MARK_SQL = "CASE {} {} END".format(
    " ".join(f"WHEN regexp_matches(b, '^第\\s*[{HAN_DIGITS}{DIGITS}]+\\s*{u}') THEN '{m}'" for u, m in UNIT_MARKS.items()),
    f"WHEN regexp_matches(b, '{SUMMARY_MARK}') THEN 'summary' " + " ".join(f"WHEN length(b) < {LONGEST} AND regexp_matches(b, '{p}') THEN '{m}'" for m, p in LINE_MARKS.items()),
)
_HEADINGS_SQL = rf"""WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS raw, generate_subscripts(ls, 1) AS i FROM t),
x AS (SELECT doc_id, i, {_BEFORE}[{_KIND} + 1] || raw AS x FROM l),
f AS (SELECT *, trim(x, ' ' || chr(9) || chr(13)) AS s, starts_with(trim(x), '```') OR starts_with(trim(x), '~~~') AS fence FROM x),
g AS (SELECT *, NOT fence AND coalesce(sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 0 AS plain FROM f),
h AS (SELECT *, CASE WHEN plain THEN length(regexp_extract(s, '{HEADING}', 1)) ELSE 0 END AS lev, CASE WHEN regexp_matches(s, '{HEADING}') THEN trim(regexp_extract(s, '{HEADING}', 2)) ELSE s END AS b FROM g),
m AS (SELECT *, CASE WHEN plain THEN {_MARK_SQL} END AS mark FROM h),
p AS (SELECT doc_id, list_filter({NESTING}, lambda z: list_contains(list_distinct(list(mark)), z)) AS used, max(CASE WHEN mark IS NULL AND lev > 0 THEN lev END) AS own FROM m GROUP BY doc_id),
q AS (SELECT doc_id, used, CASE WHEN own IS NOT NULL AND greatest(2, own + 1) + len(used) - 1 <= 6 THEN greatest(2, own + 1) ELSE 2 END AS base FROM p)
"""


@query("heading_injection", _HEADINGS_SQL + """SELECT doc_id, md5(string_agg(CASE WHEN mark IS NULL THEN x ELSE repeat('#', least(6, base + list_position(used, mark) - 1)::INT) || ' ' || b END, chr(10) ORDER BY i)) AS text_md5
FROM m JOIN q USING (doc_id) GROUP BY doc_id""")
def q_heading_injection(spark, sf_dir):
    """Over texts whose lines bear marks by turns, with fences and headings of their own among them."""
    return _marked(spark, sf_dir).select("doc_id", F.md5(inject_headings(F.col("text"))).alias("text_md5"))


@query("heading_marks", _HEADINGS_SQL.replace("CASE WHEN plain THEN CASE", "CASE WHEN true THEN CASE") + "SELECT mark, count(*) AS n FROM m WHERE mark IS NOT NULL GROUP BY mark")
def q_heading_marks(spark, sf_dir):
    """How many lines bear each mark, fences or not; headings by what stands behind their signs."""
    line = _marked(spark, sf_dir).select(F.explode(F.split("text", "\n")).alias("x")).select(stripped(F.col("x")).alias("s"))
    body = F.when(F.col("s").rlike(UNICODE + HEADING), stripped(F.regexp_extract("s", UNICODE + HEADING, 2))).otherwise(F.col("s"))
    return line.select(marker_of(body).alias("mark")).where("mark is not null").groupBy("mark").agg(F.count("*").alias("n"))


@query("text_blocks")
def q_text_blocks(spark, sf_dir):
    made = blocks(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "kind", F.length("text").cast("long").alias("n_chars"))
