"""The tables of sections as rows of their own: whole as Markdown, cells as arrays, and a summary that is indexed instead.

Tables are found by one pattern in the JVM, so that only their own texts, not the sections, go to Python, which is needed to
decode character references.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.tables import html_rows, to_markdown
from docloom.plans.registry import query
from docloom.session import small_batches, table

#: Lines between bars that follow one another, and HTML tables; possessive, so that long tables need no stack.
FOUND = r"(?d)((?:(?m:^)[ \t]*\|[^\n]*\|[ \t]*(?:\r?\n|\r?\z))++|(?is:<table\b.*?</table>))"
RULE = re.compile(r"\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?")
PARTS = "markdown string, payload array<array<string>>, summary string"


def pipe_payload(whole: str) -> list[list[str]]:
    """Cells of a table between bars, without its rule."""
    lines = [x.strip() for x in whole.split("\n")]
    return [[c.strip() for c in x.strip("|").split("|")] for x in lines if x and not RULE.fullmatch(x)]


def headed(rows: list[list[str]]) -> list[list[str]]:
    """The header and the first row behind it; rows of one cell before them are titles."""
    wide = next((i for i, r in enumerate(rows) if len(r) > 1), max(0, len(rows) - 1))
    return rows[wide : wide + 2]


def pipe_summary(whole: str) -> str:
    """The first line and the first line of data, as they are written."""
    lines = [x.strip() for x in whole.split("\n") if x.strip()]
    rest = lines[2:] if len(lines) > 1 and RULE.fullmatch(lines[1]) else lines[1:]
    return "\n".join([*lines[:1], *rest[:1]])


def table_parts(whole: str) -> tuple[str, list[list[str]], str]:
    """Markdown, cells and summary of a table; an HTML table without cells stays as it is written."""
    if "<table" in whole.lower():
        rows = html_rows(whole)
        return to_markdown(rows) or whole.strip(), rows, to_markdown(headed(rows))
    return whole.strip(), pipe_payload(whole), pipe_summary(whole)


def stored_tables(sections: DataFrame) -> DataFrame:
    """One row for each table of the sections (parent_id, content, others): id, place, markdown, payload, row_count, summary.

    Tables are numbered from 0 within their section; the id follows from section, place and the table as written, so a
    repeated load gives the same ids. row_count leaves out the header. Other columns are carried along. A null content has
    no tables; of tables within each other the outer one counts.
    """

    small_batches(sections.sparkSession)

    @F.arrow_udf(PARTS)
    def parts(whole: pa.Array) -> pa.Array:
        found = [table_parts(x) for x in whole.to_pylist()]
        columns = zip(*found, strict=True) if found else ((), (), ())
        kinds = (pa.string(), pa.list_(pa.list_(pa.string())), pa.string())
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["markdown", "payload", "summary"])

    others = [c for c in sections.columns if c != "content"]
    found = sections.select(*others, F.posexplode(F.regexp_extract_all("content", F.lit(FOUND), F.lit(1))).alias("place", "whole"))
    key = F.sha2(F.concat(F.col("parent_id").cast("string"), F.lit(":table:"), F.col("place").cast("string"), F.lit(":"), F.col("whole")), 256)
    parted = found.select(*others, "place", key.alias("id"), parts("whole").alias("t"))
    return parted.select("id", *others, "place", "t.markdown", "t.payload", F.greatest(F.lit(0), F.size("t.payload") - 1).alias("row_count"), "t.summary")


def without_tables(sections: DataFrame) -> DataFrame:
    """The sections with each table replaced by nothing: the text around their tables, trimmed; blank ones stay as ''."""
    return sections.withColumn("content", F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), FOUND, "\n"), F.lit(" \n")))


_CELLS = "CAST(l_linenumber AS VARCHAR) AS a, CAST(l_suppkey AS VARCHAR) AS b, l_returnflag || ' & ' || l_linestatus AS c"
_CELL_OF = "string(x.l_linenumber) AS a, string(x.l_suppkey) AS b, concat(x.l_returnflag, ' & ', x.l_linestatus) AS c"


def _html_row(x: str = "") -> str:
    return f"concat('<tr class=x><td>', {x}a, '</td><td></td><TD><b>', {x}b, '</b></TD><td>', replace({x}c, '&', '&amp;'), '</td></tr>')"


def _pipe_row(x: str = "") -> str:
    return f"concat('| ', {x}a, ' | ', {x}b, ' | ', {x}c, ' |')"


_HTML_ROW, _PIPE_ROW = _html_row(), _pipe_row()


def _sections(spark, sf_dir):
    """The lines of each order as an HTML table, a table between bars, or both, amid words."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus").alias("x"))
    made = lines.groupBy("l_orderkey").agg(F.collect_list("x").alias("x"))  # cells are written behind the shuffle
    cells = F.expr(f"transform(x, x -> struct({_CELL_OF}))")
    rows = F.expr(f"transform(cells, x -> struct(int(x.a) AS n, {_html_row('x.')} AS h, {_pipe_row('x.')} AS p))")
    listed = made.select("l_orderkey", cells.alias("cells")).select("l_orderkey", F.array_sort(rows).alias("r"))
    k = F.col("l_orderkey") % 3
    html = F.concat(F.lit("<TABLE border=1><tr><td colspan=3>Lines</td></tr>\n<tr><th>no</th><th>by</th><th>state</th></tr>\n"), F.array_join("r.h", "\n"), F.lit("</table>"))
    pipe = F.concat(F.lit("| no | by | state |\n|---|:---:|---|\n"), F.array_join("r.p", "\n"), F.lit("\n"))
    held = F.when(k == 0, html).when(k == 1, pipe).otherwise(F.concat(pipe, F.lit("between | the two\n"), html))
    return listed.select(F.col("l_orderkey").alias("parent_id"), F.concat(F.lit("Before.\n"), held, F.lit("\nBehind.")).alias("content"))


_WANTED = f"""WITH r AS (SELECT l_orderkey, l_linenumber AS n, {_CELLS} FROM lineitem),
o AS (SELECT l_orderkey AS k, count(*) AS n, string_agg({_PIPE_ROW}, chr(10) ORDER BY n, {_HTML_ROW}) AS body, min_by({_PIPE_ROW}, (n, {_HTML_ROW})) AS one,
 string_agg(concat(a, '/', b, '/', c), ';' ORDER BY n, {_HTML_ROW}) AS cells, string_agg({_HTML_ROW}, chr(10) ORDER BY n, {_HTML_ROW}) AS html FROM r GROUP BY 1),
t AS (SELECT k, 0 AS place, 'pipe' AS kind FROM o WHERE k % 3 > 0 UNION ALL SELECT k, CASE WHEN k % 3 = 2 THEN 1 ELSE 0 END, 'html' FROM o WHERE k % 3 <> 1)
SELECT k AS parent_id, place, CASE kind WHEN 'pipe' THEN n ELSE n + 1 END::INT AS row_count,
 md5(CASE kind WHEN 'pipe' THEN concat('| no | by | state |', chr(10), '|---|:---:|---|', chr(10), body)
  ELSE concat('| Lines |  |  |', chr(10), '| --- | --- | --- |', chr(10), '| no | by | state |', chr(10), body) END) AS markdown,
 CASE kind WHEN 'pipe' THEN concat('| no | by | state |', chr(10), one) ELSE concat('| no | by | state |', chr(10), '| --- | --- | --- |', chr(10), one) END AS summary,
 md5(concat(CASE kind WHEN 'html' THEN 'Lines;' ELSE '' END, 'no/by/state;', cells)) AS payload,
 sha256(concat(k, ':table:', place, ':', CASE kind WHEN 'pipe' THEN concat('| no | by | state |', chr(10), '|---|:---:|---|', chr(10), body, chr(10))
  ELSE concat('<TABLE border=1><tr><td colspan=3>Lines</td></tr>', chr(10), '<tr><th>no</th><th>by</th><th>state</th></tr>', chr(10), html, '</table>') END)) AS id
FROM t JOIN o USING (k)"""


@query("stored_tables", _WANTED)
def q_stored_tables(spark, sf_dir):
    """Tables written from all lines of orders, found again and taken apart."""
    cells = F.array_join(F.transform("payload", lambda r: F.array_join(r, "/")), ";")
    return stored_tables(_sections(spark, sf_dir)).select("parent_id", "place", "row_count", F.md5("markdown").alias("markdown"), "summary", F.md5(cells).alias("payload"), "id")
