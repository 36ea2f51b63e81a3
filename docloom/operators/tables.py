"""Tables inside documents, the pages of chunks, and checks of filters and metadata."""

from __future__ import annotations

import html
import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CODE = re.compile(r"[03468]\d{5}")
DATE = re.compile(r"(\d{4})(-\d{2}-\d{2})?")
REPORT_FIELDS = ("security_code", "security_name", "broker", "report_type", "industry_l1", "industry_l2")
MAX_VALUE = 64
ROW = re.compile(r"<tr\b[^>]*>([^<]*(?:<(?!tr\b|/tr>|/table>)[^<]*)*)", re.I)
CELL = re.compile(r"<t[dh]\b[^>]*>([^<]*(?:<(?!t[dh]\b|/t[dh]>)[^<]*)*)", re.I)
TAG = re.compile(r"<[^>]*>")
TABLES = re.compile(r"<table\b.*?</table>", re.I | re.S)
PIPE_ROW = re.compile(r"^\s*\|.*\|\s*$")
PIPE_RULE = re.compile(r"^\s*\|(?:\s*:?-+:?\s*\|)+\s*$")


def html_rows(table: str) -> list[list[str]]:
    """Rows of cells as plain text; empty cells and empty rows are left out."""
    rows = []
    for row in ROW.findall(table):
        cells = [" ".join(html.unescape(TAG.sub(" ", c) if "<" in c else c).split()) for c in CELL.findall(row)]
        if cells := [c for c in cells if c]:
            rows.append(cells)
    return rows


def pipe_rows(table: str) -> list[list[str]]:
    """Rows of a pipe table, without its rule."""
    lines = [x.strip() for x in table.split("\n") if PIPE_ROW.match(x) and not PIPE_RULE.match(x)]
    return [[c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", x[1:-1])] for x in lines]


def to_markdown(rows: list[list[str]]) -> str:
    """A pipe table, padded to its widest row; the first row is the header."""
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join([c.replace("|", "\\|") for c in r] + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def table_units(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the HTML and pipe tables of a text, in order and without overlap."""
    found = [(m.start(), m.end(), "html") for m in TABLES.finditer(text)]
    at, begin = 0, None
    for line in [*text.split("\n"), ""]:
        inside = bool(PIPE_ROW.match(line)) and not any(s <= at < e for s, e, _ in found)
        if inside and begin is None:
            begin = at
        elif not inside and begin is not None:
            if text.count("\n", begin, at - 1) >= 1:
                found.append((begin, at - 1, "pipe"))
            begin = None
        at += len(line) + 1
    return sorted(found)


def table_summary(rows: list[list[str]]) -> str:
    """The header and the first row of data; leading title rows of one cell are passed over."""
    wide = next((i for i, r in enumerate(rows) if len(r) > 1), 0)
    return "\n".join(" | ".join(r) for r in rows[wide : wide + 2])


def bare(text: str) -> str:
    return "".join(text.split())


PREFIX, HELD, PROBE = 12, 5, 40  # characters that a block and a chunk share at their begin, that a held block has, that tell a page


def match_score(chunk: str, block: str) -> int:
    """How strongly a block without white space speaks for a chunk: it lies in it, or both begin alike; 0 if neither."""
    if len(block) >= HELD and block in chunk:
        return len(block)
    shared = len(os.path.commonprefix([chunk, block]))
    return shared if shared >= PREFIX or chunk and shared >= max(HELD, len(chunk)) else 0


def page_of(chunk: str, blocks: list[tuple[str, int]]) -> tuple[int, int]:
    """First and last page of a chunk: that of the block that matches best, widened by those whose begin it holds; 0, 0 if none."""
    own, known = bare(chunk), [(bare(t), p) for t, p in blocks]
    score, page = max(((match_score(own, b), -i) for i, (b, _) in enumerate(known)), default=(0, 0))
    if not score:
        return 0, 0
    pages = [known[-page][1], *(p for b, p in known if len(b[:PROBE]) >= HELD and b[:PROBE] in own)]
    return min(pages), max(pages)


def page_label(first: Column, last: Column) -> Column:
    """Pages as a label; "" where the first one is missing or 0."""
    same = (F.coalesce(last, F.lit(0)) <= 0) | (first == last)
    label = F.when(same, F.concat(F.lit("页码："), first)).otherwise(F.concat(F.lit("页码："), first, F.lit("-"), last))
    return F.when(F.coalesce(first, F.lit(0)) <= 0, "").otherwise(label)


def normal_date(value: object) -> str | None:
    """yyyy-mm-dd; a year alone is its first day; anything else is None."""
    found = DATE.fullmatch(str(value).strip()) if value is not None else None
    return None if not found else found[0] if found[2] else f"{found[1]}-01-01"


def checked_filters(raw: dict, taxonomy: dict[str, list[str]], categories: set[str] = frozenset()) -> dict:
    """The filters that hold up: known fields, normal dates, codes of six digits, industries of the taxonomy.

    More than one distinct security code drops that filter; a second-level industry must belong to a chosen first-level
    one where there is one. The result suits ``catalog.build_filter``.
    """
    out: dict = {}
    for name, value in raw.items():
        values = list(value) if isinstance(value, (list, tuple)) else [value]
        if name == "date":
            if isinstance(value, dict):
                bounds = {op: d for op, x in value.items() if op in ("gte", "lte") and (d := normal_date(x))}
                out |= {"date": bounds} if bounds else {}
            elif d := normal_date(value):
                out["date"] = d
        elif name == "category":
            if kept := [v for v in values if v in categories]:
                out[name] = kept
        elif name in REPORT_FIELDS:
            texts = list(dict.fromkeys(v.strip() for v in values if isinstance(v, str) and 0 < len(v.strip()) <= MAX_VALUE))
            if name == "security_code":
                texts = [v for v in texts if CODE.fullmatch(v)]
                texts = texts if len(texts) == 1 else []
            elif name == "industry_l1":
                texts = [v for v in texts if v in taxonomy]
            if texts:
                out[name] = texts
    if "industry_l2" in out:
        above = out.get("industry_l1") or list(taxonomy)
        known = {x for a in above for x in taxonomy.get(a, ())}
        out["industry_l2"] = [v for v in out["industry_l2"] if v in known]
        if not out["industry_l2"]:
            del out["industry_l2"]
    return out


def category_deletable(category: Column, chunks: Column, default: str = "default") -> Column:
    """Categories may go when they are empty and not the default one."""
    return (category != default) & (F.coalesce(chunks, F.lit(0)) == 0)


def category_name_valid(name: Column) -> Column:
    return F.coalesce(name.rlike(r"(?U)^[\w-]{1,64}$"), F.lit(False))
