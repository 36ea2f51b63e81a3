"""Scalar functions on texts, all built from columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Trimmed lines that are page furniture: page numbers, rights and risk notices, bare addresses, contents with dot leaders.
#: Fixed values.
NOISE_LINES = [
    r"^[-—–\s]*\d{1,4}[-—–\s]*$",
    r"^第\s*[0-9一二三四五六七八九十百千]+\s*页(\s*[/，,共].*)?$",
    r"^[-—–\s]*\d{1,4}\s*/\s*\d{1,4}[-—–\s]*$",
    r"^(版权所有|未经[^。\n]*许可|免责声明\s*[:：]?|风险提示\s*[:：]?|风险揭示\s*[:：]?).*$",
    r"^本(报告|文|材料|文件)(版权|[^。\n]*仅供参考).*$",
    r"^市场有风险[，,]\s*投资需谨慎.*$",
    r"^([hH][tT][tT][pP][sS]?://|[wW][wW][wW]\.)\S+$",
    r"^.{4,}?([.·…]\s*){3,}\s*\d{0,4}\s*$",
]
LINK = r"\[([^\]]*)\]\((https?://|www\.)[^)]*\)"
OCR_GARBAGE = "[\ufffd\uf0b7\uf0d8]+"
#: A chunk that describes a picture, and a line that is a numbered entry. Fixed values.
PICTURE_WORDS = "一幅|画面|描绘|图中所示|插图显示"
NUMBERED_LINE = r"^[\(（]?[一二三四五六七八九十\d]+[\)）]?[、\.．\s]"
#: Words of notices, ratings and contact blocks. Fixed values.
BOILERPLATE_WORDS = [
    "免责声明", "特别声明", "重要声明", "分析师声明", "分析师承诺", "证券分析师承诺", "投资评级说明", "评级说明", "评级体系", "投资评级标准", "行业投资评级",
    "资料来源", "数据来源", "地址：", "邮编：", "公司网址", "联系电话", "法律声明", "版权声明", "联系我们", "风险提示", "免责条款", "适当性管理办法",
    "分析师：", "执业证书", "登记编号", "SAC", "证书编号", "THANK YOU", "演示完毕", "谢谢观看", "图表目录", "目录",
]
IMAGE_START = r"^!\[\]\(images/|^\[图片\]"
#: Words of a question that asks for more than one thing. Fixed values.
COMPLEX_HINTS = "对比 区别 差异 比较 以及 分别 步骤 流程 影响 原因 为什么 如何 有哪些 关系 优缺点".split()
#: White space of every script. Fixed values.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
UNICODE = "(?U)"  # white space and digits of every script


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]


def stripped(text: Column) -> Column:
    """The text without white space of any script at its ends."""
    return F.btrim(text, F.lit(WHITE))


def clean_lines(text: Column) -> Column:
    """The text without its noise lines; links in the others become their text, and blank lines lose their white space."""

    *starts, leaders = NOISE_LINES  # lines of contents are looked for only where dots and a number end the line
    some = UNICODE + "^(?:" + "|".join(p.removeprefix("^").removesuffix("$") for p in starts) + ")$"

    def noise(line: Column) -> Column:
        return line.rlike(some) | (line.rlike(UNICODE + r"(?:[.·…]\s*){3}\d{0,4}$") & line.rlike(UNICODE + leaders))

    lines = F.transform(F.split(text, "\n"), lambda x: let(stripped(x), lambda s: F.struct(s.alias("s"), x.alias("x"))))
    kept = F.filter(lines, lambda x: ~noise(x["s"]))
    return F.array_join(F.transform(kept, lambda x: F.when(x["s"] == "", "").otherwise(strip_links(x["x"]))), "\n")


def strip_links(text: Column) -> Column:
    """Markdown links to the web become their text."""
    return F.when(F.contains(text, F.lit("](")), F.regexp_replace(text, LINK, "$1")).otherwise(text)


def margin_lines(text: Column) -> Column:
    """The short lines without a sentence mark that a text repeats, as the headers and footers of its pages do, trimmed."""
    lines = F.transform(F.split(text, "\n"), stripped)
    short = F.filter(lines, lambda x: F.length(x).between(1, 80) & ~x.rlike("^[#|]") & ~x.rlike("[。！？；]"))
    return let(F.array_sort(short), lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1)))))


def drop_margin_lines(text: Column) -> Column:
    kept = lambda known: F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(known, stripped(x)))
    return let(margin_lines(text), lambda known: F.when(F.size(known) == 0, text).otherwise(F.array_join(kept(known), "\n")))


def squeeze(text: Column) -> Column:
    """Characters of broken recognition become a space, three or more line feeds two; white space at both ends goes."""
    return stripped(F.regexp_replace(F.regexp_replace(text, OCR_GARBAGE, " "), r"\n{3,}", "\n\n"))


def clean_text(text: Column) -> Column:
    """Noise lines, then repeated margin lines, then white space."""
    return squeeze(let(clean_lines(text), drop_margin_lines))


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))


def repeated_lines(documents: DataFrame) -> DataFrame:
    """doc_id, line, times: the margin lines of each document, trimmed."""
    lines = documents.select("doc_id", F.explode(F.transform(F.split("text", "\n"), stripped)).alias("line"))
    short = F.length("line").between(1, 80) & ~F.col("line").rlike("^[#|]") & ~F.col("line").rlike("[。！？；]")
    return lines.where(short).groupBy("doc_id", "line").agg(F.count("*").alias("times")).where("times >= 2")


def is_low_quality(text: Column) -> Column:
    """Short texts, descriptions of pictures, and lists of at least four lines that are mostly numbered and mostly short."""

    def listed(lines: Column) -> Column:
        n = F.size(lines)
        numbered = F.size(F.filter(lines, lambda x: x.rlike(UNICODE + NUMBERED_LINE)))
        short = F.size(F.filter(lines, lambda x: F.length(x) < 60))
        return (n >= 4) & (numbered / n >= 0.6) & (short / n >= 0.8)

    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), stripped), lambda x: x != "")
    return (F.length(stripped(text)) < 150) | text.rlike(PICTURE_WORDS) | let(lines, listed)


def is_boilerplate(text: Column, block_type: Column | None = None) -> Column:
    """Images, chunks that begin with a notice's words, and very short ones that hold any."""
    words = "|".join(BOILERPLATE_WORDS)
    image = stripped(text).rlike(IMAGE_START)
    if block_type is not None:
        image = image | F.coalesce(block_type == "image", F.lit(False))
    return image | F.substring(text, 1, 120).rlike(words) | ((F.length(stripped(text)) < 40) & text.rlike(words))


def complexity(question: Column) -> Column:
    """simple, normal or complex, by length, question marks and hint words of the trimmed question."""

    def graded(q: Column) -> Column:
        hints = F.lit(0)
        for w in COMPLEX_HINTS:
            hints = hints + F.contains(q, F.lit(w)).cast("int")
        marks = F.length(q) - F.length(F.translate(q, "?？", ""))
        simple = (F.length(q) <= 15) & (hints == 0) & (marks <= 1)
        return F.when(simple, "simple").when((F.length(q) > 40) | (hints >= 2) | (marks >= 2), "complex").otherwise("normal")

    return let(stripped(F.coalesce(question, F.lit(""))), graded)


#: Labels behind which a document states its date. Fixed values.
DATE_LABELS = ["发布日期", "发布时间", "报告日期", "报告期", "日期", "公布日期"]
DATE_HEAD = 3000  # characters that are looked at


def date_of(text: Column) -> Column:
    """A date as yyyy-mm-dd from the head of a text: the one behind a label, then a full date, then year and month.

    Of each form the first match counts, and only if its month and day exist; a missing day is the first.
    """
    head = F.substring(text, 1, DATE_HEAD)
    year, month, day = r"(20[0-9]{2})\s*", r"\s*([0-9]{1,2})\s*", r"\s*([0-9]{1,2})"
    forms = [
        ("(?:" + "|".join(DATE_LABELS) + r")[:：]?\s*" + year + r"[年\-/.]" + month + rf"(?:[月\-/.]{day})?", 3),
        (year + r"[年\-/.]" + month + r"[月\-/.]" + day, 3),
        (year + "年" + month + "月", 2),
    ]

    def dated(pattern: str, groups: int) -> Column:
        y, m, *rest = [F.regexp_extract(head, pattern, k + 1) for k in range(groups)]
        d = F.when(rest[0] == "", "1").otherwise(rest[0]) if rest else F.lit("1")
        valid = m.try_cast("int").between(1, 12) & d.try_cast("int").between(1, 31)
        return F.when(valid, F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))

    return F.coalesce(*[dated(*f) for f in forms])


def version_of(filename: Column) -> Column:
    """The version in names like report_v1.2.pdf; empty if none."""
    return F.regexp_extract(filename, r"(?i)[_-]v([0-9]+(?:\.[0-9]+)*)", 1)


def security_code(text: Column) -> Column:
    """The first six-digit security code outside of dates; null if none."""
    plain = F.regexp_replace(text, r"(19|20)[0-9]{2}[-/.]?[0-9]{2}[-/.]?[0-9]{2}", " ")
    code = F.regexp_extract(plain, r"(?<![0-9])([03468][0-9]{5})(?![0-9])", 1)
    return F.when(code != "", code)


def citations(answer: Column) -> Column:
    """The numbers cited as [n], in order."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[([0-9]{1,3})\]"), F.lit(1)), lambda x: x.cast("int"))


def citation_score(answer: Column, sources: Column) -> Column:
    """Share of the citations that point to one of the sources 1..n; 1 without citations."""
    cited = citations(answer)
    good = F.size(F.filter(cited, lambda x: (x >= 1) & (x <= sources)))
    return F.when(F.size(cited) == 0, F.lit(1.0)).otherwise(good / F.size(cited))
