"""Cleaning and judging of document lines and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import (
    BOILERPLATE_WORDS, IMAGE_START, LINK, NOISE_LINES, NUMBERED_LINE, PICTURE_WORDS, clean_lines, clean_text, is_boilerplate, is_low_quality, repeated_lines, strip_tags,
)
from docloom.plans.registry import query
from docloom.session import table


def _digest(c: Column) -> Column:
    return F.md5(c)


#: The lines of a text with a notice, a page number, a contents line, a link and a repeated line put among them.
_PAGES = ["第3页 共9页", " 12 / 40 ", "未经本公司许可不得转载", "第一章 总则 ....... 1", "see [this](http://x.org/a) and [that](b.md)", "www.x.org/y", "Header of a page"]
_WITH_PAGES = " || ".join(["text", *(f"chr(10) || '{x}'" for x in _PAGES), "chr(10) || 'Header of a page' || chr(10) || chr(10) || chr(10) || 'end'"])
_NOISE_SQL = " AND ".join(f"NOT regexp_matches(trim(x, chr(32) || chr(9) || chr(13)), '{p}')" for p in NOISE_LINES)
_TRIM = "trim(x, chr(32) || chr(9) || chr(13))"
_CLEAN_SQL = rf"""list_transform(list_filter(string_split(t, chr(10)), lambda x: {_NOISE_SQL}),
 lambda x: CASE WHEN {_TRIM} = '' THEN '' ELSE regexp_replace(x, '{LINK}', '\1', 'g') END)"""


def _paged(spark, sf_dir):
    text = F.concat_ws("\n", "text", *[F.lit(x) for x in _PAGES], F.lit("Header of a page\n\n\nend"))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


@query("clean_lines", f"SELECT doc_id, md5(array_to_string({_CLEAN_SQL}, chr(10))) AS cleaned FROM (SELECT doc_id, {_WITH_PAGES} AS t FROM documents)")
def q_clean_lines(spark, sf_dir):
    return _paged(spark, sf_dir).select("doc_id", _digest(clean_lines(F.col("text"))).alias("cleaned"))


@query(
    "clean_text",
    rf"""WITH c AS (SELECT doc_id, {_CLEAN_SQL} AS ls FROM (SELECT doc_id, {_WITH_PAGES} AS t FROM documents)),
l AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM c),
r AS (SELECT doc_id, {_TRIM} AS s, count(*) AS n FROM l WHERE length({_TRIM}) BETWEEN 1 AND 80 AND NOT regexp_matches({_TRIM}, '^[#|]') AND NOT regexp_matches({_TRIM}, '[。！？；]') GROUP BY ALL HAVING count(*) >= 2),
k AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS t FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = l.doc_id AND r.s = {_TRIM}) GROUP BY doc_id)
SELECT doc_id, md5(trim(regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))) AS cleaned FROM k""",
)
def q_clean_text(spark, sf_dir):
    return _paged(spark, sf_dir).select("doc_id", _digest(clean_text(F.col("text"))).alias("cleaned"))


@query(
    "repeated_lines",
    f"""WITH l AS (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x: {_TRIM})) AS line FROM documents)
SELECT doc_id, md5(line) AS line_md5, count(*) AS times FROM l WHERE length(line) BETWEEN 1 AND 80 AND NOT regexp_matches(line, '^[#|]') AND NOT regexp_matches(line, '[。！？；]')
GROUP BY doc_id, line HAVING count(*) >= 2""",
)
def q_repeated_lines(spark, sf_dir):
    found = repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.md5("line").alias("line_md5"), "times")


@query("content_hash_ids", r"SELECT doc_id, sha256(text) AS content_hash, md5(lower(regexp_replace(text, '[^\p{L}\p{N}\p{M}]+', '', 'g'))) AS normal_hash FROM documents")
def q_content_hash(spark, sf_dir):
    normal = F.lower(F.regexp_replace("text", r"[^\p{L}\p{N}\p{M}]+", ""))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.md5(normal).alias("normal_hash"))


_LISTED = "list_transform(string_split(text, chr(10)), lambda x: CASE WHEN doc_id % 3 = 0 THEN '（一）、' || x WHEN doc_id % 3 = 1 THEN x ELSE x || ' 一幅' END)"
_TITLED = "CASE WHEN doc_id % 4 = 0 THEN '资料来源' || text WHEN doc_id % 4 = 1 THEN text || '目录' WHEN doc_id % 4 = 2 THEN ' [图片] ' || text ELSE text END"


@query(
    "low_quality_chunks",
    rf"""WITH t AS (SELECT doc_id, {_LISTED} AS ls FROM documents),
l AS (SELECT doc_id, array_to_string(ls, chr(10)) AS text, list_filter(list_transform(ls, lambda x: {_TRIM}), lambda x: x <> '') AS ls FROM t)
SELECT doc_id FROM l WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) < 150 OR regexp_matches(text, '{PICTURE_WORDS}')
 OR (len(ls) >= 4 AND len(list_filter(ls, lambda x: regexp_matches(x, '{NUMBERED_LINE}'))) / len(ls) >= 0.6::DOUBLE AND len(list_filter(ls, lambda x: length(x) < 60)) / len(ls) >= 0.8::DOUBLE)""",
)
def q_low_quality(spark, sf_dir):
    """A third of the texts with every line made a numbered entry, a third as a picture's description."""

    def line(x):
        entry = F.concat(F.lit("（一）、"), x)
        return F.when(F.col("doc_id") % 3 == 0, entry).when(F.col("doc_id") % 3 == 1, x).otherwise(F.concat(x, F.lit(" 一幅")))

    text = F.array_join(F.transform(F.split("text", "\n"), line), "\n")
    return table(spark, sf_dir, "documents").where(is_low_quality(text)).select("doc_id")


@query(
    "boilerplate_chunks",
    rf"""SELECT doc_id FROM (SELECT doc_id, {_TITLED} AS text FROM documents) WHERE regexp_matches(trim(text), '{IMAGE_START}') OR regexp_matches(left(text, 120), '{"|".join(BOILERPLATE_WORDS)}')
 OR (length(trim(text)) < 40 AND regexp_matches(text, '{"|".join(BOILERPLATE_WORDS)}'))""",
)
def q_boilerplate(spark, sf_dir):
    k, text = F.col("doc_id") % 4, F.col("text")
    made = F.when(k == 0, F.concat(F.lit("资料来源"), text)).when(k == 1, F.concat(text, F.lit("目录"))).when(k == 2, F.concat(F.lit(" [图片] "), text)).otherwise(text)
    return table(spark, sf_dir, "documents").where(is_boilerplate(made)).select("doc_id")


@query("strip_html_tags", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_md5 FROM pages")
def q_strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(strip_tags(F.col("html"))).alias("text_md5"))


def located(quotes: DataFrame, documents: DataFrame) -> DataFrame:
    """item_id, doc_id of the quotes (item_id, quote) that lie in documents (doc_id, text).

    The words of a quote but its first and last one stand in a document as they are, so the first three of them, or the
    first one where there are fewer, are looked up by their hash among the document's runs of words; only documents that
    hold them are searched for the quote. Quotes of less than three words are searched for in every document.
    """
    words = F.split("quote", r"\s+")
    inner = quotes.select("item_id", "quote", F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))).alias("w"))

    def hashed(w: Column, at: Column | int, n: int) -> Column:
        return F.xxhash64(*[F.get(w, at + F.lit(i)) for i in range(n)])

    texts = documents.select("doc_id", F.split("text", r"\s+").alias("t"))
    pairs = None
    for n, some in ((3, F.size("w") >= 3), (1, F.size("w").between(1, 2))):
        anchors = inner.where(some).select("item_id", "quote", hashed(F.col("w"), F.lit(0), n).alias("h"))
        if anchors.isEmpty():
            continue
        runs = F.when(F.size("t") >= n, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("t") - n), lambda i: hashed(F.col("t"), i, n))))
        held = texts.select("doc_id", F.explode(runs).alias("h")).join(anchors, "h").select("doc_id", "item_id", "quote")
        pairs = held if pairs is None else pairs.union(held)
    searched = documents.join(inner.where(F.size("w") == 0).select("item_id", "quote"), F.contains("text", "quote")).select("item_id", "doc_id")
    if pairs is None:
        return searched
    return pairs.join(documents, "doc_id").where(F.contains("text", "quote")).select("item_id", "doc_id").union(searched)


@query(
    "quote_location_unique",
    """WITH q AS (SELECT item_id, substring(text, 1, 60) AS quote FROM benchmark WHERE length(text) >= 60),
m AS (SELECT q.item_id, d.doc_id FROM q JOIN documents d ON contains(d.text, q.quote))
SELECT item_id, min(doc_id) AS doc_id FROM m GROUP BY item_id HAVING count(*) = 1""",
)
def q_quote_location(spark, sf_dir):
    """Quotes that lie in exactly one document."""
    quotes = table(spark, sf_dir, "benchmark").where("length(text) >= 60").select("item_id", F.substring("text", 1, 60).alias("quote"))
    found = located(quotes, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.groupBy("item_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1").drop("n")


@query(
    "evidence_verify",
    r"""SELECT b.item_id, d.doc_id, contains(regexp_replace(d.text, '\s+', '', 'g'), regexp_replace(b.text, '\s+', '', 'g')) AS verified
FROM benchmark b JOIN documents d ON d.doc_id = b.item_id""",
)
def q_evidence_verify(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.regexp_replace("text", r"\s+", "").alias("d"))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", r"\s+", "").alias("b"))
    return items.join(docs, docs["doc_id"] == items["item_id"]).select("item_id", "doc_id", F.contains("d", "b").alias("verified"))
