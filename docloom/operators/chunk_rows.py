"""Rows of the chunk store: what is written, what a hit shows, whose rows they are, and their dump."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.plans.registry import query
from docloom.session import table

#: Fields of a chunk and how many characters they hold. Fixed values.
LIMITS = {
    "security_code": 32, "security_name": 64, "industry_l1": 32, "industry_l2": 32, "report_type": 16, "broker": 64, "meta_source": 16,
    "block_type": 16, "image_key": 256,
}
PAGES = ("start_page", "end_page")
EXCERPT = 200


def _given(rows: DataFrame, name: str) -> Column:
    return F.col(name) if name in rows.columns else F.lit(None)


def stored_rows(rows: DataFrame) -> DataFrame:
    """The rows with every field of the store: texts cut to their limits, and something in place of what is missing.

    A block without a type is a text, pages are 0, a row needs no review; all other texts are ''.
    """
    texts = {c: F.substring(F.coalesce(_given(rows, c).cast("string"), F.lit("")), 1, n) for c, n in LIMITS.items()}
    texts["block_type"] = F.when(texts["block_type"] == "", "text").otherwise(texts["block_type"])
    pages = {c: F.coalesce(_given(rows, c).try_cast("int"), F.lit(0)) for c in PAGES}
    return rows.withColumns(texts | pages | {"needs_review": F.coalesce(_given(rows, "needs_review").cast("boolean"), F.lit(False))})


def shown_hits(hits: DataFrame, title: str) -> DataFrame:
    """Hits as callers see them: every field there, also of tables that lack it; a chunk's own id stands for a missing key."""
    rows = stored_rows(hits).drop("needs_review", "meta_source")
    text = {c: F.coalesce(_given(hits, c).cast("string"), F.lit("")) for c in ("parent_id", "category", "date")}
    text["title"] = F.coalesce(F.nullif(_given(hits, "title").cast("string"), F.lit("")), F.lit(title))
    text["chunk_key"] = F.coalesce(F.nullif(_given(hits, "chunk_key").cast("string"), F.lit("")), F.col("id").cast("string"))
    return rows.withColumns(text)


def with_category(metadata: Column, category: Column) -> Column:
    """The metadata (a map of texts) with the category, if one is given; the field is there in any case."""
    own = F.coalesce(metadata, F.create_map().cast("map<string,string>"))
    value = F.when(category != "", category).otherwise(F.coalesce(F.try_element_at(own, F.lit("category")), F.lit("")))
    rest = F.map_filter(own, lambda k, v: k != "category")
    return F.map_concat(rest, F.create_map(F.lit("category"), value))


def of_tenant(rows: DataFrame, tenant: str) -> DataFrame:
    """A tenant's rows. Without a name nothing is read, so that a missing setting shows no one else's rows."""
    return rows.where(F.col("tenant_id") == tenant) if tenant else rows.where(F.lit(False))


def chunk_dump(chunks: DataFrame, excerpt: int = EXCERPT) -> DataFrame:
    """source, place, line for chunks (id, source, content, start_page, end_page, block_type), by page and id, for reading."""
    plain = F.regexp_replace(F.coalesce("content", F.lit("")), "\n", " ")
    head = F.format_string("[%s] p%d-%d %s len=%d", F.col("id").cast("string"), "start_page", "end_page", "block_type", F.length(plain))
    line = F.concat(head, F.lit("\n    "), F.substring(plain, 1, excerpt))
    before = F.struct("start_page", F.col("id").cast("string").alias("id"), line.alias("line"))
    listed = chunks.groupBy(F.coalesce("source", F.lit("")).alias("source"), F.col("start_page").alias("page")).agg(F.array_sort(F.collect_list(before)).alias("rows"))
    return listed.select("source", "page", F.posexplode("rows").alias("place", "r")).select("source", "page", "place", F.col("r.line").alias("line"))


def dump_index(chunks: DataFrame) -> DataFrame:
    """source, chunks, file: how many chunks each source has and the file name that suits it."""
    name = F.concat(F.substring(F.regexp_replace("source", r"(?U)[^\w.-]+", "_"), 1, 80), F.lit(".txt"))
    return chunks.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("chunks")).withColumn("file", name)


def _rows(spark, sf_dir):
    k = F.col("doc_id") % 5
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select(
        F.col("doc_id").alias("id"), "source", F.col("text").alias("content"), F.when(k > 0, F.substring("text", 1, 100)).alias("broker"),
        F.when(k == 1, "table").when(k == 2, "").alias("block_type"), F.when(k < 3, F.col("doc_id") % 40).alias("start_page"), F.lit("x").alias("end_page"),
    )


_ROWS = "SELECT doc_id AS id, source, text, CASE WHEN doc_id % 5 > 0 THEN left(text, 64) ELSE '' END AS broker, CASE WHEN doc_id % 5 = 1 THEN 'table' ELSE 'text' END AS bt, CASE WHEN doc_id % 5 < 3 THEN doc_id % 40 ELSE 0 END AS page FROM documents WHERE text IS NOT NULL"


@query("stored_rows", f"SELECT id, md5(broker) AS broker, bt AS block_type, page::INT AS start_page, 0 AS end_page, '' AS industry_l1, false AS needs_review FROM ({_ROWS})")
def q_stored(spark, sf_dir):
    made = stored_rows(_rows(spark, sf_dir))
    return made.select("id", F.md5("broker").alias("broker"), "block_type", "start_page", "end_page", "industry_l1", "needs_review")


@query(
    "chunk_dump",
    f"""SELECT source, page, row_number() OVER (PARTITION BY source, page ORDER BY id::VARCHAR) - 1 AS place,
md5('[' || id || '] p' || page || '-0 ' || bt || ' len=' || length(text) || chr(10) || '    ' || left(replace(text, chr(10), ' '), 200)) AS line FROM ({_ROWS})""",
)
def q_dump(spark, sf_dir):
    return chunk_dump(stored_rows(_rows(spark, sf_dir))).withColumn("line", F.md5("line"))
