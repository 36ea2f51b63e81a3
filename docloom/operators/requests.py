"""Decisions around a request or an ingestion: parameters by complexity, dates, case selection, source hits, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import complexity, date_of, stripped
from docloom.operators.evaluation import ASKED
from docloom.operators.ingest import TABLE_LIMIT, TABLE_NOTE
from docloom.operators.metadata import filename_date
from docloom.operators.retrieval import _dense_sql, dense, query_vectors, vectors
from docloom.plans.registry import SQL, query
from docloom.session import table

#: Rows to retrieve and to keep after reranking by complexity. Fixed values.
DYNAMIC_K = {"simple": (3, 2), "normal": (8, 4), "complex": (20, 6)}


def dynamic_k(question: Column, k: int, rerank: int, enabled: bool = True) -> Column:
    """struct<k, rerank_top_n> for a question; the given ones where the choice is off."""
    out = F.struct(F.lit(k).alias("k"), F.lit(rerank).alias("rerank_top_n"))
    if enabled:
        grade = complexity(question)
        for name, (n, m) in DYNAMIC_K.items():
            out = F.when(grade == name, F.struct(F.lit(n).alias("k"), F.lit(m).alias("rerank_top_n"))).otherwise(out)
    return out


def distinct_in_order(queries: Column, most: int) -> Column:
    """The first ``most`` different queries of an array, trimmed, in their order; empty ones are left out."""
    kept = F.filter(F.transform(queries, stripped), lambda x: x != "")
    return F.slice(F.array_distinct(kept), 1, most)


def resolved_date(explicit: Column, filename: Column, text: Column, modified: Column) -> Column:
    """The given date, or that of the file name, of the text, or of the file's last change; "" without any."""
    given = F.when(explicit != "", explicit)
    return F.coalesce(given, filename_date(filename), date_of(text), F.date_format(modified, "yyyy-MM-dd"), F.lit(""))


def select_cases(cases: DataFrame, mode: str, silver: bool = False) -> DataFrame:
    """Cases (question_type, tier) of a run: all but negative ones for retrieval, gold (and silver) ones otherwise."""
    if mode == "retrieval":
        return cases.where("question_type <> 'negative'")
    return cases.where(F.col("tier").isin(["gold", "silver"] if silver else ["gold"]))


def stem(name: Column) -> Column:
    """A file name without folders and its last ending."""
    base = F.regexp_replace(name, r"^.*[/\\]", "")
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")


def cases_in_base(cases: DataFrame, sources: DataFrame) -> DataFrame:
    """Cases (id, sources: array) all of whose sources are in the knowledge base (source), compared by stems."""
    asked = cases.select("id", F.explode("sources").alias("source")).withColumn("stem", stem(F.col("source")))
    missing = asked.join(sources.select(stem(F.col("source")).alias("stem")).distinct(), "stem", "left_anti").select("id").distinct()
    return cases.where(F.size("sources") > 0).join(missing, "id", "left_anti")


def source_hits(hits: DataFrame, chunks: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """qid, doc_hit, rank: whether one of the first k chunks comes from an expected source (qid, source), by stems."""
    found = hits.where(F.col("pos") <= k).join(chunks.select("doc_id", stem(F.col("source")).alias("stem")), "doc_id")
    wanted = expected.select("qid", stem(F.col("source")).alias("stem")).distinct()
    ranks = found.join(wanted, ["qid", "stem"]).groupBy("qid").agg(F.min("pos").alias("rank"))
    return expected.select("qid").distinct().join(ranks, "qid", "left").select("qid", F.col("rank").isNotNull().alias("doc_hit"), "rank")


def over_collections(queries: DataFrame, collections: list[str]) -> DataFrame:
    """Each query once for each of the collections named in a request."""
    return queries.withColumn("collection", F.explode(F.array(*[F.lit(c) for c in collections])))


def best_setting(results: DataFrame, metrics: list[str], smaller: list[str]) -> DataFrame:
    """The setting with the largest metrics, the first deciding first; among equals the smaller parameters."""
    return results.orderBy(*[F.desc(m) for m in metrics], *[F.asc(c) for c in smaller]).limit(1)


def whole_tables(hits: DataFrame, tables: DataFrame, limit: int = TABLE_LIMIT) -> DataFrame:
    """Hits (id, block_type, content) with the stored table's markdown (id, markdown) for table blocks, and ``truncated``.

    A table beyond the limit loses its last lines, so that whole lines and a note fit.
    """
    joined = hits.join(tables.select("id", F.col("markdown").alias("_m")), "id", "left")
    room = limit - len(TABLE_NOTE)
    head = F.substring(F.col("_m"), 1, room)
    fits = F.substring(F.col("_m"), room, 1).isin("\n", "")  # the cut falls on a line's end
    cut = F.when(fits, F.regexp_replace(head, "\n$", "")).otherwise(F.regexp_replace(head, r"\n?[^\n]*$", ""))
    long = F.length("_m") > limit
    whole = F.when(long, F.concat(cut, F.lit(TABLE_NOTE))).otherwise(F.col("_m"))
    use = (F.col("block_type") == "table") & F.col("_m").isNotNull()
    return joined.withColumn("truncated", use & long).withColumn("content", F.when(use, whole).otherwise(F.col("content"))).drop("_m")


def ingest_report(chunks: DataFrame, tables: DataFrame) -> DataFrame:
    """What was ingested of each source: chunks by block type, chunks with a page, and stored tables with their rows."""
    kind = F.coalesce("block_type", F.lit("text"))
    made = chunks.groupBy("source").agg(
        F.count("*").alias("chunks"),
        F.count(F.when(kind == "text", 1)).alias("texts"),
        F.count(F.when(kind == "image", 1)).alias("images"),
        F.count(F.when(kind == "table", 1)).alias("table_chunks"),
        F.count(F.when(F.col("start_page") > 0, 1)).alias("paged"),
    )
    stored = tables.groupBy("source").agg(F.count("*").alias("tables"), F.sum("row_count").alias("table_rows"))
    none = F.lit(0).cast("long")
    return made.join(stored, "source", "left").withColumn("tables", F.coalesce("tables", none)).withColumn("table_rows", F.coalesce("table_rows", none))


def delete_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The rows without those of the ids, and how many go."""
    gone = ids.select(key).distinct()
    return rows.join(gone, key, "left_anti"), rows.join(gone, key, "left_semi").agg(F.count("*").alias("deleted"))


def finite(metrics: Column) -> Column:
    """A map of metrics without the missing and those that are no finite numbers."""
    return F.map_filter(metrics, lambda k, v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))


@query(
    "dynamic_k",
    f"""SELECT p_partkey, CASE c WHEN 'simple' THEN 3 WHEN 'normal' THEN 8 ELSE 20 END AS k, CASE c WHEN 'simple' THEN 2 WHEN 'normal' THEN 4 ELSE 6 END AS rerank_top_n FROM ({SQL["query_complexity"].replace("AS complexity", "AS c")})""",
)
def q_dynamic_k(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", dynamic_k(F.expr(ASKED), 10, 5).alias("d")).select("p_partkey", "d.k", "d.rerank_top_n")


@query(
    "distinct_queries",
    """WITH t AS (SELECT user_id, trim(event_type) AS q, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, q, min(i) AS i FROM t WHERE q <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i) AS n FROM f)
SELECT user_id, string_agg(q, '|' ORDER BY i) AS queries FROM r WHERE n <= 3 GROUP BY user_id""",
)
def q_distinct_queries(spark, sf_dir):
    """The first three different kinds of events of each user, in their order."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("t"))
    asked = F.filter(F.transform("t", lambda x: x["event_type"]), lambda x: x.isNotNull())
    found = rows.select("user_id", distinct_in_order(asked, 3).alias("q")).where(F.size("q") > 0)
    return found.select("user_id", F.array_join("q", "|").alias("queries"))


@query(
    "text_date",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (2, 5) OR year(o_orderdate) < 2000 AND o_orderkey % 6 NOT IN (0, 1) THEN NULL
 WHEN year(o_orderdate) < 2000 THEN '2001-0' || (o_orderkey % 6 + 1) || '-01' WHEN o_orderkey % 6 IN (3, 4) THEN strftime(o_orderdate, '%Y-%m-01') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""",
)
def q_text_date(spark, sf_dir):
    """Orders' dates as a text may state them: behind a label, in full, behind an impossible one, without a day, not at all."""
    k, d = F.col("o_orderkey") % 6, F.col("o_orderdate")
    text = (
        F.when(k == 0, F.concat(F.lit("1999-01-01 报告日期： "), F.date_format(d, "yyyy年MM月dd日"), F.lit(" 2001-01-01")))
        .when(k == 1, F.concat(F.lit("by no one "), F.date_format(d, "yyyy/MM/dd"), F.lit(" 2001年2月")))
        .when(k == 2, F.concat(F.lit("发布时间:2024-13-01 "), F.date_format(d, "yyyy.MM.dd")))
        .when(k == 3, F.concat(F.lit("in "), F.date_format(d, "yyyy 年 MM 月")))
        .when(k == 4, F.concat(F.lit("日期："), F.date_format(d, "yyyy-MM")))
        .otherwise(F.col("o_orderpriority"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", date_of(text).alias("day"))


@query(
    "resolved_date",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '2020-02-02' WHEN 1 THEN '2024-03-05' WHEN 2 THEN '2023-05-06' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders""",
)
def q_resolved_date(spark, sf_dir):
    """Orders as files: some with a given date, some with one in the name or the text, the others with that of the last change."""
    k = F.col("o_orderkey") % 4
    explicit = F.when(k == 0, "2020-02-02").otherwise("")
    name = F.when(k <= 1, "report_2024-03-05.pdf").otherwise("report.pdf")
    text = F.when(k <= 2, "Released 2023-05-06 for all.").otherwise("no date")
    return table(spark, sf_dir, "orders").select("o_orderkey", resolved_date(explicit, name, text, F.col("o_orderdate")).alias("date"))


def _cases(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 5 == 0, "negative").when(F.col("doc_id") % 2 == 0, "multi_hop").otherwise("single_hop")
    return table(spark, sf_dir, "labels").select("doc_id", kind.alias("question_type"), F.when(F.col("quality") == 1, "gold").otherwise("silver").alias("tier"))


@query("select_cases", "SELECT 'retrieval' AS mode, doc_id FROM labels WHERE doc_id % 5 <> 0 UNION ALL SELECT 'gold', doc_id FROM labels WHERE quality = 1 UNION ALL SELECT 'all', doc_id FROM labels")
def q_select_cases(spark, sf_dir):
    cases = _cases(spark, sf_dir)
    made = [("retrieval", select_cases(cases, "retrieval")), ("gold", select_cases(cases, "end_to_end")), ("all", select_cases(cases, "end_to_end", True))]
    every = None
    for name, rows in made:
        rows = rows.select(F.lit(name).alias("mode"), "doc_id")
        every = rows if every is None else every.union(rows)
    return every


@query(
    "cases_in_base",
    """WITH c AS (SELECT o_custkey AS id, list(o_orderkey) AS ks FROM orders GROUP BY 1)
SELECT id FROM c WHERE len(list_filter(ks, lambda x: x % 7 = 0)) = 0""",
)
def q_cases_in_base(spark, sf_dir):
    """Customers whose orders all are in a base that lacks every seventh; sources have folders and endings, the base none."""
    o = table(spark, sf_dir, "orders")
    name = F.concat(F.lit("in/o."), F.col("o_orderkey"), F.lit(".pdf"))
    cases = o.groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(name).alias("sources"))
    base = o.where("o_orderkey % 7 <> 0").select(F.concat(F.lit("o."), F.col("o_orderkey"), F.lit(".md")).alias("source"))
    return cases_in_base(cases, base).select("id")


@query(
    "source_hits",
    _dense_sql(6) + """SELECT qid, min(pos) IS NOT NULL AS doc_hit, min(pos) AS rank FROM (SELECT q.qid, h.pos FROM (SELECT DISTINCT qid, qlabel FROM s) q
LEFT JOIN (SELECT d.qid, d.pos FROM dense d WHERE d.qid <> d.doc_id AND d.pos <= 5 AND d.label = d.qlabel) h ON h.qid = q.qid) GROUP BY qid""",
)
def q_source_hits(spark, sf_dir):
    """Dense hits whose source is the label; the query's own row is no hit."""
    v = vectors(spark, sf_dir)
    source = F.concat(F.lit("kb/"), F.col("label"), F.lit(".pdf"))
    hits = dense(v, query_vectors(spark, sf_dir), 6).where("qid <> doc_id")
    expected = v.where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), F.concat(F.col("label"), F.lit(".md")).alias("source"))
    return source_hits(hits, v.select("doc_id", source.alias("source")), expected)


@query("over_collections", "SELECT item_id, c AS collection FROM benchmark, (VALUES ('reports'), ('rules'), ('notes')) x(c)")
def q_over_collections(spark, sf_dir):
    return over_collections(table(spark, sf_dir, "benchmark").select("item_id"), ["reports", "rules", "notes"])


@query(
    "best_setting",
    """SELECT l_shipmode AS setting, mrr, recall FROM (SELECT l_returnflag || l_linestatus || (l_linenumber % 3) AS l_shipmode, l_linenumber % 3 AS k, round(avg(l_discount), 6) AS mrr, round(avg(l_tax), 6) AS recall FROM lineitem GROUP BY ALL)
ORDER BY round(mrr, 3) DESC, recall DESC, k, setting LIMIT 1""",
)
def q_best_setting(spark, sf_dir):
    k = F.col("l_linenumber") % 3
    runs = table(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus", k).alias("setting"), k.alias("k"))
    runs = runs.agg(F.round(F.avg("l_discount"), 6).alias("mrr"), F.round(F.avg("l_tax"), 6).alias("recall")).withColumn("m", F.round("mrr", 3))
    return best_setting(runs, ["m", "recall"], ["k", "setting"]).select("setting", "mrr", "recall")


@query(
    "whole_tables",
    f"""WITH t AS (SELECT l_suppkey AS id, string_agg('| ' || l_orderkey || ' | ' || l_linenumber || ' |', chr(10) ORDER BY l_orderkey, l_linenumber) AS m FROM lineitem GROUP BY 1),
h AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'text' ELSE 'table' END AS block_type, 'own' AS content FROM supplier),
j AS (SELECT h.*, m, coalesce(block_type = 'table' AND m IS NOT NULL, false) AS use FROM h LEFT JOIN t USING (id)),
l AS (SELECT id, unnest(string_split(m, chr(10))) AS x, generate_subscripts(string_split(m, chr(10)), 1) AS i FROM j WHERE use AND length(m) > 2000),
r AS (SELECT *, sum(length(x) + 1) OVER (PARTITION BY id ORDER BY i) AS upto FROM l),
c AS (SELECT id, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE upto + {len(TABLE_NOTE)} <= 2000), '') || '{TABLE_NOTE}' AS cut FROM r GROUP BY id)
SELECT id, CASE WHEN use AND length(m) > 2000 THEN md5(cut) WHEN use THEN md5(m) ELSE md5(content) END AS content, use AND length(m) > 2000 AS truncated FROM j LEFT JOIN c USING (id)""",
)
def q_whole_tables(spark, sf_dir):
    """Lines of each supplier as a stored table of at most 2,000 characters."""
    row = F.concat(F.lit("| "), F.col("l_orderkey"), F.lit(" | "), F.col("l_linenumber"), F.lit(" |"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", row.alias("x")))).alias("r"))
    tables = rows.select("id", F.array_join(F.transform("r", lambda x: x["x"]), "\n").alias("markdown"))
    hits = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, "text").otherwise("table").alias("block_type"), F.lit("own").alias("content"))
    return whole_tables(hits, tables, 2000).select("id", F.md5("content").alias("content"), "truncated")


@query(
    "ingest_report",
    """WITH t AS (SELECT source, count(*) AS tables, sum(n_chars)::BIGINT AS table_rows FROM documents WHERE doc_id % 9 = 0 GROUP BY 1)
SELECT source, count(*) AS chunks, count(CASE WHEN doc_id % 4 > 1 THEN 1 END) AS texts, count(CASE WHEN doc_id % 4 = 1 THEN 1 END) AS images, count(CASE WHEN doc_id % 4 = 0 THEN 1 END) AS table_chunks,
 count(CASE WHEN doc_id % 3 > 0 THEN 1 END) AS paged, coalesce(any_value(tables), 0) AS tables, coalesce(any_value(table_rows), 0) AS table_rows FROM documents LEFT JOIN t USING (source) GROUP BY source""",
)
def q_ingest_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 4 == 0, "table").when(F.col("doc_id") % 4 == 1, "image")
    chunks = d.select("source", kind.alias("block_type"), (F.col("doc_id") % 3).alias("start_page"))
    return ingest_report(chunks, d.where("doc_id % 9 = 0").select("source", F.col("n_chars").alias("row_count")))


@query("delete_ids", "SELECT count(*) AS stay, sum(CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 1 ELSE 0 END)::BIGINT AS still FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def q_delete_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    left, _ = delete_ids(table(spark, sf_dir, "documents"), ids, "doc_id")
    still = left.join(ids.withColumn("bad", F.lit(1)), "doc_id", "left")
    return still.agg(F.count("*").alias("stay"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("still"))


@query(
    "finite_metrics",
    "SELECT l_orderkey, l_linenumber, (l_discount > 0)::INT + (l_linenumber % 3 = 0)::INT AS n FROM lineitem",
)
def q_finite(spark, sf_dir):
    """Metrics of which some are missing, some no numbers and some infinite."""
    a = F.when(F.col("l_discount") > 0, F.col("l_discount")).otherwise(float("nan"))
    b = F.when(F.col("l_linenumber") % 3 == 0, 1.0).when(F.col("l_linenumber") % 3 == 1, float("-inf"))
    metrics = F.create_map(F.lit("a"), a, F.lit("b"), b)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.size(finite(metrics)).alias("n"))


