"""Answers: citations, refusals, keywords of a question, and overlap with evidence. Columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import citation_score, citations
from docloom.plans.registry import query
from docloom.session import table

MIN_RERANK, REJECT_BELOW, LOW_BELOW = 0.3, 0.5, 0.8

#: Phrases that mark an answer as a refusal. Fixed values.
REFUSALS = [
    "无法回答", "无法给出可靠回答", "无法给出", "拒绝回答", "不能回答",
    "未检索到", "没有检索到", "暂未检索", "未能检索", "未找到",
    "暂无相关", "无相关信息", "无相关数据", "没有相关",
    "未提供", "未提及", "未包含", "未涉及", "不含",
    "知识库中未", "现有知识库中", "语料中没有", "不足以支撑", "无法支撑",
]

#: Years, subjects and measures that count as keywords, in this order. Fixed values.
YEARS = ["2021", "2022", "2023", "2024", "2025", "2026"]
SUBJECTS = ["房地产", "金融", "银行", "货币政策", "财政政策", "支持", "稳定", "风险", "监管", "市场"]
MEASURES = ["措施", "政策", "支持", "采取", "实施", "推动", "促进"]


def is_refusal(answer: Column) -> Column:
    """1 for an empty answer or one with a refusing phrase, else 0."""
    found = F.trim(F.coalesce(answer, F.lit(""))) == ""
    return F.when(found | F.coalesce(answer, F.lit("")).rlike("|".join(REFUSALS)), 1.0).otherwise(0.0)


def refusal_policy(sources: Column, best_rerank: Column, cited: Column, score: Column) -> tuple[Column, Column]:
    """(rejected, low_confidence). A null rerank score or citation score means that there was no such step."""
    weak = F.coalesce(best_rerank < MIN_RERANK, F.lit(False))
    unsupported = (cited > 0) & F.coalesce(score < REJECT_BELOW, F.lit(False))
    rejected = (sources == 0) | weak | unsupported
    return rejected, ~rejected & (cited > 0) & F.coalesce(score < LOW_BELOW, F.lit(False))


def question_keywords(question: Column, most: int = 5) -> Column:
    """Years and listed words that the question holds, in the order of the lists; a word of two lists counts twice."""

    def held(words: list[str]) -> Column:
        return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(question, w))

    years = F.transform(held(YEARS), lambda y: F.concat(y, F.lit("年")))
    return F.slice(F.concat(years, held(SUBJECTS + MEASURES)), 1, most)


def text_units(text: Column) -> Column:
    """Distinct words of a-z and digits, and pairs of neighbouring Han characters; marks like [1] don't count."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\[[0-9]+\]", " ")
    words = F.regexp_extract_all(plain, F.lit("[a-z0-9]+"), F.lit(0))
    runs = F.regexp_extract_all(plain, F.lit("[一-鿿]+"), F.lit(0))
    pairs = F.transform(
        runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))
    )
    return F.array_distinct(F.concat(words, F.flatten(pairs)))


def unit_f1(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(2.0 * both / (F.size(a) + F.size(b)))


def claim_sentences(text: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "[。！？!?；;\n]+"), lambda x: F.btrim(x, F.lit(" \t\r")))
    return F.filter(parts, lambda x: F.length(x) >= 4)


def support(sentences: Column, evidence: Column) -> Column:
    """Mean over the sentences of each one's best overlap with a piece of evidence (an array of unit arrays)."""
    best = F.transform(sentences, lambda s: F.array_max(F.transform(evidence, lambda e: unit_f1(text_units(s), e))))
    total = F.aggregate(best, F.lit(0.0), lambda a, x: a + x)
    return F.when((F.size(sentences) == 0) | (F.size(evidence) == 0), F.lit(0.0)).otherwise(F.round(total / F.size(sentences), 4))


_ANSWER = "concat('claim [1] then [', CAST(item_id % 9 AS STRING), '] and [0]')"
_SCORE = "(1 + CASE WHEN item_id % 9 BETWEEN 1 AND 1 + item_id % 5 THEN 1 ELSE 0 END) / 3.0"


@query("citation_check", f"SELECT item_id, 3 AS cited, round({_SCORE}, 6)::DOUBLE AS score FROM benchmark")
def q_citations(spark, sf_dir):
    """Citations of made-up answers against one to five sources."""
    sources = 1 + F.col("item_id") % 5
    answer = F.expr(_ANSWER)
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(citations(answer)).alias("cited"), F.round(citation_score(answer, sources), 6).alias("score"))


@query(
    "refusal_policy",
    """SELECT o_orderkey, rejected, NOT rejected AND cited > 0 AND coalesce(score < 0.8::DOUBLE, false) AS low_confidence FROM (SELECT *,
 sources = 0 OR coalesce(best < 0.3::DOUBLE, false) OR (cited > 0 AND coalesce(score < 0.5::DOUBLE, false)) AS rejected FROM (SELECT o_orderkey, o_orderkey % 6 AS sources, o_orderkey % 4 AS cited,
 CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 10) / 10::DOUBLE END AS best, CASE WHEN o_orderkey % 7 > 0 THEN (o_orderkey % 11) / 10::DOUBLE END AS score FROM orders))""",
)
def q_refusals(spark, sf_dir):
    k = F.col("o_orderkey")
    best, score = F.when(k % 5 > 0, (k % 10) / 10), F.when(k % 7 > 0, (k % 11) / 10)
    rejected, low = refusal_policy(k % 6, best, k % 4, score)
    return table(spark, sf_dir, "orders").select(k, rejected.alias("rejected"), low.alias("low_confidence"))


_SAID = "concat(coalesce(text, ''), CASE WHEN turn % 3 = 1 THEN '，检索到的内容未提供相关数据' ELSE '' END)"
_FOUND = " OR ".join(f"contains(a, '{w}')" for w in REFUSALS)


@query("negative_rejection", f"SELECT conv_id, avg(CASE WHEN trim(a) = '' OR {_FOUND} THEN 1 ELSE 0 END) AS rate FROM (SELECT conv_id, coalesce(text, '') || CASE WHEN turn % 3 = 1 THEN '，检索到的内容未提供相关数据' ELSE '' END AS a FROM conversations) GROUP BY conv_id")
def q_rejections(spark, sf_dir):
    """Share of refusing turns by conversation."""
    said = table(spark, sf_dir, "conversations").select("conv_id", F.expr(_SAID).alias("a"))
    return said.groupBy("conv_id").agg(F.avg(is_refusal(F.col("a"))).alias("rate"))


_ASKED = "concat('20', CAST(20 + doc_id % 8 AS STRING), CASE WHEN doc_id % 3 = 0 THEN '银行监管政策' WHEN doc_id % 3 = 1 THEN '市场风险与支持措施' ELSE '采取货币政策促进金融稳定' END)"
_LISTED = "[" + ", ".join(f"'{w}'" for w in SUBJECTS + MEASURES) + "]"


@query(
    "question_keywords",
    f"SELECT doc_id, array_to_string(list_concat(list_transform(list_filter({YEARS}, lambda y: contains(q, y)), lambda y: y || '年'), list_filter({_LISTED}, lambda w: contains(q, w)))[1:5], ',') AS keywords FROM (SELECT doc_id, {_ASKED} AS q FROM documents)",
)
def q_keywords(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(question_keywords(F.expr(_ASKED)), ",").alias("keywords"))


def _units_sql(text: str) -> str:
    plain = f"regexp_replace(lower({text}), '\\[[0-9]+\\]', ' ', 'g')"
    pairs = f"list_transform(regexp_extract_all({plain}, '[一-鿿]+'), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substring(r, i, 2)) END)"
    return f"list_distinct(list_concat(regexp_extract_all({plain}, '[a-z0-9]+'), flatten({pairs})))"


_SUPPORT_SQL = f"""WITH p AS (SELECT item_id, b.text AS c, d.text AS e FROM benchmark b JOIN documents d ON d.doc_id = b.item_id WHERE d.text IS NOT NULL),
s AS (SELECT item_id, e, unnest(list_filter(list_transform(regexp_split_to_array(c, '[。！？!?；;\\n]+'), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: length(x) >= 4)) AS s FROM p),
u AS (SELECT item_id, {_units_sql("s")} AS a, {_units_sql("e")} AS b FROM s),
f AS (SELECT item_id, 2 * len(list_intersect(a, b)) / (len(a) + len(b))::DOUBLE AS f FROM u)
SELECT p.item_id, coalesce(round(avg(f), 4), 0) AS support FROM p LEFT JOIN f USING (item_id) GROUP BY p.item_id"""


@query("supported_sentences", _SUPPORT_SQL)
def q_support(spark, sf_dir):
    """How far each passage's sentences are borne out by the document of the same number."""
    claims = table(spark, sf_dir, "benchmark").select("item_id", claim_sentences(F.col("text")).alias("s"))
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("item_id"), "text")
    units = claims.join(docs, "item_id").select("item_id", "s", F.array(text_units(F.col("text"))).alias("e"))
    return units.select("item_id", support(F.col("s"), F.col("e")).alias("support"))
