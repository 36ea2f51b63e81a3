"""Metadata of reports from their names and a model's reply: what rules say wins, what a reply says is checked and fills the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import stripped
from docloom.operators.chunk_rows import LIMITS
from docloom.operators.metadata import _NAME, filled, json_payload, report_fields
from docloom.plans.registry import SQL, query
from docloom.session import table

FIELDS = ["security_code", "security_name", "industry_l1", "industry_l2", "report_type", "broker"]
#: Kinds of reports, the form of a code, and that of a version at the end of a name. Fixed values.
KINDS = ["个股", "行业", "宏观"]
CODE = "^[03468][0-9]{5}$"
VERSION = r"(?iU)[_\-（(]?v([0-9]+(?:\.[0-9]+)*)\s*[)）]?\s*$"


def checked_guess(guess: Column, taxonomy: dict[str, list[str]]) -> tuple[dict[str, Column], Column]:
    """The fields of a guess (a map of texts, or null) that hold up, '' for others, and the names of those that are refused.

    Codes have six digits, kinds are known ones, an industry is one of the taxonomy (a short fixed list) and its second level
    belongs to the first; without a first level the second isn't looked at.
    """
    given = {c: F.substring(stripped(F.coalesce(F.try_element_at(guess, F.lit(c)), F.lit(""))), 1, LIMITS[c]) for c in FIELDS}
    below = F.create_map(*[x for k, v in taxonomy.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]).cast("array<string>"))])
    first = F.map_contains_key(below, given["industry_l1"]) if taxonomy else F.lit(False)
    second = F.coalesce(F.array_contains(F.try_element_at(below, given["industry_l1"]), given["industry_l2"]), F.lit(False)) if taxonomy else F.lit(False)
    holds = {
        "security_code": given["security_code"].rlike(CODE), "report_type": given["report_type"].isin(KINDS), "industry_l1": first, "industry_l2": second,
        "security_name": F.lit(True), "broker": F.lit(True),
    }
    asked = {c: given[c] != "" for c in FIELDS} | {"industry_l2": first & (given["industry_l2"] != "")}
    kept = {c: F.when(asked[c] & holds[c], given[c]).otherwise("") for c in FIELDS}
    refused = F.array_compact(F.array(*[F.when(asked[c] & ~holds[c], F.lit(c)) for c in FIELDS]))
    return kept, refused


def merged_metadata(reports: DataFrame, taxonomy: dict[str, list[str]]) -> DataFrame:
    """The reports (filename, title, reply, others) with their fields, meta_source, needs_review and rejected.

    A reply is a model's text with an object in it; null, or a text without one, leaves what the names say. meta_source is
    ``llm`` where a reply filled a field. A review is needed where a field was refused, the first level of the industry is
    missing, or a report on a company lacks its code. All in column functions; other columns are carried along.
    """
    rules = report_fields(F.col("filename"), F.col("title"))
    kept, refused = checked_guess(json_payload(F.coalesce("reply", F.lit(""))), taxonomy)
    known = {c: rules[c] if c not in ("industry_l1", "industry_l2") else F.lit("") for c in FIELDS}
    values = {c: filled(known[c], kept[c]) for c in FIELDS}
    helped = F.lit(False)
    for c in FIELDS:
        helped = helped | ((known[c] == "") & (kept[c] != ""))
    missing = (values["industry_l1"] == "") | ((values["security_code"] == "") & (values["report_type"] == "个股"))
    others = [c for c in reports.columns if c not in ("filename", "title", "reply", *FIELDS)]
    return reports.select(
        *others,
        *[values[c].alias(c) for c in FIELDS],
        F.when(helped, "llm").otherwise("regex").alias("meta_source"),
        ((F.size(refused) > 0) | missing).alias("needs_review"),
        refused.alias("rejected"),
    )


def document_version(explicit: Column, filename: Column) -> Column:
    """The version that metadata give, or the one at the end of the name, as in ``report_v1.2.pdf``; '' if none."""
    name = F.regexp_replace(F.regexp_extract(F.coalesce(filename, F.lit("")), "[^/]*$", 0), r"(?<=[^.])\.[^.]+$", "")
    found = F.regexp_extract(name, VERSION, 1)
    return F.coalesce(F.nullif(stripped(F.coalesce(explicit, F.lit(""))), F.lit("")), found)


_TAXONOMY = {"src1": ["en", "fr"], "src2": ["de"], "src3": [], "src4": ["en", "de", "es", "fr"]}
_GUESS = """WITH b AS ({rules}), g AS (SELECT d.doc_id, d.doc_id % 7 > 1 AS asked, CASE d.doc_id % 3 WHEN 0 THEN '300750' WHEN 1 THEN '202608' ELSE '' END AS code,
 CASE d.doc_id % 4 WHEN 0 THEN '个股' WHEN 1 THEN '周报' ELSE '' END AS kind, source AS l1, lang AS l2, {known} AS k1, {below} AS k2 FROM documents d),
v AS (SELECT doc_id, asked, CASE WHEN asked AND code = '300750' THEN code ELSE '' END AS code, asked AND code = '202608' AS bad_code, CASE WHEN asked AND kind = '个股' THEN kind ELSE '' END AS kind,
 asked AND kind = '周报' AS bad_kind, CASE WHEN asked AND k1 THEN l1 ELSE '' END AS l1, asked AND NOT k1 AS bad_l1, CASE WHEN asked AND k2 THEN l2 ELSE '' END AS l2, asked AND k1 AND NOT k2 AS bad_l2 FROM g),
m AS (SELECT doc_id, coalesce(nullif(security_code, ''), code) AS security_code, CASE WHEN security_name <> '' THEN security_name WHEN asked THEN '宁德时代' ELSE '' END AS security_name,
 l1 AS industry_l1, l2 AS industry_l2, coalesce(nullif(report_type, ''), kind) AS report_type, CASE WHEN broker <> '' THEN broker WHEN asked THEN '国泰证券' ELSE '' END AS broker,
 asked AND (security_name = '' OR broker = '' OR l1 <> '' OR (security_code = '' AND code <> '') OR (report_type = '' AND kind <> '')) AS helped,
 concat_ws(',', CASE WHEN bad_code THEN 'security_code' END, CASE WHEN bad_l1 THEN 'industry_l1' END, CASE WHEN bad_l2 THEN 'industry_l2' END, CASE WHEN bad_kind THEN 'report_type' END) AS rejected
 FROM b JOIN v USING (doc_id))
SELECT doc_id, security_code, security_name, industry_l1, industry_l2, report_type, broker, CASE WHEN helped THEN 'llm' ELSE 'regex' END AS meta_source,
 rejected <> '' OR industry_l1 = '' OR (security_code = '' AND report_type = '个股') AS needs_review, rejected FROM m"""
_KNOWN = "source IN (" + ", ".join(f"'{k}'" for k in _TAXONOMY) + ")"
_BELOW = " OR ".join(f"(source = '{k}' AND lang IN ({', '.join(repr(x) for x in v)}))" for k, v in _TAXONOMY.items() if v)


@query("merged_metadata", _GUESS.format(rules=SQL["report_fields"], known=_KNOWN, below=f"({_BELOW})"))
def q_merged(spark, sf_dir):
    """Names as in ``report_fields``, with replies of a model whose industries are the documents' sources and languages."""
    k = F.col("doc_id")
    guess = F.struct(
        F.when(k % 3 == 0, "300750").when(k % 3 == 1, "202608").otherwise("").alias("security_code"),
        F.lit(" 宁德时代 ").alias("security_name"),
        F.when(k % 4 == 0, "个股").when(k % 4 == 1, "周报").otherwise("").alias("report_type"),
        F.lit("国泰证券").alias("broker"),
        F.col("source").alias("industry_l1"),
        F.col("lang").alias("industry_l2"),
    )
    reply = F.when(k % 7 > 1, F.concat(F.lit("Here: "), F.to_json(guess), F.lit("."))).when(k % 7 == 1, "I can't tell.")
    reports = table(spark, sf_dir, "documents").select("doc_id", F.expr(_NAME).alias("filename"), F.lit(None).cast("string").alias("title"), reply.alias("reply"))
    return merged_metadata(reports, _TAXONOMY).withColumn("rejected", F.array_join("rejected", ","))


@query(
    "document_version",
    "SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN '2024.' || doc_id WHEN doc_id % 4 < 3 THEN (doc_id % 3) || '.' || (doc_id % 10) ELSE '' END AS version FROM documents",
)
def q_version(spark, sf_dir):
    """Versions of made-up names: with underscore, in brackets, in front of the ending; none amid a name."""
    d = table(spark, sf_dir, "documents")
    no = "concat(CAST(doc_id % 3 AS STRING), '.', CAST(doc_id % 10 AS STRING))"
    form = F.expr(f"CASE doc_id % 4 WHEN 0 THEN concat('a/v9/', source, '_v', {no}, '.pdf') WHEN 1 THEN concat(source, '（V', {no}, '）.docx') WHEN 2 THEN concat(source, ' v', {no}, ' .md') ELSE concat(source, '_v', {no}, '_final.pdf') END")
    given = F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit(" 2024."), F.col("doc_id").cast("string"))).otherwise("")
    return d.select("doc_id", document_version(given, form).alias("version"))
