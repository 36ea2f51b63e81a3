"""The document catalogue: listing, versions, statistics, manifest comparison, soft deletion and upserts.

Tables without an in-place merge are rewritten by anti-join and union, or read through a latest-wins view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators.tables import CODE, MAX_VALUE, REPORT_FIELDS, category_name_valid
from docloom.plans.registry import query
from docloom.session import table


def list_documents(chunks: DataFrame) -> DataFrame:
    """One row for each source: attributes of its first chunk, and how many chunks it has."""
    return chunks.groupBy("source").agg(F.min_by("lang", "doc_id").alias("lang"), F.min("doc_id").alias("first_id"), F.count("*").alias("chunk_count"))


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The newest row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def newest_versions(versions: DataFrame, key: str, time: str, n: int) -> DataFrame:
    """The newest n versions of each key; ties go to the larger version."""
    order = Window.partitionBy(key).orderBy(F.desc(time), F.desc("version"))
    return versions.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def zero_filled(registry: DataFrame, stats: DataFrame, key: str, counts: list[str]) -> DataFrame:
    """Registry rows with their counts, zero where there are none."""
    return registry.join(stats, key, "left").select(*registry.columns, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])


def manifest_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """key and status of every chunk: unchanged, changed, removed or added."""
    o = old.select(F.col(key), F.col(digest).alias("_o"))
    n = new.select(F.col(key), F.col(digest).alias("_n"))
    status = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") == F.col("_n"), "unchanged").otherwise("changed")
    return o.join(n, key, "full_outer").select(key, status.alias("status"))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows whose key is not among the new ones, and all new rows."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def visible(rows: DataFrame) -> DataFrame:
    """Current rows that are not deleted; soft-deleted rows never show up in a search."""
    return rows.where("is_current and not is_deleted")


def _d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("list_documents", "SELECT source, min_by(lang, doc_id) AS lang, min(doc_id) AS first_id, count(*) AS chunk_count FROM documents GROUP BY source")
def q_list_documents(spark, sf_dir):
    return list_documents(_d(spark, sf_dir))


@query("kb_stats", "SELECT count(DISTINCT source) AS document_count, count(*) AS chunk_count FROM documents")
def q_kb_stats(spark, sf_dir):
    return _d(spark, sf_dir).agg(F.count_distinct("source").alias("document_count"), F.count("*").alias("chunk_count"))


@query(
    "category_stats_zero_fill",
    """SELECT n.n_name AS category, coalesce(s.chunks, 0)::BIGINT AS chunks, coalesce(s.sources, 0)::BIGINT AS sources FROM nation n LEFT JOIN
(SELECT c_nationkey, count(*) AS chunks, count(DISTINCT c_mktsegment) AS sources FROM customer WHERE c_acctbal > 9900 GROUP BY c_nationkey) s ON s.c_nationkey = n.n_nationkey""",
)
def q_category_stats(spark, sf_dir):
    stats = table(spark, sf_dir, "customer").where("c_acctbal > 9900").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.count("*").alias("chunks"), F.count_distinct("c_mktsegment").alias("sources")
    )
    names = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("category"))
    return zero_filled(names, stats, "n_nationkey", ["chunks", "sources"]).drop("n_nationkey")


_VERSIONS = "SELECT user_id AS source, event_type AS version, count(*) AS chunks, max(ts) AS ingested, bool_or(value > 50) AS is_current FROM events GROUP BY ALL"


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("source"), F.col("event_type").alias("version")).agg(
        F.count("*").alias("chunks"), F.max(F.col("ts").cast("timestamp")).alias("ingested"), F.bool_or(F.col("value") > 50).alias("is_current")
    )


@query("document_versions", f"SELECT source, version, chunks, epoch_us(ingested) AS ingested_us, is_current FROM ({_VERSIONS})")
def q_document_versions(spark, sf_dir):
    return versions(spark, sf_dir).withColumn("ingested_us", F.unix_micros("ingested")).drop("ingested")


@query("prune_versions", f"SELECT source, version, epoch_us(ingested) AS ingested_us FROM ({_VERSIONS}) QUALIFY row_number() OVER (PARTITION BY source ORDER BY ingested DESC, version DESC) <= 2")
def q_prune_versions(spark, sf_dir):
    return newest_versions(versions(spark, sf_dir), "source", "ingested", 2).select("source", "version", F.unix_micros("ingested").alias("ingested_us"))


_HASHED = "SELECT doc_id, source, sha256(text) AS sha FROM documents"


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _d(spark, sf_dir).select("doc_id", "source", F.sha2("text", 256).alias("sha"))


@query("unchanged_skip", f"WITH h AS ({_HASHED}) SELECT doc_id FROM h n WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.doc_id % 3 <> 0 AND o.source = n.source AND o.sha = n.sha)")
def q_unchanged_skip(spark, sf_dir):
    """Documents still to be ingested: no stored one has their source and content."""
    h = hashed(spark, sf_dir)
    return h.join(h.where("doc_id % 3 <> 0").select("source", "sha").distinct(), ["source", "sha"], "left_anti").select("doc_id")


@query(
    "manifest_diff",
    f"""WITH h AS ({_HASHED}), o AS (SELECT doc_id, sha FROM h WHERE doc_id % 5 <> 0), n AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'edited' ELSE sha END AS sha FROM h WHERE doc_id % 11 <> 0)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN o.sha = n.sha THEN 'unchanged' ELSE 'changed' END AS status
FROM o FULL JOIN n ON o.doc_id = n.doc_id""",
)
def q_manifest_diff(spark, sf_dir):
    h = hashed(spark, sf_dir)
    new = h.where("doc_id % 11 <> 0").withColumn("sha", F.when(F.col("doc_id") % 7 == 0, "edited").otherwise(F.col("sha")))
    return manifest_diff(h.where("doc_id % 5 <> 0"), new, "doc_id", "sha")


@query("vector_reuse", f"WITH h AS ({_HASHED}) SELECT n.doc_id, min(o.doc_id) AS reused_from FROM h n LEFT JOIN h o ON o.doc_id % 2 = 0 AND o.source = n.source AND o.sha = n.sha GROUP BY n.doc_id")
def q_vector_reuse(spark, sf_dir):
    """The stored document (smallest id) whose vector serves a new one of the same source and content; null: embed it."""
    h = hashed(spark, sf_dir)
    old = h.where("doc_id % 2 = 0").groupBy("source", "sha").agg(F.min("doc_id").alias("reused_from"))
    return h.join(old, ["source", "sha"], "left").select("doc_id", "reused_from")


@query(
    "upsert_latest",
    "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
)
def q_upsert_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return latest(rows, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query(
    "upsert_rows",
    """SELECT doc_id, lang FROM documents WHERE NOT (doc_id % 10 = 0 AND lang = 'en') UNION ALL SELECT doc_id, 'xx' AS lang FROM documents WHERE doc_id % 10 = 0 AND lang = 'en'""",
)
def q_upsert_rows(spark, sf_dir):
    old = _d(spark, sf_dir).select("doc_id", "lang")
    new = old.where("doc_id % 10 = 0 and lang = 'en'").withColumn("lang", F.lit("xx"))
    return upsert(old, new, ["doc_id"])


@query(
    "soft_delete",
    """SELECT source, count(*) AS shown FROM (SELECT doc_id, source, NOT source IN ('src1', 'src3') AS is_current, source IN ('src1', 'src3') AS is_deleted FROM documents)
WHERE is_current AND NOT is_deleted GROUP BY source""",
)
def q_soft_delete(spark, sf_dir):
    gone = F.col("source").isin("src1", "src3")
    return visible(_d(spark, sf_dir).withColumns({"is_current": ~gone, "is_deleted": gone})).groupBy("source").agg(F.count("*").alias("shown"))


def delete_sources(rows: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What stays of rows (source, version, …), and for each request (source, version) how many rows it takes, counted before.

    A request without a version takes all versions of its source. Requests that take nothing are listed with 0.
    """
    asked = requests.select("source", F.col("version").alias("_v")).distinct()
    hit = rows["source"] == asked["source"]
    hit = hit & (asked["_v"].isNull() | (rows["version"] == asked["_v"]))
    left = rows.join(asked, hit, "left_anti")
    sizes = rows.groupBy("source", "version").agg(F.count("*").alias("_n"))
    per = asked.join(sizes, "source", "left")
    taken = F.sum(F.when(F.col("_v").isNull() | (F.col("_v") == F.col("version")), F.col("_n")))
    return left, per.groupBy("source", F.col("_v").alias("version")).agg(F.coalesce(taken, F.lit(0)).cast("long").alias("deleted"))


def rename_categories(rows: DataFrame, registry: DataFrame, requests: DataFrame, default: str = "default") -> tuple[DataFrame, DataFrame]:
    """rows (category, …) with the categories renamed that may be, and each request (old, new) with what became of it.

    Guards: the old category is known to the registry (category), the default one keeps its name, the new name is valid, no
    category has it, and no two requests want the same name or rename the same category; of these none is done.
    """
    known = registry.select(F.col("category").alias("_c")).distinct()
    asked = requests.select("old", "new").distinct()
    twice = asked.withColumns({"_o": F.count("*").over(Window.partitionBy("old")), "_w": F.count("*").over(Window.partitionBy("new"))})
    checked = twice.join(known.withColumnRenamed("_c", "_old"), F.col("old") == F.col("_old"), "left").join(known.withColumnRenamed("_c", "_new"), F.col("new") == F.col("_new"), "left")
    status = (
        F.when(F.col("_old").isNull(), "missing")
        .when(F.col("old") == default, "default")
        .when(~category_name_valid(F.col("new")), "invalid")
        .when(F.col("_new").isNotNull(), "exists")
        .when((F.col("_o") > 1) | (F.col("_w") > 1), "ambiguous")
        .otherwise("renamed")
    )
    said = checked.select("old", "new", status.alias("status"))
    done = said.where("status = 'renamed'").select(F.col("old").alias("category"), F.col("new").alias("_new"))
    renamed = rows.join(done, "category", "left").withColumn("category", F.coalesce("_new", "category")).select(*rows.columns)
    return renamed, said


#: Fields that may be corrected by hand.
PATCHABLE = ("date", "category", *REPORT_FIELDS)


def patch_metadata(rows: DataFrame, patches: DataFrame, key: str = "source") -> tuple[DataFrame, DataFrame]:
    """rows with the valid patches (key, field, value) applied and ``is_manual`` set, and each patch with its verdict.

    Dates are normalised, a year alone to its first day; a security code has six digits; other values have up to 64
    characters; '' clears a field other than the date. Only fields that the rows have can be patched. Of several patches of
    one field the largest value counts.
    """
    fields = [f for f in PATCHABLE if f in rows.columns]
    value = F.trim(F.col("value"))
    day = F.when(value.rlike("^[0-9]{4}$"), F.concat(value, F.lit("-01-01"))).when(value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), value)
    plain = F.when(F.length(value) <= MAX_VALUE, value)
    code = F.when(value.rlike(f"^{CODE.pattern}$") | (value == ""), value)
    normal = F.when(F.col("field") == "date", day).when(F.col("field") == "security_code", code).otherwise(plain)
    judged = patches.withColumn("_value", F.when(F.col("field").isin(fields), normal)).join(rows.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left")
    verdict = F.when(~F.col("field").isin(fields), "unknown field").when(F.col("_k").isNull(), "unknown key").when(F.col("_value").isNull(), "invalid value").otherwise("patched")
    said = judged.withColumn("verdict", verdict)
    columns = [F.max(F.when(F.col("field") == f, F.col("_value"))).alias(f"_new_{f}") for f in fields]
    new = said.where("verdict = 'patched'").groupBy(key).agg(*columns, F.lit(True).alias("_hit"))
    made = rows.drop("is_manual").join(new, key, "left")
    out = [F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns if c != "is_manual"]
    before = F.coalesce(F.col("is_manual"), F.lit(False)) if "is_manual" in rows.columns else F.lit(False)
    if "is_manual" in rows.columns:
        made = made.join(rows.select(key, "is_manual").groupBy(key).agg(F.max("is_manual").alias("is_manual")), key, "left")
    return made.select(*out, F.coalesce("_hit", before).alias("is_manual")), said.select(key, "field", "value", "verdict")


_SOURCES = "SELECT source, try_cast(substr(source, 4) AS INT) AS k FROM (SELECT DISTINCT source FROM documents)"


def _sources(spark, sf_dir):
    return _d(spark, sf_dir).select("source").distinct().withColumn("k", F.substring("source", 4, 9).try_cast("int"))


@query(
    "delete_by_source",
    f"""WITH a AS (SELECT source, CASE WHEN k % 3 = 1 THEN 'en' END AS version FROM ({_SOURCES}) WHERE k % 3 < 2),
l AS (SELECT source, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.source = d.source AND (a.version IS NULL OR a.version = d.lang)) GROUP BY source)
SELECT a.source, a.version, (SELECT count(*) FROM documents d WHERE d.source = a.source AND (a.version IS NULL OR a.version = d.lang)) AS deleted, coalesce(l.n, 0)::BIGINT AS rows_left FROM a LEFT JOIN l USING (source)""",
)
def q_delete_by_source(spark, sf_dir):
    """Every third source goes whole, every third one in English only; languages stand for versions."""
    asked = _sources(spark, sf_dir).where("k % 3 < 2").select("source", F.when(F.col("k") % 3 == 1, "en").alias("version"))
    left, taken = delete_sources(_d(spark, sf_dir).select("source", F.col("lang").alias("version")), asked)
    sizes = left.groupBy("source").agg(F.count("*").alias("rows_left"))
    return taken.join(sizes, "source", "left").select("source", "version", "deleted", F.coalesce("rows_left", F.lit(0)).alias("rows_left"))


_RENAMES = f"SELECT source AS old, CASE k % 5 WHEN 0 THEN 'new_' || source WHEN 1 THEN 'src0' WHEN 2 THEN 'not valid!' WHEN 3 THEN 'same' ELSE 'to_' || k END AS new FROM ({_SOURCES}) UNION ALL SELECT 'nowhere_' || lang, 'x' FROM (SELECT DISTINCT lang FROM documents)"


@query(
    "rename_category",
    rf"""WITH r AS ({_RENAMES}), g AS (SELECT DISTINCT source FROM documents),
s AS (SELECT old, new, CASE WHEN old NOT IN (FROM g) THEN 'missing' WHEN old = 'src0' THEN 'default' WHEN NOT regexp_full_match(new, '[\w-]{{1,64}}') THEN 'invalid' WHEN new IN (FROM g) THEN 'exists'
 WHEN count(*) OVER (PARTITION BY new) > 1 THEN 'ambiguous' ELSE 'renamed' END AS status FROM r)
SELECT coalesce(s.new, d.source) AS category, count(*) AS chunks, NULL AS status FROM documents d LEFT JOIN s ON s.old = d.source AND s.status = 'renamed' GROUP BY 1
UNION ALL SELECT old || '>' || new, 0, status FROM s""",
)
def q_rename_category(spark, sf_dir):
    """Categories behind the renaming with their rows, and the requests with what became of them."""
    k = F.col("k") % 5
    new = F.when(k == 0, F.concat(F.lit("new_"), "source")).when(k == 1, "src0").when(k == 2, "not valid!").when(k == 3, "same").otherwise(F.concat(F.lit("to_"), F.col("k")))
    asked = _sources(spark, sf_dir).select(F.col("source").alias("old"), new.alias("new"))
    asked = asked.union(_d(spark, sf_dir).select(F.concat(F.lit("nowhere_"), "lang"), F.lit("x")).distinct())
    rows = _d(spark, sf_dir).select(F.col("source").alias("category"))
    renamed, said = rename_categories(rows, rows.distinct(), asked, "src0")
    shown = renamed.groupBy("category").agg(F.count("*").alias("chunks")).withColumn("status", F.lit(None).cast("string"))
    return shown.unionByName(said.select(F.concat_ws(">", "old", "new").alias("category"), F.lit(0).cast("long").alias("chunks"), "status"))


_PATCHES = f"""SELECT source, 'date' AS field, CASE k % 3 WHEN 0 THEN '2023' WHEN 1 THEN '2024-05-06' ELSE 'May' END AS value FROM ({_SOURCES})
UNION ALL SELECT source, 'security_code', CASE WHEN k % 2 = 0 THEN '60' || lpad(k::VARCHAR, 4, '0') ELSE '12345' END FROM ({_SOURCES}) UNION ALL SELECT source, 'owner', 'me' FROM ({_SOURCES}) WHERE k = 3
UNION ALL SELECT 'none_' || source, 'date', '2020' FROM ({_SOURCES}) WHERE k = 4"""


@query(
    "patch_metadata",
    rf"""WITH p AS ({_PATCHES}), v AS (SELECT *, CASE field WHEN 'date' THEN CASE WHEN regexp_full_match(value, '\d{{4}}') THEN value || '-01-01' WHEN regexp_full_match(value, '\d{{4}}-\d{{2}}-\d{{2}}') THEN value END
 WHEN 'security_code' THEN CASE WHEN regexp_full_match(value, '[03468]\d{{5}}') THEN value END END AS n FROM p),
o AS (SELECT source, max(n) FILTER (field = 'date') AS nd, max(n) FILTER (field = 'security_code') AS nc FROM v WHERE n IS NOT NULL GROUP BY source)
SELECT coalesce(nd, '2000-01-01') AS date, coalesce(nc, '') AS security_code, o.source IS NOT NULL AS is_manual, count(*) AS n FROM documents d LEFT JOIN o USING (source) GROUP BY ALL""",
)
def q_patch_metadata(spark, sf_dir):
    """Dates and codes of the sources corrected, some of them wrongly; rows by what they have behind it."""
    k, s = F.col("k"), _sources(spark, sf_dir)
    date = F.when(k % 3 == 0, "2023").when(k % 3 == 1, "2024-05-06").otherwise("May")
    code = F.when(k % 2 == 0, F.concat(F.lit("60"), F.lpad(k.cast("string"), 4, "0"))).otherwise("12345")
    patches = s.select("source", F.lit("date").alias("field"), date.alias("value")).union(s.select("source", F.lit("security_code"), code))
    patches = patches.union(s.where("k = 3").select("source", F.lit("owner"), F.lit("me"))).union(s.where("k = 4").select(F.concat(F.lit("none_"), "source"), F.lit("date"), F.lit("2020")))
    rows = _d(spark, sf_dir).select("source", F.lit("2000-01-01").alias("date"), F.lit("").alias("security_code"))
    return patch_metadata(rows, patches)[0].groupBy("date", "security_code", "is_manual").agg(F.count("*").alias("n"))


@query("filter_predicates", "SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND source = 'src0' AND n_chars >= 500 AND n_chars < 5000")
def q_filter_predicates(spark, sf_dir):
    """Equality, membership and range conditions joined by AND, all pushed to the scan."""
    return build_filter(_d(spark, sf_dir), {"lang": ["en", "fr"], "source": "src0", "n_chars": {"gte": 500, "lt": 5000}}).select("doc_id")


def build_filter(rows: DataFrame, filters: dict) -> DataFrame:
    """Conditions by field: a value, a list of values, or a dict of gte, lte, gt, lt; other operators are ignored."""
    for name, value in filters.items():
        c = F.col(name)
        if isinstance(value, dict):
            tests = {"gte": c.__ge__, "lte": c.__le__, "gt": c.__gt__, "lt": c.__lt__}
            for op, x in value.items():
                if op in tests:
                    rows = rows.where(tests[op](F.lit(x)))
        elif isinstance(value, (list, tuple)):
            rows = rows.where(c.isin(list(value))) if value else rows
        else:
            rows = rows.where(c == value)
    return rows
