"""Exact seeded samples and digests over whole tables: pairs of documents of different sources, and ordered fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.plans.registry import query
from docloom.session import table

GROUPS = 64  # parts in which the documents of a source are numbered


def _number(text: Column) -> Column:
    """60 bits of a text's md5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def cross_source_pairs(documents: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n pairs (doc_id, other) of documents (doc_id, source) of different sources, drawn uniformly from all there are.

    All pairs have a rank that follows from counts alone: documents are ordered by source, part and id, and a document forms a
    pair with every one of a later source. The drawn ranks are turned into pairs by looking two numbers up, so no pair
    is formed that is not drawn. Documents are numbered within parts of their source, which no source outgrows. Ranks are
    drawn with replacement; one that is drawn twice counts once, so there may be a few pairs less than n.
    """
    part = F.pmod("doc_id", F.lit(GROUPS)).alias("part")
    rows = documents.where("doc_id is not null and source is not null").select("doc_id", "source", part)
    sizes = rows.groupBy("source", "part").agg(F.count("*").alias("size"))  # one row for each source and part
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("size"))
    every = Window.orderBy("source")
    before = F.sum("size").over(every) - F.col("size")
    total = F.sum("size").over(Window.partitionBy())
    placed = by_source.select("source", "size", before.alias("begin"), total.alias("total"))
    after = (F.col("total") - F.col("begin") - F.col("size")).alias("after")
    pairs = placed.select("source", "begin", "size", after)
    pairs = pairs.withColumn("rank_end", F.sum(F.col("size") * F.col("after")).over(every)).withColumn("rank_begin", F.col("rank_end") - F.col("size") * F.col("after"))
    whole = pairs.agg(F.coalesce(F.max("rank_end"), F.lit(0)).alias("whole"))
    drawn = documents.sparkSession.range(n).join(F.broadcast(whole)).where("whole > 0")  # one row
    drawn = drawn.select(F.pmod(_number(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), F.col("whole")).alias("rank")).distinct()
    of = (F.col("rank") >= F.col("rank_begin")) & (F.col("rank") < F.col("rank_end"))
    inside = (F.col("rank") - F.col("rank_begin")).alias("inside")
    found = drawn.join(pairs.where("after > 0"), of).select("rank", "begin", "size", "after", inside)
    first = F.expr("begin + inside div after").alias("a")
    second = F.expr("begin + size + inside % after").alias("b")
    wanted = found.select("rank", first, second)
    starts = sizes.withColumn("start", F.sum("size").over(Window.orderBy("source", "part")) - F.col("size")).select("source", "part", "start")
    numbered = rows.join(starts, ["source", "part"]).withColumn("at", F.col("start") + F.row_number().over(Window.partitionBy("source", "part").orderBy("doc_id")) - 1)
    x = numbered.select(F.col("at").alias("a"), "doc_id")
    y = numbered.select(F.col("at").alias("b"), F.col("doc_id").alias("other"))
    return wanted.join(x, "a").join(y, "b").select("doc_id", "other")


def ordered_fingerprint(rows: DataFrame, key: str, digest: Column, chunk: int = 1000) -> DataFrame:
    """n, fingerprint of the rows in the order of their key, a whole number: one row, '' hashed for an empty table.

    Keys of one range of ``chunk`` form a digest of their rows' digests in order, the ranges' digests are taken together in
    ranges of ``chunk`` again, until one is left. A range that is not full takes part like any other, so equal rows give
    the same fingerprint however they are partitioned, and no list is longer than the rows of a range.
    """
    level = rows.select(F.col(key).cast("long").alias("_k"), F.sha2(digest, 256).alias("_d"), F.lit(1).cast("long").alias("_n"))
    span = rows.agg(F.max(F.abs(F.col(key)))).first()[0] or 0
    while True:
        ordered = F.array_sort(F.collect_list(F.struct("_k", "_d")))
        joined = F.array_join(F.transform(ordered, lambda x: x["_d"]), "")
        step = F.floor(F.col("_k") / chunk).cast("long") if span else F.lit(0).cast("long")
        level = level.groupBy(step.alias("_k")).agg(F.sha2(joined, 256).alias("_d"), F.sum("_n").alias("_n"))
        if not span:
            break
        span = span // chunk if span >= chunk else 0
    return level.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.max("_d"), F.sha2(F.lit(""), 256)).alias("fingerprint"))


_SAMPLE = 500


@query(
    "cross_source_pairs",
    f"""WITH o AS (SELECT doc_id, source, row_number() OVER (ORDER BY source, doc_id % {GROUPS}, doc_id) - 1 AS at_place FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL),
s AS (SELECT source, count(*) AS size, min(at_place) AS first, (SELECT count(*) FROM o) - min(at_place) - count(*) AS later FROM o GROUP BY source),
r AS (SELECT *, sum(size * later) OVER (ORDER BY source) - size * later AS lo, sum(size * later) OVER (ORDER BY source) AS hi FROM s),
d AS (SELECT DISTINCT (('0x' || substring(md5('0:' || i), 1, 15))::BIGINT % (SELECT max(hi)::BIGINT FROM r)) AS rank FROM range({_SAMPLE}) t(i))
SELECT x.doc_id, y.doc_id AS other FROM d JOIN r ON d.rank >= r.lo AND d.rank < r.hi
JOIN o x ON x.at_place = r.first + (d.rank - r.lo) // r.later JOIN o y ON y.at_place = r.first + r.size + (d.rank - r.lo) % r.later""",
)
def q_pairs(spark, sf_dir):
    return cross_source_pairs(table(spark, sf_dir, "documents"), _SAMPLE)


@query(
    "dataset_fingerprint",
    """WITH a AS (SELECT o_orderkey AS k, sha256(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_orderpriority)) AS d FROM orders),
l1 AS (SELECT k // 1000 AS k, sha256(string_agg(d, '' ORDER BY k, d)) AS d, count(*) AS n FROM a GROUP BY 1),
l2 AS (SELECT k // 1000 AS k, sha256(string_agg(d, '' ORDER BY k, d)) AS d, sum(n) AS n FROM l1 GROUP BY 1),
l3 AS (SELECT k // 1000 AS k, sha256(string_agg(d, '' ORDER BY k, d)) AS d, sum(n) AS n FROM l2 GROUP BY 1)
SELECT sum(n)::BIGINT AS n, max(CASE WHEN m < 1000 THEN l2s WHEN m < 1000000 THEN l3s ELSE l4s END) AS fingerprint FROM (
 SELECT (SELECT sum(n) FROM l1) AS n, (SELECT max(o_orderkey) FROM orders) AS m, (SELECT sha256(string_agg(d, '' ORDER BY k, d)) FROM l1) AS l2s, (SELECT sha256(string_agg(d, '' ORDER BY k, d)) FROM l2) AS l3s, (SELECT sha256(string_agg(d, '' ORDER BY k, d)) FROM l3) AS l4s)""",
)
def q_fingerprint(spark, sf_dir):
    text = F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return ordered_fingerprint(table(spark, sf_dir, "orders"), "o_orderkey", text)
