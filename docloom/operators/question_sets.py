"""Layered question sets made from a chunk store: questions on one chunk, on two sources, and ones to be refused.

The model that words questions is the caller's: a function of columns (a pandas UDF, say) that gives its reply as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import NUMBERED_LINE, PICTURE_WORDS, UNICODE, is_low_quality, stripped
from docloom.operators.sampling import _number
from docloom.plans.registry import query
from docloom.session import table
from docloom.sources.scratch import stored

PER_SOURCE = 8
SHARES = (0.7, 0.2)  # of questions on one chunk and on two sources; the rest is to be refused
ONE_TEXT, PAIR_TEXT = 3000, 2000  # characters of a chunk that a question is made from
LISTED_SOURCES = 20
PARTS = 64  # parts in which sources are numbered
BROADCAST_IDS = 100_000

#: Marks of a reply, and the texts that a question set carries. Fixed values.
QUESTION = r"^##\s*问题\s*\n(.+?)\n"
ANSWER = "### 标准答案"
REFUSAL = "应拒绝回答或指出知识库无相关信息"
NO_SOURCES = "（知识库为空）"
LEAST_QUESTION, LEAST_ANSWER = 4, 10

Ask = Callable[..., Column]


def parsed_reply(reply: Column) -> Column:
    """struct<query, answer> of a reply; null where it declines (SKIP), lacks a mark, or either part is too short."""
    text = stripped(F.coalesce(reply, F.lit("")))
    asked = stripped(F.regexp_extract(text, "(?Ud)" + QUESTION, 1))
    at = F.instr(text, ANSWER)
    answer = stripped(F.substr(text, at + len(ANSWER)))
    good = (at > 0) & (F.length(asked) >= LEAST_QUESTION) & (F.length(answer) >= LEAST_ANSWER)
    return F.when(good, F.struct(asked.alias("query"), answer.alias("answer")))


def candidate_pool(chunks: DataFrame, per_source: int = PER_SOURCE) -> DataFrame:
    """source, id, place of the chunks (id, source, content) that questions may be made from, numbered from 0 in each source.

    A source takes part with its first 2 * per_source chunks by id; of these the first per_source stay that are neither
    blank nor of low quality. Texts are judged in their own rows and only ids are shuffled. Rows without id or source are
    left out.
    """
    text = F.coalesce("content", F.lit(""))
    good = (stripped(text) != "") & ~is_low_quality(stripped(text))
    rows = chunks.where("id is not null and source <> ''").select("source", F.col("id").cast("string").alias("id"), good.alias("good"))
    by_source = Window.partitionBy("source").orderBy("id")
    first = rows.withColumn("place", F.row_number().over(by_source)).where(F.col("place") <= 2 * per_source)
    kept = first.where("good").withColumn("place", F.row_number().over(by_source) - 1)
    return kept.where(F.col("place") < per_source).select("source", "id", "place")


def drawn_chunks(pool: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """id, source, rank of n chunks of the pool, a seeded sample without replacement."""
    rank = _number(F.concat(F.lit(f"{seed}:one:"), F.col("id")))
    return pool.select("id", "source", rank.alias("rank")).orderBy("rank", "id", "source").limit(n)


def drawn_pairs(pool: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """draw, source_a, id_a, source_b, id_b: n pairs of chunks of two sources, drawn with replacement.

    Two different sources are drawn evenly, then a chunk of each. Sources have a number that follows from the sizes of
    ``PARTS`` parts, so a draw finds its source and chunk by joins on numbers.
    """
    sizes = pool.groupBy("source").agg(F.count("*").alias("size")).withColumn("part", F.pmod(_number(F.col("source")), F.lit(PARTS)))
    parts = sizes.groupBy("part").agg(F.count("*").alias("n"))  # at most PARTS rows
    placed = parts.select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("begin"), F.sum("n").over(Window.partitionBy()).alias("total")
    )
    within = F.row_number().over(Window.partitionBy("part").orderBy("source")) - 1
    numbered = sizes.withColumn("within", within).join(F.broadcast(placed), "part").select("source", "size", (F.col("begin") + F.col("within")).alias("no"))

    def number(what: str) -> Column:
        return _number(F.concat(F.lit(f"{seed}:{what}:"), F.col("draw").cast("string")))

    total = F.broadcast(placed.agg(F.max("total").alias("total")))  # one row
    draws = pool.sparkSession.range(n).withColumnRenamed("id", "draw").join(total).where("total > 1")
    draws = draws.withColumn("no_a", F.pmod(number("a"), F.col("total")))
    draws = draws.withColumn("no_b", F.pmod(F.col("no_a") + 1 + F.pmod(number("b"), F.col("total") - 1), F.col("total")))
    for side in ("a", "b"):
        own = numbered.select(F.col("no").alias(f"no_{side}"), F.col("source").alias(f"source_{side}"), "size")
        draws = draws.join(own, f"no_{side}").withColumn(f"place_{side}", F.pmod(number(f"chunk_{side}"), F.col("size"))).drop("size")
        held = pool.select(F.col("source").alias(f"source_{side}"), F.col("place").alias(f"place_{side}"), F.col("id").alias(f"id_{side}"))
        draws = draws.join(held, [f"source_{side}", f"place_{side}"])
    return draws.where("id_a <> id_b").select("draw", "source_a", "id_a", "source_b", "id_b")


def question_set(chunks: DataFrame, ask_one: Ask, ask_pair: Ask, ask_none: Ask, count: int = 40, seed: int = 42, per_source: int = PER_SOURCE) -> DataFrame:
    """number, query, question_type, related_docs, chunk_ids, expected_behavior, answer: a question set of about ``count``.

    Seven tenths of the questions rest on one chunk: ``ask_one(content)``; two on two sources: ``ask_pair(source, content, other source,
    other content)``, with twice as many pairs drawn as are wanted; the rest shall be refused: ``ask_none(list of sources, number)``.
    Replies that don't parse give no question. A question is kept once, whatever its white space: of single chunks before
    pairs before refusals. No pool, no questions. Only numbering the finished questions, at most ``count``, takes one task.
    """
    one, two = (round(count * s) for s in SHARES)
    pool = stored(candidate_pool(chunks, per_source), "pool")
    singles = stored(drawn_chunks(pool, one, seed), "singles")
    pairs = stored(drawn_pairs(pool, 4 * two, seed).orderBy("draw").limit(2 * two), "pairs")

    def texts(ids: DataFrame, bound: int) -> DataFrame:
        """The drawn chunks with their texts; their number follows from the arguments alone."""
        ids = ids.distinct()
        held = chunks.select(F.col("id").cast("string").alias("id"), "source", stripped("content").alias("content"))
        return held.join(F.broadcast(ids) if bound <= BROADCAST_IDS else ids, ["id", "source"], "left_semi")

    def made(rows: DataFrame, reply: Column, stage: int, rank: str, related: Column, ids: Column, kind: str, expected: str) -> DataFrame:
        asked = rows.select(F.lit(stage).alias("stage"), F.col(rank).cast("long").alias("rank"), related.alias("related_docs"), ids.alias("chunk_ids"), parsed_reply(reply).alias("r"))
        return asked.where("r is not null").select(
            "stage", "rank", "chunk_ids", "related_docs", "r.query", "r.answer", F.lit(kind).alias("question_type"), F.lit(expected).alias("expected_behavior")
        )

    own = singles.join(texts(singles.select("id", "source"), one), ["id", "source"])
    first = made(own, ask_one(F.substring("content", 1, ONE_TEXT)), 1, "rank", F.col("source"), F.array("id"), "single_hop", "")
    sides = [pairs.select(F.col(f"id_{x}").alias("id"), F.col(f"source_{x}").alias("source")) for x in "ab"]
    both = stored(texts(sides[0].union(sides[1]), 4 * two), "texts")
    for x in "ab":
        pairs = pairs.join(both.select(F.col("id").alias(f"id_{x}"), F.col("source").alias(f"source_{x}"), F.substring("content", 1, PAIR_TEXT).alias(f"content_{x}")), [f"id_{x}", f"source_{x}"])
    related = F.concat_ws(", ", "source_a", "source_b")
    reply = ask_pair(F.col("source_a"), F.col("content_a"), F.col("source_b"), F.col("content_b"))
    second = made(pairs, reply, 2, "draw", related, F.array("id_a", "id_b"), "multi_hop", "").orderBy("rank").limit(two)
    named = chunks.where("source <> ''").select("source").distinct().orderBy("source").limit(LISTED_SOURCES)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("source")), lambda s: F.concat(F.lit("- "), s)), "\n")
    sources = named.agg(F.coalesce(F.nullif(listed, F.lit("")), F.lit(NO_SOURCES)).alias("sources"))
    some = pool.limit(1).agg(F.count("*").alias("some"))
    empty = chunks.sparkSession.range(count - one - two).join(F.broadcast(sources)).join(F.broadcast(some)).where("some > 0")  # one row each
    third = made(empty, ask_none(F.col("sources"), F.col("id")), 3, "id", F.lit(""), F.array().cast("array<string>"), "negative", REFUSAL)
    rows = stored(first.union(second).union(third), "questions")  # a model is asked once
    key = F.regexp_replace("query", UNICODE + r"\s+", "")
    kept = rows.where(key != "").groupBy(key.alias("key")).agg(F.min(F.struct(*rows.columns)).alias("q")).select("q.*")
    number = F.row_number().over(Window.orderBy("stage", "rank", "chunk_ids"))
    return kept.select(number.alias("number"), "query", "question_type", "related_docs", "chunk_ids", "expected_behavior", "answer")


def question_meta(related: Column, ids: Column, kind: Column, expected: Column) -> Column:
    """The fields that a written question carries, as a map for ``sources.files.write_questions``; empty ones are left out."""
    fields = F.create_map(F.lit("问题类型"), kind, F.lit("相关文档"), related, F.lit("证据chunk"), F.array_join(ids, ", "), F.lit("期望行为"), expected)
    return F.map_filter(fields, lambda k, v: v != "")


_COUNT, _SEED = 120, 42
_ONE, _TWO = (round(_COUNT * s) for s in SHARES)
_REPLY = """CASE WHEN length({0}) % 7 = 0 THEN 'SKIP' WHEN length({0}) % 7 = 1 THEN 'No question here' ELSE concat('## 问题', chr(10), {1}, chr(10), chr(10), '### 标准答案', chr(10), {2}) END"""
_ONE_REPLY = _REPLY.format("content", "concat('What about ', replace(left(content, 12), chr(10), ' '), '?')", "left(content, 40)")
_TWO_REPLY = _REPLY.format("content_a", "concat('How do ', source_a, ' and ', source_b, ' differ?')", "concat(left(content_a, 20), ' / ', left(content_b, 20))")
_NONE_REPLY = "concat('## 问题', chr(10), 'Question ', CAST(id % 5 AS VARCHAR), ' beyond the sources', chr(10), '### 标准答案', chr(10), sources)"


def _draw(what: str) -> str:
    return f"('0x' || substring(md5('{_SEED}:{what}:' || draw), 1, 15))::BIGINT"


# MATERIALIZED: DuckDB, where it inlines these, pushes a join's filter on a place below the window that numbers it
_PAIR_SQL = f"""WITH c AS (SELECT doc_id::VARCHAR AS id, source, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) AS content FROM documents WHERE doc_id IS NOT NULL AND source <> ''),
l AS (SELECT *, list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS ls FROM c),
f AS MATERIALIZED (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY source ORDER BY id) <= {2 * PER_SOURCE}),
g AS (SELECT id, source, content, row_number() OVER (PARTITION BY source ORDER BY id) - 1 AS place FROM f WHERE NOT (length(content) < 150 OR regexp_matches(content, '{PICTURE_WORDS}')
 OR (len(ls) >= 4 AND len(list_filter(ls, lambda x: regexp_matches(x, '{NUMBERED_LINE}'))) / len(ls) >= 0.6::DOUBLE AND len(list_filter(ls, lambda x: length(x) < 60)) / len(ls) >= 0.8::DOUBLE))),
p AS MATERIALIZED (SELECT * FROM g WHERE place < {PER_SOURCE}),
s AS (SELECT source, count(*) AS size, row_number() OVER (ORDER BY ('0x' || substring(md5(source), 1, 15))::BIGINT % {PARTS}, source) - 1 AS no, count(*) OVER () AS total FROM p GROUP BY source),
d AS (SELECT draw, {_draw('a')} % t AS no_a, {_draw('b')} AS nb, {_draw('chunk_a')} AS ca, {_draw('chunk_b')} AS cb, t FROM range({4 * _TWO}) r(draw), (SELECT max(total) AS t FROM s) WHERE t > 1),
e AS (SELECT draw, a.source AS source_a, x.id AS id_a, x.content AS full_a, b.source AS source_b, y.id AS id_b, y.content AS full_b FROM d JOIN s a ON a.no = no_a JOIN s b ON b.no = (no_a + 1 + nb % (t - 1)) % t
 JOIN p x ON x.source = a.source AND x.place = ca % a.size JOIN p y ON y.source = b.source AND y.place = cb % b.size WHERE x.id <> y.id ORDER BY draw LIMIT {2 * _TWO}),
"""
_SQL = (
    _PAIR_SQL
    + f"""o AS (SELECT id, source, content AS full_text, ('0x' || substring(md5('{_SEED}:one:' || id), 1, 15))::BIGINT AS rank FROM p ORDER BY rank, id, source LIMIT {_ONE}),
q1 AS (SELECT 1 AS stage, rank, source AS related_docs, id AS chunk_ids, {_ONE_REPLY} AS reply FROM (SELECT *, left(full_text, {ONE_TEXT}) AS content FROM o)),
q2 AS (SELECT 2 AS stage, draw AS rank, source_a || ', ' || source_b AS related_docs, id_a || ',' || id_b AS chunk_ids, {_TWO_REPLY} AS reply FROM (SELECT *, left(full_a, {PAIR_TEXT}) AS content_a, left(full_b, {PAIR_TEXT}) AS content_b FROM e)),
q3 AS (SELECT 3 AS stage, id AS rank, '' AS related_docs, '' AS chunk_ids, {_NONE_REPLY} AS reply FROM range({_COUNT - _ONE - _TWO}) r(id),
 (SELECT string_agg('- ' || source, chr(10) ORDER BY source) AS sources FROM (SELECT DISTINCT source FROM c ORDER BY source LIMIT {LISTED_SOURCES})) WHERE (SELECT count(*) FROM p) > 0),
u AS (SELECT *, trim(regexp_extract(reply, '{QUESTION}', 1)) AS query, trim(substring(reply, strpos(reply, '{ANSWER}') + {len(ANSWER)}), ' ' || chr(10) || chr(13) || chr(9)) AS answer
 FROM (SELECT * FROM q1 UNION ALL SELECT * FROM q2 UNION ALL SELECT * FROM q3) WHERE strpos(reply, '{ANSWER}') > 0),
v AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY rank) AS k FROM u WHERE length(query) >= {LEAST_QUESTION} AND length(answer) >= {LEAST_ANSWER}),
w AS (SELECT * FROM v WHERE stage <> 2 OR k <= {_TWO} QUALIFY row_number() OVER (PARTITION BY regexp_replace(query, '\\s+', '', 'g') ORDER BY stage, rank, chunk_ids) = 1)
SELECT row_number() OVER (ORDER BY stage, rank, chunk_ids)::INT AS number, query, ['single_hop', 'multi_hop', 'negative'][stage] AS question_type, related_docs, chunk_ids,
 CASE WHEN stage = 3 THEN '{REFUSAL}' ELSE '' END AS expected_behavior, md5(answer) AS answer FROM w"""
)


def _chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.col("text").alias("content"))


@query("question_set", _SQL)
def q_question_set(spark, sf_dir):
    """A question set over all documents as chunks, worded by a fixed form in place of a model."""
    line = F.lit("\n")

    def reply(seen: Column, asked: Column, answer: Column) -> Column:
        k = F.length(seen) % 7
        form = F.concat(F.lit("## 问题\n"), asked, F.lit("\n\n### 标准答案\n"), answer)
        return F.when(k == 0, "SKIP").when(k == 1, "No question here").otherwise(form)

    def one(c: Column) -> Column:
        return reply(c, F.concat(F.lit("What about "), F.replace(F.left(c, F.lit(12)), line, F.lit(" ")), F.lit("?")), F.left(c, F.lit(40)))

    def pair(s: Column, c: Column, t: Column, d: Column) -> Column:
        return reply(c, F.concat(F.lit("How do "), s, F.lit(" and "), t, F.lit(" differ?")), F.concat(F.left(c, F.lit(20)), F.lit(" / "), F.left(d, F.lit(20))))

    def none(sources: Column, k: Column) -> Column:
        return F.concat(F.lit("## 问题\nQuestion "), (k % 5).cast("string"), F.lit(" beyond the sources\n### 标准答案\n"), sources)

    found = question_set(_chunks(spark, sf_dir), one, pair, none, _COUNT, _SEED)
    return found.withColumn("chunk_ids", F.array_join("chunk_ids", ",")).withColumn("answer", F.md5("answer"))
