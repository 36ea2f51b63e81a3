"""Quality rules as a short-circuit cascade.

Every rule is a boolean column over one text. A bounded sample gives each rule's cost (time to evaluate it) and
selectivity (share of texts it rejects); rules then run in the order of rejections per cost, and a text that one rule
rejects is not shown to the later ones (CASE WHEN stops at the first true branch). The order changes how much work is
done and which rule is named, never the verdict.

The counts that are returned for every text are made for every text; a rule's cost is what it takes beyond them, so the
short circuit saves the work of rules that look at the text again.

Everything stays in DataFrame functions on one row at a time: no shuffle, no join, no Python worker.

Edge cases: null and empty texts have no words and fail the base rules; repeated rows and repeated ids are judged row
by row; an empty table gives an empty result; further columns of the input are ignored by ``measure`` and kept by
``apply_rules``.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import count_chars, let, space_words, table

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SAMPLE_ROWS = 256
SAMPLE_BYTES = 65_536
COPIES, REPEATS, LEAST_COST = 8, 3, 1e-4
FEW = 32  # up to so many repeated windows are looked up in a plain list


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the text, the first occurrence included.

    Windows are compared by a 64-bit hash within the one text. With few distinct repeated windows each position is
    looked up in their list; with many, one sort brings equal windows together. Both count the same words.
    """

    def count(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
        return let(hashes, covered)

    def covered(h: Column) -> Column:
        ordered = F.sort_array(h)
        twice = let(ordered, lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1)))))
        return let(twice, lambda d: F.when(F.size(d) == 0, F.lit(0)).otherwise(let(positions(h, d), spread)))

    def positions(h: Column, d: Column) -> Column:
        listed = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_contains(d, h[i]))
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        ranked = let(
            pairs,
            lambda p: F.sort_array(
                F.transform(
                    F.filter(p, lambda x, i: (x["h"] == F.get(p, i - 1)["h"]) | (x["h"] == F.get(p, i + 1)["h"])),
                    lambda x: x["i"],
                )
            ),
        )
        return F.when(F.size(d) <= FEW, listed).otherwise(ranked)

    def spread(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(p, i - 1))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(count(w))).cast("long")


def measure(documents: DataFrame) -> DataFrame:
    """doc_id, text and the counts that the contract and the rules use, one row for each input row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    counted = let(
        space_words(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words")),
    )
    in_lines = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")
        ),
    )
    return (
        documents.select("doc_id", "text", counted.alias("_w"), in_lines.alias("_l"))
        .select("doc_id", "text", "_w.n_words", "_w.n_repeat_words", "_l.n_lines", "_l.n_dup_lines")
        .withColumn("word_chars", (F.length(text) - count_chars(text, " \t\n\x0b\x0c\r")).cast("long"))
        .withColumn("n_symbols", count_chars(text, SYMBOLS))
    )


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a text that the rule refuses; it may use the measured columns and the text."""

    name: str
    rejects: Column


def default_rules() -> list[Rule]:
    text = F.coalesce(F.col("text"), F.lit(""))
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > 3 * F.col("n_words")),
        Rule("capitals", 100 * upper > 40 * F.col("word_chars")),
        Rule("exclamations", 10 * count_chars(text, "!") > 3 * F.col("n_words")),
        Rule("repeated_lines", 100 * F.col("n_dup_lines") > 30 * F.col("n_lines")),
        Rule("word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words"))),
        Rule("digits", 100 * count_chars(text, "0123456789") > 30 * F.col("word_chars")),
    ]


def plan_order(sample: DataFrame, rules: list[Rule]) -> list[dict]:
    """Rules by rejections per cost on a measured sample: name, cost in seconds of a text, selectivity.

    The sample stands in memory ``COPIES`` times. A rule's cost is the least time of ``REPEATS`` passes over it, less the
    least time of passes that evaluate nothing, so that what a job costs besides the rule is left out.
    """
    sample = sample.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES)))).persist()

    def timed(rejects: Column) -> tuple[float, int]:
        least, rejected = float("inf"), 0
        counted = sample.agg(F.sum(F.coalesce(rejects, F.lit(False)).cast("int")))
        for _ in range(REPEATS):
            began = time.perf_counter()
            rejected = counted.first()[0] or 0
            least = min(least, time.perf_counter() - began)
        return least, rejected

    try:
        total = max(1, sample.count())
        nothing, _ = timed(F.col("copy") < 0)
        found = []
        for rule in rules:
            took, rejected = timed(rule.rejects)
            cost = max(took - nothing, LEAST_COST) / total
            found.append({"rule": rule, "cost_s": cost, "selectivity": rejected / total})
    finally:
        sample.unpersist()
    return sorted(found, key=lambda x: (-x["selectivity"] / x["cost_s"], x["rule"].name))


def apply_rules(measured: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds rejected_by: the name of the first rule, in the given order, that refuses the text, or null."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.rejects, F.lit(rule.name)).otherwise(verdict)
    return measured.withColumn("rejected_by", verdict)


def base_failed() -> Column:
    too_short = F.col("n_words") < MIN_WORDS
    return too_short | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def quality_rules(documents: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Counts, base verdict and cascade verdict for each document.

    The sample that orders the cascade is at most ``sample_rows`` texts of at most ``SAMPLE_BYTES`` bytes, thinned from
    the partitions that Spark reads first; it only sets the order.
    """
    rules = default_rules()
    short = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.octet_length("text") <= SAMPLE_BYTES)
    rows = short.sample(0.2, 11).take(sample_rows)  # reads one partition after another, and stops when it has enough
    sample = measure(documents.sparkSession.createDataFrame(rows, "doc_id long, text string"))
    ordered = [x["rule"] for x in plan_order(sample, rules)]
    judged = apply_rules(measure(documents.select("doc_id", "text")), ordered).withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS lines FROM d),
g AS (SELECT rid, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) > 2),
h AS (SELECT rid, i, struct_pack(a := words[i], b := words[i + 1], c := words[i + 2]) AS gram FROM g),
t AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM h) WHERE c > 1),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM t) GROUP BY rid),
m AS (SELECT w.doc_id, len(words) AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
             len(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, len(regexp_replace(text, '[^!]', '', 'g')) AS n_bang,
             len(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digit
      FROM w LEFT JOIN r ON r.rid = w.rid),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (10 * n_symbols > 3 * n_words OR 100 * n_upper > 40 * word_chars OR 10 * n_bang > 3 * n_words
         OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words
         OR 100 * n_digit > 30 * word_chars) AS kept
FROM b
"""
