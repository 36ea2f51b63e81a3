"""Wordings of a question: what a model's rewriting says, and further queries made of keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import let, stripped
from docloom.plans.registry import query
from docloom.session import table

MOST_SUB_QUERIES = 3
#: How lines of a rewriting begin, or what they hold. Fixed values.
KEYWORD_LABELS = ["关键词", "关键字"]
REWRITE_LABELS = ["改写查询", "改写"]
SUB_QUERY_LABEL = "子查询"


def sub_queries(question: Column, keywords: Column) -> Column:
    """At most three queries of two neighbouring keywords each, the last with the first; the question with less than two."""

    def pair(i: Column) -> Column:
        return F.concat(F.get(keywords, i), F.coalesce(F.get(keywords, i + 1), F.get(keywords, F.lit(0))))

    upto = F.least(F.size(keywords), F.lit(MOST_SUB_QUERIES)) - 1
    return F.when(F.size(keywords) >= 2, F.transform(F.sequence(F.lit(0), upto), pair)).otherwise(F.array(question))


def parse_rewrite(raw: Column, question: Column, fallback: Column) -> Column:
    """rewritten, keywords, sub_queries from the lines of a model's answer.

    A line that begins with a keyword label gives the keywords, separated by commas; of others, one that holds a rewriting
    label gives the question, and one that holds that of sub-queries one of these. What stands behind the first colon
    counts; the last line of a kind wins, sub-queries are gathered. Without keywords the fallback's are taken, without
    sub-queries they are made of the keywords.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), "\n"), stripped), lambda x: x != "")

    def value(x: Column) -> Column:
        return stripped(F.regexp_replace(F.regexp_replace(x, "^[^：]*：", ""), "^[^:]*:", ""))

    def any_of(x: Column, words: list[str]) -> Column:
        found = F.lit(False)
        for w in words:
            found = found | F.contains(x, F.lit(w))
        return found

    def keyword_line(x: Column) -> Column:
        return x.rlike("^(?:" + "|".join(KEYWORD_LABELS) + ")")

    def rewrite_line(x: Column) -> Column:
        return ~keyword_line(x) & any_of(x, REWRITE_LABELS) & (value(x) != "")

    def sub_line(x: Column) -> Column:
        return ~keyword_line(x) & ~any_of(x, REWRITE_LABELS) & any_of(x, [SUB_QUERY_LABEL]) & (value(x) != "")

    def last(found: Column) -> Column:
        return F.when(F.size(found) > 0, F.element_at(found, -1))

    def parsed(ls: Column) -> Column:
        listed = F.split(value(last(F.filter(ls, keyword_line))), ",")
        own = F.filter(F.transform(listed, stripped), lambda x: x != "")
        keywords = F.when(F.coalesce(F.size(own), F.lit(0)) > 0, own).otherwise(fallback)
        rewritten = F.coalesce(value(last(F.filter(ls, rewrite_line))), question)
        subs = F.transform(F.filter(ls, sub_line), value)
        return F.struct(rewritten.alias("rewritten"), keywords.alias("keywords"), F.when(F.size(subs) > 0, subs).otherwise(sub_queries(rewritten, keywords)).alias("sub_queries"))

    return let(lines, parsed)


_TURN = r"SELECT conv_id, turn, text, list_filter(regexp_split_to_array(coalesce(text, ''), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w, (conv_id + turn) % 4 AS k FROM conversations"


@query(
    "rewritten_questions",
    rf"""WITH t AS ({_TURN}), u AS (SELECT * FROM t WHERE len(w) >= 4),
p AS (SELECT conv_id, turn, CASE WHEN k <> 1 THEN w[1] || ' ' || w[3] ELSE w[1] END AS rewritten, CASE WHEN k = 2 THEN list_slice(w, 2, 4) ELSE [w[1], w[2]] END AS kw, CASE WHEN k = 0 THEN [w[4], w[2] || ':' || w[3]] END AS subs, w FROM u)
SELECT conv_id, turn, rewritten, array_to_string(kw, '|') AS keywords,
 array_to_string(coalesce(subs, CASE WHEN len(kw) = 3 THEN [kw[1] || kw[2], kw[2] || kw[3], kw[3] || kw[1]] ELSE [kw[1] || kw[2], kw[2] || kw[1]] END), '|') AS sub_queries FROM p""",
)
def q_rewritten(spark, sf_dir):
    """Turns of conversations and answers of a model made of their words: complete ones, ones without a rewriting, without keywords, and without sub-queries."""
    w, k = F.col("w"), F.col("k")
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N}]+"), "").alias("w"), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4)).alias("k")
    )

    def at(i: int) -> Column:
        return F.get(w, F.lit(i))

    raw = F.concat_ws(
        "\n",
        F.when(k != 2, F.concat(F.lit("关键词： "), at(0), F.lit(", "), at(1), F.lit(","))),
        F.when(k != 1, F.concat(F.lit("改写查询: "), at(0), F.lit(" "), at(2))),
        F.when(k == 0, F.concat(F.lit("\n子查询1："), at(3), F.lit("\n  子查询2："), F.lit("a:"), at(1), F.lit(":"), at(2))),
        F.lit("其他"),
    )
    made = turns.where(F.size("w") >= 4).select("conv_id", "turn", parse_rewrite(raw, at(0), F.slice(w, 2, 3)).alias("p"))
    return made.select("conv_id", "turn", F.col("p.rewritten").alias("rewritten"), *[F.array_join(f"p.{c}", "|").alias(c) for c in ("keywords", "sub_queries")])
