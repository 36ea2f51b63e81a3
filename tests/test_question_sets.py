"""Question sets: replies, the pool, drawn pairs, and the way from chunks to a written set and back."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.operators import question_sets as qs
from docloom.sources import files

REPLIES = [
    ("## 问题\n营收是多少？\n\n### 标准答案\n  营收为一百二十亿元人民币。 ", ("营收是多少？", "营收为一百二十亿元人民币。")),
    ("\n##问题 \n What is it? \nmore\n### 标准答案 ten letters", ("What is it?", "ten letters")),
    ("skip: nothing to ask", None),
    ("## 问题\nabc\n### 标准答案\nten letters and more", None),
    ("## 问题\nabcd\n### 标准答案\nshort", None),
    ("words first\n## 问题\nabcd\n### 标准答案\nten letters and more", None),
    ("## 问题\nabcd without an answer\n", None),
    ("", None),
    (None, None),
]


def test_replies(spark):
    rows = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(REPLIES)], "i int, r string")
    got = {x.i: x.p and tuple(x.p) for x in rows.select("i", qs.parsed_reply(F.col("r")).alias("p")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(REPLIES)}


@pytest.fixture(scope="module")
def chunks(spark):
    long = "Figures of the year are told in whole sentences here. " * 4
    rows = [(f"{s}{i:03}", s, f"{s} {i} {long}") for s in "abcde" for i in range(12)]
    rows += [("a0001", "a", "short"), ("b0001", "b", None), (None, "b", long), ("x1", None, long), ("x2", "", long), ("c0001", "c", "画面 " + long)]
    return spark.createDataFrame(rows, "id string, source string, content string")


def plain_pool(rows, per_source):
    out = {}
    for s in sorted({r.source for r in rows if r.source}):
        own = sorted((r for r in rows if r.source == s and r.id is not None), key=lambda r: r.id)[: 2 * per_source]
        good = [r.id for r in own if r.content and len(r.content.strip()) >= 150 and "画面" not in r.content]
        out |= {(s, i): k for k, i in enumerate(good[:per_source])}
    return out


def test_pool_and_pairs(spark, chunks):
    pool = qs.candidate_pool(chunks, 4)
    want = plain_pool(chunks.collect(), 4)
    assert {(r.source, r.id): r.place for r in pool.collect()} == want
    pairs = qs.drawn_pairs(pool, 4000).collect()
    assert len(pairs) == 4000 and all(p.source_a != p.source_b for p in pairs)
    assert {(s, i) for p in pairs for s, i in ((p.source_a, p.id_a), (p.source_b, p.id_b))} == set(want)
    times = Counter((p.source_a, p.source_b) for p in pairs)
    assert len(times) == 20 and all(130 < n < 280 for n in times.values())
    assert qs.drawn_pairs(pool, 50).exceptAll(qs.drawn_pairs(pool.repartition(7), 50)).isEmpty()
    assert qs.drawn_pairs(pool.where("source = 'a'"), 50).isEmpty()


def test_set_is_written_and_read_back(spark, chunks, tmp_path):
    def form(q, a):
        return F.concat(F.lit("## 问题\n"), q, F.lit("\n### 标准答案\n"), a)

    def one(c):
        return form(F.concat(F.lit("What of "), F.substring(c, 1, 4), F.lit("?")), F.substring(c, 1, 30))

    def pair(s, c, t, d):
        return form(F.concat(F.lit("How do "), s, F.lit(" and "), t, F.lit(" differ?")), F.concat(c, d))

    def none(sources, k):
        return form(F.concat(F.lit("Beyond "), F.repeat(F.lit(" "), (k % 2).cast("int")), F.lit("it?")), sources)

    made = qs.question_set(chunks, one, pair, none, count=40, per_source=8).orderBy("number").collect()
    assert [q.number for q in made] == list(range(1, len(made) + 1))
    kinds = Counter(q.question_type for q in made)
    assert kinds["single_hop"] == 28 and kinds["negative"] == 1
    assert 1 <= kinds["multi_hop"] <= 8 and len({"".join(q.query.split()) for q in made}) == len(made)
    assert all(len(q.chunk_ids) == {"single_hop": 1, "multi_hop": 2, "negative": 0}[q.question_type] for q in made)
    refused = [q for q in made if q.question_type == "negative"][0]
    assert refused.expected_behavior == qs.REFUSAL and refused.answer == "\n".join(f"- {s}" for s in "abcde")
    frame = spark.createDataFrame(made).withColumn("meta", qs.question_meta(*[F.col(c) for c in ("related_docs", "chunk_ids", "question_type", "expected_behavior")]))
    files.write_questions(frame, str(tmp_path / "set"))
    text = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "set").glob("part-*")))
    back = files.parse_questions(text)
    assert [(b["number"], b["query"], b["meta"].get("问题类型"), b["meta"].get("证据chunk", "")) for b in back] == [
        (q.number, q.query, q.question_type, ", ".join(q.chunk_ids)) for q in made
    ]
    assert qs.question_set(chunks.where("source = 'z'"), one, pair, none).isEmpty()
