"""The text index, pages of chunks, drawn pairs and ordered fingerprints against brute force."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.operators import pages, retrieval, sampling, text_index
from docloom.operators.retrieval import bm25, ranked, tokens
from docloom.operators.tables import page_of


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(120)], k=rng.randrange(0, 60)))) for i in range(400)]
    asked = [(q, " ".join(rng.choices(words, k=6))) for q in range(25)] + [(99, "nothing of this"), (98, ""), (97, "w0 w0 w1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame(asked, "qid long, text string")


def token_rows(docs, queries):
    t = docs.select("doc_id", tokens(F.col("text")).alias("t"))
    return t, queries.select("qid", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))


@pytest.mark.parametrize("block, seeds", [(8, 1), (64, 4), (1000, 1)])
def test_text_index_is_exact(spark, corpus, tmp_path, monkeypatch, block, seeds):
    monkeypatch.setattr(text_index, "BLOCK", block)
    monkeypatch.setattr(text_index, "SEEDS", seeds)
    t, terms = token_rows(*corpus)
    want = sorted(map(tuple, bm25(*corpus, 5).select("qid", "pos", "doc_id", "score").collect()))
    stored = text_index.build(t).store(str(tmp_path / "index"))
    for index in (stored, text_index.TextIndex.load(spark, str(tmp_path / "index")), text_index.build(t, terms)):
        got = ranked(text_index.search(index, terms, 5), 5).select("qid", "pos", "doc_id", "score")
        assert sorted(map(tuple, got.collect())) == want
    if block == 8:  # some blocks are never scored
        scored = text_index.search(stored, terms, 5).count()
        assert scored < bm25(*corpus, 400).count()
    with pytest.raises(ValueError):
        text_index.TextIndex.load(spark, str(tmp_path / "none"))


def test_text_index_of_nothing(spark, corpus):
    t, terms = token_rows(*corpus)
    assert text_index.search(text_index.build(t.where("false")), terms, 5).collect() == []
    assert text_index.search(text_index.build(t), terms.where("false"), 5).collect() == []


def test_pages_equal_the_plain_comparison(spark):
    rng = random.Random(6)
    chunks, blocks, want = [], [], {}
    for d in range(40):
        texts = ["".join(rng.choice("abc ") for _ in range(rng.choice([0, 3, 5, 6, 7, 8, 12, 30, 90]))) for _ in range(25)]
        own = [(t, 1 + i // 4) for i, t in enumerate(texts)]
        blocks += [(d, i, p, t) for i, (t, p) in enumerate(own)]
        for c in range(12):
            at = rng.randrange(25)
            text = rng.choice(["", "zz ", texts[at][3:]]) + " ".join(texts[at : at + rng.randrange(4)]) + rng.choice(["", "q"])
            text = rng.choice([text, texts[at][: rng.randrange(1, 20)], "  ".join(text)])
            chunks.append((d, c, text))
            want[d, c] = page_of(text, own)
    blocks.append((0, 999, 5, None))
    got = pages.attribute_pages(spark.createDataFrame(chunks, "doc_id long, chunk_no long, content string"), spark.createDataFrame(blocks, "doc_id long, block_no long, page int, text string"))
    assert {(r.doc_id, r.chunk_no): (r.first_page, r.last_page) for r in got.collect()} == want
    assert sum(p != (0, 0) for p in want.values()) > 100 and any(a != b for a, b in want.values())


def test_every_pair_of_sources_can_be_drawn(spark):
    rows = [(i, s) for i, s in enumerate("aaaaaabbbccd")] + [(100, None), (None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    source = dict(rows)
    every = {frozenset((i, j)) for i in range(12) for j in range(12) if source[i] != source[j]}
    drawn = Counter()
    for seed in range(12):
        got = [frozenset((r.doc_id, r.other)) for r in sampling.cross_source_pairs(docs, 60, seed).collect()]
        assert len(got) == len(set(got)) and set(got) <= every
        drawn.update(got)
    assert set(drawn) == every  # none is out of reach
    share = 1 - (1 - 1 / len(every)) ** 60
    assert max(drawn.values()) <= 12 and abs(sum(drawn.values()) / len(every) / 12 - share) < 0.05
    assert sampling.cross_source_pairs(docs.where("source = 'a'"), 10).collect() == []


def plain_pairs(n, whole, seed):
    import hashlib

    return {int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:15], 16) % whole for i in range(n)}


def test_ranks_are_spread_evenly():
    counts = Counter(r * 10 // 1000 for r in (plain_pairs(5000, 10**9, 1)) for r in [r // 10**6])
    assert len(counts) == 10 and max(abs(c - 500) for c in counts.values()) < 5 * math.sqrt(500)


def test_fingerprint_depends_on_rows_and_keys_only(spark):
    rows = [(i * 7, f"row {i}") for i in range(300)]

    def of(rows, chunk=10, parts=1):
        frame = spark.createDataFrame(rows, "k long, v string").repartition(parts)
        return tuple(sampling.ordered_fingerprint(frame, "k", F.concat_ws("|", "k", "v"), chunk).first())

    first = of(rows)
    assert first[0] == 300 and first == of(random.Random(1).sample(rows, 300), parts=7)
    assert first != of([*rows[:-1], (rows[-1][0], "other")]) and first != of(rows[1:]) and first != of([(rows[0][0], rows[1][1]), (rows[1][0], rows[0][1]), *rows[2:]])
    assert of([])[0] == 0 and of([(-5, "a"), (5, "b")]) != of([(5, "a"), (-5, "b")])


@pytest.mark.parametrize("name, value", [("SCORED_DOCS", 7), ("BATCH_TERMS", 3), ("SCORED_DOCS", 512)])
def test_both_ways_of_bm25_agree(spark, corpus, monkeypatch, name, value):
    docs, asked = corpus
    monkeypatch.setattr(retrieval, name, value)
    docs = docs.union(spark.createDataFrame([(1000, None), (1001, ""), (1002, "w0 " * 2000)], docs.schema)).repartition(3)
    for k in (1, 5, 500):
        got, want = (sorted(map(tuple, f(docs, asked, k).select("qid", "pos", "doc_id", "score").collect())) for f in (bm25, retrieval.bm25_joined))
        assert got == want and got
    none = bm25(docs.where("false"), asked, 5), bm25(docs, asked.where("false"), 5)
    assert [x.collect() for x in none] == [[], []]
