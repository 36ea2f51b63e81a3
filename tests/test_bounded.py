"""Searches whose room and rows are bounded: k best lists, tiles, relevant rows told instead of listed."""

import hashlib
import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from docloom.operators import ingest, retrieval, search
from docloom.operators.retrieval import Best


def test_best_keeps_the_first_of_all_tiles():
    rng = np.random.default_rng(3)
    scores, docs = rng.integers(0, 9, (11, 500)) / 8, rng.permutation(500)
    scores[4], scores[5, 7:] = -np.inf, -np.inf
    for k, width in ((1, 3), (7, 50), (40, 499), (600, 64)):
        kept = Best(np.arange(100, 111), k)
        for at in range(0, 500, width):
            for a, z in ((0, 6), (6, 11)):
                kept.add(a, scores[a:z, at : at + width], docs[at : at + width])
        got = sorted((q, -s, d) for f in kept.frames() for q, d, s in f.itertuples(index=False))
        want = [sorted((100 + q, -s, d) for s, d in zip(scores[q], docs, strict=True) if s > -np.inf)[:k] for q in range(11)]
        assert got == [x for rows in want for x in rows]


def test_best_needs_room_for_its_lists_only():
    rng, kept = np.random.default_rng(1), Best(np.arange(200), 10)
    tracemalloc.start()
    for at in range(0, 40_000, 400):
        kept.add(0, rng.random((200, 400)), np.arange(at, at + 400))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 << 20


def test_bm25_shuffles_the_best_rows_only(spark, monkeypatch):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(rng.choices("abcdefgh", k=9))) for i in range(900)], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(q, " ".join(rng.choices("abcdefgh", k=4))) for q in range(90)], "qid long, text string")
    monkeypatch.setattr(retrieval, "BATCH_TERMS", 100)  # several blocks, none of them a join of postings and queries
    found = retrieval.bm25(docs, asked, 4)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = retrieval.bm25_joined(docs, asked, 4)
    columns = ["qid", "pos", "doc_id", "score"]
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_relevant_rows_need_no_list(spark):
    lists = [spark.createDataFrame([(q, p, (q * s + p) % 12, 1 / p) for q in range(4) for p in range(1, 7)], "qid long, pos long, doc_id long, score double") for s in (1, 5)]
    pairs = spark.createDataFrame([(q, d) for q in range(4) for d in range(12) if (q + d) % 3 == 0], "qid long, doc_id long")
    told = search.Relevant(pairs.groupBy("qid").agg(F.count("*").alias("n")), lambda found: found.where("(qid + doc_id) % 3 = 0"))
    layers = {"a": search.Search(k=5, dense_only=True), "b": search.Search(k=5)}
    got, want = (sorted(map(tuple, search.evaluate_layers(*lists, r, None, layers).collect())) for r in (told, pairs))
    assert got == want and got


def test_simhashes_of_many_texts_at_once(monkeypatch):
    rng = random.Random(5)
    texts = ["", "a", "ab", "_", "A_b c", "中文", "😀a1", *["".join(rng.choices("abcdeé ,中", k=rng.randrange(400))) for _ in range(300)]]
    apart = [ingest.simhash(t) for t in texts]
    monkeypatch.setattr(ingest, "GRAMS", 90)
    assert ingest.simhashes(texts).tolist() == apart and ingest.simhash("") == 0 == ingest.simhash("_ ,")
    grams = ["abc", "bcd"]
    hashes = [int.from_bytes(hashlib.md5(g.encode()).digest()[:8], "big") for g in grams]
    want = sum(1 << k for k in range(64) if all(h >> k & 1 for h in hashes))
    assert ingest.simhash("A b,cd") & (1 << 64) - 1 == want


def test_frames_of_chunks_end_early():
    rows = [(i, 0, "x" * 40_000) for i in range(200)]
    frames = list(ingest._frames(iter(rows), ["doc_id", "ordinal", "content"]))
    assert len(frames) > 5 and [tuple(r) for f in frames for r in f.itertuples(index=False)] == rows


def test_paragraphs_of_many_texts_at_once():
    rng = random.Random(6)
    lines = ["".join(rng.choices("abcde ", k=60)) for _ in range(30)]
    texts = [None, "", "short", *["\n\n".join(rng.choices(lines, k=rng.randrange(9))) for _ in range(200)]]
    assert ingest._each_once(texts, 40, 3) == [None if t is None else ingest.paragraphs_once(t) for t in texts]
