"""Ingestion with state and object events: copies within and across batches, restarts, late, repeated and disordered events."""

import datetime as dt
import random

import pytest

from docloom.operators.ingest import paragraphs_once, simhash, without_repeated_paragraphs
from docloom.sources.versioned import VersionedTable
from docloom.streaming.events import INDEX, apply_batch, stream_events, visible
from docloom.streaming.ingest import accepted, stream_documents

DOCS = "doc_id long, text string"


def text(seed, words=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(words))


def near(a, b):
    return ((simhash(a) ^ simhash(b)) & (1 << 64) - 1).bit_count() <= 3


@pytest.fixture(scope="module")
def base_and_copy():
    """A text and another one that differs a little."""
    base = text(1, 400)
    return base, next(c for i in range(50) if near(base, c := base + f" x{i}") and simhash(c) != simhash(base))


def test_copies_within_and_across_batches_and_restarts(spark, tmp_path, base_and_copy):
    base, copy = base_and_copy
    where = [f"{tmp_path}/{x}" for x in ("out", "dead", "cp")]
    batches = [
        [(5, base), (7, base), (1, text(2)), (None, "b"), (2, "")],
        [(3, copy), (8, text(2)), (9, text(3))],
        [(4, base), (10, text(4)), (11, text(4)), (12, None)],
    ]
    for i, rows in enumerate(batches):  # a new query for each, from the checkpoint of the one before
        spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
        stream_documents(spark, f"{tmp_path}/in/*", DOCS, *where).awaitTermination()
        stream_documents(spark, f"{tmp_path}/in/*", DOCS, *where).awaitTermination()  # nothing new
    assert sorted(r.doc_id for r in accepted(spark, where[0]).collect()) == [1, 5, 9, 10]
    said = {r.doc_id: r.near for r in spark.read.parquet(f"{where[0]}/near").collect()}
    assert said == {5: None, 7: 5, 1: None, 3: 5, 8: 1, 9: None, 4: 3, 10: None, 11: 10}
    assert sorted(r.error for r in spark.read.parquet(where[1]).collect()) == ["no id", "no text", "no text"]


def test_exact_copies_only(spark, tmp_path, base_and_copy):
    base, copy = base_and_copy
    spark.createDataFrame([(1, base), (2, copy), (3, base)], DOCS).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream_documents(spark, f"{tmp_path}/in", DOCS, f"{tmp_path}/o", f"{tmp_path}/d", f"{tmp_path}/c", distance=0).awaitTermination()
    assert sorted(r.doc_id for r in accepted(spark, f"{tmp_path}/o").collect()) == [1, 2]


def at(minute):
    return dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=minute)


EVENTS = "event_id string, object string, kind string, digest string, at timestamp, seq long"


def test_events_late_twice_and_out_of_order(spark, tmp_path):
    index = VersionedTable(spark, f"{tmp_path}/index", INDEX, ["object"], 4)
    batches = [
        [("e1", "a", "ObjectCreated:Put", "d1", at(0), 1), ("e2", "b", "ObjectCreated:Put", "d1", at(1), 1), ("e9", "c", "ObjectAccessed:Get", "", at(1), 1)],
        [("e3", "a", "ObjectRemoved:Delete", "", at(30), 2), ("e3", "a", "ObjectRemoved:Delete", "", at(30), 2), ("e5", "b", "ObjectCreated:Put", "d3", at(40), 3)],
        [("e4", "b", "ObjectRemoved:Delete", "", at(20), 2), ("e1", "a", "ObjectCreated:Put", "d1", at(0), 1), ("e8", "d", "ObjectRemoved:Delete", "", at(41), 2)],
        [("e6", "z", "ObjectCreated:Put", "d1", at(600), 1), ("e7", "d", "ObjectCreated:Put", "d0", at(39), 1)],
        [("e10", "y", "ObjectCreated:Put", "late", at(2), 1), ("e11", "a", "ObjectCreated:Put", "d9", at(601), 4)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        events = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in/*")
        stream_events(events, index, f"{tmp_path}/cp").awaitTermination()
        rows = {r.object: (r.digest, r.is_deleted) for r in index.read().collect()}
        if i == 1:
            assert rows == {"a": ("d1", True), "b": ("d3", False)}
        if i == 2:  # an older removal and a repeated creation change nothing
            assert rows == {"a": ("d1", True), "b": ("d3", False), "d": ("", True)}
    assert rows == {"a": ("d9", False), "b": ("d3", False), "d": ("", True), "z": ("d1", False)}  # y came beyond the watermark
    assert sorted(r.object for r in visible(index.read()).collect()) == ["a", "b", "z"]


def test_a_batch_is_applied_once(spark, tmp_path):
    index = VersionedTable(spark, f"{tmp_path}/index", INDEX, ["object"], 4)
    one = spark.createDataFrame([("e1", "a", "created", "d1", at(0), 1)], EVENTS)
    assert apply_batch(index, one, 0) == 1 and apply_batch(index, one, 0) == 1
    assert apply_batch(index, spark.createDataFrame([("e2", "a", "removed", "", at(1), 2)], EVENTS), 1) == 2
    assert [(r.digest, r.is_deleted) for r in index.read().collect()] == [("d1", True)]


def plain_once(text, least=40):
    kept, seen = [], []
    for p in __import__("re").split(r"\n\s*\n+", text):
        if len(p.strip()) >= least:
            h = simhash(p) & (1 << 64) - 1
            if any((h ^ s).bit_count() <= 3 for s in seen):
                continue
            seen.append(h)
        kept.append(p)
    return "\n\n".join(kept)


def test_paragraphs_once(spark):
    rng = random.Random(2)
    texts = []
    for i in range(30):
        pool = [text(100 + i * 10 + k, 25) for k in range(4)]
        parts = [rng.choice(pool) + rng.choice(["", " x", " " + text(rng.random(), 1)]) for _ in range(12)] + ["short", "short"]
        texts.append(rng.choice(["\n\n", "\n \n\n"]).join(parts))
    texts += ["", "\n\n", None]
    got = without_repeated_paragraphs(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS)).orderBy("doc_id").collect()
    assert [r.text for r in got] == [None if t is None else plain_once(t) for t in texts]
    assert sum(len(r.text or "") for r in got) < sum(len(t or "") for t in texts)
    with pytest.raises(ValueError):
        paragraphs_once("a", distance=4)
