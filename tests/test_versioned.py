"""Versioned tables and the manifest: whole switches, second writers, touched buckets, a literal sequence of versions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docloom.operators.manifest import Manifest, as_of, history
from docloom.sources.versioned import ConcurrentWrite, VersionedTable

SCHEMA = "k long, v string"


@pytest.fixture
def numbers(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA, ["k"], 8)
    t.upsert(spark.createDataFrame([(i, "a") for i in range(50)], SCHEMA))
    return t


def content(t, version=None):
    return {r.k: r.v for r in t.read(version).collect()}


def test_empty(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/none", SCHEMA, ["k"])
    assert t.read().collect() == [] and t.versions() == [] and t.vacuum() == 0
    assert t.delete(spark.createDataFrame([(1,)], "k long")) == (0, 0)


def test_upsert_delete_replace(spark, numbers):
    one = spark.createDataFrame([(1, "b"), (99, "b")], SCHEMA)
    before = numbers.manifest()
    assert numbers.upsert(one, note="x") == 2
    after = numbers.manifest()
    changed = {b for b in after["parts"] if after["parts"].get(b) != before["parts"].get(b)}
    assert len(changed) <= 2 and after["properties"] == {"note": "x"}  # other buckets keep their files
    assert content(numbers)[1] == "b" and content(numbers)[99] == "b" and len(content(numbers)) == 51
    assert content(numbers, 1) == dict.fromkeys(range(50), "a")
    assert numbers.delete(spark.createDataFrame([(1,), (2,), (500,)], "k long")) == (2, 3)
    assert not {1, 2} & content(numbers).keys()
    assert numbers.delete(spark.createDataFrame([(500,)], "k long")) == (0, 3)
    numbers.replace(spark.createDataFrame([(3,)], "k long"), spark.createDataFrame([(1, "c")], SCHEMA))
    assert 3 not in content(numbers) and content(numbers)[1] == "c"
    assert numbers.delete(numbers.read().select("k"))[0] == 49 and content(numbers) == {}


def test_a_reader_keeps_its_version_while_others_write(spark, numbers):
    reader = numbers.read()
    numbers.upsert(spark.createDataFrame([(i, "b") for i in range(50)], SCHEMA))
    assert {r.v for r in reader.collect()} == {"a"} and set(content(numbers).values()) == {"b"}


def test_second_writer_fails_and_changes_nothing(spark, numbers):
    base = numbers.manifest()
    numbers.upsert(spark.createDataFrame([(1, "first")], SCHEMA), base)
    with pytest.raises(ConcurrentWrite):
        numbers.upsert(spark.createDataFrame([(1, "second"), (2, "second")], SCHEMA), base)
    assert content(numbers)[1] == "first" and content(numbers)[2] == "a" and numbers.versions() == [1, 2]
    assert numbers.upsert(spark.createDataFrame([(2, "second")], SCHEMA)) == 3


def test_a_failed_change_leaves_the_old_rows(spark, numbers):
    fails = F.udf(lambda v: 1 // 0, "string")
    with pytest.raises(Exception, match="ZeroDivision|division"):
        numbers.change(spark.createDataFrame([(1,)], "k long"), lambda old: old.withColumn("v", fails("v")))
    assert content(numbers) == dict.fromkeys(range(50), "a") and numbers.versions() == [1]
    with pytest.raises(ValueError, match="did not touch"):
        numbers.change(spark.createDataFrame([(1,)], "k long"), lambda old: old.unionByName(spark.createDataFrame([(i, "z") for i in range(100, 140)], SCHEMA)))
    assert numbers.versions() == [1]


def test_vacuum(spark, numbers):
    for v in "bcd":
        numbers.upsert(spark.createDataFrame([(1, v)], SCHEMA))
    assert numbers.vacuum(keep=1) == 3 and numbers.versions() == [4]
    assert content(numbers)[1] == "d" and len(content(numbers)) == 50


def at(hour):
    return dt.datetime(2024, 5, 1, hour)


def test_manifest_of_a_literal_sequence(spark, tmp_path):
    m = Manifest(spark, str(tmp_path / "m"), 4)

    def put(*rows):
        return m.register(spark.createDataFrame(rows, "source string, version string, digest string, at timestamp"))

    def state(source):
        rows = m.versions.read().where(F.col("source") == source).orderBy("valid_from").collect()
        return [(r.version, r.valid_from.hour, r.valid_to and r.valid_to.hour, r.is_current, r.status) for r in rows]

    put(("a", "v1", "d1", at(1)), ("b", "v1", "e1", at(1)))
    put(("a", "v3", "d3", at(5)))
    assert state("a") == [("v1", 1, 5, False, "superseded"), ("v3", 5, None, True, "current")]
    put(("a", "v2", "d2", at(3)))  # late
    assert state("a") == [("v1", 1, 3, False, "superseded"), ("v2", 3, 5, False, "superseded"), ("v3", 5, None, True, "current")]
    put(("a", "v3", "d3", at(9)))  # again
    assert state("a")[-1] == ("v3", 5, None, True, "current") and state("b") == [("v1", 1, None, True, "current")]
    chunk = "source string, version string, chunk_no long, content string"
    m.replace_chunks(spark.createDataFrame([("a", "v3", i, f"old {i}") for i in range(5)] + [("b", "v1", 0, "b")], chunk))
    m.replace_chunks(spark.createDataFrame([("a", "v3", 0, "new")], chunk))
    assert sorted(r.content for r in m.shown_chunks().collect()) == ["b", "new"]
    m.set_status(spark.createDataFrame([("b", "v1")], "source string, version string"), "failed", "no text")
    assert state("b") == [("v1", 1, None, False, "failed")] and [r.source for r in m.shown().collect()] == ["a"]
    assert m.soft_delete(spark.createDataFrame([("a",), ("zz",)], "source string"))[0] == 1
    assert m.shown().collect() == [] and m.soft_delete(spark.createDataFrame([("a",)], "source string"))[0] == 0
    put(("a", "v4", "d3", at(12)))
    assert [r.version for r in m.shown().collect()] == ["v4"]
    with pytest.raises(ValueError):
        m.set_status(spark.createDataFrame([("b", "v1")], "source string, version string"), "unknown")


def test_history_has_one_current_version_each(spark):
    rows = [("a", 1, "x", at(1)), ("a", 2, "x", at(2)), ("a", 3, "y", at(3)), ("a", 4, "x", at(3)), ("b", 1, None, at(1)), ("b", 2, None, at(2))]
    h = history(spark.createDataFrame(rows, "source string, version int, digest string, at timestamp"))
    assert sorted((r.source, r.version, r.is_current) for r in h.collect()) == [("a", 1, False), ("a", 3, False), ("a", 4, True), ("b", 1, True)]
    moments = spark.createDataFrame([("a", at(2)), ("a", at(3)), ("a", at(0)), ("b", at(9))], "source string, at timestamp")
    assert sorted((r.source, r.version) for r in as_of(h, moments).collect()) == [("a", 1), ("a", 4), ("b", 1)]
