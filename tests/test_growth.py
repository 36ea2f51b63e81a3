"""Steps whose cost is to grow with the input and no faster."""

import random

from pyspark.sql import functions as F

from docloom.operators import evaluation, ingest, pages, retrieval, table_store, text_index
from docloom.operators.tables import page_of


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_near_fingerprints_are_paired_once(spark, tmp_path):
    rng = random.Random(8)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    found = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for s in seeds for _ in range(40)}
    rows = [(i, h - (1 << 64) if h >> 63 else h) for i, h in enumerate(found)]
    links = ingest.hamming_links(spark.createDataFrame(rows, "doc_id long, simhash long"))
    want = [(i, j) for i, a in enumerate(found) for j, b in enumerate(found) if i < j and (a ^ b).bit_count() <= 3]
    assert sorted((r.id_a, r.id_b) for r in links.collect()) == sorted(want) and len(want) > 500
    assert plan(links).lstrip().startswith("Project")  # pairs are not gathered again to tell them apart
    spark.createDataFrame([(i, f"text {i % 3}") for i in range(9)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    pairs = ingest.q_near_pairs(spark, str(tmp_path))
    assert "Python" not in plan(pairs) and pairs.where(F.col("same")).count() == 9  # fingerprints are made once


def test_pages_of_blocks_around_every_tier(spark):
    rng = random.Random(9)
    blocks, chunks, want = [], [], {}
    for d in range(30):
        texts = ["".join(rng.choices("ab c😀é\n", k=rng.choice([4, 5, 7, 8, 9, 34, 35, 36, 39, 40, 41, 48, 300]))) for _ in range(20)]
        whole = "".join(texts)
        blocks += [(d, i, 1 + i // 3, t) for i, t in enumerate(texts)]
        for n in range(15):
            at = rng.randrange(len(whole))
            c = rng.choice([whole[at : at + rng.randrange(200)], rng.choice(texts)[: rng.randrange(60)], rng.choice(texts) + "z" * rng.randrange(3)])
            chunks.append((d, n, c))
            want[d, n] = page_of(c, [(t, 1 + i // 3) for i, t in enumerate(texts)])
    c = spark.createDataFrame(chunks, "doc_id long, chunk_no long, content string")
    got = pages.attribute_pages(c, spark.createDataFrame(blocks, "doc_id long, block_no long, page int, text string"))
    assert {(r.doc_id, r.chunk_no): (r.first_page, r.last_page) for r in got.collect()} == want and len(set(want.values())) > 12
    assert "regexp_replace" not in plan(got)  # texts lose their white space once, not for each join


def disk(spark):
    """Bytes that the stages so far have shuffled, spilled and written."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(x.shuffleWriteBytes() + x.diskBytesSpilled() + x.outputBytes() for x in (stages.apply(i) for i in range(stages.size())))


def test_pages_of_chunks_put_each_text_on_disk_once(spark):
    rng = random.Random(10)
    lines = [(d, n, 1 + n // 3, "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=60))) for d in range(40) for n in range(300)]
    whole = {d: "".join(x[3] for x in lines[300 * d : 300 * d + 300]) for d in range(40)}
    cut = [(d, n, t[600 * n : 600 * n + 600]) for d, t in whole.items() for n in range(30)]
    chunks = spark.createDataFrame(cut, "doc_id long, chunk_no long, content string")
    blocks = spark.createDataFrame(lines, "doc_id long, block_no long, page int, text string")

    before, small = disk(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
    try:
        got = pages.attribute_pages(chunks, blocks).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert sorted(map(tuple, got)) == [(d, n, 1 + 10 * n // 3, 1 + (10 * n + 9) // 3) for d, n, _ in cut]
    assert disk(spark) - before < 3.5 * sum(map(len, whole.values()))  # as chunks, as blocks and what rows need besides


def test_pages_of_rows_without_keys_and_of_equal_keys(spark):
    line, other = "a line of some words", "another line of more words"
    chunks = [(1, 0, line), (1, 0, other), (1, 1, line), (None, 0, line), (2, 0, line), (3, 0, None)]
    blocks = [(1, 0, 4, line), (1, 1, 5, other), (1, 2, 6, line), (None, 0, 7, line), (1, None, 9, line), (3, 0, 8, line), (4, 0, None, line)]
    got = pages.attribute_pages(spark.createDataFrame(chunks, "doc_id int, chunk_no int, content string"), spark.createDataFrame(blocks, "doc_id long, block_no int, page int, text string"))
    want = [(1, 0, 4, 6), (1, 0, 4, 6), (1, 1, 4, 6), (None, 0, 0, 0), (2, 0, 0, 0), (3, 0, 0, 0)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and got.columns == ["doc_id", "chunk_no", "first_page", "last_page"]


def test_diagnostics_search_once(spark, tmp_path):
    texts = [(i, f"common words of text {i % 5} here", "s", "en") for i in range(30)]
    spark.createDataFrame(texts, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "common words of text 3 here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = evaluation.q_diagnostics(spark, str(tmp_path))
    assert "MapInPandas" not in plan(found)  # the pool is scored before, not for each of its three uses
    row = found.first()
    assert (row.evidence, row.exact_hit, row.pool_hit, row.slots) == (6, 5, 6, 5)


def test_index_search_makes_no_rows_of_queries_and_documents(spark, monkeypatch):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, rng.choices("abcdefgh", k=9)) for i in range(300)], "doc_id long, t array<string>").repartition(3)
    terms = spark.createDataFrame([(q, w) for q in range(40) for w in rng.sample("abcdefghz", 3)], "qid long, term string")
    index = text_index.build(docs, terms)
    found = text_index.search(index, terms, 4)
    assert "Generate explode(docs" not in plan(found)
    assert found.count() <= 40 * 4 * spark.sparkContext.defaultParallelism * 4
    whole = sorted(map(tuple, retrieval.ranked(found, 4).select("qid", "pos", "doc_id", "score").collect()))
    monkeypatch.setattr(text_index, "BATCH_TERMS", 50)  # several batches of queries
    monkeypatch.setattr(text_index, "TILE", 640)  # some queries at a time
    again = retrieval.ranked(text_index.search(index, terms, 4), 4)
    assert whole == sorted(map(tuple, again.select("qid", "pos", "doc_id", "score").collect())) and len(whole) == 160


def test_sections_of_orders_are_written_behind_the_shuffle(spark, tmp_path):
    lines = [(o, n, 7 * o + n, "A", "F") for o in range(1, 7) for n in (2, 1, 3)]
    rows = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_returnflag string, l_linestatus string")
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    made = table_store._sections(spark, str(tmp_path))
    below = plan(made).split("Aggregate", 1)[1].split("\n", 1)[1]
    assert "<tr" not in below and "| " not in below  # only keys and plain values are gathered
    got = {(r.parent_id, r.place): r.payload for r in table_store.stored_tables(made).collect()}
    assert len(got) == 8 and got[1, 0] == [["no", "by", "state"], ["1", "8", "A & F"], ["2", "9", "A & F"], ["3", "10", "A & F"]]
    assert got[3, 0][:3] == [["Lines"], ["no", "by", "state"], ["1", "22", "A & F"]] and got[5, 0][1:] == got[5, 1][2:]
