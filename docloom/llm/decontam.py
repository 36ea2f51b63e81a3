"""Benchmark decontamination against a broadcast hash set of normalised test n-grams.

A text's words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. Each benchmark item gives its
windows of 13 consecutive words, or one window of all its words when it has fewer. They are written to the shared folder
once. Two hash sets of the windows, with their lengths hashed in, go to all tasks, as bits in an array of longs that a
scalar subquery makes, so the scan of the training text is local to a row:

1. Anchors. A window of L words always holds an anchor, an aligned run of q words that starts at a multiple of
   L - q + 1. Only these are hashed and looked up; a text without a known anchor holds no window.
2. Windows. Texts with an anchor have all their windows hashed and looked up in the set of window hashes.
3. Verification. The windows found are compared word by word, by a join with the window table, which also names the
   items. One aggregation by document then counts hit words and items.

The sets have sixteen bits or more for each hash and at most ``MOST_BITS`` (32 MB). Beyond that they let more windows
through to the join, which decides in any case; the plan is the same at every size. The join is Spark's choice: the
window table is broadcast where its bytes are below ``spark.sql.autoBroadcastJoinThreshold`` or adaptive execution
finds them so, and shuffled with the windows found, not with all windows, otherwise.

Edge cases: null texts have no words, hits or items and are not contaminated; items without words match nothing;
items without an id still mark words as hit but are not counted in n_items; two rows with the same id are judged
separately, and equal rows give equal results, one for each; an empty benchmark leaves everything clean; an empty
documents table gives an empty result. Other columns of either table are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import let, lower_ascii, stored, table

WINDOW = 13
ANCHOR = 5
MOST_BITS = 1 << 28
RUN = 1024
HIT_SHARE = 20  # contaminated when 20 times the hit words reach the number of words
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ngram_words(lowered: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), SPLIT), "")


def hash_at(words: Column, i: Column, length: int, of: int) -> Column:
    """Hash of the ``length`` words from place i on, which stand for windows of ``of`` words."""
    return F.xxhash64(F.lit(of), *[F.get(words, i + k) for k in range(length)])


def starts(words: Column, length: int, step: int = 1) -> Column:
    """Start positions of windows of ``length`` words, each ``step``-th."""
    none = F.array().cast("array<int>")
    return F.when(F.size(words) >= length, F.sequence(F.lit(0), F.size(words) - length, F.lit(step))).otherwise(none)


def anchor_of(length: int) -> tuple[int, int]:
    """Words of an anchor and the distance of aligned anchors, for windows of ``length`` words."""
    q = min(ANCHOR, length)
    return q, length - q + 1


def item_windows(benchmark: DataFrame) -> DataFrame:
    """gram, len, items: the distinct windows of all items with the ids of the items that hold them."""
    words = benchmark.select("item_id", ngram_words(lower_ascii(F.col("text"))).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(WINDOW))
    grams = F.transform(
        F.sequence(F.lit(0), F.size("w") - length), lambda i: F.concat_ws(" ", F.slice(F.col("w"), i + 1, length))
    )
    return (
        words.select("item_id", length.alias("len"), F.explode(grams).alias("gram"))
        .groupBy("gram", "len")
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )


def hashes_of(windows: DataFrame, lengths: list[int], anchors: bool) -> DataFrame:
    """h: the hashes of the windows, or of the runs of their words that an aligned anchor in a text can hold."""
    found = F.array().cast("array<bigint>")
    for n in lengths:
        q, step = anchor_of(n) if anchors else (n, 1)
        own = F.array(*[hash_at(F.col("w"), F.lit(i), q, n) for i in range(step)])
        found = F.when(F.col("len") == n, own).otherwise(found)
    return windows.select("len", F.split("gram", " ").alias("w")).select(F.explode(found).alias("h"))


def hash_set(hashes: DataFrame, n: int) -> tuple[Column, int]:
    """The hashes (h, about n of them) as bits of an array of longs, by a scalar subquery, and the number of its bits.

    The bits are gathered by runs of ``RUN`` longs, each in a group of its own; one task then only strings at most 4,096 of
    these together.
    """
    bits = min(MOST_BITS, max(1 << 12, 1 << (16 * n).bit_length()))
    spark = hashes.sparkSession
    place = F.pmod("h", F.lit(bits))
    words = hashes.select((place / 64).cast("long").alias("i"), (place % 64).cast("int").alias("bit")).distinct()
    words = words.groupBy("i").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("v"))
    every = spark.range(bits // 64).join(words, F.col("id") == F.col("i"), "left").select("id", F.coalesce("v", F.lit(0)).alias("v"))
    runs = every.groupBy(F.floor(F.col("id") / RUN).alias("run")).agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("own"))
    runs = runs.select("run", F.transform("own", lambda x: x["v"]).alias("own"))
    rows = runs.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("run", "own"))), lambda x: x["own"])).alias("bits"))
    return rows.scalar(), bits


def in_set(value: Column, words: Column, bits: int) -> Column:
    place = F.pmod(value, F.lit(bits))
    return F.getbit(F.get(words, F.shiftright(place, 6).cast("int")), (place % 64).cast("int")) == 1


def window_hits(documents: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, fp, n_words, k, hit: one row for each window found in a document, and one with a null hit without any."""
    grams = windows.select("gram", "len")
    times = dict(sorted(map(tuple, grams.groupBy("len").count().collect())))  # at most WINDOW lengths
    sets: list[Column] = []  # a subquery can't stand inside a lambda function, so each set is a column first
    known: list[tuple[Column, int]] = []
    for k, anchors in enumerate((True, False) if times else ()):
        made = hash_set(hashes_of(grams, [*times], anchors), sum(t * (anchor_of(n)[1] if anchors else 1) for n, t in times.items()))
        sets.append(made[0].alias(f"_set{k}"))
        known.append((F.col(f"_set{k}"), made[1]))
    base = documents.select(
        "doc_id", F.xxhash64("text").alias("fp"), ngram_words(lower_ascii(F.col("text"))).alias("_w"), *sets
    )

    def near(w: Column) -> Column:
        """Whether an aligned anchor of the text is known."""
        found = F.lit(False)
        for n in times:
            q, step = anchor_of(n)
            found = found | F.exists(starts(w, q, step), lambda i: in_set(hash_at(w, i, q, n), *known[0]))
        return found

    none = F.array().cast("array<struct<pos:int,len:int,gram:string>>")

    def hits(w: Column) -> Column:
        parts = [none]
        for n in times:
            at = F.filter(starts(w, n), lambda i: in_set(hash_at(w, i, n, n), *known[1]))
            parts.append(
                F.transform(
                    at,
                    lambda i: F.struct(
                        i.alias("pos"), F.lit(n).alias("len"), F.concat_ws(" ", F.slice(w, i + 1, n)).alias("gram")
                    ),
                )
            )
        return F.concat(*parts)

    scanned = let(
        F.col("_w"),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.when(near(w), hits(w)).otherwise(none).alias("hits"),
        ),
    )
    return base.select("doc_id", "fp", scanned.alias("s")).select(
        "doc_id", "fp", F.col("s.n_words").alias("n_words"), F.posexplode_outer("s.hits").alias("k", "hit")
    )


def covered_words(hits: Column) -> Column:
    """Words inside any of the (pos, len) intervals."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def add(a: Column, h: Column) -> Column:
        end = h["pos"] + h["len"]
        new = F.greatest(F.lit(0), end - F.greatest(a["end"], h["pos"]))
        return F.struct((a["n"] + new).alias("n"), F.greatest(a["end"], end).alias("end"))

    return F.aggregate(F.array_sort(hits), start, add, lambda a: a["n"]).cast("long")


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, fp (a hash of the text), n_words, hits, items, n_hit, contaminated: a row for each document."""
    windows = stored(item_windows(benchmark), "windows")
    verified = window_hits(documents, windows).select("*", F.col("hit.gram").alias("gram")).join(
        windows.select("gram", "items"), "gram", "left"
    )
    found = F.when(F.col("items").isNotNull(), F.struct("hit.pos", "hit.len"))
    per_doc = verified.groupBy("doc_id", "fp").agg(
        F.first("n_words").alias("n_words"),
        F.sum(F.when(F.coalesce("k", F.lit(0)) == 0, 1).otherwise(0)).cast("int").alias("copies"),
        F.collect_set(found).alias("hits"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    return (
        per_doc.withColumn("n_hit", covered_words(F.col("hits")))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (HIT_SHARE * F.col("n_hit") >= F.col("n_words")))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .drop("copies", "copy")
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        "contaminated",
    )


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
             list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
g AS (SELECT item_id, least(len(w), 13) AS n, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM g),
lens AS (SELECT DISTINCT n FROM wins),
p AS (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n),
q AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM p),
hit AS (SELECT q.rid, q.n, q.i, wins.item_id FROM q JOIN wins ON q.gram = wins.gram AND q.n = wins.n),
c AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS pos FROM hit) GROUP BY rid),
k AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(k.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(k.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c ON c.rid = d.rid LEFT JOIN k ON k.rid = d.rid
"""
