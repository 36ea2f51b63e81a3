"""Near duplicates by MinHash, with every link confirmed on full shingle sets.

1. Signatures. A text's distinct 5-word shingles are hashed to 64 bits; ``BANDS * ROWS`` universal hashes give their
   minima. Each run of ROWS minima is a band key. Two texts at the threshold of 0.75 agree in no band with probability
   (1 - 0.75 ** ROWS) ** BANDS, about 5 in a million.
2. Classes. Texts with equal sets (a fingerprint of all shingle hashes) become one class, represented by its smallest
   id, before anything else: copies, however many, never meet each other.
3. Stars. In each bucket of a band every class is paired with the bucket's smallest id only, so pairs grow with the
   members and not with their square. Pairs are confirmed on the full sets, by counting the intersection.
4. Components. Confirmed links go through alternating large-star and small-star steps until nothing changes.
5. Rest. A bucket of three or more members that still holds different components may hide links between members
   other than its smallest. In small buckets the pairs across components are confirmed directly. In larger ones, each
   member is indexed under its rarest shingles, so many that two sets at the threshold must share one of them (prefix
   filter), and only members that share one early enough to reach the threshold are compared (positional filter). No
   pair at the threshold is left out, whatever the size.
   The links found join the earlier ones and the components are computed again.

Only counts come to the driver. Ids, links and components are written to the shared folder between the steps, from
where a lost task reads them again, and deleted behind the last step that needs them; the ids of a step are broadcast
when a count shows at most ``BROADCAST_IDS``.

Edge cases: texts without words and null texts have an empty set and are linked with nothing, not even each other;
texts of one to four words have one shingle; ids are expected to be unique, but where rows share one, each is classed
by its own set, links found for any of them hold for the id, and each row is returned; rows without an id keep a null
component and stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, small_batches, table

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 32, 4
SMALL_BUCKET = 8
BROADCAST_IDS = 1_000_000
SPREAD = 64  # pairs of one center in a task
BLOCK = 8192
SIGNATURES = "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>"

_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = (_RNG.integers(0, 1 << 31, (2, BANDS * ROWS // 2, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, (2, BANDS * ROWS // 2, 1), dtype=np.uint64).astype(np.uint32)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base for the places in a word; the table grows with the longest word met."""

    def __init__(self) -> None:
        self.table = np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if n > len(self.table):
            self.table = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 2 * len(self.table)), _BASE)]), dtype=np.uint64)
        return self.table


_POWERS = _Powers()


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)  # of bytes, lower() changes ASCII letters only
    if not len(raw):
        return np.empty(0, np.uint64)
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    letters = raw[inside]
    firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(letters)) - np.repeat(firsts, lengths)
    terms = _BYTE[letters] * _POWERS.upto(int(lengths.max()))[place]
    return _mix(np.add.reduceat(terms, firsts) + lengths.astype(np.uint64))


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    w = word_hashes(text or "")
    if not len(w):
        return w
    k = min(SHINGLE, len(w))
    n = len(w) - k + 1
    h = np.full(n, np.uint64(k))
    for j in range(k):
        h += w[j : j + n] * _PLACE[j]
    return np.unique(_mix(h))


def minima(shingles: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minima; half of the hashes read the upper bits of a shingle's hash, half the lower ones."""
    halves = ((shingles >> np.uint64(32)).astype(np.uint32), shingles.astype(np.uint32))
    out = []
    for a, b, half in zip(_A, _B, halves, strict=True):
        low = None
        for at in range(0, len(half), BLOCK):
            m = (a * half[at : at + BLOCK] + b).min(axis=1)
            low = m if low is None else np.minimum(low, m)
        out.append(low)
    return np.stack(out, axis=1).ravel()


def band_keys(shingles: np.ndarray) -> np.ndarray:
    rows = minima(shingles).reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = _mix(key * _BASE + rows[:, j] + np.uint64(1))
    return key.view(np.int64)


def _signature_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch["text"].tolist():
            s = shingle_set(text)
            if len(s):
                rows.append((len(s), int(s.sum().view(np.int64)), int(_mix(s + _BASE).sum().view(np.int64)), band_keys(s)))
            else:
                rows.append((0, 0, 0, np.empty(0, np.int64)))
        out = pd.DataFrame(rows, columns=["n_shingles", "fp1", "fp2", "bands"])
        out.insert(0, "doc_id", batch["doc_id"].array)
        yield out


def _set_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = [shingle_set(t).view(np.int64) for t in batch["text"].tolist()]
        yield pd.DataFrame({"doc_id": batch["doc_id"].array, "shingles": sets})


def signatures(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "text").mapInPandas(_signature_rows, SIGNATURES)


def _among(frame: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """Rows of the frame whose column is one of the ids (column ``id``, distinct); broadcast only when few."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return frame.join(ids, frame[column] == ids["id"], "left_semi")


def confirmed(pairs: DataFrame, documents: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have at least the threshold's similarity.

    salt: a column of pairs that deals the pairs of one b, which may be as many as a bucket has members, over several
    tasks; the set of b is sent once for each of its salts that occurs.
    """
    ids = scratch.stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    sets = _among(documents.select("doc_id", "text").where("doc_id is not null"), ids).mapInPandas(
        _set_rows, "doc_id long, shingles array<long>"
    )
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(left, "a")
        .join(pairs.select("b", "salt").distinct().join(right, "b"), ["b", "salt"])
        .where(100 * both >= PERCENT * (F.size("sa") + F.size("sb") - both))
        .select("a", "b")
        .distinct()
    )


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """id and component (smallest id reachable) of every id in the edges (a, b), by alternating star steps.

    The minima of a step are written before they are joined to the edges, so that both sides of the join are plain
    exchanges, of which adaptive execution splits the tasks of a root with very many edges.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 999_983)).first())

    own = Scratch(scratch.spark)
    current = own.stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = state(current)
    while before[0]:
        both = current.union(current.select("b", "a"))
        least = own.stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = own.stored(large, "large")
        low = own.stored(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        current = own.stored(small, "edges")
        own.clear(current)
        now = state(current)
        if now == before:
            break
        before = now
    found = scratch.stored(
        current.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
            current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
        ),
        "components",
    )
    own.clear()
    return found


def _rest_pairs(members: DataFrame, found: DataFrame, documents: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Pairs of different components that share a bucket and that the stars did not compare; None if there are none.

    members: key, id, center, size of the buckets of three or more.
    """
    own = members.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = scratch.stored(
        own.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key"), "mixed"
    )
    open_ = scratch.stored(own.join(mixed, "key", "left_semi").where("id <> center").select("key", "id", "size", "component"), "open")
    if open_.isEmpty():
        return None

    def pairs(rows: DataFrame, on: list[str]) -> DataFrame:
        x = rows.select(*on, F.col("id").alias("a"), F.col("component").alias("ca"))
        y = rows.select(*on, F.col("id").alias("b"), F.col("component").alias("cb"))
        return x.join(y, on).where("ca < cb").select("a", "b").distinct()

    small = pairs(open_.where(F.col("size") <= SMALL_BUCKET), ["key"])
    large = open_.where(F.col("size") > SMALL_BUCKET)
    if large.isEmpty():
        return small
    ids = scratch.stored(large.select("id").distinct(), "ids")
    sets = scratch.stored(_among(documents.select("doc_id", "text").where("doc_id is not null"), ids).mapInPandas(_set_rows, "doc_id long, shingles array<long>"), "sets")
    shingles = sets.select(F.col("doc_id").alias("id"), F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    common = scratch.stored(shingles.groupBy("shingle").agg(F.count("*").alias("times")), "times")
    ranked = shingles.join(common.where("times > 1"), "shingle", "left").withColumn("times", F.coalesce("times", F.lit(1)))
    prefix = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
    rare = (
        ranked.groupBy("id", "n")
        .agg(F.sort_array(F.collect_list(F.struct("times", "shingle"))).alias("all"))
        .select("id", "n", F.posexplode(F.slice("all", F.lit(1), prefix.cast("int"))).alias("place", "s"))
        .where("s.times > 1")
        .select("id", "n", "place", F.col("s.shingle").alias("shingle"))
    )
    # at their first common shingle two sets cannot share more than what follows it in the shorter rest
    reach = 1 + F.least(F.col("na") - F.col("pa") - 1, F.col("nb") - F.col("pb") - 1)
    enough = (100 + PERCENT) * reach >= PERCENT * (F.col("na") + F.col("nb"))
    indexed = rare.join(large.select("id", "component").distinct(), "id")
    x = indexed.select("shingle", *[F.col(c).alias(f"{k}a") for c, k in (("n", "n"), ("place", "p"), ("component", "c"))], F.col("id").alias("a"))
    y = indexed.select("shingle", *[F.col(c).alias(f"{k}b") for c, k in (("n", "n"), ("place", "p"), ("component", "c"))], F.col("id").alias("b"))
    near = x.join(y, (x["shingle"] == y["shingle"]) & (F.col("ca") < F.col("cb")) & enough).select("a", "b")
    return small.union(near).distinct()


def near_duplicates(documents: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each document.

    scratch: where the tables go that the result reads, for a caller that deletes them when it has used the result.
    """
    scratch = scratch or Scratch(documents.sparkSession)
    small_batches(documents.sparkSession)
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = scratch.stored(signatures(documents), "signatures")
    sets = ["n_shingles", "fp1", "fp2"]
    some = signed.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.stored(
        some.groupBy(*sets).agg(F.min("doc_id").alias("class_id"), F.count("*").alias("members")).where("members > 1").drop("members"),
        "classes",
    )
    joined = signed.join(classes, sets, "left")
    classed = joined.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"))
    # in the buckets a class is represented by its smallest id
    heads = joined.where("n_shingles > 0 and doc_id is not null and (class_id is null or class_id = doc_id)")
    bands = heads.select(F.explode("bands").alias("key"), F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"))
    centers = scratch.stored(
        bands.groupBy("key")
        .agg(F.min(F.struct("id", "n")).alias("c"), F.max("id").alias("top"), F.count("*").alias("size"))
        .where("c.id <> top")
        .select("key", F.col("c.id").alias("center"), F.col("c.n").alias("center_n"), "size"),
        "centers",
    )
    members = scratch.stored(bands.join(centers, "key"), "members")
    alike = 100 * F.least("n", "center_n") >= PERCENT * F.greatest("n", "center_n")  # sets of other sizes never are
    copies = F.ceil(F.max("size") / SPREAD)
    pairs = scratch.stored(
        members.where((F.col("id") != F.col("center")) & alike)
        .groupBy(F.col("id").alias("a"), F.col("center").alias("b"))
        .agg(copies.alias("copies"))
        .select("a", "b", F.pmod(F.xxhash64("a"), F.col("copies")).alias("salt")),
        "pairs",
    )
    links = scratch.stored(confirmed(pairs, documents, scratch), "links")
    found = components(links, scratch)
    rest = _rest_pairs(members.where("size > 2"), found, documents, scratch)
    if rest is not None:
        salted = rest.join(pairs, ["a", "b"], "left_anti").withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(16)))
        more = scratch.stored(confirmed(scratch.stored(salted, "pairs"), documents, scratch), "links")
        if not more.isEmpty():
            found = components(links.union(more), scratch)
    scratch.clear(signed, classes, found)
    return (
        classed.join(found.select(F.col("id").alias("class_id"), "component"), "class_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "class_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
