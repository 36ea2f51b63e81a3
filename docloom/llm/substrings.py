"""Removal of repeated passages by prefix-partitioned suffix trees over words.

Words are ``[^\\x20\\x09-\\x0D]+``, as they stand; a window is WINDOW consecutive words of one document. A word goes if a window
that covers it also starts in a document with a smaller id. Windows are judged on the input.

A suffix matters only if its first WINDOW words occur in two documents, so suffixes that can't are left out first:

1. Anchors. Of each window the run of ANCHOR words with the least hash is its anchor (leftmost in ties), so equal windows
   have equal anchors. Each task writes the anchors of a block of documents, once for each block and anchor, as compressed
   cells by hash range, and the digest of every document. Documents whose words are all the same form a class; only its
   smallest id goes on, the others are removed whole.
2. Repeated anchors. Each hash range is one group that finds the anchors of several documents, by ranges of these. An
   anchor comes once from a block, so one that is everywhere costs its group a number for each block and no more.
3. Suffixes. The documents named are read again. Suffixes whose anchor is repeated are written as leaves: hashes of their
   words 1-4, 5-8 and 9-13, which are the edge labels of the path on which they lie, and where they occur. Equal ones of a
   block are one leaf with its smallest document. Leaves are dealt out by ranges of their first four words; a range with
   over ``LEAVES`` leaves is split by a prefix of eight words, and parts that are still too large by all thirteen: the
   prefixes that part the suffixes are as long as memory asks for.
4. Subtrees. Each part is one group: sorted leaves, and nodes at the depths of 4, 8 and 13 words where neighbours differ. An
   internal node at the depth of WINDOW is a repeat, the runs of such nodes along a text its maximal repeats; deeper ones lie
   below one of them and have no smaller document. The smallest document of the node decides about each leaf.
5. The leaves of a block that must go become intervals of its documents; the texts of these are read a third time.

Hashes of 48 bits stand for the runs of four or five words and for anchors; a leaf is told by three of them. Only counts come
to the driver. Ids are broadcast where a count shows at most ``BROADCAST_IDS``.

Edge cases: null texts and texts without words have no words and the digest of ''; texts of fewer than WINDOW words lose
nothing; rows that share an id are one document when windows are compared, so they never remove from each other, and each
is returned; rows without an id neither remove nor lose words; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.blobs import pack, pack_ascending, spans, unpack, unpack_ascending
from docloom.llm.common import Scratch, small_batches, table

WINDOW = 13
ANCHOR = 5
DEPTHS = (4, 8, WINDOW)
BLOCK = 1 << 20  # anchors or suffixes that a task holds
LEAVES = 2 << 20
RANGE_BYTES = 16 << 20
BROADCAST_IDS = 1_000_000
MADE = "kind int, doc_id long, fp long, n_words long, seq1 long, seq2 long, sha string, bucket int, hashes binary, docs binary, known binary"
MADE_NAMES = [x.split()[0] for x in MADE.split(", ")]
CELLS = "kind int, block long, bucket int, part long, n long, h1 binary, h2 binary, h3 binary, entry binary, low binary, times binary, row binary, pos binary"
CELL_NAMES = [x.split()[0] for x in CELLS.split(", ")]
LEAF = ["h1", "h2", "h3"]

_RNG = np.random.default_rng(20250117)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(0, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(16)  # bits that are dropped to leave 48


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a batch of texts as hashes behind each other, with the text to which each belongs."""

    powers = np.ones(1, np.uint64)

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        inside = (raw != 32) & ((raw < 9) | (raw > 13))
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.append(0, edge)
        starts, lengths = edge[::2], edge[1::2] - edge[::2]
        ends_of_text = np.cumsum([len(t) + 1 for t in texts])
        self.text = np.searchsorted(ends_of_text, starts, side="right")
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))  # of each text, its first word
        if not len(starts):
            self.hashes = np.empty(0, np.uint64)
            return
        if lengths.max() > len(Words.powers):
            Words.powers = np.cumprod(np.append(np.uint64(1), np.full(2 * int(lengths.max()), _BASE)), dtype=np.uint64)
        firsts = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
        self.hashes = _mix(np.add.reduceat(_BYTE[raw[inside]] * Words.powers[place], firsts) + lengths.astype(np.uint64))

    def runs(self, length: int, skip: int = 0) -> np.ndarray:
        """48-bit hashes of the runs of words that start ``skip`` words behind each place; places near the end are left out."""
        n = max(0, len(self.hashes) - skip - length + 1)
        h = np.full(n, np.uint64(length))
        for k in range(length):
            h += self.hashes[skip + k : skip + k + n] * _PLACE[k]
        return _mix(h) >> _TOP

    def windows(self) -> np.ndarray:
        """Places at which a window of one text starts."""
        n = max(0, len(self.text) - WINDOW + 1)
        return np.flatnonzero(self.text[:n] == self.text[WINDOW - 1 :])

    def anchors(self, runs: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """The place of each window's anchor."""
        best, at = runs[windows], windows.copy()
        for k in range(1, WINDOW - ANCHOR + 1):
            other = runs[windows + k]
            less = other < best
            best[less], at[less] = other[less], windows[less] + k
        return at


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _hex(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _sequence(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of the word sequence of each text."""
    if not len(words.hashes):
        return (np.zeros(len(words.first) - 1, np.int64),) * 2
    place = np.arange(len(words.hashes), dtype=np.uint64) - words.first[words.text].astype(np.uint64)
    out = []
    for salt in (_BYTE[0], _BYTE[1]):
        sums = np.append(np.uint64(0), np.cumsum(_mix(words.hashes + place * salt), dtype=np.uint64))
        out.append((sums[words.first[1:]] - sums[words.first[:-1]]).view(np.int64))
    return out[0], out[1]


def _scanned(buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, docs, seqs, held = [], [], [], 0

        def flushed() -> pd.DataFrame:
            h, d = np.concatenate(hashes), np.concatenate(docs)
            ids, first, second = map(np.concatenate, zip(*seqs, strict=True))
            order = np.lexsort((ids, second, first))
            copy = (first[order][1:] == first[order][:-1]) & (second[order][1:] == second[order][:-1]) & (ids[order][1:] != ids[order][:-1])
            gone = ids[order][1:][copy]
            alive = ids[order][np.append(True, ~copy)] if len(ids) else ids
            kept = ~np.isin(d, np.setdiff1d(gone, alive))  # ids of which every row is a copy of a smaller one
            h, d = h[kept], d[kept]
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            new, _ = spans(h, d)
            h, d = h[new], d[new]
            head, end = spans(h)
            times = end - head
            several = np.repeat(times > 1, times)
            rows = [(2, *[None] * 6, k, *cells, None) for k, *cells in _by_doc(h[several], d[several], buckets)]
            heads, known = h[head], (times > 1).astype(np.uint64)
            bucket = (heads * np.uint64(buckets)) >> np.uint64(48)
            for a, b in zip(*spans(bucket), strict=True):
                cells = (pack_ascending(heads[a:b]), pack(d[head[a:b]]), pack(known[a:b]))
                rows.append((1, None, None, None, None, None, None, int(bucket[a]), *cells))
            hashes.clear(), docs.clear(), seqs.clear()
            return _frame(rows)

        for batch in batches:
            raws = [_raw(t) for t in batch["text"].tolist()]
            ids, null = batch["doc_id"].to_numpy(), batch["null_id"].to_numpy()
            words = Words(raws)
            windows = words.windows()
            runs = words.runs(ANCHOR)
            at = np.unique(words.anchors(runs, windows))
            at = at[~null[words.text[at]]]
            first, second = _sequence(words)
            hashes.append(runs[at])
            docs.append(ids[words.text[at]])
            seqs.append((ids[~null], first[~null], second[~null]))
            held += len(at)
            n = np.diff(words.first)
            shas = [_hex(raw.split()) for raw in raws]
            out = pd.DataFrame({"kind": 0, "doc_id": batch["doc_id"].astype("Int64"), "fp": batch["fp"], "n_words": n, "seq1": first, "seq2": second, "sha": shas})
            out.loc[null, "doc_id"] = pd.NA
            out["bucket"] = pd.array([None] * len(out), dtype="Int64")
            for cell in ("hashes", "docs", "known"):
                out[cell] = None
            yield out[MADE_NAMES]
            if held >= BLOCK:
                yield flushed()
                held = 0
        if hashes:
            yield flushed()

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=MADE_NAMES)
    return out.astype({c: "Int64" for c in ("doc_id", "fp", "n_words", "seq1", "seq2", "bucket")})


def _by_doc(hashes: np.ndarray, docs: np.ndarray, buckets: int) -> list[tuple]:
    """Number of a range of documents, hashes, documents: a cell for each range."""
    bucket = _mix(docs.view(np.uint64)) % np.uint64(buckets)
    order = np.lexsort((hashes, docs, bucket))
    hashes, docs, bucket = hashes[order], docs[order], bucket[order]
    return [(int(bucket[a]), pack(hashes[a:b]), pack(docs[a:b])) for a, b in zip(*spans(bucket), strict=True)]


def _named(cells: pd.DataFrame) -> pd.DataFrame:
    """doc_id, hashes: the repeated anchors of the documents of one range, by document."""
    h = np.concatenate([unpack(x) for x in cells["hashes"]])
    d = np.concatenate([unpack(x).view(np.int64) for x in cells["docs"]])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    return pd.DataFrame([(int(d[a]), pack_ascending(h[a:b])) for a, b in zip(*spans(d), strict=True)], columns=["doc_id", "hashes"])


def _repeated(cells: pd.DataFrame) -> pd.DataFrame:
    """bucket, hashes, docs: the anchors of one hash range that occur in several blocks, by ranges of documents."""
    h = np.concatenate([unpack_ascending(x) for x in cells["hashes"]])
    d = np.concatenate([unpack(x).view(np.int64) for x in cells["docs"]])
    known = np.concatenate([unpack(x) for x in cells["known"]]).astype(bool)
    order = np.argsort(h, kind="stable")
    h, d, known = h[order], d[order], known[order]
    head, end = spans(h)
    several = np.repeat(end - head, end - head) > 1
    own = several & ~known  # documents of the others are named by their blocks
    return pd.DataFrame(_by_doc(h[own], d[own], int(cells["buckets"].iloc[0])), columns=["bucket", "hashes", "docs"])


def _leaves(buckets: int):
    """Documents with the anchors that are repeated to cells of leaves, one for each block and range, and one of its rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = TaskContext.get().partitionId() << 36
        parts: list[tuple] = []
        ids: list[int] = []
        fps: list[int] = []
        held = 0

        def flushed() -> pd.DataFrame:
            h1, h2, h3, row, pos = map(np.concatenate, zip(*parts, strict=True))
            doc = np.array(ids, np.int64)
            order = np.lexsort((doc[row], h3, h2, h1))
            h1, h2, h3, row, pos = (x[order] for x in (h1, h2, h3, row, pos))
            head, ends = spans(h1, h2, h3)
            bucket = (h1[head] * np.uint64(buckets)) >> np.uint64(48)
            rows = [(0, block, None, None, len(ids), *[None] * 6, pack(doc), pack(np.array(fps, np.int64)))]
            for a, b in zip(*spans(bucket), strict=True):
                at, of = head[a:b], slice(head[a], ends[b - 1])
                cells = [pack_ascending(h1[at]), pack(h2[at]), pack(h3[at]), pack_ascending(np.arange(b - a)), pack(doc[row[at]])]
                rows.append((1, block, int(bucket[a]), 0, int(b - a), *cells, pack(ends[a:b] - at), pack(row[of]), pack(pos[of])))
            parts.clear(), ids.clear(), fps.clear()
            return pd.DataFrame(rows, columns=CELL_NAMES).astype({"bucket": "Int64", "part": "Int64"})

        for batch in batches:
            words = Words([_raw(t) for t in batch["text"].tolist()])
            windows = words.windows()
            runs = words.runs(ANCHOR)
            at = words.anchors(runs, windows)
            named = np.concatenate([unpack_ascending(x) | np.uint64(i << 48) for i, x in enumerate(batch["hashes"])])
            hit = np.isin(runs[at] | words.text[at].astype(np.uint64) << np.uint64(48), named)
            w = windows[hit]
            text = words.text[w]
            edges = [words.runs(b - a, a)[w] for a, b in zip((0, *DEPTHS), DEPTHS, strict=False)]
            parts.append((*edges, text + len(ids), w - words.first[text]))
            ids += batch["doc_id"].tolist()
            fps += batch["fp"].tolist()
            held += len(w)
            if held >= BLOCK:
                yield flushed()
                block, held = block + 1, 0
        if held:
            yield flushed()

    return run


def _split(column: int):
    """Cells of leaves to cells by their prefix of one more edge; parts is how many there are of a range."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for c in batch.itertuples():
                h = [unpack_ascending(c.h1), unpack(c.h2), unpack(c.h3)]
                part = _mix(h[column] + np.uint64(c.part)) % np.uint64(c.parts)
                entry, low = unpack_ascending(c.entry), unpack(c.low)
                for k in np.unique(part).tolist():
                    own = part == k
                    cells = [pack_ascending(h[0][own]), pack(h[1][own]), pack(h[2][own]), pack_ascending(entry[own]), pack(low[own])]
                    rows.append((c.block, c.bucket, (c.part << 20) + k + 1, int(own.sum()), *cells))
            yield pd.DataFrame(rows, columns=["block", "bucket", "part", "n", *LEAF, "entry", "low"])

    return run


def subtree(h1: np.ndarray, h2: np.ndarray, h3: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of the leaves and, by depth, the first leaf of each node in that order."""
    order = np.lexsort((h3, h2, h1))
    edges = [h[order] for h in (h1, h2, h3)]
    return order, [spans(*edges[: k + 1])[0] for k in range(len(edges))]


def _judged(cells: pd.DataFrame) -> pd.DataFrame:
    """block, bucket, entries: the leaves of a subtree whose node holds a smaller document than the block's own."""
    n = cells["n"].to_numpy()
    h1 = np.concatenate([unpack_ascending(x) for x in cells["h1"]])
    h2, h3, low = (np.concatenate([unpack(x) for x in cells[c]]) for c in ("h2", "h3", "low"))
    low = low.view(np.int64)
    order, nodes = subtree(h1, h2, h3)
    deep = nodes[-1]
    least = np.minimum.reduceat(low[order], deep)
    gone = np.empty(len(order), bool)
    gone[order] = np.repeat(least, np.diff(deep, append=len(order))) < low[order]
    rows = []
    for c, mine in zip(cells.itertuples(), np.split(gone, np.cumsum(n)[:-1]), strict=True):
        if mine.any():
            rows.append((c.block, c.bucket, pack_ascending(unpack_ascending(c.entry)[mine])))
    return pd.DataFrame(rows, columns=["block", "bucket", "entries"])


def _covers(cells: pd.DataFrame, judged: pd.DataFrame) -> pd.DataFrame:
    """doc_id, fp, starts: the windows of each document of a block that go."""
    gone = {b: np.concatenate([unpack_ascending(x) for x in some]) for b, some in judged.groupby("bucket")["entries"]}
    own = cells[cells["kind"] == 0].iloc[0]
    doc, fp = unpack(own["row"]).view(np.int64), unpack(own["pos"]).view(np.int64)
    rows, at = [], []
    for c in cells[cells["kind"] == 1].itertuples():
        times = unpack(c.times).astype(np.int64)
        out = np.zeros(len(times), bool)
        out[gone.get(c.bucket, np.empty(0, np.uint64)).astype(np.int64)] = True
        row, pos = unpack(c.row).astype(np.int64), unpack(c.pos)
        mine = np.repeat(out, times) | (doc[row] > np.repeat(unpack(c.low).view(np.int64), times))
        rows.append(row[mine])
        at.append(pos[mine])
    rows, at = np.concatenate(rows), np.concatenate(at)
    order = np.lexsort((at, rows))
    rows, at = rows[order], at[order]
    found = [(int(doc[rows[a]]), int(fp[rows[a]]), pack_ascending(at[a:b])) for a, b in zip(*spans(rows), strict=True)]
    return pd.DataFrame(found, columns=["doc_id", "fp", "starts"])


def _without(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text, starts in zip(batch["text"], batch["starts"], strict=True):
            words = _raw(text).split()
            delta = np.zeros(len(words) + 1, np.int64)
            begin = unpack_ascending(starts).astype(np.int64)
            delta[begin] += 1
            delta[begin + WINDOW] -= 1
            stay = np.flatnonzero(np.cumsum(delta[:-1]) == 0)
            rows.append((len(words), len(words) - len(stay), _hex([words[i] for i in stay.tolist()])))
        out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"])
        out.insert(0, "doc_id", batch["doc_id"].array)
        yield out


def _bounded(ids: DataFrame) -> DataFrame:
    """Distinct ids, to be broadcast if a count shows that they are few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _parted(cells: DataFrame, scratch: Scratch) -> DataFrame:
    """Leaves by (bucket, part): prefixes of four words, of eight where there are too many leaves, and of thirteen."""
    done, rest = None, cells.where("kind = 1").select("block", "bucket", "part", "n", *LEAF, "entry", "low")
    for column in (1, 2):
        parts = F.ceil(F.sum("n") / LEAVES).cast("int").alias("parts")
        large = scratch.stored(rest.groupBy("bucket", "part").agg(parts).where("parts > 1"), "large")
        if large.isEmpty():
            break
        fine = rest.join(large, ["bucket", "part"], "left_anti")
        done = fine if done is None else done.union(fine)
        schema = "block long, bucket int, part long, n long, h1 binary, h2 binary, h3 binary, entry binary, low binary"
        rest = scratch.stored(rest.join(large, ["bucket", "part"]).mapInPandas(_split(column), schema), "parts")
    return rest if done is None else done.unionByName(rest)


def without_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row for each document."""
    spark = documents.sparkSession
    scratch = Scratch(spark)
    small_batches(spark)
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("fp"))
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(1 << 15, max(64, size // RANGE_BYTES))
    source = documents.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("null_id"), "text", "fp")
    made = scratch.stored(source.mapInPandas(_scanned(buckets), MADE), "anchors")
    rows = made.where("kind = 0").select("doc_id", "fp", "n_words", "seq1", "seq2", "sha")
    same = ["n_words", "seq1", "seq2"]
    long = rows.where((F.col("n_words") >= WINDOW) & F.col("doc_id").isNotNull())
    classes = scratch.stored(long.groupBy(*same).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select(*same, "least"), "classes")
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias("copy")
    rows = scratch.stored(rows.join(classes, same, "left").select("doc_id", "fp", "n_words", "sha", copy), "rows")
    alive = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("copy").alias("gone")).where("not gone").select("doc_id")
    ranges = made.where("kind = 1").select("bucket", "hashes", "docs", "known", F.lit(buckets).alias("buckets"))
    across = ranges.groupBy("bucket").applyInPandas(_repeated, "bucket int, hashes binary, docs binary")
    named = made.where("kind = 2").select("bucket", "hashes", "docs").union(across)
    named = named.groupBy("bucket").applyInPandas(_named, "doc_id long, hashes binary").join(alive, "doc_id", "left_semi")
    named = scratch.stored(named, "named")
    texts = documents.join(_bounded(named.select("doc_id")), "doc_id", "left_semi")
    cells = scratch.stored(texts.join(named, "doc_id").mapInPandas(_leaves(buckets), CELLS), "leaves")
    parted = _parted(cells, scratch)
    judged = parted.groupBy("bucket", "part").applyInPandas(_judged, "block long, bucket int, entries binary")
    occurring = cells.select("kind", "block", "bucket", "low", "times", "row", "pos")
    covers = occurring.groupBy("block").cogroup(judged.groupBy("block")).applyInPandas(_covers, "doc_id long, fp long, starts binary")
    covers = scratch.stored(covers.dropDuplicates(["doc_id", "fp"]), "covers")
    keys = _bounded(covers.select("doc_id", "fp"))
    cut = documents.join(keys, ["doc_id", "fp"], "left_semi").join(covers, ["doc_id", "fp"])
    cut = cut.select("doc_id", "text", "starts").mapInPandas(_without, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    rows = rows.join(keys, ["doc_id", "fp"], "left_anti")
    removed = F.when(F.col("copy"), F.col("n_words")).otherwise(F.lit(0)).cast("long")
    digest = F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.col("sha"))
    return rows.select("doc_id", "n_words", removed.alias("n_removed"), digest.alias("kept_sha256")).union(cut)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
