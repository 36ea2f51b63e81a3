"""Alignment of two tokenizers over a corpus, and how usual each aligned pair of ids is there.

A (byte-level BPE) and B (pieces with byte fallback) encode the same bytes, space + text. Where tokens of both end at one
byte the text is cut, and the two tokens that end there are linked. How often a pair of ids is linked in the whole corpus
says how usual the link is; which pair of a B id is its most usual one says which links are its best.

Postings cogroup:

1. Each task encodes documents and gathers the links of a block of them: for each pair of ids the documents that hold it,
   with multiplicities. Blocks are sorted by (B id, A id, document) and dealt out by B id into ``BUCKETS`` cells, each a few
   compressed arrays, beside one row for each document with its counts. All is written once to the shared folder.
2. Pair counts. Only the keys and totals of the cells are read; a task sums those of its blocks before Spark sums by pair
   and takes the maximum by B id. The result has a row for each distinct pair, at most one for each two ids.
3. Postings and pair counts meet in a cogroup by (bucket, salt). Cells of one bucket are dealt over as many salts as its
   bytes ask for, so a B id that holds a third of all links is split, and each group stays below ``GROUP_BYTES`` or so of
   compressed postings; counts of the bucket go to each of its salts. Spark's shuffle sorts and spills both sides. Each
   group emits, for each block, what its links contribute to each document.
4. The contributions of a block, at most ``BUCKETS`` cells, are added by document and joined to the documents' rows.

Edge cases: texts that are null or empty, and texts whose joined token bytes of A or of B differ from space + text, have no
tokens: zeros, and '' for the groups; strings of special tokens inside a text are plain text; rows that share an id are
documents of their own, and so are rows with a null id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.blobs import group_sums, pack, pack_ascending, unpack, unpack_ascending
from docloom.llm.common import Scratch, small_batches, table
from docloom.llm.token_files import BYTE_LETTERS, PieceEncoder, encoder_of

BUCKETS = 64
BLOCK_LINKS = 1 << 20
MERGE_PAIRS = 1 << 21
GROUP_BYTES = 4 << 20
REMEMBERED = 300_000  # space-led words of B
UNITS = re.compile(" *[^ ]+| +")
MADE = (
    "kind int, block long, idx int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "bucket int, size long, keys binary, totals binary, times binary, docs binary, mult binary"
)
COLUMNS = [x.split()[0] for x in MADE.split(", ")]


class PlainEncoder(PieceEncoder):
    """Byte-level ids in which the strings of special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        bytes_of = {c: b for b, c in BYTE_LETTERS.items()}
        self.bytes = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = bytes(bytes_of[c] for c in token) if all(c in bytes_of for c in token) else token.encode()


class PieceModel:
    """Ids of a sentencepiece model, by space-led words that are encoded once and remembered.

    No piece of the model goes from a letter over to a space behind it, so merges never cross the place before a run of
    spaces, and words can be encoded alone. A model that has such pieces encodes whole texts.
    """

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.apart = not any(re.search("[^▁]▁", p) for p in pieces)
        self.space = pieces.index("▁")
        self.known: dict[str, bytes] = {}

    def _new(self, unit: str) -> bytes:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        ids = [self.space] if unit == " " else self.model.encode(unit[1:], num_threads=1)
        made = np.array(ids, np.uint32).tobytes()
        if len(unit) <= 64:
            self.known[unit] = made
        return made

    def encode(self, spaced: str) -> np.ndarray:
        """The ids of a text; ``spaced`` is the text behind the space that the model adds to it."""
        if not self.apart or "▁" in spaced:
            return np.array(self.model.encode(spaced[1:], num_threads=1), np.uint32)
        known, new = self.known.get, self._new
        return np.frombuffer(b"".join([known(u) or new(u) for u in UNITS.findall(spaced)]), np.uint32)


_MODELS: dict[str, PieceModel] = {}


def model_of(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS.clear()
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


class Aligner:
    """Groups and links of one document after another."""

    def __init__(self, bytes_a: list[bytes], bytes_b: list[bytes]):
        self.bytes_a, self.bytes_b = bytes_a, bytes_b
        self.len_a, self.len_b = np.array([*map(len, bytes_a)]), np.array([*map(len, bytes_b)])
        self.words = [f"{i}{end}".encode() for mark, n in ((b"|", len(bytes_a)), (b";", len(bytes_b))) for i in range(n) for end in (",", mark.decode())]

    def __call__(self, raw: bytes, a: np.ndarray, b: np.ndarray) -> tuple[str, np.ndarray, np.ndarray] | None:
        """The digest of the groups and the linked A and B ids; None if either side's bytes are not those of the text."""
        if b"".join([self.bytes_a[i] for i in a.tolist()]) != raw or b"".join([self.bytes_b[i] for i in b.tolist()]) != raw:
            return None
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        at = np.searchsorted(ends_b, ends_a)
        last_a = np.flatnonzero(ends_b[at] == ends_a)
        last_b = at[last_a]
        slots_a = np.arange(len(a)) + np.repeat(np.append(0, last_b[:-1] + 1), np.diff(last_a, prepend=-1))
        slots_b = np.arange(len(b)) + np.repeat(last_a + 1, np.diff(last_b, prepend=-1))
        codes = np.empty(len(a) + len(b), np.int64)
        codes[slots_a] = 2 * a.astype(np.int64)
        codes[slots_b] = 2 * (len(self.bytes_a) + b.astype(np.int64))
        codes[slots_a[last_a]] += 1
        codes[slots_b[last_b]] += 1
        text = b"".join([self.words[i] for i in codes.tolist()])
        return hashlib.sha256(text[:-1]).hexdigest(), a[last_a], b[last_b]


def _postings(block: int, keys: list[np.ndarray], docs: list[int]) -> Iterator[tuple]:
    """The cells of a block: keys are B id << 32 | A id of each link of each document."""
    joined = np.concatenate(keys)
    idx = np.repeat(np.array(docs, np.int64), [*map(len, keys)])
    order = np.argsort(joined, kind="stable")
    joined, idx = joined[order], idx[order]
    first = np.flatnonzero(np.append(True, (joined[1:] != joined[:-1]) | (idx[1:] != idx[:-1])))
    mult = np.diff(first, append=len(joined))
    joined, idx = joined[first], idx[first]
    bucket = (joined >> np.uint64(32)) % np.uint64(BUCKETS)
    for k in np.unique(bucket).tolist():
        own = np.flatnonzero(bucket == k)
        key, doc, m = joined[own], idx[own], mult[own]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        cells = [pack_ascending(key[head]), pack(np.add.reduceat(m, head)), pack(np.diff(head, append=len(key))), pack(doc), pack(m)]
        yield (1, block, None, None, *[None] * 5, int(k), sum(map(len, cells)), *cells)


def _encoded(path_a: str, path_b: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a_side, b_side = encoder_of(PlainEncoder, path_a), model_of(path_b)
        align = Aligner(a_side.bytes, b_side.bytes)
        block = TaskContext.get().partitionId() << 36
        idx, links, keys, docs = 0, 0, [], []

        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=COLUMNS)
            return out.astype({c: "Int64" for c in ("idx", "doc_id", "n_a", "n_b", "n_groups", "n_links", "bucket", "size")})

        for batch in batches:
            rows: list[tuple] = []
            texts = [f" {t}" if t else "" for t in batch["text"].tolist()]
            made = a_side.encode_all([t for t in texts if t], 0)
            for doc_id, null_id, text in zip(batch["doc_id"].tolist(), batch["null_id"].tolist(), texts, strict=True):
                found, n_a, n_b, n = None, 0, 0, 0
                if text:
                    a, b = next(made)[:-1], b_side.encode(text)
                    found = align(text.encode(), a, b)
                    if found:
                        n_a, n_b, n = len(a), len(b), len(found[1])
                        keys.append(found[2].astype(np.uint64) << np.uint64(32) | found[1])
                        docs.append(idx)
                        links += n
                rows.append((0, block, idx, None if null_id else doc_id, n_a, n_b, n, n, found[0] if found else "", *[None] * 7))
                idx += 1
                if links >= BLOCK_LINKS:
                    rows += _postings(block, keys, docs)
                    block, idx, links, keys, docs = block + 1, 0, 0, [], []
            yield frame(rows)
        if keys:
            yield frame([*_postings(block, keys, docs)])

    return run


def _pair_totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Key and number of links, summed over the cells of a task while they fit."""
    keys, totals, held = [], [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        return group_sums(np.concatenate(keys), np.concatenate(totals))

    for batch in batches:
        for k, t in zip(batch["keys"], batch["totals"], strict=True):
            keys.append(unpack_ascending(k))
            totals.append(unpack(t).astype(np.int64))
            held += len(keys[-1])
            if held > MERGE_PAIRS:
                k, t = merged()
                keys, totals, held = [k], [t], len(k)
                if held > MERGE_PAIRS // 2:
                    yield pd.DataFrame({"key": k.view(np.int64), "n": t})
                    keys, totals, held = [], [], 0
    if keys:
        k, t = merged()
        yield pd.DataFrame({"key": k.view(np.int64), "n": t})


def _contributions(postings: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """block, docs, best, total: what the links of a group add to the documents of each block."""
    counts = counts.sort_values("key")
    known, count, best = counts["key"].to_numpy(), counts["n"].to_numpy(), counts["best"].to_numpy()
    rows = []
    for p in postings.itertuples():
        at = np.searchsorted(known, unpack_ascending(p.keys).view(np.int64))
        times, m = unpack(p.times).astype(np.int64), unpack(p.mult).astype(np.int64)
        docs, n_best, total = group_sums(unpack(p.docs), m * np.repeat(best[at], times), m * np.repeat(count[at], times))
        rows.append((p.block, pack_ascending(docs), pack(n_best), pack(total)))
    return pd.DataFrame(rows, columns=["block", "docs", "best", "total"])


def _by_document(cells: pd.DataFrame) -> pd.DataFrame:
    parts = [[unpack_ascending(c.docs), unpack(c.best), unpack(c.total)] for c in cells.itertuples()]
    docs, best, total = group_sums(*map(np.concatenate, zip(*parts, strict=True)))
    block = cells["block"].iloc[0]
    return pd.DataFrame({"block": block, "idx": docs.astype(np.int32), "n_best": best.astype(np.int64), "count_sum": total.astype(np.int64)})


def pair_counts(postings: DataFrame) -> DataFrame:
    """key (B id << 32 | A id), n (links in the corpus), best (1 if no pair of the B id has more links), bucket."""
    summed = postings.select("keys", "totals").mapInPandas(_pair_totals, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    side = F.shiftright("key", 32).alias("b")
    most = summed.groupBy(side).agg(F.max("n").alias("most"))
    best = (F.col("n") == F.col("most")).cast("long").alias("best")
    return summed.select("*", side).join(most, "b").select("key", "n", best, F.pmod("b", F.lit(BUCKETS)).cast("int").alias("bucket"))


def align(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row for each document."""
    spark = documents.sparkSession
    scratch = Scratch(spark)
    small_batches(spark)
    source = documents.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNull().alias("null_id"), "text")
    made = scratch.stored(source.mapInPandas(_encoded(path_a, path_b), MADE), "alignment")
    postings = made.where("kind = 1")
    counts = scratch.stored(pair_counts(postings), "pairs")
    # at most BUCKETS rows; a bucket's cells are dealt over as many groups as their bytes ask for
    salts = postings.groupBy("bucket").agg(F.ceil(F.sum("size") / GROUP_BYTES).cast("int").alias("salts"))
    salts = F.broadcast(scratch.stored(salts, "salts"))
    dealt = postings.join(salts, "bucket").select(
        "bucket", F.pmod(F.xxhash64("block"), F.col("salts")).cast("int").alias("salt"), "block", "keys", "times", "docs", "mult"
    )
    sent = counts.join(salts, "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "key", "n", "best")
    added = (
        dealt.groupBy("bucket", "salt")
        .cogroup(sent.groupBy("bucket", "salt"))
        .applyInPandas(_contributions, "block long, docs binary, best binary, total binary")
        .groupBy("block")
        .applyInPandas(_by_document, "block long, idx int, n_best long, count_sum long")
    )
    none = F.lit(0).cast("long")
    return (
        made.where("kind = 0")
        .join(added, ["block", "idx"], "left")
        .select(
            *("doc_id", "n_a", "n_b", "n_groups", "n_links"),
            F.coalesce("n_best", none).alias("n_best"),
            F.coalesce("count_sum", none).alias("count_sum"),
            "groups_sha256",
        )
    )


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
