"""Token ids of a corpus in compact binary segments, and the way back.

Documents are dealt out by ranges of (doc_id, hash of the text), so that rows of one id can be split, sorted, encoded
and written as segments. A segment holds whole documents; its ids are cut into blocks of a fixed size, each block is
transposed into byte planes (or bit planes), each plane is compressed with zstandard, and an index at the end of the
segment says where each plane of each block starts. Segments are rows of a Parquet table with their part, their
position and their counts beside them, so any store that Spark writes to will do, a lost task is simply run again,
and a reader can pick segments and blocks without decoding the others.

Segment layout, little-endian::

    magic "DLT1" | planes of block 0 | planes of block 1 | ... | index | footer
    index:  uint32 length of each document, int64 ids of documents (with a validity byte each), uint32 size of each plane
    footer: uint32 documents, uint64 ids, uint32 ids a block, uint8 kind (0 byte planes, 1 bit planes), uint8 planes a block

Pieces of text are encoded once and remembered: a tokenizer treats the pieces into which it cuts a text independently,
so a text's ids are the joined ids of its pieces. The memory is bounded in pieces and in their length.

Edge cases: null texts count as empty and have the end id alone; rows of equal id follow each other by the hash of
their text; null ids come first; an empty table gives no segment and an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm.common import shared_path, small_batches, table

MAGIC = b"DLT1"
FOOTER = struct.Struct("<IQIBB")
BLOCK = 1 << 16
SEGMENT = 1 << 20
REMEMBERED = 800_000  # pieces
LONGEST = 64  # characters of a piece that is known by its polynomial
CHUNK = 1 << 18  # characters that are cut at once
CONTRACTED_ONE = np.array([ord(c) for c in "stmd"], np.uint32)
CONTRACTED_TWO = np.array([ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")], np.uint32)
END_ID = 1
SEGMENTS = "part int, seq int, first long, n_docs int, n_ids long, payload binary"


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 and up, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(moved)}


BYTE_LETTERS = _byte_letters()
#: Outside these, Python's character classes, lower() and the tokenizers' own agree and composition changes nothing: ASCII,
#: Latin, Cyrillic, general punctuation, kana, Han and Hangul. Superscripts, fractions and the dotted capital I are left out.
UNSURE = re.compile(
    "[^\n -~\u00a1-\u00ac\u00ae-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u012f\u0131-\u024f\u0400-\u0481\u048a-\u052f"
    "\u2010-\u2027\u2030-\u205e\u3001-\u3003\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fef\uac00-\ud7a3]"
)
END = "\0"  # stands behind each text; no text that is cut into pieces holds it
OTHER, LETTER, DIGIT, WHITE, ENDING = range(5)
SPACE, LINE_FEED, APOSTROPHE = 32, 10, 39


def _kinds() -> np.ndarray:
    out = np.zeros(1 << 16, np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        if not UNSURE.match(c):
            out[i] = out[ord(c.lower())] = LETTER if c.isalpha() else DIGIT if c.isdigit() else WHITE if c.isspace() else OTHER
    out[0] = ENDING
    return out


KINDS = _kinds()
_RNG = np.random.default_rng(20240711)
_OF_CHAR = _RNG.integers(0, 1 << 63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.cumprod(np.append(np.uint64(1), np.full(2 * CHUNK, _BASE, np.uint64)), dtype=np.uint64)
_INVERSE = np.cumprod(np.append(np.uint64(1), np.full(2 * CHUNK, pow(_BASE, -1, 1 << 64), np.uint64)), dtype=np.uint64)


class PieceEncoder:
    """Ids of whole texts, by a tokenizer that first cuts them into words, numbers and marks.

    Some hundred thousand characters at a time are cut at once by numpy, where the tokenizer cuts them; each piece is
    known by a 64-bit hash, and only pieces that are not yet in the table of ids go to the tokenizer's model. The table
    holds at most ``limit`` pieces and eight ids for each; when it is full, the half that was not used for the longest
    time goes. Texts with characters of which the two engines may think differently, and texts that hold a special token,
    go through the tokenizer whole. Both ways give the tokenizer's own ids.
    """

    lower = False  # the tokenizer lower-cases
    spaced = True  # it keeps white space and joins a space to the piece behind it; otherwise a digit is a piece of its own

    def __init__(self, path: str, limit: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.limit, self.turn = limit, 0
        self.hashes = np.empty(0, np.uint64)  # ascending; the three below belong to them
        self.first, self.count, self.used = (np.empty(0, np.int32) for _ in range(3))
        self.ids, self.n_ids = np.empty(1 << 16, np.uint32), 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, text: str, end_id: int) -> np.ndarray:
        return next(self.encode_all([text], end_id))

    def encode_all(self, texts: Iterable[str], end_id: int) -> Iterator[np.ndarray]:
        """The ids of each text, in order, and ``end_id`` behind them."""
        held: list[str] = []
        size = 0
        for text in texts:
            plain = not UNSURE.search(text) and not any(s in text for s in self.special)
            if plain and size + len(text) <= CHUNK:
                held.append(text)
                size += len(text)
                continue
            yield from self.encode_chunk(held, end_id)
            held, size = [], 0
            if not plain:
                yield np.append(self.whole(text), np.uint32(end_id))
            elif len(text) <= CHUNK:
                held, size = [text], len(text)
            else:
                parts = [self.encode_chunk([x], end_id)[0] if len(x) <= CHUNK else np.append(self.whole(x), np.uint32(end_id)) for x in cut_text(text)]
                yield np.concatenate([*(x[:-1] for x in parts[:-1]), parts[-1]])
        yield from self.encode_chunk(held, end_id)

    def encode_chunk(self, texts: list[str], end_id: int) -> list[np.ndarray]:
        if not texts:
            return []
        joined = END.join(texts).lower() + END if self.lower else END.join(texts) + END
        c = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = KINDS[c]
        starts = np.flatnonzero(self.starts(c, kind))
        ends = np.append(starts[1:], len(c))
        if not self.spaced:
            kept = kind[starts] != WHITE
            starts, ends = starts[kept], ends[kept]
        sums = np.append(np.uint64(0), np.cumsum(_OF_CHAR[c] * _POWERS[: len(c)], dtype=np.uint64))
        hashes = (sums[ends] - sums[starts]) * _INVERSE[starts] ^ (ends - starts).astype(np.uint64)
        for k in np.flatnonzero(ends - starts > LONGEST).tolist():  # where a polynomial could be led astray
            hashes[k] = int.from_bytes(hashlib.blake2b(joined[starts[k] : ends[k]].encode(), digest_size=8).digest(), "little")
        at = self.look_up(hashes, starts, ends, joined)
        count, first = self.count[at], self.first[at]
        stops = np.cumsum(count)
        ids = self.ids[np.repeat(first - stops + count, count) + np.arange(stops[-1])]
        finals = stops[kind[starts] == ENDING]
        ids[finals - 1] = end_id
        return np.split(ids, finals[:-1])

    def starts(self, c: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Whether a piece begins at each place."""
        before = np.append(np.uint8(ENDING), kind[:-1])
        out = (kind != before) | (kind == ENDING)
        if self.spaced:
            white = kind == WHITE
            spaces = (c == SPACE)[:-1] & ~white[1:] & (kind[1:] != ENDING)  # each goes with the piece behind it
            out[1:][spaces] = False
            final = white[:-1] & ~white[1:] & (kind[1:] != ENDING)  # of several the last stands alone or goes with the next
            out[:-1] |= final
        else:
            out |= kind == DIGIT
        marks = np.flatnonzero(c == APOSTROPHE)
        if len(marks):
            bare = (before[marks] != OTHER) | (marks == 0)
            if self.spaced:
                bare &= np.append(np.uint32(0), c)[marks] != SPACE
            padded = np.append(c, np.zeros(3, np.uint32))
            one, two = padded[marks + 1], padded[marks + 2]
            short = np.isin(one, CONTRACTED_ONE) & bare
            long = bare & np.isin(one << 8 | two, CONTRACTED_TWO) & (two < 256)
            for n, found in ((2, marks[short]), (3, marks[long])):
                out[found] = True
                out[found + 1] = False
                out[found + n] = True
        return out

    def look_up(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, joined: str) -> np.ndarray:
        """The place of each piece in the table; pieces that are not there are added."""
        distinct, some, which = np.unique(hashes, return_index=True, return_inverse=True)
        self.turn += 1
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == distinct[inside]
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.hashes) + len(new) > self.limit or self.n_ids > 8 * self.limit:
                self.forget()
                return self.look_up(hashes, starts, ends, joined)
            made = [self.make(joined[a:b]) for a, b in zip(starts[some[new]].tolist(), ends[some[new]].tolist(), strict=True)]
            count = np.fromiter(map(len, made), np.int32, len(made))
            total = int(count.sum())
            while self.n_ids + total > len(self.ids):
                self.ids = np.append(self.ids, np.empty_like(self.ids))
            self.ids[self.n_ids : self.n_ids + total] = np.fromiter(itertools.chain.from_iterable(made), np.uint32, total)
            first = self.n_ids + np.cumsum(count) - count
            self.n_ids += total
            self.hashes = np.insert(self.hashes, at[new], distinct[new])
            self.first, self.count = np.insert(self.first, at[new], first), np.insert(self.count, at[new], count)
            self.used = np.insert(self.used, at[new], 0)
            at = at + np.cumsum(~known) - ~known
        self.used[at] = self.turn
        return at[which]

    def forget(self) -> None:
        """Keeps the half of the table that was used last, or nothing if one chunk has filled it."""
        kept = self.used > np.median(self.used) if len(self.used) else np.empty(0, bool)
        first, count = self.first[kept], self.count[kept]
        stops = np.cumsum(count)
        total = int(stops[-1]) if len(stops) else 0
        ids = self.ids[np.repeat(first - stops + count, count) + np.arange(total)]
        self.ids, self.n_ids = np.append(ids, np.empty(1 << 16, np.uint32)), total
        self.hashes, self.used, self.count, self.first = self.hashes[kept], self.used[kept], count, (stops - count).astype(np.int32)

    def make(self, piece: str) -> list[int]:
        if piece == END:
            return [0]
        plain = piece.isascii() and piece.isalnum()
        return [t.id for t in self.model.tokenize(piece if plain else piece.encode().decode("latin-1").translate(BYTE_LETTERS))]


def cut_text(text: str) -> Iterator[str]:
    """A long text in parts of at most CHUNK characters, cut before single spaces; longer parts where there are none."""
    at = 0
    while len(text) - at > CHUNK:
        to = at + CHUNK
        while to > at and not (text[to] == " " and not text[to - 1].isspace() and not text[to + 1 : to + 2].isspace()):
            to -= 1
        if to == at:
            found = re.compile(r"(?<=\S) (?=\S)").search(text, at + CHUNK)
            to = found.start() if found else len(text)
        yield text[at:to]
        at = to
    if at < len(text) or not text:
        yield text[at:]


class WordEncoder(PieceEncoder):
    """For a tokenizer that lower-cases and drops white space; digits are pieces of their own."""

    lower, spaced = True, False


_ENCODERS: dict[tuple, PieceEncoder] = {}


def encoder_of(kind: type[PieceEncoder], path: str) -> PieceEncoder:
    """The worker's encoder, kept from one task to the next; one at a time, so that a worker never holds two."""
    if (kind, path) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[kind, path] = kind(path)
    return _ENCODERS[kind, path]


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """A block of uint32 ids as planes: all first bytes, all second bytes and so on, or the same by bits."""
    if bits:
        spread = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        return [np.packbits(spread[:, k], bitorder="little").tobytes() for k in range(32)]
    return [np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, k]).tobytes() for k in range(4)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 32:
        spread = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        return np.packbits(spread, axis=1, bitorder="little").view("<u4").ravel()
    return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)).view("<u4").ravel()


def write_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: bool = False, block: int = BLOCK) -> bytes:
    pack = zstandard.ZstdCompressor(level=3)
    planes = [pack.compress(p) for at in range(0, len(ids), block) for p in to_planes(ids[at : at + block], bits)]
    index = (
        np.array(lengths, "<u4").tobytes()
        + np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes()
        + np.array([x is not None for x in doc_ids], np.uint8).tobytes()
        + np.array([len(p) for p in planes], "<u4").tobytes()
    )
    footer = FOOTER.pack(len(doc_ids), len(ids), block, int(bits), 32 if bits else 4)
    return b"".join([MAGIC, *planes, index, footer])


def read_segment(data: bytes) -> tuple[list[int | None], np.ndarray, Iterator[np.ndarray]]:
    """Document ids, their lengths, and the blocks of ids in order."""
    if data[:4] != MAGIC:
        raise ValueError("not a token segment")
    n_docs, n_ids, block, _, per_block = FOOTER.unpack(data[-FOOTER.size :])
    n_planes = -(-n_ids // block) * per_block
    at = len(data) - FOOTER.size - 4 * n_planes
    sizes = np.frombuffer(data, "<u4", n_planes, at)
    at -= n_docs
    valid = np.frombuffer(data, np.uint8, n_docs, at)
    at -= 8 * n_docs
    doc_ids = np.frombuffer(data, "<i8", n_docs, at)
    at -= 4 * n_docs
    lengths = np.frombuffer(data, "<u4", n_docs, at)
    ends = 4 + np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])

    def blocks() -> Iterator[np.ndarray]:
        unpack = zstandard.ZstdDecompressor()
        for b in range(n_planes // per_block):
            ks = range(b * per_block, (b + 1) * per_block)
            yield from_planes([unpack.decompress(data[ends[k] : ends[k + 1]]) for k in ks], min(block, n_ids - b * block))

    return [int(x) if v else None for x, v in zip(doc_ids, valid, strict=True)], lengths, blocks()


def write_tokens(documents: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, bits: bool = False) -> None:
    """Encodes all documents, each followed by ``end_id``, in ascending doc_id order, into the segment table at ``path``."""
    spark = documents.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, part, seq, first = encoder_of(WordEncoder, tokenizer), TaskContext.get().partitionId(), itertools.count(), 0
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def segment() -> pd.DataFrame:
            payload = write_segment(doc_ids, lengths, np.concatenate(held), bits)
            return pd.DataFrame([(part, next(seq), first, len(doc_ids), size, payload)], columns=["part", "seq", "first", "n_docs", "n_ids", "payload"])

        for batch in batches:
            made_all = encoder.encode_all(batch["text"], end_id)
            for doc_id, null_id, made in zip(batch["doc_id"].tolist(), batch["null_id"].tolist(), made_all, strict=True):
                doc_ids.append(None if null_id else int(doc_id))
                lengths.append(len(made))
                held.append(made)
                size += lengths[-1]
                if size >= SEGMENT:
                    yield segment()
                    first += size
                    doc_ids, lengths, held, size = [], [], [], 0
        if doc_ids:
            yield segment()

    rows = documents.select(
        F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"),
        F.col("doc_id").isNull().alias("null_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    keys = [F.desc("null_id"), F.asc("doc_id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ordered.mapInPandas(encode, SEGMENTS).write.mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the segment table.

    The ids before a segment are those of the earlier parts plus those earlier in its part; only one total for each
    part comes to the driver, which is as many rows as the write had partitions.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    totals = sorted(segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    starts = dict(zip([r["part"] for r in totals], itertools.accumulate([0, *[r["n"] for r in totals]]), strict=False))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, first, payload in zip(batch["part"], batch["first"], batch["payload"], strict=True):
                doc_ids, lengths, blocks = read_segment(payload)
                ends = np.cumsum(lengths, dtype=np.int64)
                begins = ends - lengths
                crcs = np.zeros(len(doc_ids), np.int64)
                d, at = 0, 0
                for ids in blocks:  # one block at a time; a document may span several
                    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                    stop = at + len(ids)
                    while d < len(doc_ids) and begins[d] < stop:
                        lo, hi = max(begins[d], at) - at, min(ends[d], stop) - at
                        crcs[d] = zlib.crc32(raw[4 * lo : 4 * hi], int(crcs[d]))
                        if ends[d] > stop:
                            break
                        d += 1
                    at = stop
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(doc_ids, dtype="Int64"),
                        "start": starts[part] + first + begins,
                        "n_tokens": lengths.astype(np.int64),
                        "ids_crc32": crcs,
                    }
                )

    return segments.select("part", "first", "payload").mapInPandas(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, path)
