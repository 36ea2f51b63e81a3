"""Packing documents into training sequences by an order-preserving dynamic programme.

Each partition's documents form one stream of ids, in the order in which they are read. The stream is cut into windows
of at most ``SEQUENCE`` ids. A window costs its padding and ``START``; a cut costs nothing behind a document,
``SENTENCE_CUT`` behind a sentence and ``BREAK`` inside one, all in pad ids. With f(j) the least cost of a packing that
ends at position j,

    f(j) = cut(j) + START + min over i in [j - SEQUENCE, j) of f(i) + pad(j - i),    pad(n) = SEQUENCE - n,

so i with the least f(i) + i is best for j, and the minimum over the sliding range comes from a monotone queue that each
place enters and leaves once. Of the positions inside sentences only those one full window behind the head of the queue
can matter: while the head stays the same, all of them have the same f(j) + j, and the last one stays in reach longest.
So the programme visits the ends of documents and sentences and these places, and is exact all the same.

A window whose length is a smaller power of two needs no padding. Such windows are offered between ends of documents or
sentences; cutting inside a sentence for one never is.

The stream is packed in stretches of a bounded length. All best ways to the places of a stretch's last window come from
one cut before it, up to which the packing of the whole stream is settled; what follows is carried over to the next
stretch. Only the last window of a partition is left short without need. Nothing is shuffled, and a lost task packs its
partition again with the same result.

Edge cases: null and empty texts are a document of the end id alone; a document longer than a window is cut into
pieces; rows of equal id are documents of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import small_batches, table
from docloom.llm.token_files import BYTE_LETTERS, PieceEncoder, encoder_of

SEQUENCE = 1024
END_ID = 0
SENTENCE_CUT, BREAK, START = 1.0, 48.0, 12.0
STRETCH = 1 << 17
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Marks behind which a sentence ends if white space follows, with closing ones behind them; and marks that need none.
MARKED, ALONE = re.compile("[.!?\u2026][\"')\\]\u201d\u2019]*$"), re.compile("[\n\u3002\uff01\uff1f]$")


class SentenceEnds:
    """Behind which ids of a document a sentence ends."""

    def __init__(self, tokenizer):
        self.marked, self.alone, self.spaced = np.zeros((3, tokenizer.get_vocab_size()), bool)
        bytes_of = {c: b for b, c in BYTE_LETTERS.items()}
        for token, i in tokenizer.get_vocab().items():
            text = bytes(bytes_of.get(c, 63) for c in token).decode("utf-8", "replace")
            self.marked[i], self.alone[i] = bool(MARKED.search(text)), bool(ALONE.search(text))
            self.spaced[i] = text[:1].isspace()

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        """Ascending positions in (0, len(ids))."""
        return 1 + np.flatnonzero(self.alone[ids[:-1]] | (self.marked[ids[:-1]] & self.spaced[ids[1:]]))


def choose_cuts(total: int, cheap: np.ndarray, costs: np.ndarray, last: bool, size: int = SEQUENCE) -> list[int]:
    """Cut positions in (0, total] of the cheapest packing of a stream of ``total`` ids.

    cheap: ascending positions in (0, total] at which a cut costs ``costs``, the last of them ``total``; at others it
    costs ``BREAK``. last: the stream ends at ``total``; otherwise the cuts end at the last cheap place through which the
    cheapest packing goes whatever follows, or at ``total`` if there is none.
    """
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])  # f(i) + i and i, both ascending
    came: dict[int, int] = {}
    at: dict[int, float] = {0: 0.0}  # f of the cheap places
    full = size + START
    short, pairs = _shorter_windows(total, cheap, size), 0
    short.append((total + 1, 0))

    def break_at(place: int) -> None:
        key, came[place] = queue[0]
        queue.append((key + full + BREAK, place))  # the last of all: no key of the queue is as large

    for j, cost in zip(cheap.tolist(), costs.tolist(), strict=True):
        if queue[0][1] + size < j:
            gone = [queue.popleft()]
            while queue and queue[0][1] + size < j:
                gone.append(queue.popleft())
            # places inside sentences behind a head that leaves are not needed if j has a smaller key than any of them
            if not queue or queue[0][0] + cost > gone[0][0] + BREAK:
                queue.extendleft(reversed(gone))
                while (place := queue[0][1] + size) < j:
                    if place not in came:
                        while queue[-1][0] >= queue[0][0] + full + BREAK:
                            queue.pop()
                        break_at(place)
                    queue.popleft()
        key, i = queue[0]
        value = key - j + full + cost
        while short[pairs][0] <= j:
            before = short[pairs][0] - short[pairs][1]
            if (other := at[before] + START + cost) < value:
                value, i = other, before
            pairs += 1
        at[j], came[j] = value, i
        key = value + j
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    end = total
    if not last:  # from the places of the last window back to the one that all of them come from
        heap = sorted(-j for j in came if j > total - size)
        live = set(heap)
        while len(heap) > 1:
            if (i := -came[-heappop(heap)]) not in live:
                live.add(i)
                heappush(heap, i)
        end = -heap[0]
        while end not in at:
            end = came[end]
        end = end or total
    cuts = []
    while end:
        cuts.append(end)
        end = came[end]
    return cuts[::-1]


def _shorter_windows(total: int, cheap: np.ndarray, size: int) -> list[tuple[int, int]]:
    """End and length of the windows between cheap places, or the begin and one, that a smaller power of two is long."""
    marked = np.zeros(total + 1, bool)
    marked[cheap] = marked[0] = True
    found = []
    for k in range(1, size.bit_length()):
        n = size >> k
        ends = cheap[cheap >= n]
        ends = ends[marked[ends - n]]
        found.append(np.stack([ends, np.full(len(ends), n)], axis=1))
    pairs = np.concatenate(found) if found else np.empty((0, 2), np.int64)
    return [*map(tuple, pairs[np.argsort(pairs[:, 0], kind="stable")].tolist())]


class Packer:
    """Packs a stream of documents; ``add`` and ``finish`` give the pieces that are settled."""

    def __init__(self, ends: Callable[[np.ndarray], np.ndarray], size: int = SEQUENCE, stretch: int = STRETCH):
        self.ends, self.size, self.stretch = ends, size, stretch
        #: Of each held document: its id, ids before these, ids, all its ids, and the sentence ends among these.
        self.docs: list[tuple[object, int, np.ndarray, int, np.ndarray]] = []
        self.held = 0
        self.sequence = 0

    def add(self, doc_id, ids: np.ndarray) -> list[tuple]:
        self.docs.append((doc_id, 0, ids, len(ids), self.ends(ids)))
        self.held += len(ids)
        return self.pack(False) if self.held >= self.stretch else []

    def finish(self) -> list[tuple]:
        return self.pack(True) if self.held else []

    def pack(self, last: bool) -> list[tuple]:
        doc_ends = np.cumsum([len(d[2]) for d in self.docs])
        total = int(doc_ends[-1])
        cost = np.full(total + 1, np.inf)
        cost[np.concatenate([d[4] + end - len(d[2]) for d, end in zip(self.docs, doc_ends, strict=True)])] = SENTENCE_CUT
        cost[doc_ends] = 0.0
        cheap = np.flatnonzero(np.isfinite(cost))
        cuts = choose_cuts(total, cheap, cost[cheap], last, self.size)
        out, d, doc_start = [], 0, 0
        begin = 0
        for end in cuts:
            at = begin
            while at < end:
                doc_id, before, own, whole, _ = self.docs[d]
                stop = min(end, doc_start + len(own))
                piece = own[at - doc_start : stop - doc_start]
                crc = zlib.crc32(piece.tobytes())
                out.append((doc_id, before + at - doc_start, len(piece), crc, whole, self.sequence, at - begin))
                at = stop
                if stop == doc_start + len(own):
                    doc_start += len(own)
                    d += 1
            self.sequence += 1
            begin = end
        rest = self.docs[d:]
        if rest and begin > doc_start:
            doc_id, before, own, whole, ends = rest[0]
            gone = begin - doc_start
            rest[0] = (doc_id, before + gone, own[gone:], whole, ends[ends > gone] - gone)
        self.docs, self.held = rest, total - begin
        return out


def pack(documents: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents: where each lies in its document and in its sequence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(PieceEncoder, tokenizer)
        packer = Packer(SentenceEnds(encoder.tokenizer))
        packer.sequence = TaskContext.get().partitionId() << 36
        names = [x.split()[0] for x in PIECES.split(", ")]

        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=names)
            out["doc_id"] = pd.array(out["doc_id"].tolist(), dtype="Int64")
            return out

        for batch in batches:
            rows: list[tuple] = []
            made = encoder.encode_all(batch["text"], end_id)
            for doc_id, null_id, ids in zip(batch["doc_id"].tolist(), batch["null_id"].tolist(), made, strict=True):
                rows += packer.add(None if null_id else int(doc_id), ids)
                if len(rows) > 20_000:
                    yield frame(rows)
                    rows = []
            if rows:
                yield frame(rows)
        if rows := packer.finish():
            yield frame(rows)

    small_batches(documents.sparkSession)
    return documents.select(
        F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"),
        F.col("doc_id").isNull().alias("null_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).mapInPandas(run, PIECES)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
