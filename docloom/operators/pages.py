"""Pages of chunks, by one pass over the chunks of each document behind the parser's blocks of the same document.

A block speaks for a chunk if it lies in it, or if both begin alike; white space never counts. The page of the block that
speaks loudest is the chunk's, widened by the pages of all blocks whose beginning the chunk holds. Chunks and blocks are
dealt out by document, each text once, and sorted so that a task meets a document's blocks first and its chunks one by one
after them. It holds the blocks of one document, by their beginnings and in order, and looks up the places of a chunk there,
so no chunk meets all blocks and no pair of both is ever written.
"""

from __future__ import annotations

import os
from bisect import bisect_left, bisect_right
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from docloom.operators.tables import HELD, PREFIX, PROBE
from docloom.plans.registry import query
from docloom.session import small_batches, table
from docloom.sources.scratch import stored


def bare(text: Column) -> Column:
    """The text without white space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")


def _wider(a: tuple | None, b: tuple | None) -> tuple | None:
    """The span of pages over both; None is none."""
    return (min(a[0], b[0]), max(a[1], b[1])) if a and b else a or b


def _slots(text: str, bits: int, step: int = 1) -> np.ndarray:
    """For the HELD characters from every ``step``-th place on, a slot among 2 to the power of ``bits``."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    found = np.zeros(max(0, len(codes) - HELD + 1), np.uint32)
    for k in range(HELD):
        found = (found + codes[k : k + len(found)]) * np.uint32(0x9E3779B1)
    return found[::step] >> np.uint32(32 - bits)


class _Blocks:
    """Blocks (text, block_no, page) of a document; equal texts are one, for which the smallest block_no decides."""

    def __init__(self, rows) -> None:
        self.texts, self.probes, self.heads, self.longer, self.least = {}, {}, {}, {}, {}
        spans: dict = {}
        for text, no, page in rows:
            place = -no, page is not None, page
            self.texts[text] = max(self.texts.get(text, place), place)
            spans[text[:PROBE]] = _wider(spans.get(text[:PROBE]), None if page is None else (page, page))
        self.order = sorted(self.texts)
        for probe in sorted(spans, key=len):  # what holds a beginning holds the shorter ones that it begins with
            sizes = self.heads.setdefault(probe[:HELD], [])
            span, whole = next((self.probes[probe[:n]] for n in sizes if probe[:n] in self.probes), (None, (0,)))
            whole = (len(probe), self.texts[probe]) if probe in self.texts else whole
            self.probes[probe] = _wider(span, spans[probe]), whole
            if not sizes or sizes[0] != len(probe):
                sizes.insert(0, len(probe))  # longest first
        self.bits = min(24, len(self.heads).bit_length() + 8)
        self.taken = np.zeros(1 << self.bits, bool)  # the slots of the heads tell most places of a chunk apart from them at once
        self.taken[_slots("".join(self.heads), self.bits, HELD)] = True
        for text in sorted((t for t in self.texts if len(t) > PROBE), key=len):
            sizes = self.longer.setdefault(text[:PROBE], [])
            if not sizes or sizes[-1] != len(text):
                sizes.append(len(text))

    def speak(self, chunk: str) -> tuple[tuple, tuple | None]:
        """(score, place) of the block that speaks loudest, (0,) if none does, and the span of those whose beginning is held."""
        best, span, heads = self._alike(chunk), None, self.heads
        for i in np.flatnonzero(self.taken[_slots(chunk, self.bits)]).tolist():
            probe = next((p for n in heads.get(chunk[i : i + HELD], ()) if (p := chunk[i : i + n]) in self.probes), None)
            if probe is None:
                continue
            held, whole = self.probes[probe]
            best, span = max(best, whole), _wider(span, held)
            sizes = self.longer.get(probe, ())
            for n in reversed(sizes[: bisect_right(sizes, len(chunk) - i)]):
                if n < best[0]:
                    break
                if (text := chunk[i : i + n]) in self.texts:
                    best = max(best, (n, self.texts[text]))
        return best, span

    def _alike(self, chunk: str) -> tuple:
        """(score, place) of the block that shares the longest beginning with the chunk; its neighbours in order tell how long."""
        at = bisect_left(self.order, chunk)
        shared = max((len(os.path.commonprefix([chunk, t])) for t in self.order[max(at - 1, 0) : at + 1]), default=0)
        if shared < max(HELD, min(PREFIX, len(chunk))):
            return (0,)
        first = bisect_left(self.order, chunk[:shared])
        last = bisect_right(self.order, chunk[:shared], first, key=lambda t: t[:shared])
        if (first, last) not in self.least:
            self.least[first, last] = max(self.texts[t] for t in islice(self.order, first, last))
        return shared, self.least[first, last]


def _attributed(batches):
    """Rows (doc_id, chunk_no, text, block_no, page), the blocks of a document first: first and last page of its chunks."""
    schema = None

    def made(rows):
        fields = [schema.field(n) for n in ("doc_id", "chunk_no", "page", "page")]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], ["doc_id", "chunk_no", "first_page", "last_page"])

    def read():
        nonlocal schema
        for batch in batches:
            schema = batch.schema
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    out = []
    for doc_id, own in groupby(read(), lambda r: r[0]):
        blocks = _Blocks(())
        for (chunk, no), rows in groupby(own, lambda r: (r[3] is None, r[1])):
            if not chunk:
                blocks = _Blocks((text, block_no, page) for _, _, text, block_no, page in rows)
                continue
            best, span, n = (0,), None, 0
            for _, _, text, _, _ in rows:  # rows of one number are one chunk
                found, held = blocks.speak(text)
                best, span, n = max(best, found), _wider(span, held), n + 1
            pages = [p for p in (best[1][2], *(span or ())) if p is not None] if best[0] else []
            out += [(doc_id, no, min(pages, default=0), max(pages, default=0))] * n
            if len(out) >= 10_000:
                yield made(out)
                out = []
    if out:
        yield made(out)


def attribute_pages(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, chunk_no, first_page, last_page for chunks (doc_id, chunk_no, content); 0 and 0 where no block speaks.

    blocks: doc_id, block_no, page, text. Of equal scores the block with the smallest number decides. The result is written
    once, as reading it twice would match the texts twice.
    """
    small_batches(chunks.sparkSession)
    c = chunks.select("doc_id", "chunk_no", bare(F.col("content")).alias("text"))
    b = blocks.select("doc_id", "block_no", "page", bare(F.col("text")).alias("text")).where((F.length("text") >= HELD) & F.col("doc_id").isNotNull() & F.col("block_no").isNotNull())
    rows = c.unionByName(b, allowMissingColumns=True).select("doc_id", "chunk_no", "text", "block_no", "page")
    dealt = rows.repartition("doc_id").sortWithinPartitions("doc_id", F.col("block_no").isNull(), "chunk_no")
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = StructType([StructField(n, kinds[k]) for n, k in (("doc_id", "doc_id"), ("chunk_no", "chunk_no"), ("first_page", "page"), ("last_page", "page"))])
    return stored(dealt.mapInArrow(_attributed, schema), "pages")


SIZE, LINES = 600, 3  # characters of a chunk and lines of a page in the query


@query(
    "page_attribution",
    rf"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS block_no FROM documents),
b AS (SELECT doc_id, block_no, block_no // {LINES} + 1 AS page, regexp_replace(t, '\s+', '', 'g') AS b FROM l WHERE length(regexp_replace(t, '\s+', '', 'g')) >= {HELD}),
k AS (SELECT doc_id, text, unnest(range(0, greatest(1, ceil(length(text) / {SIZE}::DOUBLE)::INT))) AS chunk_no FROM documents),
c AS (SELECT doc_id, chunk_no, regexp_replace(substring(coalesce(text, ''), chunk_no * {SIZE} + 1, {SIZE}), '\s+', '', 'g') AS c FROM k),
p AS (SELECT doc_id, chunk_no, block_no, page, c, b, contains(c, substring(b, 1, {PROBE})) AS holds,
  CASE WHEN substring(c, 1, {HELD}) <> substring(b, 1, {HELD}) THEN 0 ELSE coalesce(list_sum(list_transform(range(1, least(length(c), length(b)) + 1), lambda n: (substring(c, 1, n) = substring(b, 1, n))::INT)), 0) END AS shared
  FROM c JOIN b USING (doc_id)),
s AS (SELECT *, CASE WHEN contains(c, b) THEN length(b) WHEN shared >= {PREFIX} OR shared >= greatest({HELD}, length(c)) THEN shared ELSE 0 END AS score FROM p),
f AS (SELECT doc_id, chunk_no, arg_max(page, (score, -block_no)) FILTER (score > 0) AS page, min(page) FILTER (holds) AS lo, max(page) FILTER (holds) AS hi FROM s GROUP BY ALL)
SELECT c.doc_id, c.chunk_no, coalesce(least(page, coalesce(lo, page)), 0)::INT AS first_page, coalesce(greatest(page, coalesce(hi, page)), 0)::INT AS last_page FROM c LEFT JOIN f ON f.doc_id = c.doc_id AND f.chunk_no = c.chunk_no AND page IS NOT NULL""",
)
def q_pages(spark, sf_dir):
    """Lines stand for the parser's blocks, three to a page; chunks are cut without regard to them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_no", "text"))
    blocks = lines.withColumn("page", F.floor(F.col("block_no") / LINES).cast("int") + 1)
    cut = F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{SIZE}}}"), F.lit(0)))
    chunks = docs.select("doc_id", F.posexplode(cut).alias("chunk_no", "content"))
    return attribute_pages(chunks.withColumn("chunk_no", F.col("chunk_no").cast("long")), blocks)
