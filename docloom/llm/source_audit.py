"""How far the sources of each language diverge in the terms that they use, counted in mergeable radix tries.

Terms are runs of ASCII letters and characters outside ASCII, A-Z lower-cased. With count the occurrences of a kept term (one
in at least ``MIN_DOCS`` documents of the language), N their sum over the V kept terms, a side's probability of a term in
parts per billion is p = 1 + floor(10**9 * (count + 1) / (N + V)), and f = floor((p - q)**2 / q) is what the term adds to
the divergence of p from q. Everything is whole numbers.

1. Count. Each task counts occurrences by source and documents for each language. At ``FLUSH`` counters, and at the end of the
   partition, these are laid out as a byte trie: leaves in byte order, each with a counter for each of its sources, cut into a
   cell of compressed arrays for each two-byte prefix. So a task's memory is bounded whatever the vocabulary.
2. Merge by prefix range. Neighbouring prefixes form ranges of some ``LEAVES`` leaves, from their sums over all cells; each
   range is one group, whose tries are merged into one radix trie. A range that has more (very many tasks met one frequent word) is merged
   in salted groups first, which is what makes a third of all rows in one source or one term harmless: a cell holds each
   (term, source) once, however often it occurs. Terms in too few documents are dropped here, where counts are complete.
3. Totals. N by source and V by language are sums over the merged ranges. Groups number as many as sources; the result has
   a row for each pair of them, so they are sent to all tasks, at most ``GROUPS`` at a time: beyond that the languages are
   taken in slices.
4. Traversal. The merged tries are read in UTF-8 order. Each task adds up f by pair of sources and keeps the first ``TOP``
   terms of each source, ties in UTF-8 order; Spark sums the pairs and ranks what the tasks kept.

Edge cases: null text, lang and source count as ''; a group without terms takes part with counts of 0; a language without
kept terms has pairs of value 0 and no terms; a language with one source has no pairs; repeated rows are documents of their
own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.blobs import pack, unpack
from docloom.llm.common import Scratch, small_batches, table

TERM = re.compile(rb"[a-z\x80-\xff]+")  # of lower-cased UTF-8
MIN_DOCS = 3
SCALE = 1_000_000_000
TOP = 200
PREFIX = 2
FLUSH = 800_000  # counters that a task holds
LEAVES = 200_000
GROUPS = 200_000
DENSE = 1 << 20  # cells of a matrix of terms and sources
CELLS = "lang string, prefix binary, n long, sources array<string>, terms binary, docs binary, degree binary, source binary, counts binary"
NAMES = [x.split()[0] for x in CELLS.split(", ")]
MERGED = "lang string, n long, sources array<string>, sums array<long>, terms binary, degree binary, source binary, counts binary"
OF_DOCUMENTS = -1  # key of a leaf's number of documents, beside its sources'


class Trie:
    """A radix trie of bytes. A node is its label, its children by first byte, and its leaf's counters or None."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]
        self.size = 0

    def leaf(self, term: bytes) -> dict[int, int]:
        """The counters of a term; new and empty if it wasn't there."""
        node, at = self.root, 0
        while at < len(term):
            kids, first = node[1], term[at]
            kid = kids.get(first)
            if kid is None:
                node = kids[first] = [term[at:], {}, None]
                break
            label = kid[0]
            if not term.startswith(label, at):
                k = 1
                while at + k < len(term) and term[at + k] == label[k]:
                    k += 1
                kids[first] = middle = [label[:k], {label[k]: kid}, None]
                kid[0] = label[k:]
                kid = middle
            node, at = kid, at + len(kid[0])
        if node[2] is None:
            node[2] = {}
            self.size += 1
        return node[2]

    def walk(self) -> Iterator[tuple[bytes, dict[int, int]]]:
        """Terms and counters in byte order, which is that of UTF-8."""
        stack = [(b"", self.root)]
        while stack:
            before, node = stack.pop()
            term = before + node[0]
            if node[2] is not None:
                yield term, node[2]
            stack += [(term, node[1][k]) for k in sorted(node[1], reverse=True)]


def _cell(lang: str, prefix: bytes, terms: list[bytes], docs: np.ndarray, degree: np.ndarray, source: np.ndarray, counts: np.ndarray, names: list[str]) -> tuple:
    """Leaves of one prefix in byte order as compressed arrays, with the sources that occur there."""
    used, place = np.unique(source, return_inverse=True)
    return (lang, prefix, len(terms), [names[s] for s in used.tolist()], b"\n".join(terms), *map(pack, (docs, degree, place, counts)))


def _leaf_arrays(leaves: list[tuple[bytes, dict[int, int]]]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, documents, number of sources, sources and counts of leaves."""
    docs = [leaf.pop(OF_DOCUMENTS) for _, leaf in leaves]
    source, counts = [s for _, leaf in leaves for s in leaf], [n for _, leaf in leaves for n in leaf.values()]
    return [t for t, _ in leaves], *(np.array(x, np.int64) for x in (docs, [len(leaf) for _, leaf in leaves], source, counts))


def _cells(lang: str, trie: Trie, names: list[str]) -> Iterator[tuple]:
    for prefix, leaves in groupby(trie.walk(), key=lambda x: x[0][:PREFIX]):
        yield _cell(lang, prefix, *_leaf_arrays([*leaves]), names)


def _laid_out(lang: str, docs: Counter, by_source: dict[str, Counter]) -> Iterator[tuple]:
    """The trie of a language as cells: its leaves in byte order, where an inner node is the range under its prefix."""
    terms, names = sorted(docs), [*by_source]
    place = {t: i for i, t in enumerate(terms)}
    leaf = np.concatenate([np.fromiter(map(place.__getitem__, c), np.int64, len(c)) for c in by_source.values()])
    counts = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in by_source.values()])
    source = np.repeat(np.arange(len(names)), [*map(len, by_source.values())])
    order = np.lexsort((source, leaf))
    counts, source = counts[order], source[order]
    degree = np.bincount(leaf, minlength=len(terms))
    first = np.append(0, np.cumsum(degree))
    of_docs = np.fromiter(map(docs.__getitem__, terms), np.int64, len(terms))
    a = 0
    for prefix, same in groupby(terms, key=lambda t: t[:PREFIX]):
        b = a + sum(1 for _ in same)
        own = slice(first[a], first[b])
        yield _cell(lang, prefix, terms[a:b], of_docs[a:b], degree[a:b], source[own], counts[own], names)
        a = b


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    docs: dict[str, Counter] = defaultdict(Counter)
    found: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))

    def flushed() -> pd.DataFrame:
        rows = [row for lang, by_source in found.items() for row in _laid_out(lang, docs[lang], by_source)]
        docs.clear(), found.clear()
        return pd.DataFrame(rows, columns=NAMES)

    for batch in batches:
        for text, lang, source in zip(batch["text"], batch["lang"], batch["source"], strict=True):
            terms = TERM.findall(text.encode().lower())
            if terms:
                found[lang][source].update(terms)
                docs[lang].update(set(terms))
        if sum(len(c) for by_source in found.values() for c in by_source.values()) >= FLUSH:
            yield flushed()
    yield flushed()


def _merged_trie(cells: pd.DataFrame) -> tuple[Trie, list[str]]:
    trie, sources = Trie(), {}
    for c in cells.itertuples():
        place = [sources.setdefault(s, len(sources)) for s in c.sources]
        numbers = zip([place[i] for i in unpack(c.source).tolist()], unpack(c.counts).tolist(), strict=True)
        for term, docs, degree in zip(c.terms.split(b"\n"), unpack(c.docs).tolist(), unpack(c.degree).tolist(), strict=True):
            leaf = trie.leaf(term)
            leaf[OF_DOCUMENTS] = leaf.get(OF_DOCUMENTS, 0) + docs
            for _ in range(degree):
                s, n = next(numbers)
                leaf[s] = leaf.get(s, 0) + n
    return trie, [*sources]


def _merge_some(cells: pd.DataFrame) -> pd.DataFrame:
    """Cells of one salted group as cells again."""
    trie, names = _merged_trie(cells)
    return pd.DataFrame(_cells(cells["lang"].iloc[0], trie, names), columns=NAMES)


def _merge_range(cells: pd.DataFrame) -> pd.DataFrame:
    """The kept terms of a prefix range in UTF-8 order, with the sums of their counts by source."""
    trie, names = _merged_trie(cells)
    leaves = [(t, leaf) for t, leaf in trie.walk() if leaf[OF_DOCUMENTS] >= MIN_DOCS]
    if not leaves:
        return pd.DataFrame(columns=[x.split()[0] for x in MERGED.split(", ")])
    lang, _, n, used, terms, _, degree, source, counts = _cell(cells["lang"].iloc[0], b"", *_leaf_arrays(leaves), names)
    sums = [0] * len(used)
    for s, c in zip(unpack(source).tolist(), unpack(counts).tolist(), strict=True):
        sums[s] += c
    row = {"lang": lang, "n": n, "sources": used, "sums": sums, "terms": terms, "degree": degree, "source": source, "counts": counts}
    return pd.DataFrame([row])


def probability(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """p of each count, total being N + V; in Python's numbers where 64 bits would not do."""
    if len(counts) and counts.max() > 9_000_000_000:
        counts = counts.astype(object)
    return (1 + SCALE * (counts + 1) // total).astype(np.int64)


def _traversal(totals: dict[str, tuple[int, dict[str, int]]]):
    """totals: V, and N by source, of each language."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs: dict[str, np.ndarray] = {}
        best: dict[tuple[str, str], list[tuple[int, bytes]]] = defaultdict(list)

        def keep(group: tuple[str, str], some: list[tuple[int, bytes]]) -> None:
            best[group] += some
            if len(best[group]) > 5 * TOP:
                best[group] = sorted(best[group])[:TOP]

        for batch in batches:
            for c in batch.itertuples():
                v, of_source = totals[c.lang]
                names = [*of_source]
                n = np.array([*of_source.values()], np.int64)
                sums = pairs.setdefault(c.lang, np.zeros((len(names), len(names)), np.int64))
                at = {s: i for i, s in enumerate(names)}
                place = np.array([at[s] for s in c.sources])
                terms, degree = c.terms.split(b"\n"), unpack(c.degree).astype(np.int64)
                column, counts = place[unpack(c.source).astype(np.int64)], unpack(c.counts).astype(np.int64)
                first = np.append(0, np.cumsum(degree))
                step = max(1, DENSE // len(names))
                for a in range(0, len(terms), step):
                    b = min(len(terms), a + step)
                    dense = np.zeros((len(names), b - a), np.int64)
                    dense[column[first[a] : first[b]], np.repeat(np.arange(b - a), degree[a:b])] = counts[first[a] : first[b]]
                    p = probability(dense, (n + v)[:, None])
                    q = probability(dense.sum(axis=0), int(n.sum()) + v)
                    for i, name in enumerate(names):
                        sums[i] += ((p[i] - p) ** 2 // p).sum(axis=1)
                        above = np.flatnonzero((dense[i] > 0) & (p[i] > q))
                        value = (p[i, above] - q[above]) ** 2 // q[above]
                        order = np.argsort(-value, kind="stable")[:TOP]
                        keep((c.lang, name), [(-int(value[k]), terms[a + above[k]]) for k in order.tolist()])
        rows = []
        for lang, sums in pairs.items():
            names = [*totals[lang][1]]
            rows += [(lang, x, "pair", y, int(sums[i, j])) for i, x in enumerate(names) for j, y in enumerate(names) if i != j]
        for (lang, source), some in best.items():
            rows += [(lang, source, "term", term.decode(), -value) for value, term in sorted(some)[:TOP]]
        yield pd.DataFrame(rows, columns=["lang", "source", "part", "item", "value"])

    return run


def merged_terms(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """One row for each language and prefix range: its kept terms and their counts by source."""
    cells = scratch.stored(documents.mapInPandas(_counted, CELLS), "tries")
    by_prefix = cells.groupBy("lang", "prefix").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("prefix")) - F.col("n")  # at most 65,536 prefixes of a language
    ranges = by_prefix.withColumn("range", (before / LEAVES).cast("long"))
    salts = F.ceil(F.sum("n").over(Window.partitionBy("lang", "range")) / (4 * LEAVES)).cast("int")
    ranges = scratch.stored(ranges.withColumn("salts", salts).select("lang", "prefix", "range", "salts"), "ranges")
    dealt = cells.join(ranges, ["lang", "prefix"])
    heavy = ranges.where("salts > 1")
    if not heavy.isEmpty():
        salted = dealt.where("salts > 1").withColumn("salt", F.pmod(F.xxhash64("terms", "counts"), F.col("salts")))
        some = salted.groupBy("lang", "range", "salt").applyInPandas(_merge_some, CELLS)
        dealt = dealt.where("salts = 1").select("range", *NAMES).union(some.join(heavy, ["lang", "prefix"]).select("range", *NAMES))
    merged = dealt.select("range", *NAMES).groupBy("lang", "range").applyInPandas(_merge_range, MERGED)
    return scratch.stored(merged, "ranges-merged")


def audit(documents: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: divergence of each source from the others, and its most telling terms."""
    spark = documents.sparkSession
    scratch = Scratch(spark)
    small_batches(spark)
    documents = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    merged = merged_terms(documents, scratch)
    counted = merged.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.sums").alias("n"))
    kept = merged.groupBy("lang").agg(F.sum("n").alias("v"))
    groups = documents.select("lang", "source").distinct()
    groups = groups.join(counted, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = scratch.stored(groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v")), "groups")
    slices = max(1, -(-groups.count() // GROUPS))
    found = None
    for k in range(slices):
        own = F.pmod(F.xxhash64("lang"), F.lit(slices)) == k
        totals: dict[str, tuple[int, dict[str, int]]] = {}
        for r in groups.where(own & (F.col("v") > 0)).orderBy("lang", "source").toLocalIterator():  # some GROUPS rows
            totals.setdefault(r["lang"], (r["v"], {}))[1][r["source"]] = r["n"]
        part = merged.where(own).mapInPandas(_traversal(totals), "lang string, source string, part string, item string, value long")
        found = part if found is None else found.union(part)
    found = scratch.stored(found, "divergence")
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    sides = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = sides.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    terms = found.where("part = 'term'").select("*", place).where(F.col("rank") <= TOP)
    return pairs.select("*", place).union(terms)


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(n.total, 0)::HUGEINT + v.v) AS p
      FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang
           LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c.n) + 1)) // ((SELECT sum(x.n) FROM c x WHERE x.lang = c.lang)::HUGEINT + (SELECT v.v FROM v WHERE v.lang = c.lang)) AS q
      FROM c GROUP BY lang, term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
               LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (((p.p - q.q) * (p.p - q.q)) // q.q)::BIGINT AS value
          FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q),
both_parts AS (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM both_parts)
WHERE part = 'pair' OR rank <= 200
"""
