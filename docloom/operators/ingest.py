"""From parsed documents to chunks: splitting, sections, tables, fingerprints and near copies."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.plans.registry import query
from docloom.session import small_batches, table
from docloom.sources.scratch import stored

SEPARATORS = ["\n\n", "\n", "。", "！", "？", "；", "，", " ", ""]
CHUNK, OVERLAP = 2048, 200
HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$")
TABLE_LIMIT = 8000
#: Behind a table that was cut. Fixed value.
TABLE_NOTE = "\n\n（表已截断，可点击查看完整表）"


def split_text(text: str, size: int = CHUNK, overlap: int = OVERLAP, separators: list[str] | None = None) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the first separator that helps and merged with an overlap.

    The public recursive algorithm: a text is split at the first separator that it holds, which stays at the head of
    the following piece; pieces that are still too long are split by the next separators, and neighbours are merged.
    """
    separators = SEPARATORS if separators is None else separators
    sep, rest = separators[-1], []
    for i, s in enumerate(separators):
        if s == "" or s in text:
            sep, rest = s, separators[i + 1 :]
            break
    if sep:
        raw = text.split(sep)
        parts = [raw[0], *[sep + x for x in raw[1:]]]
    else:
        parts = list(text)
    parts = [p for p in parts if p]
    out: list[str] = []
    good: list[str] = []
    for p in parts:
        if len(p) < size:
            good.append(p)
            continue
        if good:
            out += _merge(good, size, overlap)
            good = []
        out += split_text(p, size, overlap, rest) if rest else [p]
    return out + (_merge(good, size, overlap) if good else [])


def _merge(parts: list[str], size: int, overlap: int) -> list[str]:
    out: list[str] = []
    held: list[str] = []
    total = 0
    for p in parts:
        if held and total + len(p) > size:
            if joined := "".join(held).strip():
                out.append(joined)
            while held and (total > overlap or total + len(p) > size and total > 0):
                total -= len(held.pop(0))
        held.append(p)
        total += len(p)
    if joined := "".join(held).strip():
        out.append(joined)
    return out


def sections(markdown: str) -> list[tuple[str, str, str]]:
    """(heading, heading path, content) of each section; fenced code holds no headings."""
    out: list[tuple[str, str, str]] = []
    stack: list[tuple[int, str]] = []
    body: list[str] = []
    fenced = False

    def flush() -> None:
        text = "\n".join(body).strip()
        if text:
            out.append((stack[-1][1] if stack else "", " > ".join(h for _, h in stack), text))
        body.clear()

    for line in markdown.split("\n"):
        if line.lstrip().startswith("```"):
            fenced = not fenced
        found = None if fenced else HEADING.match(line)
        if found:
            flush()
            level = len(found[1])
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, found[2]))
        else:
            body.append(line)
    flush()
    return out


def truncate_table(markdown: str, limit: int = TABLE_LIMIT) -> str:
    """Whole lines up to the limit, the note included."""
    if len(markdown) <= limit:
        return markdown
    kept, total = [], len(TABLE_NOTE)
    for line in markdown.split("\n"):
        if total + len(line) + 1 > limit:
            break
        kept.append(line)
        total += len(line) + 1
    return "\n".join(kept) + TABLE_NOTE


FILLED = 16  # cells of a table of counts for each trigram
GRAMS, TEXTS = 1 << 18, 4096  # characters and texts that are hashed at once
KNOWN = 1 << 18  # signs of trigrams that a task keeps
_PAD = chr(0x10FFFF)  # no letter: fills texts of fewer than three characters
_NO_WORD = re.compile(r"[\W_]+")
_signs: dict[int, np.ndarray] = {}


def simhash(text: str) -> int:
    """64-bit SimHash over character trigrams of the letters and digits; 0 for a text without any."""
    return int(simhashes([text])[0])


def simhashes(texts: list[str]) -> np.ndarray:
    """The SimHash of each text; trigrams of several texts are counted at once, and one that came before is not hashed again."""
    plain = [_NO_WORD.sub("", t).lower() for t in texts]
    out, some, held = np.zeros(len(plain), np.int64), [], 0
    for i, t in enumerate(plain):
        if not t:
            continue
        if some and (held + len(t) > GRAMS or len(some) == TEXTS):
            out[some] = _voted([plain[j] for j in some])
            some, held = [], 0
        some.append(i)
        held += len(t)
    if some:
        out[some] = _voted([plain[j] for j in some])
    return out


def _voted(plain: list[str]) -> np.ndarray:
    padded = [t + _PAD * (3 - len(t)) for t in plain]
    ends = np.cumsum([len(t) for t in padded])
    c = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    whole = np.ones(len(c), bool)  # where a trigram begins that lies in one text
    whole[ends - 1] = whole[ends - 2] = False
    keys = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[whole[:-2]]
    owner = np.repeat(np.arange(len(padded)), np.diff(ends, prepend=0) - 2)
    grams, at = np.unique(keys, return_inverse=True)
    votes = np.zeros((len(padded), 64))
    if len(grams) * len(padded) <= FILLED * len(at):  # few long texts: by a table of counts
        for lo in range(0, len(grams), step := 1 << 14):
            signs = np.stack([_sign(g) for g in grams[lo : lo + step].tolist()]).astype(float)
            own = slice(None) if len(grams) <= step else (at >= lo) & (at < lo + step)
            cells = np.bincount(owner[own] * len(signs) + at[own] - lo, minlength=len(padded) * len(signs))
            votes += cells.reshape(len(padded), -1) @ signs
    else:  # many short ones, which hold few of the trigrams each
        signs = np.stack([_sign(g) for g in grams.tolist()]).astype(np.int32)
        for lo in range(0, len(at), step := 1 << 15):
            own = owner[lo : lo + step]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            votes[own[first]] += np.add.reduceat(signs[at[lo : lo + step]], first, axis=0)
    return ((votes > 0).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


def _sign(key: int) -> np.ndarray:
    """1 or -1 for each bit of the trigram's hash, the lowest first."""
    found = _signs.get(key)
    if found is None:
        if len(_signs) >= KNOWN:
            _signs.clear()
        gram = "".join(map(chr, (key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF))).rstrip(_PAD)
        h = int.from_bytes(hashlib.md5(gram.encode("utf-8", "replace")).digest()[:8], "big")
        found = _signs[key] = np.unpackbits(np.array([h], "<u8").view(np.uint8), bitorder="little").astype(np.int8) * 2 - 1
    return found


def with_simhash(documents: DataFrame) -> DataFrame:
    small_batches(documents.sparkSession)

    @F.pandas_udf("long")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(simhashes(texts.tolist()))

    return documents.withColumn("simhash", hashed(F.coalesce("text", F.lit(""))))


_EDGES = (0, 11, 22, 33, 44, 54, 64)
_MASKS = [sum(1 << bit for b in blocks for bit in range(_EDGES[b], _EDGES[b + 1])) for blocks in combinations(range(6), 3)]
_SIGNED = [m - (1 << 64) if m >> 63 else m for m in _MASKS]


def fingerprint_keys(simhash: Column) -> Column:
    """Twenty keys (b, k), at least one of which any two fingerprints share that differ in up to three bits.

    Of six blocks of a fingerprint three agree at least, so it stands under the bits of each three of them: keys of 32 bits
    or more, few of which unlike fingerprints share.
    """
    return F.array(*[F.struct(F.lit(i).alias("b"), simhash.bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(_SIGNED)])


def hamming_links(hashed: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs of different fingerprints within the distance, exact for up to three bits.

    Equal fingerprints are joined as one, so copies don't multiply; ``ids_a`` counts the documents behind a fingerprint. A
    pair counts under the first of the keys that it shares and no other, so pairs are neither kept nor shuffled to tell them apart.
    """
    distinct = hashed.groupBy("simhash").agg(F.min("doc_id").alias("id"), F.count("*").alias("ids"))
    keyed = distinct.select("*", F.explode(fingerprint_keys(F.col("simhash"))).alias("band"))
    x, y = (keyed.select(F.col("band.b").alias("b"), F.col("band.k").alias("k"), *[F.col(c).alias(f"{c}_{s}") for c in ("simhash", "id", "ids")]) for s in "ab")
    differ = F.col("simhash_a").bitwiseXOR(F.col("simhash_b"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, i) for i, m in enumerate(_SIGNED)])
    near = (F.col("id_a") < F.col("id_b")) & (F.bit_count(differ) <= distance) & (first == F.col("b"))
    return x.join(y.hint("merge"), ["b", "k"]).where(near).select("id_a", "id_b", "ids_a", "ids_b")


def fingerprint_members(hashed: DataFrame) -> DataFrame:
    """doc_id, id, ids: for each document the smallest id among those with its fingerprint, and how many these are."""
    return hashed.join(hashed.groupBy("simhash").agg(F.min("doc_id").alias("id"), F.count("*").alias("ids")), "simhash").select("doc_id", "id", "ids")


_BLOCKS = tuple((at, (1 << size) - 1) for at, size in ((0, 16), (16, 16), (32, 16), (48, 16)))


def paragraphs_once(text: str, least: int = 40, distance: int = 3, hashes: list[int] | None = None) -> str:
    """Drops paragraphs whose SimHash is near that of a *kept* earlier one; short paragraphs stay.

    Kept fingerprints stand under their four blocks of 16 bits. Up to three differing bits leave one block equal, so a
    paragraph is compared with the few kept ones that share a block and not with all of them. hashes: the fingerprints of the
    paragraphs that are not short, where they are known.
    """
    if distance >= len(_BLOCKS):
        raise ValueError("blocks tell up to three bits apart")
    kept: list[str] = []
    seen: dict[tuple[int, int], list[int]] = {}
    parts = re.split(r"\n\s*\n+", text)
    hashes = iter(simhashes([p for p in parts if len(p.strip()) >= least]).view(np.uint64).tolist() if hashes is None else hashes)
    for p in parts:
        if len(p.strip()) >= least:
            h = next(hashes)
            keys = [(i, h >> at & mask) for i, (at, mask) in enumerate(_BLOCKS)]
            if any((h ^ s).bit_count() <= distance for k in keys for s in seen.get(k, ())):
                continue
            for k in keys:
                seen.setdefault(k, []).append(h)
        kept.append(p)
    return "\n\n".join(kept)


def _each_once(texts: list[str | None], least: int, distance: int) -> list[str | None]:
    """paragraphs_once of each text, the paragraphs of all of them hashed at once."""
    long = [[] if t is None else [p for p in re.split(r"\n\s*\n+", t) if len(p.strip()) >= least] for t in texts]
    hashes = iter(simhashes([p for some in long for p in some]).view(np.uint64).tolist())
    own = [list(islice(hashes, len(some))) for some in long]
    return [None if t is None else paragraphs_once(t, least, distance, h) for t, h in zip(texts, own, strict=True)]


def without_repeated_paragraphs(documents: DataFrame, least: int = 40, distance: int = 3) -> DataFrame:
    """The documents with their text's near-equal paragraphs reduced to the first of each; null texts stay null."""

    small_batches(documents.sparkSession)

    @F.pandas_udf("string")
    def once(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(_each_once(texts.tolist(), least, distance), dtype=object)

    return documents.withColumn("text", once("text"))


FRAME_CHARS = 1 << 20  # of the last column, in a frame that is returned


def _frames(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of the rows, each ended behind some ``FRAME_CHARS``."""
    some, held = [], 0
    for row in rows:
        some.append(row)
        held += len(row[-1])
        if held >= FRAME_CHARS:
            yield pd.DataFrame(some, columns=columns)
            some, held = [], 0
    if some:
        yield pd.DataFrame(some, columns=columns)


def chunks(documents: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, ordinal, content of every chunk of every document."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = ((d, i, c) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for i, c in enumerate(split_text(t, size, overlap)))
            yield from _frames(rows, ["doc_id", "ordinal", "content"])

    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id long, ordinal int, content string")


def markdown_sections(documents: DataFrame) -> DataFrame:
    """doc_id, ordinal, heading, heading_path, content of every section."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = ((d, i, *s) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for i, s in enumerate(sections(t)))
            yield from _frames(rows, ["doc_id", "ordinal", "heading", "heading_path", "content"])

    schema = "doc_id long, ordinal int, heading string, heading_path string, content string"
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, schema)


@query("paragraph_dedup")
def q_paragraphs(spark, sf_dir):
    """Lines stand for paragraphs in the tables' texts, which have few blank lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "\n+", "\n\n").alias("text"))
    found = without_repeated_paragraphs(docs)
    return found.select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("recursive_split")
def q_split(spark, sf_dir):
    return chunks(table(spark, sf_dir, "documents")).select("doc_id", "ordinal", F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"))


#: What is put before the lines of a text, by the number of the line and the id, so that sections lie within each other.
_SIGNS = ["# ", "", "## ", "", "### ", "```", "## ", "#### ", "", "# "]


def _sections_sql(line: str) -> str:
    """Sections by windows: a heading of level k is open where the last one of level k stands behind those of lower levels."""
    last = ", ".join(f"max(CASE WHEN lev = {k} THEN {{'i': i, 't': title}} END) OVER w AS a{k}" for k in range(1, 7))
    is_open = " ".join(
        f"WHEN {k} THEN lev >= {k} AND a{k} IS NOT NULL" + "".join(f" AND coalesce(a{j}.i, 0) < a{k}.i" for j in range(1, k)) for k in range(1, 7)
    )
    title = " ".join(f"WHEN {k} THEN a{k}.t" for k in range(1, 7))
    return rf"""WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS raw, generate_subscripts(ls, 1) AS i FROM t),
x AS (SELECT doc_id, i, {line} AS x FROM l),
f AS (SELECT *, sum(starts_with(ltrim(x, ' ' || chr(9)), '```')::INT) OVER (PARTITION BY doc_id ORDER BY i) % 2 = 1 AS fenced FROM x),
h AS (SELECT *, CASE WHEN NOT fenced THEN length(regexp_extract(x, '^(#{{1,6}})\s+(.+?)\s*$', 1)) ELSE 0 END AS lev, regexp_extract(x, '^(#{{1,6}})\s+(.+?)\s*$', 2) AS title FROM f),
n AS (SELECT *, sum((lev > 0)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS no FROM h),
b AS (SELECT doc_id, no, trim(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (lev = 0), ''), ' ' || chr(9) || chr(10) || chr(13)) AS content FROM n GROUP BY doc_id, no),
k AS (SELECT doc_id, no, lev, {last} FROM n WHERE lev > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT doc_id, no, array_to_string(list_transform(list_filter(range(1, 7), lambda q: CASE q {is_open} END), lambda q: CASE q {title} END), ' > ') AS path FROM k)
SELECT b.doc_id, (row_number() OVER (PARTITION BY b.doc_id ORDER BY b.no) - 1)::INT AS ordinal, coalesce(path, '') AS heading_path, md5(content) AS content_md5
FROM b LEFT JOIN p ON p.doc_id = b.doc_id AND p.no = b.no WHERE content <> ''"""


def _digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "ordinal", "heading_path", F.md5("content").alias("content_md5"))


@query("split_sections", _sections_sql("raw"))
def q_sections(spark, sf_dir):
    return _digests(markdown_sections(table(spark, sf_dir, "documents")))


@query("heading_sections", _sections_sql(f"{_SIGNS}[(i + doc_id) % 10 + 1] || raw"))
def q_heading_sections(spark, sf_dir):
    """Sections of texts whose lines become headings of four levels and fences by turns."""
    signs = F.array(*[F.lit(x) for x in _SIGNS])
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.concat(F.get(signs, ((i + 1 + F.col("doc_id")) % 10).cast("int")), x))
    return _digests(markdown_sections(table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))))


_SIMHASH_SQL = r"""WITH p AS (SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}]+', '', 'g')) AS t FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, greatest(1, length(t) - 2) + 1), lambda i: substr(t, i, 3))) AS gram FROM p WHERE t <> ''),
c AS (SELECT doc_id, ('0x' || substr(md5(gram), 1, 16))::UBIGINT AS h, count(*) AS n FROM g GROUP BY doc_id, gram),
b AS (SELECT doc_id, k, sum(CASE WHEN (h >> k::UBIGINT) & 1 = 1 THEN n ELSE -n END) AS votes FROM c, range(64) r(k) GROUP BY doc_id, k),
v AS (SELECT doc_id, sum(CASE WHEN votes > 0 THEN pow(2::DOUBLE, k % 32)::HUGEINT * CASE WHEN k >= 32 THEN 4294967296::HUGEINT ELSE 1 END ELSE 0 END)::HUGEINT AS s FROM b GROUP BY doc_id)
SELECT p.doc_id, coalesce(CASE WHEN s >= 9223372036854775808 THEN s - 18446744073709551616 ELSE s END, 0)::BIGINT AS simhash FROM p LEFT JOIN v USING (doc_id)"""


@query("doc_simhash", _SIMHASH_SQL)
def q_simhash(spark, sf_dir):
    return with_simhash(table(spark, sf_dir, "documents")).select("doc_id", "simhash")


@query(
    "near_dup_pairs",
    f"""WITH hashed AS ({_SIMHASH_SQL}), d AS (SELECT simhash, min(doc_id) AS id, count(*) AS ids FROM hashed GROUP BY simhash)
SELECT x.id AS id_a, y.id AS id_b, x.ids AS ids_a, y.ids AS ids_b, false AS same FROM d x JOIN d y ON x.id < y.id AND bit_count(xor(x.simhash, y.simhash)) <= 3
UNION ALL SELECT d.id, h.doc_id, d.ids, d.ids, true FROM hashed h JOIN d USING (simhash)""",
)
def q_near_pairs(spark, sf_dir):
    """Pairs of near fingerprints by their smallest ids; where ``same``, a row for each document (id_b) with that of its own (id_a)."""
    hashed = stored(with_simhash(table(spark, sf_dir, "documents")).select("doc_id", "simhash"), "simhash")  # read three times
    ids = F.col("ids")
    members = fingerprint_members(hashed).select(F.col("id").alias("id_a"), F.col("doc_id").alias("id_b"), ids.alias("ids_a"), ids.alias("ids_b"), F.lit(True).alias("same"))
    return hamming_links(hashed).withColumn("same", F.lit(False)).unionByName(members)


@query("dedup_first_wins", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text)")
def q_first_wins(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("sha")
