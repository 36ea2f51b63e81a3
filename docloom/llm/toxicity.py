"""Toxicity scores that see through obfuscation.

Noisy-channel restoration. Writers hide words by look-alike characters (1d10t), by spacing letters out (i d i o t) and
by repeating them (idiooot). Suspicious stretches of a text become character lattices: each character may stand for
itself, for a letter that it resembles, for a repeated one to be dropped, or for a separator to be dropped or kept. A
Viterbi search finds the path that is likeliest under channel costs and a character language model of order four, and
the restored words are scored beside the text as written.

Scoring. Word beginnings of three to twelve letters, and whole words, are candidates for toxic stems; those whose share of
toxic texts is significantly above that of the others are kept, and a ridge logistic regression over their presence and the
logarithms of their counts gives the probability.

The language model counts the character 4-grams of all documents, labelled or not, by a Spark aggregation over a gram
space of ``SYMBOLS`` to the power of ``ORDER``: the end of a word, a to z, and all other letters by the remainder of
their code point, which tells the letters of one alphabet apart but not all of those of large scripts. Stems and weights
alone are fitted on the driver from at most ``PER_CLASS`` labelled texts of each class of at most ``MAX_BYTES`` bytes
(documented bound; see samples.py). Scoring is done row by row over whole texts, with a bounded memory of restored
stretches.

Edge cases: null and empty texts score as a text without any stem; without labels of both classes every score is the
share of label 1 (0 without any); repeated rows score alike; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import small_batches, table
from docloom.llm.samples import labelled_texts

PER_CLASS = 1500
MAX_BYTES = 16_000
THRESHOLD = 0.7
ORDER = 4
STEM_LENGTHS = range(3, 13)
MIN_G2 = 18.0
MAX_STEMS = 300
TELLING = 8  # texts, and this share of the toxic ones
TELLING_SHARE = 0.05
REMEMBERED = 50_000
SYMBOLS = 64
CHUNK = 1 << 20  # characters whose grams are counted at a time

#: Letters that a character may stand for. Fixed values.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "(": "c", "<": "c", "*": "aeiou", "#": "aeiou",
}
SUBSTITUTED, SECOND_DROPPED, REPEAT_DROPPED, DROPPED_SEPARATOR, DROPPED_MARK, KEPT_MARK = -1.5, -2.5, -0.3, -0.5, -4.0, -3.0

LETTER = r"[^\W\d_]"
WORD = re.compile(rf"{LETTER}+")
MARK = r"[0-9@$!|€+(<*#]"
LOOKALIKE = re.compile(rf"{MARK}(?={LETTER})|(?<={LETTER}){MARK}")
ONE = rf"(?:{LETTER}|{MARK})"
SPACED = re.compile(rf"(?<!\w){ONE}(?:[ .\-_*/]{{1,2}}{ONE}){{2,}}(?!\w)")
SPACED_HINT = re.compile(rf"[ .\-_*/]{ONE}[ .\-_*/]{{1,2}}{ONE}(?!\w)")
REPEATED = re.compile(r"(.)\1\1")
DOUBLED = re.compile(r"(.)\1")
REPEATS = re.compile(r"(.)\1+")
TOKEN_REST = re.compile(r"\S*")


@cache
def _symbol_of() -> np.ndarray:
    """The symbol of each code point; 0 for what is no letter and so ends a word."""
    out = np.zeros(0x110000, np.uint8)
    codes = [i for i in range(0x110000) if (c := chr(i)).isalnum() and not c.isdecimal()]
    out[codes] = [symbol(chr(i)) for i in codes]
    return out


def symbol(char: str) -> int:
    return 0 if char == " " else ord(char) - 96 if "a" <= char <= "z" else 27 + ord(char) % (SYMBOLS - 27)


def add_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys and the sums of their counts."""
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(keys) else n


def text_grams(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The grams of the words of a lower-cased text, each word behind ORDER - 1 ends and before one, and their counts."""
    codes = np.frombuffer((" " * ORDER + text + " ").encode("utf-32-le", "replace"), np.uint32)
    for lo in range(ORDER, len(codes), CHUNK):
        s = _symbol_of()[codes[lo - ORDER + 1 : lo + CHUNK]].astype(np.int32)
        key, before = s[ORDER - 1 :].copy(), None
        for k in range(1, ORDER):  # what lies behind an end is another word
            now = s[ORDER - 1 - k : len(s) - k] * (1 if before is None else before > 0)
            if before is None:
                inside = (key > 0) | (now > 0)
            key += now << 6 * k
            before = now
        found, n = np.unique(key[inside], return_counts=True)
        yield found.astype(np.int64), n.astype(np.int64)


def grams_of(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """The grams of the texts in ascending order, and how often each one occurs."""
    parts = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    held: list[str] = []
    size = 0

    def count() -> None:
        parts.extend(text_grams("\n".join(held).lower()))
        if sum(len(x[0]) for x in parts) > 2 * len(parts[0][0]) + CHUNK:
            parts[:] = [add_up(parts)]
        held.clear()

    for text in texts:
        held.append(text)
        size += len(text)
        if size >= CHUNK:
            count()
            size = 0
    count()
    return add_up(parts)


class CharModel:
    """Interpolated character n-grams of words, each word between a space and a space."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        """grams: ascending, without repetition; the shorter ones are their ends."""
        self.grams, self.counts, self.totals, self.kinds = [], [], [], []
        for k in range(ORDER):
            size = SYMBOLS ** (k + 1)
            n = np.bincount(grams % size, counts, size)
            found = np.flatnonzero(n)
            self.grams.append(found.astype(np.int32))
            self.counts.append(n[found])
            self.totals.append(np.bincount(found // SYMBOLS, n[found], size // SYMBOLS))
            self.kinds.append(np.bincount(found // SYMBOLS, minlength=size // SYMBOLS).astype(np.int32))
        self.size = max(1, len(self.grams[0]))
        self.known: dict[tuple[str, str], float] = {}

    def count(self, k: int, key: int) -> float:
        at = int(np.searchsorted(self.grams[k], key))
        return float(self.counts[k][at]) if at < len(self.grams[k]) and self.grams[k][at] == key else 0.0

    def logp(self, context: str, char: str) -> float:
        if (found := self.known.get((context, char))) is None:
            p = 1 / (self.size + 50)
            c = 0
            for k in range(ORDER):
                if k:
                    c += symbol(context[-k]) * SYMBOLS ** (k - 1)
                total, kinds = float(self.totals[k][c]), int(self.kinds[k][c])
                if not kinds:
                    break
                p = self.count(k, c * SYMBOLS + symbol(char)) / (total + kinds) + p * kinds / (total + kinds)
            if len(self.known) >= 4 * REMEMBERED:
                self.known.clear()
            found = self.known[context, char] = math.log(p)
        return found


def lattice(stretch: str) -> list[list[tuple[str, float]]]:
    """For each character: what it may stand for ("" for nothing) and at which cost."""
    out = []
    before, run = "", 0
    for c in stretch:
        run = run + 1 if c == before else 0
        dropped = SECOND_DROPPED if run == 1 else REPEAT_DROPPED
        if c.isalpha():
            options = [(c, 0.0)]
            if c == before:
                options.append(("", dropped))
        elif c in LOOKS_LIKE:
            options = [(x, SUBSTITUTED) for x in LOOKS_LIKE[c]] + [("", DROPPED_MARK), (" ", KEPT_MARK)]
            if c == before:
                options.append(("", dropped))
        else:
            options = [(" ", 0.0), ("", DROPPED_SEPARATOR)]
        out.append(options)
        before = c
    return out


def restore(stretch: str, model: CharModel) -> str:
    """The likeliest text behind a stretch (Viterbi over the last ORDER - 1 characters)."""
    start = " " * (ORDER - 1)
    best: dict[str, tuple[float, tuple | None]] = {start: (0.0, None)}
    for options in [*lattice(stretch), [(" ", 0.0)]]:
        new: dict[str, tuple[float, tuple | None]] = {}
        for state, (score, path) in best.items():
            for char, cost in options:
                if not char:
                    to, value, way = state, score + cost, path
                elif char == " " and state[-1] == " ":
                    to, value, way = state, score + cost, path
                else:
                    to, value, way = (state + char)[1:], score + cost + model.logp(state, char), (char, path)
                if to not in new or value > new[to][0]:
                    new[to] = (value, way)
        best = new
    _, path = max(best.values(), key=lambda x: x[0])
    out = []
    while path:
        out.append(path[0])
        path = path[1]
    return "".join(reversed(out)).strip()


def stretches(text: str, doubled: re.Pattern | None = None) -> list[str]:
    """The suspicious stretches of a lower-cased text. doubled: the words to open at letters that stand there twice."""
    found = [m[0] for m in SPACED.finditer(text) if WORD.search(m[0])] if SPACED_HINT.search(text) else []
    if doubled:
        found += [w for w in doubled.findall(text) if DOUBLED.search(w) and not REPEATED.search(w)]
    for pattern in (LOOKALIKE, REPEATED):
        done = -1
        for m in pattern.finditer(text):
            if m.start() < done or pattern is REPEATED and not m[1].isalpha():
                continue
            lo = max(text.rfind(" ", 0, m.start()), text.rfind("\n", 0, m.start())) + 1
            done = TOKEN_REST.match(text, m.end()).end()
            found.append(text[lo:done])
    return found


class Reach:
    """Whether some way through the lattice of a stretch spells one of the stems, by one bit for each of their letters.

    It overlooks costs and word beginnings, so it says yes too often but never no wrongly: what it refuses can't be
    restored to a text with a stem and need not be decoded.
    """

    def __init__(self, stems: list[str]):
        self.masks: dict[str, int] = defaultdict(int)
        self.begins = self.ends = 0
        at = 0
        for stem in stems:
            self.begins |= 1 << at
            for c in stem:
                for x in (c, *(mark for mark, letters in LOOKS_LIKE.items() if c in letters)):
                    self.masks[x] |= 1 << at
                at += 1
            self.ends |= 1 << at - 1

    def __call__(self, stretch: str) -> bool:
        read = 0  # the letters that may have been read last
        for c in stretch:
            mask = self.masks.get(c, 0)
            read = (read << 1 | self.begins) & mask | (read & mask if c.isalpha() else read)
            if read & self.ends:
                return True
        return False


def _trie(words: list[str], more: str = "") -> str:
    """A pattern that matches any of the words, the longest first, branching letter by letter; more: behind each letter."""
    by_first: dict[str, list[str]] = defaultdict(list)
    for w in words:
        if w:
            by_first[w[0]].append(w[1:])
    parts = [re.escape(c) + more + _trie(rest, more) for c, rest in sorted(by_first.items())]
    inner = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")" if parts else ""
    return f"(?:{inner})?" if "" in words and inner else inner


def _g2(dp: int, dn: int, p: int, n: int) -> float:
    """Log-likelihood ratio of a feature in dp of p toxic and dn of n other texts; negative if commoner in the others."""
    total = 0.0
    for seen, of, other, all_other in ((dp, p, dn, n), (p - dp, p, n - dn, n)):
        both, every = seen + other, of + all_other
        for x, size in ((seen, of), (other, all_other)):
            if x:
                total += 2 * x * math.log(x * every / (both * size))
    return total if dp * n > dn * p else -total


class ToxicityModel:
    def __init__(self, texts: list[tuple[str, int]], grams: tuple[np.ndarray, np.ndarray] | None = None):
        """texts: the labelled ones; grams: those of all documents with their counts, of the labelled texts where not given."""
        self.remembered: dict[str, str] = {}
        labels = [y for _, y in texts]
        self.constant = None if len(set(labels)) == 2 else float(np.mean(labels)) if labels else 0.0
        if self.constant is not None:
            return
        lowered = [t.lower() for t, _ in texts]
        self.model = CharModel(*(grams or grams_of(lowered)))
        self.stems = self._choose(lowered, labels)
        self.pattern = self._compile()
        alone = self._telling(lowered, labels)  # each of these words is to be enough by itself
        x = np.array([self.counts(t) for t in lowered + alone])
        self.weights = _logistic(x, np.array(labels + [1] * len(alone), float))

    def _telling(self, texts: list[str], labels: list[int]) -> list[str]:
        """Words with a stem that many toxic texts hold and no other text."""
        if self.pattern is None:
            return []
        seen = {0: Counter(), 1: Counter()}
        for t, y in zip(texts, labels, strict=True):
            seen[y].update(set(self.pattern.findall(t)))
        least = max(TELLING, TELLING_SHARE * sum(labels))
        return sorted(w for w, n in seen[1].items() if n >= least and w not in seen[0])

    def _choose(self, texts: list[str], labels: list[int]) -> list[str]:
        """Stems by significance; a whole word ends in "$"."""
        p, n = sum(labels), len(labels) - sum(labels)
        seen = {0: Counter(), 1: Counter()}
        for t, y in zip(texts, labels, strict=True):
            found = set()
            for w in set(WORD.findall(t)):
                found.update(self._features(w))
            seen[y].update(found)
        scored = []
        for stem, dp in seen[1].items():
            if dp >= 3 and len(stem) > 3:
                g = _g2(dp, seen[0][stem], p, n)
                if g >= MIN_G2 and dp * n >= 4 * seen[0][stem] * p:
                    scored.append((-g, -len(stem), stem))
        return sorted(stem for _, _, stem in sorted(scored)[:MAX_STEMS])

    @staticmethod
    def _features(word: str) -> list[str]:
        return [word[:k] for k in STEM_LENGTHS if k <= len(word)] + [word + "$"]

    def _compile(self) -> re.Pattern | None:
        """Words that begin with a stem."""
        self.place = {s: i for i, s in enumerate(self.stems)}
        self.of_word: dict[str, list[int]] = {}
        bare = sorted({s.rstrip("$") for s in self.stems})
        least = [s for k, s in enumerate(bare) if not k or not any(s.startswith(b) for b in bare[:k])]
        # a word that drops some of its doubled letters can begin with a stem only if both do so without any doubled letter
        single = sorted({REPEATS.sub(r"\1", s) for s in least})
        single = [s for k, s in enumerate(single) if not k or not any(s.startswith(b) for b in single[:k])]
        self.reach = Reach(least)
        self.doubled = re.compile(rf"\b{_trie(single, '+')}{LETTER}*") if least else None
        return re.compile(rf"\b{_trie(least)}{LETTER}*") if least else None

    def places(self, word: str) -> list[int]:
        if (found := self.of_word.get(word)) is None:
            if len(self.of_word) >= REMEMBERED:
                self.of_word.clear()
            found = self.of_word[word] = [self.place[f] for f in self._features(word) if f in self.place]
        return found

    def restored(self, stretch: str) -> str:
        if (found := self.remembered.get(stretch)) is None:
            if len(self.remembered) >= REMEMBERED:
                self.remembered.clear()
            found = self.remembered[stretch] = restore(stretch, self.model)
        return found

    def counts(self, lowered: str) -> np.ndarray:
        out = np.zeros(len(self.stems) + 1)
        out[-1] = 1
        if self.pattern is None:
            return out
        found = self.pattern.findall(lowered)
        for x in stretches(lowered, self.doubled):
            if self.reach(x) and (r := self.restored(x)) != x and (hidden := self.pattern.findall(r)):
                found += (Counter(hidden) - Counter(self.pattern.findall(x))).elements()
        for s in found:
            for i in self.places(s):
                out[i] += 1
        seen = out[:-1] > 0
        out[:-1][seen] = 1 + np.log(out[:-1][seen])
        return out

    def score(self, text: str) -> float:
        if self.constant is not None:
            return self.constant
        z = float(self.counts(text.lower()) @ self.weights)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.004) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last column is the intercept, classes weigh the same."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-4
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + penalty * w
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(remainder: int, of: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of == remainder, F.lit(False))


def count_grams(documents: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The grams of all texts in ascending order, and their counts; at most SYMBOLS ** ORDER rows come to the driver."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, counts = grams_of(t for b in batches for t in b.column(0).to_pylist() if t)
        for lo in range(0, len(found), CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + CHUNK], pa.int64()) for x in (found, counts)], ["gram", "n"])

    of_parts = documents.select("text").mapInArrow(part, "gram long, n long")
    counted = of_parts.groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    grams, n = (counted.column(c).to_numpy() for c in ("gram", "n"))
    order = np.argsort(grams)
    return grams[order], n[order]


def fit(documents: DataFrame, labels: DataFrame) -> ToxicityModel:
    small_batches(documents.sparkSession)
    return ToxicityModel(labelled_texts(documents, labels, "toxic", ~held_out(1, 3), PER_CLASS, MAX_BYTES), count_grams(documents))


def with_score(documents: DataFrame, model: ToxicityModel, name: str = "score") -> DataFrame:
    """The input with the score of each text."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype="float64")

    return documents.withColumn(name, score(F.coalesce("text", F.lit(""))))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit(documents, table(spark, sf_dir, "labels"))
    return with_score(documents.select("doc_id", "text"), model).select(
        "doc_id", held_out(1, 3).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )
