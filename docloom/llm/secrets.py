"""Secret scans: three fixed patterns and a battery of randomness tests, in DataFrame functions only.

Base spans are the leftmost non-overlapping matches of each pattern, over the whole text. The functions at hand return
matched strings but no positions, so the matches are enclosed in two private-use marks by one replacement, the text is
split at the marks, and the lengths of the pieces give the positions in code points.

The method adds spans of kind ``random``: runs of 20 or more characters of ``A-Z a-z 0-9 + / _ -`` (with ``=`` at the
end), or three such pieces of 10 or more joined by points, that hold a digit and a letter, or letters only, and don't
overlap a base span. Each one's encoding is inferred (hexadecimal, base 32, letters of one or two cases, letters and
digits, base 64), and these tests are made against it:

* chi-squared uniformity of the alphabet. Under uniform draws the statistic per character tends to (A - 1) / n; under
  prose it tends to A * sum(q^2) - 1 with letter frequencies q. z_chi is the distance from prose, in deviations.
* runs of one character class (lower, upper, digit): prose changes class rarely, random strings at every second step;
  separators as in paths change nothing. Not for letters only, where names joined by capitals change class as well.
* runs of vowels and consonants among neighbouring letters: speech alternates, random letters are mostly consonants. Not
  for hexadecimal runs, which have few letters.
* serial correlation of neighbouring code points, which must be that of an unordered sequence.

All but the last give one p-value against "this is prose" (Stouffer); a run that fails the last gets 1. The
false-discovery control is a weighted Benjamini-Hochberg step over the distinct candidates of all rows: weights grow with
the length, so that short runs, on which the tests have little power, need stronger evidence, and the share of false
discoveries among the reported ones stays below ``FDR`` as far as the tests are independent. A first pass counts the
candidates by levels of their weighted p-value (``STEPS`` levels to a power of ten, rounded to the side of fewer
discoveries); the level that passes is one number, a scalar subquery of the second pass. So what is reported of a row
depends on the whole table, but not on how often a token is repeated.

Edge cases: null and empty texts have no spans; texts that contain the marks themselves are scanned with these
characters exchanged for another of their kind, so positions hold; repeated rows and ids are scanned row by row; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import let, table

ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
RANDOM = (
    r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9_-]{10,}(?:\.[A-Za-z0-9_-]{10,}){2}(?![A-Za-z0-9_-])|[A-Za-z0-9+/_-]{20,}={0,2})"
)
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KINDS = ["assign", "access", "hex", "random"]
OPEN, CLOSE, OTHER = "", "", ""
FDR = 0.001
SERIAL_LEAST = 1e-4
STEPS = 20
LONGEST = 64  # beyond this length a run weighs no more

#: Relative frequencies of the letters a to z in English prose, in percent. Fixed values.
LETTERS = [
    8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4,
    6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074,
]
_Q = [x / sum(LETTERS) for x in LETTERS]
Q2 = sum(q * q for q in _Q)
Q3 = sum(q**3 for q in _Q)
PROSE_CHANGE = 0.1  # how often prose changes its character class from one character to the next
PROSE_TURN = 0.62  # how often it turns from vowel to consonant or back, from one letter to the next

SPAN = "struct<start:int,kind:int,end:int,match:string>"


def _no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def match_spans(text: Column, pattern: str, kind: int) -> Column:
    """start, kind, end (code points, exclusive) and text of the leftmost non-overlapping matches, in order."""
    pieces = F.split(F.regexp_replace(text, pattern, OPEN + "$0" + CLOSE), OPEN)

    def located(p: Column) -> Column:
        first = F.struct(F.length(p[0]).alias("at"), _no_spans().alias("out"))

        def add(a: Column, piece: Column) -> Column:
            match = F.substring_index(piece, CLOSE, 1)
            end = a["at"] + F.length(match)
            span = F.struct(a["at"].alias("start"), F.lit(kind).alias("kind"), end.alias("end"), match.alias("match"))
            at = a["at"] + F.length(piece) - 1
            return F.struct(at.alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

        return F.aggregate(F.slice(p, 2, F.size(p)), first, add, lambda a: a["out"])

    return let(pieces, lambda p: F.when(F.size(p) < 2, _no_spans()).otherwise(located(p)))


def base_spans(text: Column) -> Column:
    """Spans of the three fixed kinds, by start and then kind. Cheap substring tests come before the patterns."""
    lowered = F.lower(text)
    worded = F.lit(False)
    for word in ("passw", "secret", "token", "apikey", "api_key"):
        worded = worded | F.contains(lowered, F.lit(word))
    assign = F.filter(
        match_spans(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= ASSIGN_LEAST
    )
    access = F.filter(match_spans(text, ACCESS, 1), lambda s: s["end"] - s["start"] >= ACCESS_LEAST)
    found = F.concat(
        F.when(worded, assign).otherwise(_no_spans()),
        F.when(F.contains(text, F.lit("AKIA")), access).otherwise(_no_spans()),
        F.when(text.rlike(HEX), match_spans(text, HEX, 2)).otherwise(_no_spans()),
    )
    return F.array_sort(found)


def normal_tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution by a logistic approximation, within 0.0002."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(1.5976) * z + F.lit(0.070565992) * z * z * z))


def _alphabet(token: Column) -> Column:
    return (
        F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16)
        .when(token.rlike("^([a-z]+|[A-Z]+)$"), 26)
        .when(token.rlike("^[A-Za-z]+$"), 52)
        .when(token.rlike("^[A-Z2-7]+$"), 32)
        .when(token.rlike("^[a-z0-9]+$"), 36)
        .when(token.rlike("^[A-Za-z0-9]+$"), 62)
        .otherwise(64)
    )


def battery(token: Column) -> Column:
    """The p-value of a run against prose; 1 where its code points are serially correlated."""

    def steps(values: Column, change: Callable[[Column, Column], Column]) -> Column:
        """In how many of the steps from one value to the next the condition holds."""
        return F.aggregate(
            F.sequence(F.lit(1), F.size(values) - 1), F.lit(0.0), lambda s, i: s + F.when(change(values[i - 1], values[i]), 1.0).otherwise(0.0)
        )

    def tests(chars: Column) -> Column:
        n = F.size(chars).cast("double")
        body = F.rtrim(token, F.lit("="))
        a = _alphabet(body).cast("double")
        squares = F.aggregate(
            F.array_distinct(chars),
            F.lit(0.0),
            lambda s, c: s + F.pow(F.length(token) - F.length(F.replace(token, c, F.lit(""))), F.lit(2)),
        )
        prose = a * Q2 - 1
        # for sixteen symbols prose is hardly less uniform than chance; the floor keeps the test one-sided
        z_chi = (F.greatest(prose, F.lit(0.25)) + (a - 1) / n - (a / (n * n) * squares - 1)) / (
            a * 2 * math.sqrt(Q3 - Q2 * Q2) / F.sqrt(n)
        )
        kind = F.transform(
            chars, lambda c: F.when(c.between("a", "z"), 0).when(c.between("A", "Z"), 1).when(c.between("0", "9"), 2).otherwise(3)
        )
        changes = let(kind, lambda k: steps(k, lambda x, y: (x != y) & (x < 3) & (y < 3)))
        z_runs = (changes - PROSE_CHANGE * (n - 1)) / F.sqrt(PROSE_CHANGE * (1 - PROSE_CHANGE) * (n - 1))
        sound = F.transform(chars, lambda c: F.when(c.rlike("[AEIOUYaeiouy]"), 1).when(c.rlike("[A-Za-z]"), -1).otherwise(0))
        turns = let(sound, lambda v: F.struct(steps(v, lambda x, y: x * y != 0).alias("all"), steps(v, lambda x, y: x * y < 0).alias("turned")))
        z_turns = let(
            turns,
            lambda t: (PROSE_TURN * t["all"] - t["turned"]) / F.sqrt(F.greatest(PROSE_TURN * (1 - PROSE_TURN) * t["all"], F.lit(1.0))),
        )
        z = (
            F.when(a == 16, (z_chi + z_runs) / math.sqrt(2))
            .when(a.isin(26.0, 52.0), (z_chi + z_turns) / math.sqrt(2))
            .otherwise((z_chi + z_runs + z_turns) / math.sqrt(3))
        )
        codes = F.transform(chars, lambda c: F.ascii(c).cast("double"))
        correlation = let(codes, lambda v: let(F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n, lambda m: _correlation(v, m)))
        z_serial = F.abs(correlation) * F.sqrt(n - 1)
        return F.when(2 * normal_tail(z_serial) < SERIAL_LEAST, 1.0).otherwise(normal_tail(z))

    return let(F.split(token, ""), tests)


def _correlation(v: Column, mean: Column) -> Column:
    both = F.aggregate(F.sequence(F.lit(1), F.size(v) - 1), F.lit(0.0), lambda s, i: s + (v[i] - mean) * (v[i - 1] - mean))
    alone = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
    return let(alone, lambda d: F.when(d > 0, both / d).otherwise(F.lit(1.0)))


def candidates(text: Column, base: Column) -> Column:
    """Spans of kind random that the battery is to test."""

    def fit(s: Column) -> Column:
        m = s["match"]
        mixed = m.rlike("[0-9]") & m.rlike("[A-Za-z]") | m.rlike("^[A-Za-z]+=*$")
        return mixed & ~F.exists(base, lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"]))

    return F.when(text.rlike(RANDOM), F.filter(match_spans(text, RANDOM, 3), fit)).otherwise(_no_spans())


def _weight(token: Column) -> Column:
    return F.least(F.length(token), F.lit(LONGEST))


def level(token: Column) -> Column:
    """The whole level of a token: STEPS times the negative decimal logarithm of its p-value over its weight, rounded down."""
    p = F.greatest(battery(token), F.lit(1e-300))
    return F.floor(-F.log10(p / _weight(token)) * STEPS).cast("int")


def passing_level(tokens: DataFrame) -> DataFrame:
    """One row with the least level that passes for the distinct values of the column match; null if none does.

    Weights are lengths over their mean, so the k best candidates pass together where the k-th has
    p / length <= FDR * k / (sum of all lengths). There are at most some 6,000 levels whatever the table's size.
    """
    tested = tokens.groupBy("match").agg(F.lit(1).alias("n")).select("n", _weight(F.col("match")).cast("long").alias("w"), level(F.col("match")).alias("level"))
    levels = tested.groupBy("level").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    row = levels.agg(F.sum("w").alias("w"), F.sort_array(F.collect_list(F.struct("level", "n")), asc=False).alias("r"))
    first = F.struct(F.lit(0).cast("long").alias("k"), F.lit(None).cast("int").alias("least"))

    def add(a: Column, x: Column) -> Column:
        k = a["k"] + x["n"]
        passes = F.pow(F.lit(10.0), -x["level"] / F.lit(float(STEPS))) <= F.lit(FDR) * k / F.col("w")
        return F.struct(k.alias("k"), F.when(passes, x["level"]).otherwise(a["least"]).alias("least"))

    return row.select(F.aggregate("r", first, add, lambda a: a["least"]).alias("least"))


def scan(documents: DataFrame) -> DataFrame:
    """The input with base and all: arrays of struct<start, kind, end, match>, by start and kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE))
    plain = F.when(marked, F.translate(text, OPEN + CLOSE, OTHER * 2)).otherwise(text)

    def parts(t: Column) -> Column:
        return let(base_spans(t), lambda b: F.struct(b.alias("base"), candidates(t, b).alias("maybe")))

    found = documents.where(text.rlike(RANDOM)).select(F.explode(let(plain, parts)["maybe"]["match"]).alias("match"))
    least = F.coalesce(passing_level(found).scalar(), F.lit(2**31 - 1))
    names = [c for c in documents.columns if c not in ("base", "all")]
    split = documents.select(F.struct(*names).alias("row"), let(plain, parts).alias("spans"), least.alias("least"))

    def both(s: Column) -> Column:
        passed = F.filter(s["maybe"], lambda x: level(x["match"]) >= F.col("least"))
        return F.array_sort(F.concat(s["base"], passed))

    return split.select("row.*", "spans.base", both(F.col("spans")).alias("all"))


def joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["end"])), ",")


def redact(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The same rows with every span of the text replaced by ``mark``; overlapping spans are replaced together.

    Null texts stay null. n_chars, where there is one, follows the new text.
    """
    names = documents.columns

    def cut(spans: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def add(a: Column, s: Column) -> Column:
            gap = F.substring(F.col("text"), a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
            out = F.when(s["start"] >= a["at"], F.concat(a["out"], gap, F.lit(mark))).otherwise(a["out"])
            return F.struct(F.greatest(a["at"], s["end"]).alias("at"), out.alias("out"))

        return F.aggregate(
            spans, start, add, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text")))
        )

    scanned = scan(documents.select(F.struct(*names).alias("_row"), "text"))
    text = F.when(F.size("all") > 0, let(F.col("all"), cut)).otherwise(F.col("text"))
    out = scanned.select("_row", text.alias("_text"))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return out.select(*[(new[c] if c in new else F.col(f"_row.{c}")).alias(c) for c in names])


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def n(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("all")).alias("spans"),
    )
