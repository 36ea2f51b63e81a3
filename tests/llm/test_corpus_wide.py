"""Source divergence, repeated passages and tokenizer alignment against brute force, and on awkward tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from docloom.llm import alignment, decontam, html_text, source_audit, substrings

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n long, bucket int, kind string, `range` string"


@pytest.fixture(scope="module")
def frame(spark):
    """Shared passages, copies, nulls, repeated ids, long and odd texts, and columns named like those of the steps."""
    rng = random.Random(5)
    words = [f"wörd{i}" if i % 9 == 0 else f"Word{i}" for i in range(300)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = [None, "", " \n", "one", " ".join(passage), " ".join(passage[5:40])]
    for _ in range(40):
        own = [rng.choice(words) for _ in range(rng.randrange(0, 80))]
        at = rng.randrange(48)
        texts.append(rng.choice([" ", "  ", "\n"]).join(own + passage[at : at + rng.randrange(20)] + own[:20]))
    texts += [texts[10], texts[10], texts[20], "a " * 40, "<|endoftext|> <s>▁x", "x\ty\x00z é 漢字", " ".join(rng.choice(words) for _ in range(20_000))]
    ids = [*range(len(texts) - 6, 0, -1), 7, 7, None, None, 900, 901]
    langs, sources = ["en", "de", None], ["s1", "s2", "", None]
    rows = [(i, t, rng.choice(langs), rng.choice(sources), 1, 2, "k", "r") for i, t in zip(ids, texts, strict=True)]
    rows += [(3000, "", "xx", "only"), (3001, None, "yy", "p"), (3002, "b", "yy", "q")]
    return spark.createDataFrame([r if len(r) == 8 else (*r, 1, 2, "k", "r") for r in rows], SCHEMA).repartition(5)


def rows_of(frame, *columns):
    return [tuple(r) for r in frame.select(*columns).collect()]


def plain_audit(rows):
    docs, count, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        docs.update((lang, t) for t in set(terms))
        count.update((lang, source, t) for t in terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), n in docs.items() if x == lang and n >= 3]
        names = sorted(s for x, s in groups if x == lang)
        total = {s: sum(count[lang, s, t] for t in kept) for s in names}
        p = {(s, t): 1 + 10**9 * (count[lang, s, t] + 1) // (total[s] + len(kept)) for s in names for t in kept}
        whole = {t: sum(count[lang, s, t] for s in names) for t in kept}
        q = {t: 1 + 10**9 * (whole[t] + 1) // (sum(total.values()) + len(kept)) for t in kept}
        for s in names:
            pairs = [(-sum((p[s, t] - p[o, t]) ** 2 // p[o, t] for t in kept), o.encode()) for o in names if o != s]
            terms = [(-((p[s, t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if count[lang, s, t] and p[s, t] > q[t]]
            for part, some in (("pair", sorted(pairs)), ("term", sorted(terms)[:200])):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(some)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_audit_equals_brute_force(spark, frame, monkeypatch, small):
    if small:  # many flushes, ranges, salted merges and slices of languages
        for name, value in (("FLUSH", 20), ("LEAVES", 10), ("GROUPS", 3), ("DENSE", 16)):
            monkeypatch.setattr(source_audit, name, value)
    got = source_audit.audit(frame)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain_audit(rows_of(frame, "text", "lang", "source"))


def test_audit_ties_and_large_counts(spark):
    same = spark.createDataFrame([("zz aa mm", "en", s) for s in "xy" for _ in range(3)], "text string, lang string, source string")
    rows = source_audit.audit(same).collect()
    assert [r.value for r in rows if r.part == "pair"] == [0, 0] and not [r for r in rows if r.part == "term"]
    huge = source_audit.np.array([10**13], source_audit.np.int64)
    assert source_audit.probability(huge, 10**14)[0] == 1 + 10**9 * (10**13 + 1) // 10**14


def test_trie_order_and_merge():
    rng = random.Random(1)
    terms = ["".join(rng.choice("abé漢") for _ in range(rng.randrange(1, 7))).encode() for _ in range(500)]
    trie = source_audit.Trie()
    for t in terms:
        leaf = trie.leaf(t)
        leaf[0] = leaf.get(0, 0) + 1
    assert [(t, leaf[0]) for t, leaf in trie.walk()] == sorted(Counter(terms).items()) and trie.size == len(set(terms))


def plain_dedup(rows):
    first, words = {}, [(i, (t or "").encode().split()) for i, t in rows]
    windows = [[(k, b" ".join(w[k : k + 13])) for k in range(len(w) - 12)] for _, w in words]
    for (i, _), own in zip(words, windows, strict=True):
        for _, x in own if i is not None else ():
            first[x] = min(first.get(x, i), i)
    out = []
    for (i, w), own in zip(words, windows, strict=True):
        gone = {k + j for k, x in own if i is not None and first[x] < i for j in range(13)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [False, True])
def test_dedup_equals_brute_force(spark, frame, monkeypatch, small):
    if small:  # many blocks, and ranges that are split by longer prefixes twice
        monkeypatch.setattr(substrings, "BLOCK", 50)
        monkeypatch.setattr(substrings, "LEAVES", 5)
    got = substrings.without_repeats(frame)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    want = plain_dedup(rows_of(frame, "doc_id", "text"))
    assert sorted(map(tuple, got.collect()), key=str) == want and sum(r[2] > 0 for r in want) > 5


def test_dedup_repeats_within_one_document_and_at_edges(spark):
    p = " ".join(f"p{i}" for i in range(13))
    rows = [(5, f"{p} {p}"), (9, p), (2, f"x {p[:-1]}"), (9, f"a {p} b"), (30, f"{p} y {p}")]
    got = substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == plain_dedup(rows)


def test_dedup_of_the_table(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(map(tuple, substrings.op12_substring_dedup(spark, SF).collect()), key=str)
    assert got == plain_dedup(rows_of(documents, "doc_id", "text"))


def plain_alignment(rows):
    bytes_of = {c: b for b, c in alignment.BYTE_LETTERS.items()}
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    made, pairs = [], Counter()
    for i, text in rows:
        cells, raw = None, b" " + (text or "").encode()
        if text:
            a = first.encode(" " + text, add_special_tokens=False).ids
            b = second.encode(text)
            as_bytes = [bytes(bytes_of[c] for c in first.id_to_token(x)) for x in a]
            bs_bytes = [bytes([int(second.id_to_piece(x)[3:5], 16)]) if second.is_byte(x) else second.id_to_piece(x).replace("▁", " ").encode() for x in b]
            if b"".join(as_bytes) == raw == b"".join(bs_bytes):
                cells = [[[], []]]
                ends = [{sum(map(len, side[: k + 1])): k for k in range(len(side))} for side in (as_bytes, bs_bytes)] if len(a) < 200 else None
                if ends is None:
                    ends = []
                    for side in (as_bytes, bs_bytes):
                        at, found = 0, {}
                        for k, x in enumerate(side):
                            at += len(x)
                            found[at] = k
                        ends.append(found)
                last_a = last_b = -1
                cells, links = [], []
                for end in sorted(ends[0].keys() & ends[1].keys()):
                    ka, kb = ends[0][end], ends[1][end]
                    cells.append((a[last_a + 1 : ka + 1], b[last_b + 1 : kb + 1]))
                    links.append((a[ka], b[kb]))
                    last_a, last_b = ka, kb
                pairs.update(links)
        made.append((i, a, b, cells, links) if cells is not None else (i, [], [], None, []))
    most = defaultdict(int)
    for (_, b), n in pairs.items():
        most[b] = max(most[b], n)
    out = []
    for i, a, b, cells, links in made:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in cells or [])
        best = sum(pairs[x] == most[x[1]] for x in links)
        out.append((i, len(a), len(b), len(links), len(links), best, sum(pairs[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if cells else ""))
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [False, True])
def test_alignment_equals_brute_force(spark, frame, monkeypatch, small):
    if small:  # many blocks, partial sums and salts
        for name, value in (("BLOCK_LINKS", 100), ("MERGE_PAIRS", 50), ("GROUP_BYTES", 500), ("REMEMBERED", 20)):
            monkeypatch.setattr(alignment, name, value)
    got = alignment.align(frame, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_alignment(rows_of(frame, "doc_id", "text"))


def test_alignment_of_the_table(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(map(tuple, alignment.op13_alignment(spark, SF).collect()), key=str)
    assert got == plain_alignment(rows_of(documents, "doc_id", "text"))


@pytest.mark.parametrize("text", ["a  b", "  a", "a ", " ", "   ", "▁x", "a\tb\n c", "<s>x</s>", "a\x00b", "<unk>", "é́ﬁ", "x   "])
def test_words_of_pieces_are_encoded_apart(text):
    assert alignment.model_of(B).encode(" " + text).tolist() == sentencepiece.SentencePieceProcessor(model_file=B).encode(text)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    for made in (source_audit.audit(none), substrings.without_repeats(none), alignment.align(none, A, B)):
        assert made.collect() == []


LONG = ", and more words of it, which go on for some while, so that it is long enough to count as prose."
GOLDEN = [
    ("<article><p>Short art.</p></article><div class=comments>" + f"<p>Reader says{LONG * 3}</p>" * 10 + "</div>", ["Short art."]),
    (f"<article><h1>T</h1><p>A{LONG}</p><div class=alert><p>Note{LONG}</p></div><div class=share><a href=x>Tweet</a></div></article>", ["T", f"A{LONG}", f"Note{LONG}"]),
    (f"<article><p>A{LONG}</p><div class=search-results-analysis><p>Search{LONG}</p></div></article><div class=search><p>Find</p></div>", [f"A{LONG}", f"Search{LONG}"]),
    (f"<article><p>A{LONG}</p><section class=share-prices><p>Prices{LONG}</p></section><section id=respond><p>B{LONG * 9}</p></section></article>", [f"A{LONG}", f"Prices{LONG}"]),
    (f"<div><p>A{LONG}</p><p>B{LONG}</p></div><div><p>The end.</p></div><div>Copyright</div>", [f"A{LONG}", f"B{LONG}", "The end."]),
    (f"<article><p>Press the <button>Save</button> key, and <label>name</label> it well{LONG}</p><form><label>Mail</label></form></article>", [f"Press the Save key, and name it well{LONG}"]),
    (f'<div class="post has-comments"><p>A{LONG}</p></div><div id=footer>x</div>', [f"A{LONG}"]),
    (f"<div class=cookie-notice><p>We use cookies{LONG}</p></div><main><p>A{LONG}</p><p>B{LONG}</p></main>", [f"A{LONG}", f"B{LONG}"]),
    (f"<main><p>A{LONG}</p><div class=related><ul><li><a href=x>Other{LONG}</a></ul></div></main>", [f"A{LONG}"]),
    (f"<article><p>A{LONG}</p><div class=notice>Short note</div><div class=newsletter><p>Mail{LONG}</p></div></article>", [f"A{LONG}"]),
]


@pytest.mark.parametrize("page, want", GOLDEN)
def test_pages_of_different_templates(page, want):
    assert html_text.main_text(f"<html><body><nav><a href=/>Home</a></nav>{page}<footer>f</footer></body></html>").split("\n") == want


def test_pages_with_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "u", "<p>x", 3, "t"), (1, "u", "<p>x", 4, "s"), (None, None, None, None, None)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long, text string"))
    assert got.columns == ["page_id", "url", "text"] and sorted((r.text, str(r.page_id)) for r in got.collect()) == [("", "None"), ("x", "1"), ("x", "1")]


@pytest.mark.parametrize("bits", [1 << 12, 1 << 20])
def test_windows_of_many_lengths_share_two_sets(spark, monkeypatch, bits):
    """Windows against brute force, also where the bits are so few that most places collide."""
    monkeypatch.setattr(decontam, "MOST_BITS", bits)
    monkeypatch.setattr(decontam, "RUN", 8)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(words) for _ in range(1 + i % 16))) for i in range(60)]
    docs = [(i, " ".join([*(rng.choice(words) for _ in range(40)), items[i % 60][1]])) for i in range(80)]
    found = decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: (r.n_hit, sorted(r["items"])) for r in found.collect()}
    for i, text in docs:
        w, hit, named = text.split(), set(), set()
        for k, item in items:
            v = item.split()
            n = min(13, len(v))
            own = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)}
            at = [p for p in range(len(w) - n + 1) if tuple(w[p : p + n]) in own]
            hit.update(p + j for p in at for j in range(n))
            named.update([str(k)] if at else [])
        assert got[i] == (len(hit), sorted(named))
