"""Splitting by separators: what holds for every text, and a plain count of what is kept."""

from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.operators import ingest

TEXTS = st.lists(st.sampled_from(["word", "a", "。", "！", " ", "\n", "\n\n", "，", "long" * 9, "句子"]), max_size=120).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(8, 60), st.integers(0, 7))
def test_pieces(text, size, overlap):
    pieces = ingest.split_text(text, size, overlap)
    assert all(p and p == p.strip() and len(p) <= size for p in pieces)
    at = 0
    for p in pieces:  # each piece stands in the text, not before the one before it
        at = text.find(p, at)
        assert at >= 0
    seen = "".join("".join(p.split()) for p in ingest.split_text(text, size, 0))
    assert seen == "".join(text.split())  # without an overlap nothing is lost and nothing is doubled


def test_short_and_empty_texts():
    assert ingest.split_text("", 10, 2) == [] and ingest.split_text(" \n ", 10, 2) == [] and ingest.split_text(" ab ", 10, 2) == ["ab"]
    assert ingest.split_text("x" * 25, 10, 0) == ["x" * 10, "x" * 10, "x" * 5]
    assert ingest.split_text("one\n\ntwo\n\nthree", 9, 4) == ["one\n\ntwo", "three"]
