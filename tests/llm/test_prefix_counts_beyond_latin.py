"""Prefix counts beyond Latin pieces: no prefix is encoded by itself, and the counts are the library's."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flightline.llm import prefix_counts

from .brute import documents

PARTS = st.sampled_from(["'", "’", "—", "日", "本", "é", "re", "r", "s", "ll", "T", "1", ".", " ", "  ", "\n", "\t", "　", "\xa0", "\x85", "\x1c", " ", "<", "|", "<|", "<|endoftext|>", "<|endoftext", "|>", "é", "🙂"])


@pytest.fixture(scope="module")
def counter():
    import public_tokenizers

    return prefix_counts._table(public_tokenizers.path("byte_bpe_50k.json"))[0]


@settings(max_examples=1500, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_counts_of_any_text_equal_the_library(text):
    import public_tokenizers

    counter, _ = prefix_counts._table(public_tokenizers.path("byte_bpe_50k.json"))
    assert counter.counts(text) == counter.whole([text[:k] for k in range(1, len(text) + 1)])


@pytest.mark.parametrize("unit", ["日本語テキスト", "f(x)=>'a’s';", "don't—"])
def test_long_unspaced_text_is_not_encoded_prefix_by_prefix(counter, monkeypatch, unit):
    text = unit * (60_000 // len(unit))
    last, handed = counter.whole([text])[0], []
    whole = counter.whole
    monkeypatch.setattr(counter, "whole", lambda texts: handed.extend(texts) or whole(texts))
    deltas = counter.deltas(text.encode())
    assert len(deltas) == len(text) and sum(deltas) == last
    assert sum(map(len, handed)) < 1000


def test_long_texts_without_blanks_stay_small_and_right(counter):
    import tracemalloc

    han = "".join(chr(0x4E00 + 37 * k % 3001) for k in range(60_000))
    code = ("if(a){b='x';}else{c=\"don't\"};" * 8000)[:200_000]
    for text in (han, code):
        tracemalloc.start()
        counts = counter.counts(text)
        assert tracemalloc.get_traced_memory()[1] < 200 << 20
        tracemalloc.stop()
        assert len(counts) == len(text)
        for k in (1, 2, 999, 50_001, len(text)):
            assert counts[k - 1] == counter.whole([text[:k]])[0]


def test_limits_are_read_off_the_prefix_table(spark, counter):
    docs = documents(spark)
    table = prefix_counts.prefix_table(docs, public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted((tuple(r) for r in prefix_counts.answered(table, 20).collect()), key=repr)
    expected = []
    for r in docs.collect():
        text = r["text"] or ""
        n = counter.whole([text[:k] for k in range(min(len(text), 400) + 1)])
        total = counter.whole([text])[0]
        fits = len(text) if total <= 20 and len(text) <= 400 else max(k for k, c in enumerate(n) if c <= 20)
        expected.append((r["doc_id"], len(text.encode()), len(text), total, total > 20, fits))
    assert got == sorted(expected, key=repr)
