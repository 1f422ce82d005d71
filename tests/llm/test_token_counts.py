import random

import pytest
from pyspark.sql import functions as F

from helixframe.llm.queries import tokenizer_file
from helixframe.llm.token_counts import PrefixCounter, count_prefixes, longest_prefix, packed, token_counts, tokens_of_prefix, unpacked

PATH = tokenizer_file("word_bpe_49k.json")
#: Parts of texts that the normalizer, the word pattern or special strings treat in their own way.
PARTS = ["a", "re", "'", "'re", "'s", "ll", "v", "e", "!", "=", "==", "<|endoftext|>", "<|startoftext|>", "<|endof", "İ", "É", "é", "ọ̈", "́", "Σ", "ς", "한", "한", "ᄀ", "ᅡ", "漢", "\U0001f600", "‍", " ", "\n", "\xa0", " ", "　", "\x1c", "​", "7", "\xbd", "Ⅷ", "Å", "क़", "﻿", "\x00", "\x85", "̈́", "\xdf", "ﬁ", "HELLO", "the"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


def test_every_prefix_has_the_count_of_the_library(library):
    r, counter = random.Random(5), PrefixCounter(PATH)
    for _ in range(600):
        text = "".join(r.choice(PARTS) for _ in range(r.randint(0, 12)))
        steps = counter.changes(text)
        counts = unpacked(packed(steps), steps.itemsize)
        assert counts.tolist() == [library(text[:k]) for k in range(len(text) + 1)], ascii(text)


def test_long_runs(library):
    counter = PrefixCounter(PATH)
    for text in ("=" * 3000, "ab" * 2000, "漢" * 900, "zqx" * 700 + "!" * 500, "e" + "́" * 60):
        steps = counter.changes(text)
        counts = unpacked(packed(steps), steps.itemsize)
        for k in (0, 1, len(text) // 3, len(text) - 1, len(text)):
            assert counts[k] == library(text[:k])


def test_answers_come_from_the_table(make, text_of, library):
    texts = [text_of(1, 300), "short", "", None]
    held = count_prefixes(make(texts), PATH)
    for most in (0, 5, 64):
        for r in held.select("id", tokens_of_prefix(F.lit(most)).alias("tokens"), longest_prefix(F.lit(most)).alias("chars")).collect():
            text = texts[r.id] or ""
            counts = [library(text[:k]) for k in range(len(text) + 1)]
            assert r.tokens == counts[min(most, len(text))]
            assert r.chars == max(k for k, c in enumerate(counts) if c <= most)
    assert held.select(longest_prefix(F.lit(None).cast("long")).alias("x")).where("x is not null").count() == 0


def test_odd_rows(odd, empty, library):
    rows = token_counts(odd, PATH, limit=100).collect()
    assert len(rows) == odd.count() and sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((r.doc_id is None, r.doc_id or 0) for r in odd.collect())
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    for r in rows:
        if r.doc_id is not None:
            text = texts[r.doc_id] or ""
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), library(text), library(text) > 100)
            assert library(text[: r.fit_chars]) <= 100
    assert token_counts(empty, PATH).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        PrefixCounter(tokenizer_file("byte_bpe_50k.json"))
