import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from helixframe.llm.language_id import LEAST_SHARE, LanguageFilters, grams, held_out, identify_languages, keep_languages, predictor, slots, train

SYLLABLES = {"en": "the and ing tion er re on".split(), "fr": "eau ç de que ment oi é".split(), "de": "sch ung der ein ü keit ß".split()}


def text(lang, seed, n=60):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, text(lang, i, 5 + i % 90), lang, "s", 1) for i, lang in enumerate(list(SYLLABLES) * 100)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_grams_are_windows_of_letters_with_single_boundaries():
    doc, h = grams(["Ab, c", None, "", "Ab c"])
    assert (h[doc == 0] == h[doc == 3]).all() and not ((doc == 1) | (doc == 2)).any()
    assert len(h[doc == 0]) == len(" ab c ") - 3


def test_filter_returns_all_languages_of_a_gram():
    _, a = grams(["abcd"])
    masks = np.zeros((1 << 12, 2), np.uint64)
    for bit in (0, 70):
        for place in slots(a, 1 << 12, 3):
            masks[place, bit // 64] |= np.uint64(1 << bit % 64)
    f = LanguageFilters([str(i) for i in range(71)], masks)
    lang, score = f.predict(["abcd", "zzzz", None, "123"])
    assert lang == ["0", "0", "und", "und"] and abs(score[0] - 0.5) < 1e-6 and score[2] == 0


def test_held_out_accuracy(docs):
    rows = identify_languages(docs, train(docs.where(~held_out()))).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert len(out) > 30 and np.mean([r.lang == r.lang_pred for r in out]) >= 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)


def exact_grams(text):
    """The n-grams of a text as strings, with repeats."""
    letters = "".join(c.lower()[0] if c.isalpha() else " " for c in " " + text + "   ")
    while "  " in letters:
        letters = letters.replace("  ", " ")
    return [letters[i : i + 4] for i in range(len(letters) - 3)]


@pytest.mark.parametrize("m", [1 << 20, 1 << 13])  # hardly any false positives, and a filter that has many
def test_predictions_are_those_of_exact_sets(docs, m):
    """Brute force without Bloom filters: sets of n-grams by language, whole counts of each text's."""
    known = docs.where(~held_out()).collect()
    held = {}
    for lang in SYLLABLES:
        texts = [set(exact_grams(r.text)) for r in known if r.lang == lang]
        counts = Counter(g for s in texts for g in s)
        held[lang] = {g for g, n in counts.items() if n >= max(2, len(texts) * LEAST_SHARE)}
    f = train(docs.where(~held_out()), m=m)
    texts = [text(lang, 1000 + i, 1 + i % 40) for i in range(60) for lang in SYLLABLES] + ["the schung deré", "ing ing"]
    said, score = f.predict(texts)
    same, apart = 0, []
    for t, lang, s in zip(texts, said, score):
        n = {x: sum(g in held[x] for g in exact_grams(t)) for x in sorted(held)}
        if not sum(n.values()):
            continue
        best = max(n.values())
        same += n[lang] == best
        apart.append(abs(s - best / sum(n.values())))
    assert same >= (len(apart) if m > 1 << 13 else 0.95 * len(apart))
    assert np.max(apart) < 1e-3 if m > 1 << 13 else np.mean(apart) < 0.05  # what chance reports is taken off
    noise = ["".join(random.Random(i).choice("qxzjkwvy") for _ in range(400)) for i in range(20)]
    doc, h = grams(noise)
    hit = f.masks[slots(h, m, f.hashes)[0]] & f.masks[slots(h, m, f.hashes)[1]] & f.masks[slots(h, m, f.hashes)[2]]
    measured = [((hit[:, 0] >> np.uint64(i)) & np.uint64(1)).mean() for i in range(len(f.languages))]
    assert np.allclose(measured, f.chance(), atol=0.01)


def test_long_texts_count_whole(docs):
    f = train(docs)
    mixed = text("en", 1, 50) + " " + text("de", 2, 40_000)
    assert f.predict([mixed])[0] == ["de"]


def test_filter_keeps_columns(docs):
    f = train(docs)
    kept = keep_languages(docs.unionByName(docs.limit(1).selectExpr("doc_id", "'123 !!' AS text", "lang", "source", "n_chars")), f)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_odd_rows(odd, empty, docs):
    f = train(docs)
    rows = identify_languages(odd, f).collect()
    assert len(rows) == odd.count() and all(r.lang_pred == "und" for r in rows if r.doc_id in (1, 2, 3))
    assert not any(r.held_out for r in rows if r.doc_id is None)
    assert keep_languages(odd, f).columns == odd.columns
    none = train(empty)
    assert {r.lang_pred for r in identify_languages(odd, none).collect()} == {"und"}
    assert identify_languages(empty, f).count() == 0
    assert train(odd).languages == ["en", "fr", "xx"]


def test_workers_take_few_texts_at_once(spark, monkeypatch):
    """A batch of any size is turned into Python's texts by slices, so a worker's memory does not grow with the batch."""
    filters = LanguageFilters(["a"], np.zeros((64, 1), np.uint64))
    seen = []
    monkeypatch.setattr(LanguageFilters, "predict", lambda self, texts: (seen.append(len(texts)), (["a"] * len(texts), np.zeros(len(texts))))[1])
    out = list(predictor(spark, filters).func(iter([pa.array(["x", None] * 500)])))
    assert [len(x) for x in out] == [1000]
    assert sum(seen) == 1000 and max(seen) <= 64
