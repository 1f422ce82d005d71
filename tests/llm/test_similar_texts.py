import random
import re

import numpy as np

from helixframe.llm import similar_texts as T
from helixframe.llm.simhash_dedup import fingerprint


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return {doc: least[find(i)] for i, (doc, _) in enumerate(rows)}


def edited(r, text, n):
    words = text.split()
    for i in r.sample(range(len(words)), min(n, len(words))):
        words[i] = f"new{r.random()}"
    return " ".join(words)


def test_pigeonring_is_the_hamming_check_and_keeps_links():
    r = np.random.default_rng(6)
    one = r.integers(0, 2**64, (4000, T.SEGMENTS), dtype=np.uint64)
    two = one.copy()
    for i in range(len(one)):  # flips unevenly spread over the segments
        for b in r.choice(64 * T.SEGMENTS, r.integers(40, 120), replace=False) if i % 2 else r.choice(150, r.integers(40, 120), replace=False):
            two[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    away = np.bitwise_count(one ^ two).sum(1)
    assert (T.in_budget(one, two) == (away <= T.MOST_BITS)).all() and 0 < (away <= T.MOST_BITS).mean() < 1
    for n in (4, 5, 9, 20, 100, 400):  # sets whose similarity is 0.8 or just more
        worst = 0
        for _ in range(300):
            shared = r.integers(0, 2**64, -(-8 * n // 9), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([shared, r.integers(0, 2**64, k, dtype=np.uint64)])) for k in (n - len(shared), n - len(shared)))
            worst = max(worst, np.bitwise_count(T.simhash(a) ^ T.simhash(b)).sum())
        assert worst < T.MOST_BITS, n
    four, five = r.integers(0, 2**64, (2, 5), dtype=np.uint64)[0][:4], None
    five = np.append(four, r.integers(0, 2**64, 1, dtype=np.uint64))
    assert np.bitwise_count(T.simhash(np.sort(four)) ^ T.simhash(np.sort(five))).sum() < T.MOST_BITS


def test_all_similar_texts_link_in_small_and_large_buckets(make, text_of, monkeypatch):
    r = random.Random(3)
    monkeypatch.setattr(T, "SAMPLED", 1)
    passage = text_of(99, 60)
    texts = []
    for k in range(25):
        base = text_of(k, r.choice([5, 17, 40, 120, 300])) + (" " + passage if k % 2 else "")
        texts += [base] + [edited(r, base, r.randint(0, max(1, len(base.split()) // 40))) for _ in range(6)]
    base = text_of(50, 200)
    texts += [base] + [edited(r, base, r.randint(1, 9)) for _ in range(40)] + ["a b", "A  b", "a", None, "", " \n"]
    rows = list(zip(r.sample(range(1000), len(texts)), texts))
    want = brute(rows)
    assert len(set(want.values())) < len(rows) - 40
    for block, named in ((4, 0), (5000, T.NAMED)):  # the first one deals pairs of blocks and joins texts
        assert {x.doc_id: x.component_id for x in T.similar_texts(make(rows), block=block, named=named).collect()} == want, block


def test_the_stage_drops_near_copies_beyond_three_bits(spark, make, text_of):
    import corpus_pipeline

    r = random.Random(8)
    base = text_of(7, 300)
    copies = [c for c in (edited(r, base, 5) for _ in range(50)) if bin(fingerprint(c) ^ fingerprint(base)).count("1") > 3 and jaccard(grams(c), grams(base)) >= 0.8]
    assert len(copies) > 3
    docs = make([(1, base), *((i + 2, c) for i, c in enumerate(copies)), (900, edited(r, base, 60)), (901, text_of(8, 300))])
    assert sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 900, 901]


def test_odd_rows(odd, empty):
    assert T.similar_texts(odd).count() == odd.count()
    kept = T.drop_similar_texts(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 1 in ids and 8 in ids and 9 not in ids and ids.count(5) == 1
    assert T.similar_texts(empty).count() == 0 and T.drop_similar_texts(empty).count() == 0


def test_a_large_group_is_joined_by_few_links(make, monkeypatch):
    """Texts that all link with each other, met by the last steps alone: pairs and walked links grow with the texts, not with their square."""
    base, texts = [f"w{i}" for i in range(200)], 150
    rows = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(20, 20 + texts)]
    walked, compared = [], []
    components, written = T.components, T.written
    monkeypatch.setattr(T, "components", lambda links, *a: walked.append(links.count()) or components(links, *a))
    monkeypatch.setattr(T, "written", lambda df, folder, name: (compared.append((out := written(df, folder, name)).count()) or out) if name.endswith("_pairs") else written(df, folder, name))
    found = T.similar_texts(make(rows), rounds=-1).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(i, 20) for i, _ in rows}
    assert sum(compared) <= 12 * texts and sum(walked) <= 12 * texts, (compared, walked)
