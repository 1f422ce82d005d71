import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from helixframe.llm.lexical_search import Ranking, groups_of_masks, search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, total, df = len(held), sum(n for _, _, n in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in set(items):
        found = []
        for i, c, n in held:
            m = 10 + 90 * n * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, i is not None, i or 0))
        out += [(item, r + 1, i if there else None, -s) for r, (s, there, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def case(text_of):
    r = random.Random(3)
    docs = [(i, text_of(r.randint(0, 60), r.randint(1, 120), 60)) for i in range(300)] + [(400, None), (401, ""), (402, "?!"), (None, "alpha beta"), (7, "Alpha, BETA. café")]
    items = [(i, text_of(900 + i, 5 * i + 1, 60)) for i in range(15)] + [(20, "ALPHA café beta-beta"), (20, "ALPHA café beta-beta"), (21, None), (22, "..."), (23, "nowhere"), (None, "alpha"), (24, text_of(4, 400, 200))]
    return docs, items


@pytest.mark.parametrize("block_terms", [500_000, 40])  # one block of queries, and many
def test_matches_brute_force(spark, make, case, block_terms):
    docs, items = case
    found = search(make(docs).repartition(3), spark.createDataFrame(items, "item_id long, text string"), block_terms=block_terms)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(docs, items)


def test_equal_scores_go_by_id(spark, make):
    docs = [(i, "same words here") for i in range(40, 0, -1)] + [(100 + i, f"filler {i}") for i in range(50)]
    found = search(make(docs).repartition(4), spark.createDataFrame([(1, "same words")], "item_id long, text string")).collect()
    assert [r.doc_id for r in sorted(found, key=lambda r: r.rank)] == list(range(1, 11))


def test_masks_are_grouped():
    r = np.random.default_rng(1)
    for n in (1, 8, 9, 64, 65, 200):
        present = r.random((n, 150)) < 0.1
        masks, group = groups_of_masks(present)
        assert len({m.tobytes() for m in masks}) == len(masks)
        assert all((masks[g] == present[:, i]).all() for i, g in enumerate(group))


def test_groups_below_the_best_are_not_scored():
    n, rare = 5000, 40
    ends = np.arange(n + 1)
    held = np.where(np.arange(n) < rare, 1, 0)
    ranking = Ranking([(0, [0, 1])], np.array([10, 900]), n, 5 * n, 10)
    ranking.add(np.arange(n), np.zeros(n, bool), np.full(n, 5), ends, held, np.ones(n, int))
    assert ranking.best[0][1].tolist() == list(range(10)) and ranking.scored <= n
    ranking.add(np.arange(n, 2 * n), np.zeros(n, bool), np.full(n, 5), ends, np.zeros(n, int), np.ones(n, int))
    assert ranking.scored <= n  # the second batch holds the common term alone


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "x Ünïcödé")], "item_id long, text string")
    found = [tuple(r) for r in search(odd, items).collect()]
    assert sorted(found, key=repr) == brute([(r.doc_id, r.text) for r in odd.collect()], [(1, "x Ünïcödé")])
    assert search(empty, items).count() == 0 and search(odd, items.limit(0)).count() == 0
