import random
import re

import numpy as np
import xxhash

from helixframe.llm import simhash_dedup as S
from helixframe.llm.components import components
from helixframe.llm.common import shared_folder


def slow(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    g = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if bin(a ^ values[j]).count("1") <= 3:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(values))]


def test_fingerprints(text_of):
    for t in ["", None, "A", "b C", "one two three", "ÄÖ  x y\x0bz\x1cq r s", text_of(1, 300)]:
        assert S.fingerprint(t) == slow(t)


def cluster(r, center, n, bits):
    return [center ^ sum(1 << b for b in r.sample(bits, r.randint(0, 3))) for _ in range(n)]


def test_all_links_are_found_in_small_and_large_buckets(spark):
    r = random.Random(4)
    values = [r.getrandbits(64) for _ in range(150)]
    values += cluster(r, values[0], 120, range(64)) + cluster(r, values[1], 120, range(16, 34)) + [0, 1, 7, 15, 2**64 - 1, 2**64 - 8]
    values = list(dict.fromkeys(values))
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = brute_components(values)
    for block in (8, 64, 5000):  # the smallest ones refine buckets and deal pairs of blocks
        folder = shared_folder(spark)
        roots = {x.node: x.root for x in components(S.fingerprint_links(df, folder, block), folder).collect()}
        got = {}
        for i, v in enumerate(signed):
            got.setdefault(roots.get(v, v), set()).add(i)
        expected = {}
        for i, c in enumerate(want):
            expected.setdefault(c, set()).add(i)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values())), block


def test_budgets_are_those_of_the_ring():
    assert S.BUDGETS == (0, 1, 2, 3)


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(5, 5)]
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "a long, b long"), shared_folder(spark)).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 140))


def test_documents_and_filter(make, text_of):
    base = text_of(1, 2000)
    own = slow(base)
    near = next(t for t in (base + f" {'more ' * i}" for i in range(1, 200)) if 0 < bin(slow(t) ^ own).count("1") <= 3)
    docs = make([(5, base), (3, base), (9, near), (7, text_of(2, 300)), (8, None), (4, "")])
    rows = {r.doc_id: r for r in S.near_duplicates(docs).collect()}
    assert {i: rows[i].component_id for i in rows} == {5: 3, 3: 3, 9: 3, 7: 7, 8: 4, 4: 4} and rows[8].fingerprint == "0" * 16
    assert all(rows[i].fingerprint == format(slow(t), "016x") for i, t in [(5, base), (9, near)])
    assert sorted(r.doc_id for r in S.drop_near_duplicates(docs).collect()) == [3, 4, 7]


def test_odd_rows(odd, empty):
    rows = S.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    kept = S.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 1 in ids and 8 in ids and 9 not in ids and ids.count(5) == 1
    assert S.near_duplicates(empty).count() == 0 and S.drop_near_duplicates(empty).count() == 0
