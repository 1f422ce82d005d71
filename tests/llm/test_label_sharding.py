import itertools
import zlib

import numpy as np
import pytest

from helixframe.llm.label_sharding import grants, shard_documents


def checked(rows, shards, total):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert sum(sizes) == total and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_sizes_slots_and_groups(make, text_of):
    texts = [text_of(i, 20) for i in range(300)] + [text_of(900 + i // 6, 15) for i in range(120)]
    docs = make(texts)
    rows = shard_documents(docs, shards=10).collect()
    checked(rows, 10, 420)
    at = {r.doc_id: r for r in rows}
    assert all(at[i].text_crc32 == zlib.crc32(t.encode()) and at[i].size == len(t.encode()) + 16 and at[i].law == "rows" and at[i].grown_shard is None for i, t in enumerate(texts))
    cut = sum(len({at[300 + 6 * g + k].shard for k in range(6)}) > 1 for g in range(20))
    assert cut <= 2


def least_cut(groups, shards, total):
    """Brute force: the fewest groups that any assignment with sizes at most one apart must cut."""
    quota = [total // shards + (s < total % shards) for s in range(shards)]

    def fit(left, room):  # whether these groups go into shards uncut
        if not left:
            return True
        return any(fit(left[1:], [r - left[0] if k == s else r for k, r in enumerate(room)]) for s in range(shards) if room[s] >= left[0])

    for cut in range(len(groups) + 1):
        if any(fit(sorted((g for i, g in enumerate(groups) if i not in gone), reverse=True), quota) for gone in itertools.combinations(range(len(groups)), cut)):
            return cut


@pytest.mark.parametrize("sizes, alone", [([4, 3, 3, 2], 12), ([6, 2, 2], 14), ([9, 3], 12), ([5, 5, 5], 9)])
def test_cuts_are_close_to_the_least(make, text_of, sizes, alone):
    texts = [text_of(700 + g, 12) for g, n in enumerate(sizes) for _ in range(n)] + [text_of(i, 12) for i in range(alone)]
    rows = shard_documents(make(texts), shards=4).collect()
    checked(rows, 4, len(texts))
    at, cut, first = {r.doc_id: r.shard for r in rows}, 0, 0
    for n in sizes:
        cut += len({at[i] for i in range(first, first + n)}) > 1
        first += n
    assert least_cut(sizes, 4, len(texts)) <= cut <= least_cut(sizes, 4, len(texts)) + 1


def test_a_group_of_a_third_fills_as_few_shards_as_it_can(make, text_of):
    texts = ["same text for all of these"] * 200 + [text_of(i, 10) for i in range(400)]
    rows = shard_documents(make(texts).repartition(3), shards=12).collect()
    checked(rows, 12, 600)
    assert len({r.shard for r in rows if r.doc_id < 200}) <= 6  # four are full of it


def test_grants_keep_within_capacity():
    rng = np.random.default_rng(1)
    demand = rng.integers(0, 40, (6, 6)) * (1 - np.eye(6, dtype=int))
    loads = demand.sum(1) + rng.integers(0, 30, 6)
    share = grants(demand.astype(float), loads.astype(float), loads.mean() * 1.1)
    flow = share * demand
    after = loads - flow.sum(1) + flow.sum(0)
    assert ((0 <= share) & (share <= 1)).all() and (after <= np.maximum(loads.mean() * 1.1, loads) + 1e-3).all()


def test_odd_rows(odd, empty):
    rows = shard_documents(odd, shards=4).collect()
    checked(rows, 4, odd.count())
    assert all(r.size == 16 and r.text_crc32 == 0 for r in rows if r.doc_id in (1, 2))
    assert shard_documents(empty, shards=4).count() == 0
