import hashlib
import zlib
from collections import defaultdict

import pytest

from helixframe.llm.merkle_manifest import lowered_fifth, manifest, rolled_up

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def leaf_of(r, text):
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def path(tree, at):
    for nodes in tree[:-1]:
        low = at // 16 * 16
        yield nodes[low:at], nodes[at + 1 : low + 16]
        at //= 16


def brute(rows):
    """The sorted result rows, by plain lists."""
    groups = defaultdict(list)
    for r in rows:
        groups[r.source].append(r)
    keys = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for k in keys:
        groups[k].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text)))
        trees.append(levels([leaf_of(r, r.text) for r in groups[k]]))
    top = levels([t[-1][0] for t in trees])
    out = []
    for s, (k, tree) in enumerate(zip(keys, trees)):
        for i, r in enumerate(groups[k]):
            hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
            steps = [*path(tree, i), *path(top, s)]
            folded = leaf_of(r, lower(r.text) if hit else r.text)
            for before, after in steps:
                folded = digest([*before, folded, *after])
            proof = digest(x for before, after in steps for x in (*before, *after))
            out.append((r.doc_id, tree[0][i], tree[-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def check(df):
    got = sorted((tuple(r) for r in manifest(df, tampered=lowered_fifth).collect()), key=repr)
    assert got == brute(df.collect())
    return got


@pytest.mark.parametrize("counts", [{"one": 1}, {"a": 16, "b": 17, None: 1, "": 2}, {"a": 257, "B": 300, "ü": 5}, {f"s{i}": 1 + i % 3 for i in range(40)}])
def test_matches_plain_lists(spark, counts):
    rows = [(i * 7 % 1000, f"Text {i} OF {s}", "en", s, i) for s, n in counts.items() for i in range(n)]
    check(spark.createDataFrame(rows, SCHEMA))


def test_more_than_one_tier(spark):
    rows = [(i, f"Row {i}", None, "hot" if i < 4600 else "x", i) for i in range(4700)]
    got = check(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert {r[6] for r in got} == {True, False}


def test_blocks_are_bounded(spark):
    nodes = spark.range(9000).selectExpr("'k' AS key", "id AS rank", "9000L AS n", "sha2(string(id), 256) AS node", "string(id) AS held")
    blocks = rolled_up(nodes).collect()
    assert sorted(sum(len(b.kids) for a in r.kids for b in a.kids) for r in blocks) == [808, 4096, 4096]


def test_plan_shuffles_blocks_once(spark):
    nodes = spark.range(90).selectExpr("string(id % 2) AS key", "id AS rank", "id % 3 AS n", "sha2(string(id), 256) AS node", "string(id) AS held")
    assert rolled_up(nodes)._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
    plan = rolled_up(nodes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_odd_rows(odd, empty):
    check(odd)
    assert manifest(empty).count() == 0
    assert all(r.verified for r in manifest(odd).collect())
