import random

import xxhash

from helixframe.llm import line_dedup
from helixframe.llm.line_dedup import LINES, PIECES, dedup_lines, least_of, windows, winnow


def cleaned(df, **options):
    return {r.doc_id: r for r in dedup_lines(df, **options).collect()}


def block(text_of, seed, lines, words=12):
    return "\n".join(" ".join(text_of(seed * 100 + i, words).split()) for i in range(lines))


def test_windows():
    assert windows([60, 5, 50, 1], 50) == [1, 3, 3]
    assert windows([10, 10], 50) == []


def test_every_shared_span_shares_a_fingerprint():
    r = random.Random(3)
    for _ in range(200):
        shared = [(r.getrandbits(40), r.randint(1, 30)) for _ in range(r.randint(2, 12))]
        sides = [[(r.getrandbits(40), r.randint(1, 40)) for _ in range(r.randint(0, 6))] for _ in range(4)]
        docs = [sides[0] + shared + sides[1], sides[2] + shared + sides[3]]
        keys = [{k for k, _, _ in winnow([h for h, _ in d], [w for _, w in d], 50)} for d in docs]
        assert (sum(w for _, w in shared) < 50) or keys[0] & keys[1]


def brute(docs):
    """Deleted words of texts in order: spans of lines and pieces seen before, extended while they agree with the first one."""
    gone = [set() for _ in docs]
    for kind in (LINES, PIECES):
        least = least_of(kind)
        split = []
        for t in docs:
            words, lines = t.split(), [i for i, x in enumerate(t.split("\n")) for _ in x.split()]
            ends = [i + 1 for i in range(len(words)) if i + 1 == len(words) or lines[i] != lines[i + 1]] if kind == LINES else brute_pieces(words)
            split.append([(a, words[a:b]) for a, b in zip([0, *ends], ends)])
        seen = {}
        for d, held in enumerate(split):
            for start, end in enumerate(windows([len(x) for _, x in held], least)):
                key = tuple(tuple(x) for _, x in held[start:end])
                if key not in seen:
                    seen[key] = (d, start)
                    continue
                other, at = split[seen[key][0]], seen[key][1]
                a, b, total = 0, 0, 0
                while start - a > 0 and at - a > 0 and held[start - a - 1][1] == other[at - a - 1][1] and total < least:
                    a += 1
                    total += len(held[start - a][1])
                total, far = 0, at + end - start
                while end + b < len(held) and far + b < len(other) and held[end + b][1] == other[far + b][1] and total < least:
                    total += len(held[end + b][1])
                    b += 1
                for place, words in held[start - a : end + b]:
                    gone[d].update(range(place, place + len(words)))
    return gone


def brute_pieces(words):
    h = [xxhash.xxh64_intdigest(w.encode()) for w in words]
    pair = [(h[i + 1] * 0x9E3779B97F4A7C15) % 2**64 ^ (h[i] >> 7) for i in range(len(h) - 1)]
    cuts = {len(words)} if words else set()
    if len(words) > 8:
        for i in range(len(pair) - 7):
            cuts.add(min(range(i, i + 8), key=lambda k: (pair[k], k)) + 2)
    return sorted(cuts)


def test_matches_brute_force(make):
    r = random.Random(8)
    pool = [" ".join(f"w{r.randint(0, 500)}" for _ in range(r.randint(1, 30))) for _ in range(60)]
    passages = [[r.choice(pool) for _ in range(r.randint(2, 9))] for _ in range(12)]
    docs = ["\n".join(x for _ in range(r.randint(1, 4)) for x in (r.choice(passages) if r.random() < 0.6 else [f"own {r.getrandbits(30)} " + r.choice(pool)])) for _ in range(60)]
    got = cleaned(make(docs).repartition(5))
    for i, words in enumerate(brute(docs)):
        assert got[i].n_words_deleted == len(words), i
        assert got[i].text.split() == [w for k, w in enumerate(docs[i].split()) if k not in words], i


def test_passages_inside_lines_are_found_however_they_are_wrapped(make):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8)))
    found = 0
    texts = []
    for _ in range(60):
        passage = [word() for _ in range(51)]
        for _ in range(2):
            wrapped = "".join(w + ("\n" if r.random() < 0.15 else " ") for w in passage)
            texts.append(" ".join(word() for _ in range(30)) + " " + wrapped + " ".join(word() for _ in range(30)))
    got = cleaned(make(texts))
    for k in range(60):
        assert got[2 * k].n_words_deleted == 0
        assert 33 <= got[2 * k + 1].n_words_deleted <= 51, k
        found += got[2 * k + 1].n_words_deleted
    assert found / 60 > 40


def test_repeated_lines_go(make):
    line = "all rights of this text are reserved by nobody"
    docs = [f"one two three\n{line}\nfour", f"five six\n{line}", f"{line}\n{line}\nseven", "one two three\neight"]
    got = cleaned(make(docs))
    assert [got[i].text for i in range(4)] == [docs[0], "five six", "seven", docs[3]]  # three words are no run
    assert [got[i].n_deleted for i in range(4)] == [0, 1, 2, 0]


def test_later_runs_go_and_the_first_stays(make, text_of):
    shared = block(text_of, 1, 8)
    docs = [block(text_of, 2, 3) + "\n" + shared, block(text_of, 3, 2) + "\n\n" + shared + "\n" + block(text_of, 4, 2), "only " + block(text_of, 5, 6), shared + "\n" + shared]
    got = cleaned(make(docs))
    assert got[0].text == docs[0] and got[0].n_deleted == 0
    assert got[1].text == block(text_of, 3, 2) + "\n\n" + block(text_of, 4, 2) and got[1].n_deleted == 8
    assert got[2].text == docs[2]
    assert got[3].text == "" and got[3].n_deleted == 16


def test_one_long_line_and_short_runs(make, text_of):
    long = " ".join(text_of(9, 60).split())
    short = "a b c\nd e"
    got = cleaned(make([long + "\n" + short, "other\n" + long, short + "\nmore"]))
    assert got[1].text == "other" and got[2].text == short + "\nmore"


def test_repeats_within_a_document(make, text_of):
    b = block(text_of, 21, 6)
    got = cleaned(make([b + "\nmiddle words here\n" + b]))
    assert got[0].text == b + "\nmiddle words here"


def test_copies_keep_one(make, text_of):
    docs = [block(text_of, 31, 7)] * 5
    got = cleaned(make(docs).repartition(3))
    assert got[0].n_deleted == 0 and all(got[i].n_deleted == 7 and got[i].text == "" for i in range(1, 5))


def test_odd_rows(odd, empty):
    out = dedup_lines(odd)
    assert out.count() == odd.count()
    assert set(odd.columns) <= set(out.columns)
    assert out.where("doc_id = 1").first().text is None
    same = [r for r in out.where("doc_id = 5").collect()]
    assert len({r.text for r in same}) == 1  # rows of one document are treated alike
    assert dedup_lines(empty).count() == 0


def test_no_stage_holds_two_kernels(make, text_of, monkeypatch):
    """Each kernel of a stage has a Python worker a core: two in one stage take twice the memory."""
    plans = {}

    def held(df, folder, name, write=line_dedup.written):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, folder, name)

    monkeypatch.setattr(line_dedup, "written", held)
    text = block(text_of, 1, 8)
    assert sum(r["n_deleted"] for r in cleaned(make([text, "new words\n" + text])).values()) > 0
    assert {"units", "spans", "runs"} <= set(plans)
    assert {name: plan.count("MapInArrow") for name, plan in plans.items() if plan.count("MapInArrow") > 1} == {}
