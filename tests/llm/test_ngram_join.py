"""N-gram Jaccard join against brute force, with crowds, hot shingles and edge cases."""

import random
import re
from collections import defaultdict

import pytest

import hubflow.llm.ngram_join as J
from tests.llm.conftest import ODD, by_id

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, n, pct):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").encode().lower())
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= pct * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((top(a), top(b)))
                up[q] = p
    return {i: (len(sets[i]), top(i)) for i in sets}


def corpus(seed, crowd):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(120):
        w = [rng.choice(words) for _ in range(rng.randint(3, 90))]
        if i % 3 == 0:
            w[1:1] = passage
        rows.append(w)
    base = [rng.choice(words) for _ in range(80)]
    for _ in range(crowd):  # near copies with few and with many changes
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append(w)
    rows += [list(rows[5]), [x.upper() for x in rows[7]]]
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("n, pct, hot", [(3, 90, 64), (5, 80, 64), (3, 90, 8), (2, 60, 6)])
def test_components_equal_brute_force(docs, monkeypatch, n, pct, hot):
    monkeypatch.setattr(J, "HOT", hot)
    rows = corpus(n, 70)
    got = {i: (r["n_shingles"], r["component_id"]) for i, r in by_id(J.ngram_jaccard_join(docs(rows), n, pct)).items()}
    assert got == brute(rows, n, pct)


def test_odd_rows(docs):
    rows = [r for r in ODD if r[0] is not None]
    got = J.ngram_jaccard_join(docs(ODD + [(4, "one")]), 5, 80)
    assert got.count() == len(ODD) + 1
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in by_id(got.where("doc_id is not null")).items()} == brute(rows, 5, 80)
    assert got.where("doc_id is null").first()["component_id"] is None


def test_empty_table(docs):
    assert J.ngram_jaccard_join(docs([(1, "a")]).limit(0), 5, 80).collect() == []


def test_prefix_grows_past_hot_shingles():
    import numpy as np
    l, r = J.best_prefix(40, 90, np.array([100.0, 100, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1]), 12)
    assert l >= 3 and r >= 1
    assert J.best_prefix(40, 90, np.full(12, 100.0), 12) == (0, 0)


def test_row_without_id_links_its_neighbours(docs):
    words = [f"w{i}" for i in range(60)]
    text = lambda w: " ".join(w)
    ends = words + ["a", "b", "c", "d", "e", "f"], ["p", "q", "r", "s", "t", "u"] + words
    rows = [(5, text(ends[0])), (9, text(ends[1])), (None, text(words)), (11, "something else entirely in this one")]
    assert by_id(J.ngram_jaccard_join(docs([rows[0], rows[1]]), 3, 90))[9]["component_id"] == 9
    got = by_id(J.ngram_jaccard_join(docs(rows), 3, 90))
    assert {i: got[i]["component_id"] for i in (5, 9, None, 11)} == {5: 5, 9: 5, None: 5, 11: 11}
