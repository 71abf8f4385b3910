"""Suffix-array removal against brute force over bytes."""

import random

import numpy as np
import pytest

import hubflow.llm.suffix_dedup as S
from tests.llm.conftest import ODD, by_id


def brute(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k:k + length]
            if w in seen:
                gone[k:k + length] = b"\1" * length
            seen.add(w)
        keep = bytes(x for x, g in zip(b, gone) if not g)
        a = np.frombuffer(bytes(gone), np.uint8)
        out[i] = (len(b), len(b) - len(keep), int((np.diff(np.concatenate(([0], a))) == 1).sum()), keep)
    return out


def report(df):
    return {i: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for i, r in by_id(df).items()}


def corpus(seed):
    rng = random.Random(seed)
    line = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    shared, exact, near = line(130), line(101), line(400)
    rows = []
    for i in range(60):
        t = line(rng.randint(0, 300))
        if i % 4 == 0:
            t = t[:20] + shared + t[20:]
        if i % 7 == 0:
            t += exact + "x" * (i % 3)
        if i % 5 == 0:
            at = rng.randrange(len(near))
            t += near[:at] + "#" + near[at + 1:]
        rows.append((i, t))
    return rows + [(60, "ab" * 200), (61, "ab" * 150), (62, "z" * 99), (63, "z" * 100), (64, "z" * 350), (65, rows[8][1]), (66, "\0" * 120), (67, "\0" * 120)]


def test_suffix_order():
    rng = np.random.default_rng(5)
    for _ in range(150):
        s = rng.integers(0, rng.integers(1, 5), rng.integers(1, 70)).astype(np.uint8)
        b = s.tobytes()
        assert [b[i:] for i in S.suffix_order(s + 97, 100)] == sorted(b[i:] for i in range(len(b)))


@pytest.mark.parametrize("group", [20_000, 3])
def test_equals_brute_force(docs, monkeypatch, group):
    monkeypatch.setattr(S, "GROUP", group)  # 3: most anchors are dealt out by window
    rows = corpus(group)
    assert report(S.repeat_report(docs(rows))) == brute(rows)


def test_blocks_find_the_same_anchors(monkeypatch):
    text = " ".join(str(i * i) for i in range(2000)).encode()
    whole = S.anchors(text)
    monkeypatch.setattr(S, "BLOCK", 700)
    for a, b in zip(whole, S.anchors(text)):
        assert np.array_equal(a, b)


def test_odd_rows(docs):
    rows = [r for r in ODD if r[0] is not None and len(r[1] or "") < 60_000]
    got = S.repeat_report(docs([r for r in ODD if len(r[1] or "") < 60_000] + [(9, ODD[-1][1])]))
    assert got.count() == len(rows) + 2
    assert report(got.where("doc_id is not null")) == brute(rows)
    assert S.repeat_report(docs([(1, "a")]).limit(0)).collect() == []


def test_texts_stay_whole_characters(docs):
    text = "é日本" + "".join(chr(0x4E00 + 7 * i) for i in range(60))
    out = {r["doc_id"]: r for r in S.remove_repeats(docs([(1, text), (2, text + " end"), (3, None)])).collect()}
    assert out[1]["text"] == text and out[2]["text"].endswith(" end") and len(out[2]["text"]) < 40 and out[3]["text"] is None
    assert set(out[1].asDict()) == set(docs([(1, "")]).columns)


def test_periodic_text_sends_each_context_once(docs, monkeypatch):
    sent, whole = [], S._sorted_groups
    monkeypatch.setattr(S, "_sorted_groups", lambda held, length: sent.append(held.count()) or whole(held, length))
    line = "One line that is repeated again and again.\n"
    text = "head " + line * (2_000_000 // len(line)) + "tail"
    rows = [(1, text), (2, "other " + line * 40 + "end")]
    assert report(S.repeat_report(docs(rows))) == brute(rows)
    assert 0 < sent[0] < 100
