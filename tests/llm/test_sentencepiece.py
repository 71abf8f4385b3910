"""SentencePiece Viterbi against a plain dynamic programme, and the round trip."""

import random

import numpy as np
import pytest

import hubflow.llm.sentencepiece_viterbi as S
from tests.llm.conftest import ODD, by_id

tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return S.PieceModel(PATH)


def brute(model, text):
    special = {int(i) for i in model.byte_id} | {0, 1, 2}
    vocab = {b.decode(): i for i, b in enumerate(model.bytes_of) if b and i not in special}
    s = " " + text.replace("▁", " ")
    best, back = [0.0] + [-np.inf] * len(s), [None] * (len(s) + 1)
    for j in range(1, len(s) + 1):
        for l in range(min(j, 48), 0, -1):
            p = vocab.get(s[j - l:j])
            if p is not None and best[j - l] + model.score[p] > best[j]:
                best[j], back[j] = best[j - l] + model.score[p], (l, [p])
        if s[j - 1] not in vocab and best[j - 1] + model.unknown > best[j]:
            best[j], back[j] = best[j - 1] + model.unknown, (1, [int(model.byte_id[b]) for b in s[j - 1].encode()])
    out, j = [], len(s)
    while j:
        out, j = back[j][1] + out, j - back[j][0]
    return out if text else []


def texts():
    rng = random.Random(4)
    alphabet = "etaoin shrdlu  the\n\té日本語한▁😀\u0301.,<0x0A>"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(150)] + ["a" * 700, "日" * 300, " " * 90, "x" + " " * 40 + "y", "nospace" * 60 + "é"]


def test_equals_plain_programme(model):
    for t, ids in zip(texts(), model.encode([t.encode() for t in texts()])):
        assert np.frombuffer(ids, "<u4").tolist() == brute(model, t), t
        assert model.decode(ids).decode() == t.replace("▁", " ")


def test_memory_is_bounded(model, monkeypatch):
    monkeypatch.setattr(S, "REMEMBERED", 5)
    fresh = S.PieceModel(PATH)
    rows = [t.encode() for t in texts()]
    for at in range(0, len(rows), 10):
        fresh.encode(rows[at:at + 10])
        assert len(fresh.remember) <= 5 or len(fresh.remember) <= sum(len(r) for r in rows[at:at + 10])
    assert fresh.encode(rows) == model.encode(rows)


def test_operator(docs):
    rows = ODD + [(4, "one")]
    out = S.encoding_report(docs(rows), PATH)
    assert out.count() == len(rows) and out.where("not round_trip").count() == 0
    assert by_id(out)[1]["n_pieces"] == 0
    back = by_id(S.decode(S.encode(docs(ODD), PATH), PATH))
    assert all(back[i]["text"] == (t or "") for i, t in ODD)
    assert S.encoding_report(docs(rows).limit(0), PATH).collect() == []
