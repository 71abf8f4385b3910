"""Best-fit packing: exact complements, whole use of every piece, gapless sequences, ids of the tokenizer."""

import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import numpy as np
import pytest

import hubflow.llm.packing as P
from tests.llm.conftest import ODD

tokenizers = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("n", [0, 1, 7, 300, 20_000])
def test_plan_uses_every_piece_once(n):
    rng = random.Random(n)
    counts = Counter(min(2048, max(1, int(rng.lognormvariate(6.2, 1.1)))) for _ in range(n))
    used = Counter()
    bins = 0
    for shape, k in P.plan(counts):
        assert sum(shape) <= 2048 and k > 0
        bins += k
        for x in shape:
            used[x] += k
    assert used == counts
    total = sum(k * v for k, v in counts.items())
    assert bins <= -(-total // 2048) * 1.02 + 2


def test_complements():
    stock = lambda *lengths: P.SumIndex(Counter(lengths), 2048).complement(1500)
    assert stock(1500, 548, 500, 48) == (1500, 548)
    assert stock(1500, 500, 48, 40, 8) == (1500, 500, 48)
    assert stock(1500, 500, 40, 8) == (1500, 500, 40, 8)
    assert stock(1500, 500, 40) is None and stock(1500, 274) is None and stock(1500, 274, 274) == (1500, 274, 274)
    assert P.SumIndex({2048: 1}, 2048).complement(2048) == (2048,)


def _exhaustive(have, limit):
    """The complement of the longest length by trying everything: fewest lengths, then the longest ones first."""
    length = max(x for x, n in have.items() if n)
    rest = have - Counter([length])
    gap = limit - length
    lengths = sorted((x for x, n in rest.items() if n), reverse=True)
    if not gap:
        return (length,)
    for k in (1, 2, 3):
        for shape in combinations_with_replacement(lengths, k):
            if sum(shape) == gap and all(rest[x] >= n for x, n in Counter(shape).items()):
                return (length, *shape)
    return None


@pytest.mark.parametrize("seed", range(60))
def test_indexes_agree_with_trying_everything(seed):
    """Down to the last piece, while counts fall and entries of the indexes run out."""
    rng = random.Random(seed)
    limit = rng.choice([16, 40, 64])
    have = Counter(rng.randint(1, limit) for _ in range(rng.randint(1, 60)))
    index = P.SumIndex(have, limit)
    while +have:
        want = _exhaustive(have, limit)
        length = max(+have)
        assert index.complement(length) == want
        taken = Counter(want) if want else Counter({length: have[length]})
        have -= taken
        for x, n in taken.items():
            index.have[x] -= n


def test_large_counts_stay_a_small_plan():
    shapes = P.plan({700: 10**9, 648: 10**9, 2048: 10**9, 3: 5})
    assert len(shapes) < 20 and sum(k for s, k in shapes) <= 2 * 10**9 + 1


def test_pieces_and_places(docs, monkeypatch):
    monkeypatch.setattr(P, "RANK_ROWS", 3)  # several salts of one length
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    rows = [r for r in ODD if len(r[1] or "") < 60_000 or r[0] == 7] + [(20 + i, "same text here") for i in range(20)] + [(40, "x <|endoftext|> y"), (4, "one")]
    out = P.pack(docs(rows), tokenizers.path("byte_bpe_50k.tiktoken"), 64).collect()
    want = Counter()
    for i, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        start = 0
        for p, end in enumerate(range(len(ids) % 64 or 64, len(ids) + 1, 64)):
            want[(i, p, start, end - start, zlib.crc32(ids[start:end].tobytes()))] += 1
            start = end
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    seqs = defaultdict(list)
    for r in out:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    assert P.pack(docs([(1, "a")]).limit(0), tokenizers.path("byte_bpe_50k.tiktoken")).collect() == []


def test_ids_of_the_plain_contract_call(spark, docs, monkeypatch):
    from hubflow.llm import queries
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    texts = [t for _, t in ODD if len(t or "") < 60_000] + ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n", "<|endoftext|", "é <|endoftext|>" * 900]
    rows = list(enumerate(texts))
    monkeypatch.setattr(queries, "table", lambda *_: docs(rows))
    want = []
    for i, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        start = 0
        for p, end in enumerate(range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)):
            want.append((i, p, start, end - start, zlib.crc32(ids[start:end].tobytes())))
            start = end
    out = queries.QUERIES["op4_best_fit_packing"](spark, "").collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
