"""Byte-level BPE: against the tiktoken library and against a search of the whole pair list, round trips, odd inputs."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from hubflow.llm.byte_bpe import Bpe, RankQueue, decode, encode, encoding_report
from hubflow.llm.queries import QUERIES
from tests.conftest import SF_SMALL
from tests.llm.conftest import ODD

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
BPE = Bpe(open(PATH, "rb").read(), P.PATTERN)


def ids(text):
    return np.frombuffer(BPE.encode(text), "<u4").tolist()


def brute(piece, ranks):
    """Lowest rank first, leftmost first, the whole list searched for every merge."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def bpe_plain(piece, ranks):
    """As ``brute``, without the look-up of the whole pre-token."""
    return brute(piece + b"\xff", ranks)[:-1]


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def expected(text):
    got = LIBRARY.encode_ordinary(text or "")
    return len(got), sha(np.array(got, "<u4").tobytes()), sha((text or "").encode())


def test_queue_gives_lowest_rank_leftmost_first():
    rng, queue, held = random.Random(3), RankQueue(300_000), []
    for _ in range(3000):
        if held and rng.random() < 0.45:
            assert queue.pop() == min(held)
            held.remove(min(held))
        else:
            entry = rng.choice([rng.randrange(300_000), 7, 299_999]), rng.randrange(50)
            queue.push(*entry)
            held.append(entry)
    assert [queue.pop() for _ in range(len(held))] == sorted(held) and queue.pop() is None


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text_equals_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    assert ids(text) == LIBRARY.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text("ab", min_size=1, max_size=40), st.lists(st.text("ab", min_size=2, max_size=6), max_size=12, unique=True))
def test_any_ranks_equal_a_whole_search(piece, more):
    """Ranks that merging didn't make: a new pair may rank below the one merged last, equal ranks overlap."""
    ranks = {bytes([b]): b for b in range(256)} | {m.encode(): 256 + i for i, m in enumerate(more)}
    bpe = Bpe(b"\n".join(base64.b64encode(p) + b" " + str(r).encode() for p, r in ranks.items()), P.PATTERN)
    assert bpe.merge(piece.encode()) == brute(piece.encode(), ranks)
    together = [piece.encode(), b"abab", piece[::-1].encode(), b"a"]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.merge_many(together)] == [bpe_plain(p, ranks) for p in together]


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 20_000 + "c", "日本語の文章" * 4000, "x" + "é" * 9999, "\n \n" * 5000, "1234567890" * 3000, "=-" * 7000, "\U0001F600" * 3000])
def test_very_long_pre_tokens(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)


def test_texts_longer_than_a_block_and_a_full_table():
    rng = random.Random(5)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(1, 9))) for _ in range(150_000))
    assert ids(text) == LIBRARY.encode_ordinary(text)
    assert len(BPE.known) <= 1 << 18


def test_many_pre_tokens_through_one_queue_equal_each_alone():
    rng = random.Random(9)
    pieces = ["".join(rng.choices("etaoinshrdluéñü日 the", k=rng.randrange(1, 14))).encode() for _ in range(20_000)] + [b"aaaa" * 500, b"ab" * 999, b" the" * 300]
    pieces = [p for p in pieces if p not in RANKS]
    assert [np.frombuffer(x, "<u4").tolist() for x in BPE.merge_many(pieces)] == [BPE.merge(p) for p in pieces]


def test_whole_table_equals_the_library(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_byte_bpe"](spark, SF_SMALL).collect()}
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    assert got == {d["doc_id"]: expected(d["text"]) for d in docs}


def test_odd_rows(spark, docs):
    rows = ODD + [(4, "one"), (10, "a\x00b\r\n \x1c\x85 z"), (11, "<|endoftext|> it's"), (12, "q" * 2_000_000 + " end")]
    got = sorted((r["doc_id"] or -1, *tuple(r)[1:]) for r in encoding_report(docs(rows), PATH, P.PATTERN).collect())
    assert got == sorted((i or -1, *expected(t)) for i, t in rows)


def test_round_trip_through_tables(spark, docs):
    rows = [(i, t) for i, t in ODD if i is not None]
    back = decode(encode(docs(rows), PATH, P.PATTERN), PATH, P.PATTERN)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t in rows}


def test_empty_table_and_null_ids(spark, docs):
    assert encoding_report(docs([(1, "x")]).limit(0), PATH, P.PATTERN).collect() == []
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {tuple(r) for r in decode(none, PATH, P.PATTERN).collect()} == {(1, ""), (2, "")}


def test_ranks_without_a_byte_are_refused():
    with pytest.raises(ValueError):
        Bpe(b"YQ== 0", P.PATTERN)
