"""Byte-level BPE encoding and decoding by a rank queue of hierarchical bitmaps (operator 13).

A text is cut into pre-tokens by a pattern; each is merged on its own: the adjacent pair
whose joined bytes have the lowest rank goes first, the leftmost of equal ones.

Method. Every rank has a bucket of positions in the linked list of parts. Three levels of
64-bit words tell which buckets hold something: the lowest rank is found by one
find-first-set a level, whatever the number of pairs. A merge links two parts, enters the
two new pairs beside it and leaves the old entries where they are; an entry whose position
no longer starts a pair of that rank is stale and skipped when it comes up. A pre-token of
n bytes takes O(n log n) steps, also where it has no blank for megabytes.

One queue serves all new pre-tokens of a batch (``merge_many``): a bucket then has the
positions of its rank in all of them and is merged as a whole, which is the same order for
every single one as long as no merge makes a pair that ranks below it. The pre-tokens where
one does are merged again on their own (``merge``), entry by entry.

Short pre-tokens are remembered in a bounded table of each worker, which saves time and
decides nothing. Texts are independent, so nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import regex
from pyspark.sql import DataFrame

from hubflow.llm.common import id_text, map_rows

#: Pre-tokens remembered by a worker, and the longest that is.
REMEMBERED, SHORT = 1 << 18, 48
#: Characters of texts that are cut at once, and pre-tokens of a longer text that are held at once.
TOGETHER, BLOCK = 1 << 22, 1 << 18
#: With fewer bytes of new pre-tokens they are merged one by one.
FEW = 1 << 14


class RankQueue:
    """Buckets by rank; ``lowest`` finds the lowest rank that has one."""

    def __init__(self, ranks: int):
        sizes = [-(-max(1, ranks) // 64)]
        sizes += [-(-sizes[0] // 64), -(-sizes[0] // 4096)]
        self.low, self.mid, self.top = ([0] * size for size in sizes)
        self.buckets: dict[int, list] = {}

    def bucket(self, rank: int) -> list:
        """The bucket of a rank, made if there is none."""
        found = self.buckets.get(rank)
        if found is None:
            found = self.buckets[rank] = []
            self.low[rank >> 6] |= 1 << (rank & 63)
            self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
            self.top[rank >> 18] |= 1 << (rank >> 12 & 63)
        return found

    def lowest(self) -> int | None:
        for t, word in enumerate(self.top):
            if word:
                m = t << 6 | (word & -word).bit_length() - 1
                word = self.mid[m]
                l = m << 6 | (word & -word).bit_length() - 1  # noqa: E741
                word = self.low[l]
                return l << 6 | (word & -word).bit_length() - 1
        return None

    def remove(self, rank: int) -> list:
        """Take the bucket of a rank out."""
        l, m = rank >> 6, rank >> 12  # noqa: E741
        self.low[l] &= ~(1 << (rank & 63))
        if not self.low[l]:
            self.mid[m] &= ~(1 << (l & 63))
            if not self.mid[m]:
                self.top[m >> 6] &= ~(1 << (m & 63))
        return self.buckets.pop(rank)

    def push(self, rank: int, position: int) -> None:
        heappush(self.bucket(rank), position)

    def pop(self) -> tuple[int, int] | None:
        """The leftmost position of the lowest rank."""
        rank = self.lowest()
        if rank is None:
            return None
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            self.remove(rank)
        return rank, position


class Bpe:
    """Encoder and decoder of one file of ranks (base64 bytes, blank, rank on each line) and one pattern."""

    def __init__(self, raw: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"the ranks lack the single bytes {missing[:5]}")
        self.pieces = {rank: piece for piece, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.longest = max(map(len, self.ranks))
        self.queue = RankQueue(max(self.pieces) + 1)
        self.known: dict[str, bytes] = {}
        # every way to make a piece of two others: (left rank, right rank) -> rank
        made = sorted((self.ranks[p[:i]] << 32 | self.ranks[p[i:]], rank) for p, rank in self.ranks.items()
                      for i in range(1, len(p)) if p[:i] in self.ranks and p[i:] in self.ranks)
        self.pairs = np.array([key for key, _ in made] + [2**63 - 1], np.int64)
        self.joined = np.array([rank for _, rank in made] + [-1], np.int32)
        self.byte_rank = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, rank_of, queue, longest = len(piece), self.ranks.get, self.queue, self.longest
        after = array("i", range(1, n + 1))  # start of the next part
        before = array("i", range(-1, n - 1))
        pair = array("i", [-1]) * n  # rank of the pair that starts here
        for i in range(n - 1):
            rank = rank_of(piece[i:i + 2])
            if rank is not None:
                pair[i] = rank
                queue.push(rank, i)
        while (entry := queue.pop()) is not None:
            rank, i = entry
            if pair[i] != rank:
                continue  # stale
            j = after[i]
            k = after[j]
            after[i] = k
            pair[i] = pair[j] = -1
            if k < n:
                before[k] = i
                end = after[k]
                new = rank_of(piece[i:end]) if end - i <= longest else None
                if new is not None:
                    pair[i] = new
                    queue.push(new, i)
            h = before[i]
            if h >= 0:
                new = rank_of(piece[h:k]) if k - h <= longest else None
                if new is None:
                    pair[h] = -1
                else:
                    pair[h] = new
                    queue.push(new, h)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i:after[i]]])
            i = after[i]
        return out

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of parts, -1 where the ranks have none or a part is -1."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.joined[at], np.int32(-1))

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token as 32-bit integers, all merged through one queue."""
        raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
        length = np.array([len(p) for p in pieces])
        ends = np.cumsum(length + 1) - 1  # a slot after each piece that pairs with nothing
        n = raw.size
        tok = self.byte_rank[raw]
        tok[ends] = -1
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        alive = tok >= 0
        pair = np.full(n, -1, np.int32)
        pair[:-1] = self.pair_ranks(tok[:-1], tok[1:])
        queue, again = RankQueue(len(self.queue.low) << 6), set()
        _push(queue, np.arange(n, dtype=np.int32), pair)
        while (rank := queue.lowest()) is not None:
            entries = queue.remove(rank)
            at = entries[0] if len(entries) == 1 else np.unique(np.concatenate(entries))
            at = at[pair[at] == rank]  # the others are stale
            if at.size > 1:
                follows = after[at[:-1]] == at[1:]
                if follows.any():  # overlapping: the first, third, ... of a run
                    index = np.arange(at.size)
                    begin = index.copy()
                    begin[1:][follows] = 0
                    at = at[(index - np.maximum.accumulate(begin)) % 2 == 0]
            if not at.size:
                continue
            j = after[at]
            k = after[j]
            same = np.full(at.size, rank, np.int32)
            soon = self.pair_ranks(same, tok[k])  # what stands there until the pair on the right is merged too
            tok[at], after[at], before[k] = rank, k, at
            alive[j], pair[j] = False, -1
            h = before[at]
            right, left = self.pair_ranks(same, tok[k]), self.pair_ranks(tok[h], same)
            pair[at], pair[h] = right, left
            below = np.minimum(np.minimum(soon.view(np.uint32), right.view(np.uint32)), left.view(np.uint32)) <= rank  # -1 is the largest
            if below.any():
                again.update(np.searchsorted(ends, at[below]).tolist())
            _push(queue, np.concatenate((at, h)), np.concatenate((right, left)))
        ids = tok[alive].astype("<u4").tobytes()
        stop = (np.cumsum(alive)[ends] * 4).tolist()
        out = [ids[a:b] for a, b in zip([0, *stop], stop)]
        for i in again:
            out[i] = _ids(self.merge(pieces[i]))
        return out

    def learn(self, found: list[list[str]]) -> list[str]:
        """Work out the pre-tokens that aren't known yet; returns them."""
        new = list(set().union(*found).difference(self.known))
        pieces = [t.encode("utf-8") for t in new]
        if sum(map(len, pieces)) < FEW:
            self.known.update(zip(new, (_ids(self.merge(p)) for p in pieces)))
            return new
        whole = [i for i, p in enumerate(pieces) if p in self.ranks]
        self.known.update((new[i], _ids([self.ranks[pieces[i]]])) for i in whole)
        rest = sorted(set(range(len(new))).difference(whole))
        self.known.update(zip([new[i] for i in rest], self.merge_many([pieces[i] for i in rest])))
        return new

    def forget(self, new: list[str]) -> None:
        """Keep the table of known pre-tokens within its bounds."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for token in new:
            if len(token) > SHORT:
                self.known.pop(token, None)

    def encode_many(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of whole texts as little-endian unsigned 32-bit integers, in order."""
        at = 0
        while at < len(texts):
            if len(texts[at]) > TOGETHER:
                yield self._encode_long(texts[at])
                at += 1
                continue
            found, size = [], 0
            while at < len(texts) and size + len(texts[at]) <= TOGETHER:
                found.append(self.pattern.findall(texts[at]))
                size += len(texts[at])
                at += 1
            new = self.learn(found)
            for tokens in found:
                yield b"".join(map(self.known.__getitem__, tokens))
            self.forget(new)

    def _encode_long(self, text: str) -> bytes:
        each, out = (m.group() for m in self.pattern.finditer(text)), []
        for block in iter(lambda: list(islice(each, BLOCK)), []):
            new = self.learn([block])
            out.append(b"".join(map(self.known.__getitem__, block)))
            self.forget(new)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        return next(self.encode_many([text]))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids; an id that the ranks lack raises KeyError."""
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


def _ids(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def _push(queue: RankQueue, positions: np.ndarray, ranks: np.ndarray) -> None:
    some = np.flatnonzero(ranks >= 0)
    if not some.size:
        return
    order = some[np.argsort(ranks[some], kind="stable")]
    ranks = ranks[order]
    cuts = np.flatnonzero(np.diff(ranks)) + 1
    for rank, part in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(positions[order], cuts)):
        queue.bucket(rank).append(part)


_LOADED: dict[tuple[str, str], Bpe] = {}


def _shared(spark, path: str, pattern: str):
    """A function that gives the worker's own Bpe; the file is read by the driver and sent along (its size is the vocabulary's)."""
    with open(path, "rb") as f:
        raw = f.read()
    sent, name = spark.sparkContext.broadcast(raw), hashlib.sha256(raw).hexdigest()

    def get() -> Bpe:
        if (name, pattern) not in _LOADED:
            _LOADED[name, pattern] = Bpe(sent.value, pattern)
        return _LOADED[name, pattern]

    return get


def _text(raw: bytes | None) -> str:
    return (raw or b"").decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row's whole text; null and empty texts have no ids. Other columns are ignored, repeated rows stay repeated."""
    bpe = _shared(docs.sparkSession, path, pattern)

    def rows(cols) -> Iterator[tuple]:
        for doc_id, ids in zip(cols["doc_id"], bpe().encode_many([_text(t) for t in cols["text"]])):
            yield doc_id, np.frombuffer(ids, "<u4").astype(np.int32)

    return map_rows(id_text(docs), rows, "doc_id long, ids array<int>", rows=64)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give an empty text. An id that the ranks lack fails the job, as a text can't be guessed.

    Ids that don't end at a character boundary give the replacement character there.
    """
    bpe = _shared(encoded.sparkSession, path, pattern)

    def rows(cols) -> Iterator[tuple]:
        for doc_id, ids in zip(cols["doc_id"], cols["ids"]):
            yield doc_id, _text(bpe().decode(np.array(ids or [], np.int64)))

    return map_rows(encoded.select("doc_id", "ids"), rows, "doc_id long, text string", rows=64)


def encoding_report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256; every whole text is encoded and its ids decoded again.

    A null text counts as empty (no ids, digest of nothing); a null doc_id stays null;
    repeated rows stay repeated; bytes that aren't UTF-8 become the replacement character
    before encoding; extra columns are ignored; an empty table gives an empty result.
    ids_sha256 is over the ids as little-endian unsigned 32-bit integers.
    """
    bpe = _shared(docs.sparkSession, path, pattern)

    def rows(cols) -> Iterator[tuple]:
        for doc_id, ids in zip(cols["doc_id"], bpe().encode_many([_text(t) for t in cols["text"]])):
            back = bpe().decode(np.frombuffer(ids, "<u4"))
            yield doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()

    return map_rows(id_text(docs), rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows=20_000)
