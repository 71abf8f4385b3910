"""Best-fit packing by exact-complement hashing (operator 4).

Documents become token ids followed by id 0; documents over the limit are cut into whole
sequences from their end, so only the first piece is shorter. The packing plan depends
on the number of pieces of each length alone: a histogram of at most ``limit`` rows,
which is all that reaches the driver. For every length, longest first, the gap it leaves
is looked up in hash indexes of single, pair and triple length sums, and combinations
that fill it exactly are consumed as often as the counts allow; what is left goes
best-fit. Every step uses up a length or a sequence shape, so the plan stays small
however many pieces there are.

Pieces get their rank within their length by salted windows (about ``RANK_ROWS`` rows
each), and the plan's rank ranges give sequence and offset: no piece list is ever on one task.
"""

from __future__ import annotations

import base64
import os
import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hubflow.llm.common import id_text, map_rows, stage

LIMIT = 2048
RANK_ROWS = 500_000
_ENCODERS: dict = {}


def encoder(path: str):
    """text -> numpy ids with the byte-level vocabulary at ``path``, one per worker.

    .json: the ids of ``Tokenizer.encode(text, add_special_tokens=False)``; added tokens such
    as ``<|endoftext|>`` in a text get their own ids. .tiktoken: ranks alone, without added tokens.
    """
    if path not in _ENCODERS:
        _ENCODERS[path] = _ranks(path) if path.endswith(".tiktoken") else _tokenizer(path)
    return _ENCODERS[path]


def _ranks(path: str):
    import public_tokenizers
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: np.array(enc.encode_ordinary(text), np.uint32)


def _tokenizer(path: str):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    whole = lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, np.uint32)
    same = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(same):
        return whole
    # the ranks give the same ids six times as fast, but for texts that hold an added token
    added, plain = [t.content for t in tok.get_added_tokens_decoder().values()], _ranks(same)
    return lambda text: whole(text) if any(t in text for t in added) else plain(text)


def pieces(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row's ids and a closing 0; a null text is empty.

    Every row of ``docs`` gets its own pieces, repeated rows and null ids too.
    """
    def rows(cols):
        encode = encoder(vocabulary)
        for doc_id, text in zip(cols["doc_id"], cols["text"]):
            tokens = np.append(encode((text or b"").decode("utf-8", "replace")), 0).astype("<u4")
            start = 0
            for p, end in enumerate(range(tokens.size % limit or limit, tokens.size + 1, limit)):
                yield doc_id, p, start, end - start, zlib.crc32(tokens[start:end].tobytes())
                start = end

    return map_rows(id_text(docs), rows, "doc_id long, piece int, start long, length long, ids_crc32 long", rows=10_000)


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of one sequence, longest first; how many such sequences)] that uses every piece exactly once."""
    index = SumIndex(counts, limit)
    have = index.have
    out: list[tuple[tuple[int, ...], int]] = []
    left = np.zeros(limit + 1, np.int64)
    for length in range(limit, 0, -1):
        while have[length]:
            shape = index.complement(length)
            if shape is None:
                left[length] += have[length]
                have[length] = 0
            else:
                most = min(have[x] // shape.count(x) for x in set(shape))
                for x in shape:
                    have[x] -= most
                out.append((shape, most))
    return out + best_fit(left, limit)


class SumIndex:
    """Hash indexes of the sums of one, two and three lengths in stock, under their counts ``have``.

    ``have`` is the index of single lengths. ``pairs[sum]`` lists the longer lengths of the
    pairs with that sum, ``triples(sum)`` the longest lengths of the triples, both ascending. Counts only
    fall, so an entry whose lengths have run out is dropped from the end of its list for good.
    """

    def __init__(self, counts: dict[int, int], limit: int):
        self.limit = limit
        self.have = [0] * (limit + 1)
        for length, n in counts.items():
            self.have[length] = int(n)
        stock = [x for x in range(1, limit) if self.have[x]]
        self.pairs: dict[int, list[int]] = {}
        for a in stock:
            for b in stock:
                if b > a or a + b >= limit:
                    break
                self.pairs.setdefault(a + b, []).append(a)
        self._stock, self._triples = stock, {}

    def _pair(self, total: int, used: tuple[int, ...]) -> tuple[int, int] | None:
        """The pair of that sum with the longest first length, beside the lengths already ``used``."""
        have, longer = self.have, self.pairs.get(total, [])
        while longer and not (have[longer[-1]] and have[total - longer[-1]]):
            longer.pop()
        for a in reversed(longer):
            b = total - a
            if have[a] - used.count(a) - (a == b) > 0 and have[b] - used.count(b) > 0:
                return a, b
        return None

    def triples(self, total: int) -> list[int]:
        """The longest lengths of the triples of that sum: indexed when a gap of that size is first met."""
        if total not in self._triples:
            self._triples[total] = [a for a in self._stock if a < total <= 3 * a and self.pairs.get(total - a)]
        return self._triples[total]

    def complement(self, length: int) -> tuple[int, ...] | None:
        """``length`` and one to three lengths in stock that fill the sequence exactly, the longest first; None if there are none.

        ``length`` is the longest in stock.
        """
        have, gap = self.have, self.limit - length
        if not gap:
            return (length,)
        if not have[length]:
            return None
        if have[gap] - (gap == length) > 0:
            return (length, gap)
        two = self._pair(gap, (length,))
        if two:
            return (length, *two)
        longest = self.triples(gap)
        while longest and not have[longest[-1]]:
            longest.pop()
        for a in reversed(longest):
            if have[a] - (a == length) > 0:
                two = self._pair(gap - a, (length, a))
                if two and two[0] <= a:
                    return (length, a, *two)
        return None


def best_fit(left: np.ndarray, limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: equal pieces go to equal sequences together."""
    shapes: dict[tuple[int, ...], int] = {}
    by_gap: dict[int, list[tuple[int, ...]]] = {}
    gaps: list[int] = []

    def put(shape: tuple[int, ...], n: int) -> None:
        if n <= 0:
            return
        if shape in shapes:
            shapes[shape] += n
            return
        shapes[shape] = n
        gap = limit - sum(shape)
        if gap not in by_gap:
            by_gap[gap] = []
            insort(gaps, gap)
        by_gap[gap].append(shape)

    for length in range(limit, 0, -1):
        n = int(left[length])
        while n:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = limit // length
                put((length,) * each, n // each)
                put((length,) * (n % each), 1 if n % each else 0)
                break
            gap = gaps[at]
            shape = by_gap[gap][-1]
            fit = gap // length  # as many of this length as the gap takes
            stock = shapes[shape]
            whole = min(stock, n // fit)
            rest = 1 if whole < stock and n - whole * fit else 0
            part = (n - whole * fit) if rest else 0
            part = min(part, fit)
            shapes[shape] -= whole + rest
            if not shapes[shape]:
                del shapes[shape]
                by_gap[gap].pop()
                if not by_gap[gap]:
                    del by_gap[gap]
                    gaps.pop(at)
            put(shape + (length,) * fit, whole)
            if rest:
                put(shape + (length,) * part, 1)
            n -= whole * fit + part
    return [(s, n) for s, n in shapes.items()]


def slots(shapes: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, offset): the ranks of a length that take one place of a run of equal sequences."""
    used: dict[int, int] = {}
    out, first = [], 0
    for shape, n in shapes:
        offset = 0
        for length in shape:
            lo = used.get(length, 0)
            used[length] = lo + n
            out.append((length, lo, lo + n, first, offset))
            offset += length
        first += n
    return out


def pack(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; every sequence has at most ``limit`` ids and no gap.

    Null and empty texts are the single id 0. Repeated rows and null ids are packed like
    any others; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    cut = stage(pieces(docs, vocabulary, limit), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``limit`` rows
    table = spark.createDataFrame(slots(plan(counts, limit)), "len long, lo long, hi long, seq long, offset long")
    salts = spark.createDataFrame([(k, n // RANK_ROWS + 1) for k, n in counts.items()], "len long, salts long")
    salted = cut.join(F.broadcast(salts), F.col("length") == F.col("len")).drop("len").withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("salts"))).drop("salts")
    # offsets of the salts: about one row per RANK_ROWS pieces and length
    share = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = share.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = (salted.withColumn("r", F.row_number().over(own) - 1)
              .join(before.select(F.col("length").alias("l2"), F.col("salt").alias("s2"), F.coalesce("before", F.lit(0)).alias("before")),
                    (F.col("length") == F.col("l2")) & (F.col("salt") == F.col("s2")))
              .withColumn("rank", F.col("r") + F.col("before")))
    # the plan's rows of one length, in rank order: a bounded array each
    plans = table.groupBy("len").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "seq", "offset"))).alias("slots"))
    placed = ranked.join(F.broadcast(plans), F.col("length") == F.col("len")).withColumn(
        "at", F.element_at(F.filter("slots", lambda s: (s["lo"] <= F.col("rank")) & (F.col("rank") < s["hi"])), 1))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("at.seq") + F.col("rank") - F.col("at.lo")).alias("sequence_id"), F.col("at.offset").alias("offset"))
