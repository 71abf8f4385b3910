"""Removal of repeated byte strings by two-stage suffix sorting (operator 10).

Every byte covered by a string of ``length`` bytes that also starts earlier (smaller
doc_id, or same document and earlier start) is removed; strings are judged on the input.

Distribution. Any two equal strings of ``length`` bytes contain the same anchors: an
anchor is a ``GRAM``-byte string with the least hash in some window of that length, which
depends on the window's bytes alone (about one anchor in thirty bytes). So only texts
around equal anchors have to be compared:

1. Anchors are counted over all texts (partial aggregates collapse hot ones); the rest of
   the work sees only those found twice or more.
2. Around each anchor stands its context, which holds all windows with the anchor. Of
   equal contexts only the first can have first windows; all others are covered whole.
3. First contexts of anchors with two or more different contexts go, grouped by anchor, to
   suffix arrays: the suffixes smaller than their successors are sorted directly, all
   others are induced by one scan over the buckets, and adjacent common prefixes of
   ``length`` bytes tie equal windows together. An anchor with more than ``GROUP``
   different contexts is dealt out by its windows instead, and the first window of each
   kind found by an aggregate, so no anchor's contexts have to fit into one task.

Hashes are 64-bit and matter in pairs (anchor and context), never alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow.llm.common import id_text, map_rows, membership_sketch, release, ship_package, sketch_test, stage, unstage
from hubflow.llm.hashing import BYTE, U, gram_hashes, mix, powers

LENGTH, GRAM = 100, 40
#: Different contexts of one anchor that are sorted in one task.
GROUP = 20_000
#: Bytes that one suffix array takes, but for a single larger group (GROUP contexts at most).
BUFFER = 1 << 18
BLOCK = 1 << 20


def slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over every w neighbours."""
    size = 1
    while size * 2 <= w:
        x = op(x[:-size], x[size:])
        size *= 2
    return op(x[:x.size - (w - size)], x[w - size:]) if size < w else x


def anchors(text: bytes, length: int = LENGTH, k: int = GRAM) -> tuple[np.ndarray, ...]:
    """(position, anchor hash, context hash, context start, context end) of a text's anchors; contexts keep within the text."""
    raw = np.frombuffer(text, np.uint8)
    n, w, around = raw.size, length - k + 1, length - k
    if n < length:
        return (np.empty(0, np.int64),) * 5
    out = []
    for core in range(0, n, BLOCK):
        lo, hi = max(0, core - 2 * length), min(n, core + BLOCK + 2 * length)
        part = raw[lo:hi]
        if part.size < length:
            continue
        up, down = powers(part.size + 1)
        total = np.zeros(part.size + 1, U)
        np.cumsum(BYTE[part] * up[:part.size], out=total[1:])
        h = total[k:] - total[:part.size - k + 1]
        h *= down[:h.size]
        h = mix(h)
        rank = (h >> U(32)).astype(np.uint32)
        least = slide(rank, w, np.minimum)
        pad = np.zeros(w - 1, np.uint32)
        best = slide(np.concatenate((pad, least, pad)), w, np.maximum)
        at = np.flatnonzero((best == rank) & (best > 0))
        at = at[(at + lo >= core) & (at + lo < core + BLOCK)]
        start = np.maximum(at + lo - around, 0) - lo
        end = np.minimum(at + lo + k + around, n) - lo
        c = (total[end] - total[start]) * down[start]
        c += (at - start).astype(U) * U(0xA0761D6478BD642F) + (end - start).astype(U) * U(0xE7037ED1A0B428DB)
        out.append((at + lo, h[at].view(np.int64), mix(c).view(np.int64), start + lo, end + lo))
    return tuple(np.concatenate(x) for x in zip(*out))


def stands_again(a: np.ndarray, c: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Flags of one document's places (anchor, context, start): the same context of the anchor stands earlier in it."""
    by = np.lexsort((lo, c, a))
    again = np.zeros(by.size, bool)
    again[by[1:]] = (a[by[1:]] == a[by[:-1]]) & (c[by[1:]] == c[by[:-1]])
    return again


def suffix_order(s: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffix starts of the byte array in the order of their first ``depth`` bytes at least.

    With ``wanted`` (a flag for each place) only those and the ones they are induced from.

    Suffixes smaller than their successors are sorted directly; the others are induced
    bucket by bucket: when a bucket is complete, every suffix in it hands its
    predecessor, if that is larger, to the end of that one's bucket.
    """
    n = s.size
    nxt = np.concatenate((s[1:].astype(np.int16), [-1]))
    at = np.where(s != nxt, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]  # the next place where neighbours differ
    small = s[at] < nxt[at]  # smaller than its successor
    if wanted is None:
        needed = np.ones(n, bool)
    else:  # up to the next suffix that is sorted directly
        following = np.where(small, np.arange(n), n - 1)
        following = np.minimum.accumulate(following[::-1])[::-1]
        mark = np.zeros(n + 1, np.int64)
        places = np.flatnonzero(wanted)
        np.add.at(mark, places, 1)
        np.add.at(mark, following[places] + 1, -1)
        needed = mark.cumsum()[:n] > 0
    mine = np.flatnonzero(small & needed)
    wide = np.concatenate((s, np.zeros(depth, np.uint8)))
    head = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(wide, depth)[mine]).view(f"S{depth}").ravel()
    mine = mine[np.argsort(head)]
    bounds = np.searchsorted(s[mine], np.arange(257))
    queue: list[list[np.ndarray]] = [[] for _ in range(256)]
    if needed[n - 1]:
        queue[s[n - 1]].append(np.array([n - 1]))
    induced = ~small & needed
    order = []
    for c in range(256):
        large = [np.concatenate(queue[c])] if queue[c] else []
        while large and large[-1].size:  # predecessors within a run of one byte
            p = large[-1][large[-1] > 0] - 1
            large.append(p[(s[p] == c) & induced[p]])
        bucket = np.concatenate([*large, mine[bounds[c]:bounds[c + 1]]])
        if not bucket.size:
            continue
        order.append(bucket)
        p = bucket[bucket > 0] - 1
        p = p[induced[p] & (s[p] > c)]
        p = p[np.argsort(s[p], kind="stable")]
        cut = np.flatnonzero(np.diff(s[p])) + 1
        for part in np.split(p, cut):
            if part.size:
                queue[s[part[0]]].append(part)
    return np.concatenate(order) if order else np.empty(0, np.int64)


def repeated(docs: np.ndarray, starts: np.ndarray, texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(doc, from, to): the merged windows of ``length`` bytes in the contexts (doc, start, bytes) that stand earlier in another place of them."""
    s = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    ends = sizes.cumsum()
    of = np.repeat(np.arange(sizes.size), sizes)
    inside = np.arange(s.size) + length <= ends[of]  # windows within one context
    order = suffix_order(s, length, inside)
    order = order[inside[order]]
    if not order.size:
        return []
    # the adjacent common prefix has ``length`` bytes; a hash of the window tells most others
    h = gram_hashes(s, length)[order]
    same = np.flatnonzero(h[1:] == h[:-1])
    windows = np.lib.stride_tricks.sliding_window_view(s, length)
    for at in range(0, same.size, 1 << 16):
        i = same[at:at + (1 << 16)]
        same[at:at + (1 << 16)] = np.where((windows[order[i]] == windows[order[i + 1]]).all(axis=1), i, -1)
    new = np.ones(order.size, bool)
    new[same[same >= 0] + 1] = False
    heads = np.flatnonzero(new)
    names, rank = np.unique(docs, return_inverse=True)
    place = (rank.astype(np.int64) << 40)[of[order]] + starts[of[order]] + order - (ends - sizes)[of[order]]
    first = np.minimum.reduceat(place, heads)
    later = np.sort(place[place != np.repeat(first, np.diff(np.append(heads, order.size)))])
    if not later.size:
        return []
    run = np.flatnonzero(np.concatenate(([True], np.diff(later) > length)))
    last = np.append(run[1:], later.size) - 1
    low = (1 << 40) - 1
    return list(zip(names[later[run] >> 40].tolist(), (later[run] & low).tolist(), ((later[last] & low) + length).tolist()))


def merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int, int]]:
    """Maximal runs of the intervals of each doc; touching intervals run on."""
    if not doc.size:
        return []
    by = np.lexsort((lo, doc))
    doc, lo, hi = doc[by], lo[by], hi[by]
    number = np.concatenate(([0], (doc[1:] != doc[:-1]).cumsum()))
    span = int(hi.max()) + 1
    reach = np.maximum.accumulate(hi + number * span)
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (lo[1:] + number[1:] * span > reach[:-1])))
    at = np.flatnonzero(new)
    top = np.concatenate((reach[at[1:] - 1], reach[-1:])) - number[at] * span
    return list(zip(doc[at].tolist(), lo[at].tolist(), top.tolist()))


def removed_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, spans): the removed runs [from, to) of each document that has any, in bytes, in order, apart from each other.

    A null text counts as empty. Rows with a null doc_id have no place in the order: they
    take no part. Rows that share a doc_id are one document's: equal ones count once,
    different ones are told apart by start only.
    """
    spark = docs.sparkSession
    texts = id_text(docs).where("doc_id is not null and text is not null")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                found = [anchors(t, length)[1] for t in batch.slice(at, 64).column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found), pa.int64())], ["a"])

    ship_package(spark)
    often = texts.select("text").mapInArrow(hashes, "a long").groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    seen = membership_sketch(often, F.col("a"))

    def places(cols):
        for doc_id, text in zip(cols["doc_id"], cols["text"]):
            pos, a, c, lo, hi = anchors(text, length)
            keep = np.flatnonzero(sketch_test(seen.value, a))
            if keep.size:
                a, c, lo, hi = a[keep], c[keep], lo[keep], hi[keep]
                for row in zip(a.tolist(), c.tolist(), lo.tolist(), hi.tolist(), stands_again(a, c, lo).tolist()):
                    yield doc_id, *row

    found = stage(map_rows(texts, places, "doc long, a long, c long, lo long, hi long, again boolean", rows=50_000), "anchors")
    release(seen)
    firsts = stage(found.where("not again").groupBy("a", "c").agg(F.min("doc").alias("first"), F.min("lo").alias("any")), "firsts")
    several = stage(firsts.groupBy("a").agg(F.count("*").alias("contexts")).where("contexts > 1"), "several")
    covered = (found.where("not again").join(firsts.select("a", "c", "first"), ["a", "c"]).where("doc <> first").select("doc", "lo", "hi")
               .union(found.where("again").select("doc", "lo", "hi")))

    wanted = stage(firsts.join(several, "a", "left_semi").select((F.col("a").bitwiseXOR(F.col("c")).bitwiseXOR(F.col("first"))).alias("key"), "first"), "wanted")
    keys, holders = membership_sketch(wanted, F.col("key")), membership_sketch(wanted, F.col("first"))
    unstage(wanted)

    def contexts(cols):
        hold = sketch_test(holders.value, np.array(cols["doc_id"], np.int64))
        for at in np.flatnonzero(hold).tolist():
            doc_id, text = cols["doc_id"][at], cols["text"][at]
            pos, a, c, lo, hi = anchors(text, length)
            keep = np.flatnonzero(sketch_test(keys.value, a ^ c ^ np.int64(doc_id)))
            keep = keep[~stands_again(a[keep], c[keep], lo[keep])]  # the others are covered whole already
            for i in keep.tolist():
                yield int(a[i]), doc_id, int(lo[i]), text[lo[i]:hi[i]]

    held = map_rows(texts, contexts, "a long, doc long, lo long, part binary", rows=2_000)
    huge = several.where(F.col("contexts") > GROUP).select("a")
    if huge.limit(1).count():
        held = stage(held, "contexts")
        spans = covered.union(_sorted_groups(held.join(huge, "a", "left_anti"), length)).union(_by_window(held.join(huge, "a", "left_semi"), length))
    else:
        spans = covered.union(_sorted_groups(held, length))

    def join_up(cols):
        for doc_id, runs in zip(cols["doc"], cols["runs"]):
            lo, hi = (np.array([r[x] for r in runs], np.int64) for x in ("lo", "hi"))
            yield doc_id, [{"lo": a, "hi": b} for _, a, b in merged(np.zeros(lo.size, np.int64), lo, hi)]

    runs = spans.groupBy("doc").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    out = stage(map_rows(runs, join_up, "doc_id long, spans array<struct<lo:long,hi:long>>"), "spans")
    release(keys, holders)
    unstage(found, firsts, several, held)
    return out


def _sorted_groups(held: DataFrame, length: int) -> DataFrame:
    """Covered windows among the contexts of each anchor, by suffix arrays over whole groups."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last = 0, None

        def done() -> pa.RecordBatch:
            docs, starts, parts = zip(*rows)
            out = repeated(np.array(docs, np.int64), np.array(starts, np.int64), list(parts), length)
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["doc", "lo", "hi"])

        for batch in batches:
            for a, doc, lo, part in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if a != last and size >= BUFFER:
                    yield done()
                    rows, size = [], 0
                rows.append((doc, lo, part))
                size, last = size + len(part), a
        if rows:
            yield done()

    return held.select("a", "doc", "lo", "part").repartition("a").sortWithinPartitions("a").mapInArrow(run, "doc long, lo long, hi long")


def _by_window(held: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many contexts: the first of each kind of window by an aggregate."""
    def windows(cols):
        for a, doc, lo, part in zip(*(cols[x] for x in ("a", "doc", "lo", "part"))):
            for i, h in enumerate(gram_hashes(np.frombuffer(part, np.uint8), length).view(np.int64).tolist()):
                yield a, h, doc, lo + i

    each = stage(map_rows(held.select("a", "doc", "lo", "part"), windows, "a long, h long, doc long, lo long", rows=20_000), "windows")
    first = each.groupBy("a", "h").agg(F.min(F.struct("doc", "lo")).alias("first"))
    return (each.join(first, ["a", "h"]).where("doc <> first.doc or lo <> first.lo")
            .select("doc", "lo", (F.col("lo") + length).alias("hi")))


def cut(text: bytes, spans) -> bytes:
    """The bytes outside the spans, joined."""
    out, at = [], 0
    for s in () if spans is None else spans:
        out.append(text[at:s["lo"]])
        at = s["hi"]
    return b"".join(out) + text[at:]


def repeat_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes).

    Null and empty texts have nothing to remove; texts under ``length`` bytes stay whole;
    a null doc_id stays whole. Other columns are ignored.
    """
    spans = removed_spans(docs, length).withColumnRenamed("doc_id", "sid")

    def rows(cols):
        for doc_id, text, runs in zip(cols["doc_id"], cols["text"], cols["spans"]):
            text = text or b""
            kept = cut(text, runs)
            yield doc_id, len(text), len(text) - len(kept), len(runs or ()), kept

    joined = id_text(docs).join(spans, F.col("doc_id") == F.col("sid"), "left").select("doc_id", "text", "spans")
    return map_rows(joined, rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with all columns, its texts without the repeated strings; characters that a run cuts in part are dropped."""
    spans = removed_spans(docs, length).withColumnRenamed("doc_id", "_sid").withColumnRenamed("spans", "_spans")
    ship_package(docs.sparkSession)

    @F.pandas_udf("string")
    def remaining(text, runs):
        import pandas as pd
        return pd.Series([cut(t.encode("utf-8", "surrogatepass"), r).decode("utf-8", "ignore") if t is not None else None for t, r in zip(text, runs)], dtype=object)

    joined = docs.join(spans, F.col("doc_id") == F.col("_sid"), "left")
    text = F.when(F.col("_spans").isNotNull(), remaining("text", "_spans")).otherwise(F.col("text"))
    return joined.withColumn("text", text).select(*[F.col(c) for c in docs.columns])
