"""N-gram Jaccard self-join with adaptive multi-match prefixes (operator 1).

Two documents link when the Jaccard similarity of their sets of word shingles reaches
the threshold t. Documents with equal sets form one class; only classes are compared.

Method. Shingles have one global order (their hash). Let o = ceil(t * n) for a set of n
shingles; the l-prefix holds the first n - o + l of them. Two linked sets share at least
l shingles of their l-prefixes, with l the smaller of the two documents' choices. Every
document lengthens its prefix to the l with the least estimated candidate cost, taken
from the document frequencies of its prefix shingles. A shingle in many (``HOT``)
different groups never generates candidates: a document with m such shingles in its
prefix takes l > m, so that linked partners still share l - m others. Where the first
shingles don't suffice, the whole set is taken.

Large groups of near copies make their own shingles frequent. They are tied together
first, by comparing the members of a frequent shingle with a few chosen members only;
frequencies then count such a group once, and pairs inside a group are never listed.
A link between different texts is skipped only where both are in one component already,
so component ids are exact.

Hashes are 64-bit; an error needs a collision inside one pair of documents (under 1e-10
for 20,000 shingles each).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow.llm.common import id_text, map_rows, membership_sketch, min_labels, release, ship_package, sketch_test, stage, tasks_for, unstage
from hubflow.llm.hashing import shingle_set

#: A shingle in the prefixes of this many groups generates no candidates.
HOT = 64
#: A shingle in this many documents' prefixes is looked at for groups of near copies.
CROWD = 16
#: Comparing two sets costs about as much as listing this many candidate rows.
VERIFY = 8
#: Rounds in which documents may turn out to need their whole set before the frequencies are final.
LONGER = 4
#: Members of a crowd that all others are compared with, and rounds of that.
PIVOTS, ROUNDS = 3, 3


def ngram_jaccard_join(docs: DataFrame, n: int = 5, threshold_pct: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, class_size.

    Words are runs of characters other than 0x20 and 0x09-0x0D, A-Z lower-cased; the set
    has the distinct n-word shingles (with fewer words the whole sequence as one). Null,
    empty and blank texts have an empty set, link with nothing and are their own
    component. component_id is the smallest doc_id reachable by links; a null doc_id is
    returned as it is and never a component's id unless all of it are null. Repeated rows
    stay repeated. class_size counts the rows with an equal set. Other columns are ignored.
    """
    spark = docs.sparkSession
    sets = stage(_heads(id_text(docs), n, threshold_pct), "sets")
    # tables of classes and pairs have tasks by their rows: there are dozens of shuffles, and most carry little
    tasks = tasks_for(sets)
    classes = stage(sets.where("n > 0").groupBy("k", "n").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("size"), F.first("head").alias("head")), "classes", tasks)
    rows = stage(sets.select("doc_id", "n", "k"), "rows")
    unstage(sets)

    counts = stage(_counts(classes, threshold_pct), "counts", tasks)
    links = _crowd_links(docs, classes, counts, n, threshold_pct, tasks)
    tied = min_labels(links)
    pairs, hot = _candidates(docs, classes, counts, tied, n, threshold_pct, tasks)
    more = _verified(docs, classes, pairs, n, threshold_pct, tasks)
    unstage(pairs)
    added = more if hot is None else more.union(hot.select("a", "b"))
    labels = min_labels(links.union(added)) if added.limit(1).count() else tied
    unstage(links, more, *([] if hot is None else [hot]))

    comp = (classes.join(labels, F.col("k") == F.col("v"), "left").select("k", "doc_id", "size", F.coalesce("c", "k").alias("c")))
    first = comp.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    comp = stage(comp.join(first, "c").select(F.col("k").alias("ck"), "component_id", F.col("size").alias("class_size")), "components", tasks)
    full = rows.where("n > 0").join(comp, F.col("k") == F.col("ck")).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", "class_size")
    none = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("class_size"))
    return full.union(none)


def _least(n: int, pct: int) -> int:
    """Smallest overlap of a set of n with any linked set."""
    return -(-pct * n // 100)


def _heads(texts: DataFrame, n: int, pct: int) -> DataFrame:
    def rows(cols):
        for doc_id, text in zip(cols["doc_id"], cols["text"]):
            s = shingle_set(text, n)
            base = s.size - _least(s.size, pct)
            head = s[:base + 1 + max(8, (base + 1) // 2)]
            yield doc_id, s.size, hashlib.blake2b(s.tobytes(), digest_size=16).digest(), head.view(np.int64)

    return map_rows(texts, rows, "doc_id long, n long, k binary, head array<long>")


def _shingles(classes: DataFrame, sketch, first: bool = False, pct: int = 0) -> DataFrame:
    """(k, pos, s): the shingles of each class's head, of the 1-prefix if ``first``, that are in the sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                bounds = part.column(2).offsets.to_numpy()
                sizes, flat = np.diff(bounds), part.column(2).values.to_numpy(zero_copy_only=False)[bounds[0]:bounds[-1]]
                pos = np.arange(flat.size) - np.repeat(bounds[:-1] - bounds[0], sizes)
                hit = sketch_test(sketch.value, flat)
                if first:
                    n = part.column(1).to_numpy()
                    hit &= pos < np.repeat(n + (-pct * n) // 100 + 1, sizes)
                hit = np.flatnonzero(hit)
                if hit.size:
                    k = part.column(0).take(pa.array(np.repeat(np.arange(sizes.size), sizes)[hit]))
                    yield pa.RecordBatch.from_arrays([k, pa.array(pos[hit].astype(np.int32)), pa.array(flat[hit])], ["k", "pos", "s"])

    ship_package(classes.sparkSession)
    return classes.select("k", "n", "head").mapInArrow(run, "k binary, pos int, s long")


def _counts(classes: DataFrame, pct: int) -> DataFrame:
    """(s, m, first): the classes with the shingle in their head and in their 1-prefix, of shingles in two or more heads."""
    seen = classes.select(F.expr(f"n - ({pct} * n + 99) div 100 + 1").alias("p"), F.posexplode("head").alias("pos", "s"))
    return seen.groupBy("s").agg(F.count("*").alias("m"), F.count_if(F.col("pos") < F.col("p")).alias("first")).where("m > 1")


def _crowd_links(docs: DataFrame, classes: DataFrame, counts: DataFrame, n: int, pct: int, tasks: int) -> DataFrame:
    """Links between members of a crowded shingle and a few of its members (written table a, b)."""
    crowd = stage(counts.where(F.col("first") >= CROWD).select("s"), "crowd", tasks)
    sketch = membership_sketch(crowd, F.col("s"), unique=True)
    inside = _shingles(classes, sketch, True, pct).select("k", "s").join(crowd, "s").coalesce(tasks)
    own = inside.groupBy("k").agg(F.count("*").alias("x")).join(classes.select("k", "n"), "k").select(
        F.col("k").alias("ok"), F.expr(f"n - ({pct} * n + 99) div 100 + 1 - x").alias("own"), F.expr(f"n - ({pct} * n + 99) div 100 + 1").alias("p"))
    inside = stage(inside.join(own, F.col("k") == F.col("ok")).drop("ok"), "inside", tasks)
    release(sketch)
    links = None
    for r in range(ROUNDS):
        members = inside
        if links is not None:
            tied = min_labels(links)
            members = inside.join(tied, F.col("k") == F.col("v"), "left").select("s", "k", "own", "p", F.coalesce("c", "k").alias("c"))
        else:
            members = members.withColumn("c", F.col("k"))
        # first the members with the least of their own, which are in the middle of their group; later any
        middle = F.lit(0) if r else F.col("own")
        chosen = members.groupBy("s").agg(*[F.min(F.struct(middle.alias("o"), F.xxhash64("k", F.lit(PIVOTS * r + i)).alias("x"), "k", "c", "p")).alias(f"p{i}") for i in range(PIVOTS)])
        pivots = chosen.select("s", F.explode(F.array_distinct(F.array(*[F.struct(F.col(f"p{i}.k").alias("a"), F.col(f"p{i}.c").alias("ac"), F.col(f"p{i}.p").alias("ap")) for i in range(PIVOTS)]))).alias("x")).select("s", "x.*")
        # a near copy of a pivot shares most of the prefix: the others are left to the full search
        pairs = (members.join(pivots, "s").where("c <> ac").coalesce(tasks).groupBy("a", F.col("k").alias("b")).agg(F.count("*").alias("shared"), F.min(F.least("p", "ap")).alias("least"))
                 .where("shared >= 2 and 2 * shared >= least").select("a", "b"))
        pairs = stage(pairs, "pairs", tasks)
        found = _verified(docs, classes, pairs, n, pct, tasks)
        unstage(pairs)
        if links is None:
            links = found
        else:
            both = stage(links.union(found), "links", tasks)
            unstage(links)
            links = both
        if not found.limit(1).count():
            break
    unstage(crowd, inside)
    return links


def _candidates(docs: DataFrame, classes: DataFrame, counts: DataFrame, tied: DataFrame, n: int, pct: int, tasks: int) -> tuple[DataFrame, DataFrame | None]:
    """Pairs of classes in different groups that share enough prefix shingles (written table a, b), and links found on the way (``_hot_links``)."""
    group = classes.select("k", "n", "head").join(tied, F.col("k") == F.col("v"), "left").select("k", "n", "head", F.coalesce("c", "k").alias("c"))
    # document frequency: different groups with the shingle; only those in two or more matter, so those that one group has alone go
    inside = classes.join(tied, F.col("k") == F.col("v")).select("c", F.explode("head").alias("s")).groupBy("s", "c").agg(F.count("*").alias("x"))
    alone = inside.join(counts, "s").where("x = m").select("s")
    freq = stage(counts.join(alone, "s", "left_anti").select("s", "m"), "freq", tasks)
    unstage(counts)
    crowded = freq.where(F.col("m") >= HOT).select("s")
    sketch = membership_sketch(crowded, F.col("s"), unique=True)
    crowd = _shingles(classes, sketch).select("k", "s").join(crowded, "s").join(tied, F.col("k") == F.col("v"), "left")
    groups = crowd.select("s", F.coalesce("c", "k").alias("c")).distinct().groupBy("s").agg(F.count("*").alias("df"))
    freq2 = stage(freq.join(groups, "s", "left").select("s", F.coalesce("df", "m").alias("df")), "freq", tasks)
    release(sketch)
    unstage(freq)
    freq, chosen = freq2, _chosen(group, classes, freq2, pct, tasks)
    longer = stage(chosen.where("more").select("k", "c"), "longer", tasks)
    whole, own = None, None
    for left in reversed(range(LONGER)):
        some = longer.limit(HOT).count()
        if not some:
            break
        more = _sets(docs, classes, longer, n, "whole", tasks)
        toks = stage(more.select("c", F.explode("s").alias("s")).distinct(), "toks", tasks)
        added, before = toks.select("s").distinct(), whole
        own = toks if own is None else stage(own.union(toks).distinct(), "toks", tasks)
        whole = more if before is None else stage(before.unionByName(more), "whole")
        # whole sets hold shingles that no head has shown: count the groups of theirs anew; under HOT
        # documents can make a shingle hot only together with others, where it costs a few candidates more
        if not left or some < HOT:
            break
        sketch = membership_sketch(added, F.col("s"), unique=True)
        heads = _shingles(classes, sketch).select("k", "s").join(added, "s").join(tied, F.col("k") == F.col("v"), "left")
        again = stage(own.join(added, "s").select("s", "c").union(heads.select("s", F.coalesce("c", "k"))).distinct().groupBy("s").agg(F.count("*").alias("df")).where("df > 1"), "again", tasks)
        release(sketch)
        # a choice holds as long as no shingle of the head has become hot
        newly = stage(again.where(F.col("df") >= HOT).select("s").join(freq.where(F.col("df") >= HOT), "s", "left_anti").select("s"), "newly", tasks)
        recounted = stage(freq.join(added, "s", "left_anti").union(again), "freq", tasks)
        unstage(freq, again, longer)
        freq = recounted
        sketch = membership_sketch(newly, F.col("s"), unique=True)
        touched = _shingles(classes, sketch).select("k", "s").join(newly, "s").select("k").distinct()
        touched = stage(touched.join(whole.select("k"), "k", "left_anti"), "touched", tasks)
        release(sketch)
        anew = _chosen(group.join(touched, "k", "left_semi"), classes, freq, pct, tasks, touched)
        kept = stage(chosen.join(touched, "k", "left_anti").unionByName(anew), "prefixes", tasks)
        longer = stage(anew.where("more").select("k", "c"), "longer", tasks)
        unstage(chosen, anew, touched, newly)
        chosen = kept
    index = chosen.where("not more").select("k", "n", "c", "l", "r", F.explode("toks").alias("s"))
    if whole is None:
        rows = stage(index.join(freq.select("s"), "s", "left_semi").select("k", "n", "c", "l", "r", "s"), "index")
        unstage(chosen, freq)
        pairs = stage(_matches(rows, pct), "pairs")
        unstage(rows)
        return pairs, None
    useful = freq.select("s").union(own.select("s")).distinct()
    long = stage(_whole_prefixes(whole, freq, pct), "long", tasks)
    index = index.union(long.select("k", "n", "c", "l", "r", F.explode("toks").alias("s"))).join(useful, "s", "left_semi").select("k", "n", "c", "l", "r", "s")
    index = stage(index, "index")
    saturated = stage(long.where(F.col("l") == WHOLE).select("k", "n", "c", F.size("toks").alias("u"), "hot", F.explode("hot").alias("s")), "saturated", tasks)
    unstage(chosen, freq, own, long)
    hot, groups = _hot_links(saturated, whole, pct, tasks)
    now = saturated if groups is None else saturated.join(groups, F.col("c") == F.col("v"), "left").select("k", "n", F.coalesce("now", "c").alias("c"), "u", "hot", "s")
    pairs = stage(_matches(index, pct).union(_hot_matches(now, pct)).distinct(), "pairs")
    unstage(index, saturated, whole)
    return pairs, hot


def _chosen(group: DataFrame, classes: DataFrame, freq: DataFrame, pct: int, tasks: int, only: DataFrame | None = None) -> DataFrame:
    """The prefixes of the classes in ``group`` (of those in ``only``, if given) under the frequencies ``freq`` (written table)."""
    own = classes if only is None else classes.join(only, "k", "left_semi")
    sketch = membership_sketch(freq, F.col("s"), unique=True)
    shared = (_shingles(own, sketch).join(freq, "s").coalesce(tasks)
              .groupBy(F.col("k").alias("fk")).agg(F.collect_list(F.struct("pos", "df")).alias("freq")))
    known = group.join(shared, F.col("k") == F.col("fk"), "left")
    out = stage(_choose(known.select("k", "n", "head", "c", F.col("freq.pos").alias("pos"), F.col("freq.df").alias("df")), pct), "prefixes", tasks)
    release(sketch)
    return out


def _matches(index: DataFrame, pct: int) -> DataFrame:
    """Pairs of different groups that share as many indexed shingles as the document with the smaller l asks for."""
    b = index.select(*[F.col(x).alias(f"{x}2") for x in index.columns])
    need = F.when(F.col("l") == F.col("l2"), F.greatest("r", "r2")).otherwise(F.when(F.col("l") < F.col("l2"), F.col("r")).otherwise(F.col("r2")))
    return (index.join(b, F.col("s") == F.col("s2")).where("k < k2 and c <> c2")
            .where(f"100 * least(n, n2) >= {pct} * greatest(n, n2)")
            .groupBy("k", "k2").agg(F.count("*").alias("shared"), F.max(need).alias("need"))
            .where("shared >= need").select(F.col("k").alias("a"), F.col("k2").alias("b")))


def best_prefix(n: int, pct: int, df: np.ndarray, known: int) -> tuple[int, int]:
    """(l, r): the l with the least estimated cost and r = l minus the hot shingles of the l-prefix; (0, 0) if none of the first ``known`` will do.

    ``df`` has the document frequency of each of the first ``known`` shingles.
    """
    base = n - _least(n, pct)
    cost = np.where(df < HOT, df - 1.0, 0.0).cumsum()
    hot = (df >= HOT).cumsum()
    l = np.arange(1, known - base + 1)
    if not l.size:
        return 0, 0
    r = l - hot[base + l - 1]
    total = np.where(r > 0, cost[base + l - 1] * (1 + VERIFY / np.maximum(r, 1)), np.inf)
    best = int(total.argmin())
    return (int(l[best]), int(r[best])) if r[best] > 0 else (0, 0)


def _choose(classes: DataFrame, pct: int) -> DataFrame:
    def rows(cols):
        for k, n, head, c, pos, freq in zip(*(cols[x] for x in ("k", "n", "head", "c", "pos", "df"))):
            df = np.ones(len(head))
            if pos is not None:
                df[pos] = freq
            l, r = best_prefix(n, pct, df, len(head))
            yield k, n, c, l, r, head[np.flatnonzero(df[:n - _least(n, pct) + l] < HOT)] if l else head[:0], l == 0

    return map_rows(classes, rows, "k binary, n long, c binary, l int, r int, toks array<long>, more boolean", arrays=True)


#: l of a document whose whole set is its prefix.
WHOLE = 1 << 30


def _whole_prefixes(whole: DataFrame, freq: DataFrame, pct: int) -> DataFrame:
    """Prefixes out of whole sets; l is WHOLE, and ``hot`` the first hot shingles, where a set is hot nearly throughout."""
    def rows(cols):
        for k, c, s, pos, freq_ in zip(*(cols[x] for x in ("k", "c", "s", "pos", "df"))):
            df = np.ones(len(s))
            if pos is not None:
                df[pos] = freq_
            size = len(s)
            l, r = best_prefix(size, pct, df, size)
            l, r, end = (l, r, size - _least(size, pct) + l) if l else (WHOLE, 1, size)
            rare = np.flatnonzero(df[:end] < HOT)
            # the 1-prefix of the order in which hot shingles come last
            hot = np.flatnonzero(df >= HOT) if l == WHOLE else np.array([], np.int64)
            # the least frequent of them first: those of its own family and not of a passage that many families have
            hot = hot[np.lexsort((s[hot], df[hot]))][:max(0, size - _least(size, pct) + 1 - rare.size)]
            yield k, size, c, l, r, s[rare], s[hot]

    freqs = whole.select("k", F.posexplode("s").alias("pos", "s")).join(freq, "s").groupBy("k").agg(F.collect_list(F.struct("pos", "df")).alias("freq"))
    known = whole.join(freqs, "k", "left").select("k", "c", "s", F.col("freq.pos").alias("pos"), F.col("freq.df").alias("df"))
    return map_rows(known, rows, "k binary, n long, c binary, l int, r int, toks array<long>, hot array<long>", arrays=True)


def _hot_links(index: DataFrame, whole: DataFrame, pct: int, tasks: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Links (written table a, b, ca, cb) between the documents of a hot shingle and a few of them, and (v, now): the groups they tie together.

    Documents that are hot nearly throughout and have the same hot shingles are in one family and link;
    comparing all with those that have the least of their own ties them, so that ``_hot_matches`` lists no pair of them.
    """
    links, groups = None, None
    sets = whole.select("k", "s")
    for r in range(ROUNDS):
        members = index.select("k", "n", "c", "u", "s")
        if groups is not None:
            members = members.join(groups, F.col("c") == F.col("v"), "left").select("k", "n", F.coalesce("now", "c").alias("c"), "u", "s")
        middle = F.lit(0) if r else F.col("u")
        chosen = members.groupBy("s").agg(*[F.min(F.struct(middle.alias("o"), F.xxhash64("k", F.lit(PIVOTS * r + i)).alias("x"), "k", "c", "n", "u")).alias(f"p{i}") for i in range(PIVOTS)])
        pivots = chosen.select("s", F.explode(F.array_distinct(F.array(*[F.struct(*[F.col(f"p{i}.{x}").alias(f"{x}2") for x in ("k", "c", "n", "u")]) for i in range(PIVOTS)]))).alias("x")).select("s", "x.*")
        pairs = (members.join(pivots, "s").where("c <> c2").where(f"{100 + pct} * least(n - u, n2 - u2) >= {pct} * (n + n2)")
                 .coalesce(tasks).groupBy(F.col("k").alias("a"), F.col("k2").alias("b")).agg(F.first("c").alias("ca"), F.first("c2").alias("cb")))
        both = pairs.join(sets.select(F.col("k").alias("a"), F.col("s").alias("sa")), "a").coalesce(tasks).join(sets.select(F.col("k").alias("b"), F.col("s").alias("sb")), "b")
        found = stage(map_rows(both, _linked(pct, "ca", "cb"), "a binary, b binary, ca binary, cb binary", arrays=True), "hotlinks", tasks)
        some = found.limit(1).count()
        if links is None:
            links = found
        else:
            more = stage(links.union(found), "hotlinks", tasks)
            unstage(links, found)
            links = more
        if not some:
            break
        # groups of the first round's names: later rounds tie names of earlier ones
        tied = min_labels(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        groups = tied.select("v", F.col("c").alias("now"))
    return links, groups


def _linked(pct: int, *extra: str):
    """Rows (a, b, sa, sb) whose sets reach the threshold, as a, b and the ``extra`` columns."""
    def rows(cols):
        for a, b, sa, sb, *more in zip(*(cols[x] for x in ("a", "b", "sa", "sb", *extra))):
            shared = np.intersect1d(sa, sb, assume_unique=True).size
            if (100 + pct) * shared >= pct * (len(sa) + len(sb)):
                yield a, b, *more

    return rows


def _hot_matches(index: DataFrame, pct: int) -> DataFrame:
    """Pairs of documents that are hot nearly throughout (u shingles aren't) and share one of the first hot ones.

    Pairs that share a rare shingle are matched by that; the others lose all u on either side.
    A pair comes from the least hot shingle that both have among their first.
    """
    b = index.select(*[F.col(x).alias(f"{x}2") for x in index.columns])
    return (index.join(b, (F.col("s") == F.col("s2")) & (F.col("k") < F.col("k2")) & (F.col("c") != F.col("c2"))
                       & F.expr(f"{100 + pct} * least(n - u, n2 - u2) >= {pct} * (n + n2)")
                       & F.expr("array_min(array_intersect(hot, hot2)) = s"))
            .select(F.col("k").alias("a"), F.col("k2").alias("b")))


def _sets(docs: DataFrame, classes: DataFrame, keys: DataFrame, n: int, label: str, tasks: int) -> DataFrame:
    """(k, s) and the other columns of ``keys``: the whole sets of the classes in it (written table); classes whose rows all lack an id are found by their key."""
    ids = stage(keys.select("k").join(classes.select("k", "doc_id"), "k").select("k", "doc_id"), "ids", tasks)
    sketch = membership_sketch(ids.where("doc_id is not null"), F.col("doc_id"), unique=True)
    nameless = ids.where("doc_id is null")
    # the first 7 bytes of the key, as ``int.from_bytes`` reads them
    other = membership_sketch(nameless, F.conv(F.hex(F.substring("k", 1, 7)), 16, 10).cast("long")) if nameless.limit(1).count() else None

    def rows(cols):
        ids_ = cols["doc_id"]
        known = np.array([i is not None for i in ids_], bool)
        hit = sketch_test(sketch.value, np.array([i or 0 for i in ids_], np.int64)) & known
        for i in np.flatnonzero(hit if other is None else hit | ~known).tolist():
            s = shingle_set(cols["text"][i], n)
            k = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
            if known[i] or sketch_test(other.value, np.array([int.from_bytes(k[:7], "big")], np.int64))[0]:
                yield k, s.view(np.int64)

    found = map_rows(id_text(docs), rows, "k binary, s array<long>", rows=64)
    found = found.join(ids.select("k"), "k", "left_semi").dropDuplicates(["k"])
    out = stage(found.join(keys, "k") if len(keys.columns) > 1 else found, label, tasks)
    release(sketch, other)
    unstage(ids)
    return out


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, n: int, pct: int, tasks: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold: an exact upper bound from the heads first, then the whole sets."""
    head = classes.select("k", F.col("n").alias("size"), "head")

    def promising(cols):
        for a, b, na, nb, ha, hb in zip(*(cols[x] for x in ("a", "b", "na", "nb", "ha", "hb"))):
            x, y = ha.view(np.uint64), hb.view(np.uint64)
            both = min([h[-1] for h, size in ((x, na), (y, nb)) if h.size < size], default=np.uint64(2**64 - 1))
            cx, cy = int(np.searchsorted(x, both, "right")), int(np.searchsorted(y, both, "right"))
            most = np.intersect1d(x[:cx], y[:cy], assume_unique=True).size + min(na - cx, nb - cy)
            if (100 + pct) * most >= pct * (na + nb):
                yield a, b

    with_a = pairs.select("a", "b").join(head.select(F.col("k").alias("a"), F.col("size").alias("na"), F.col("head").alias("ha")), "a").coalesce(tasks)
    with_b = with_a.join(head.select(F.col("k").alias("b"), F.col("size").alias("nb"), F.col("head").alias("hb")), "b")
    near = stage(map_rows(with_b, promising, "a binary, b binary", arrays=True), "near", tasks)
    if not near.limit(1).count():  # the texts needn't be read for none
        return near
    keys = near.select(F.col("a").alias("k")).union(near.select("b")).distinct()
    sets = _sets(docs, classes, keys, n, "sets", tasks)

    full = near.join(sets.select(F.col("k").alias("a"), F.col("s").alias("sa")), "a").coalesce(tasks).join(sets.select(F.col("k").alias("b"), F.col("s").alias("sb")), "b")
    out = stage(map_rows(full, _linked(pct), "a binary, b binary", arrays=True), "links", tasks)
    unstage(sets, near)
    return out
