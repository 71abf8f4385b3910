"""Merkle manifest of a table of documents, with a proof for every row (operator 12).

Leaves are digests of rows; in each source they ascend by doc_id and every ``FAN``
consecutive nodes become one, until one is left (the subroot); the subroots, ordered by
source, become the root in the same way.

Method. A leaf's place is its rank among the ids of its source, read from bitmaps and not
from a sort of the leaves: the ids of a group are kept as 64-bit words (empty words are
left out, which is the compression), merged by a bitwise or. A directory of popcounts over
the words, 2**16 words a block, 2**16 blocks a block and so on, gives the number of rows
before a word; the set bits below an id's own give the rest. No step of the directory
holds more than 2**16 rows in one group, whatever a source's share of the table. Ids that
several rows share, and rows without an id, are ranked among themselves by the same
bitmaps over their digests. Node (group, rank) then belongs in slot rank % FAN of array
(group, rank / FAN); one aggregate over that key reduces a level.

Proofs run down again: an array's siblings are added to the path that all of its slots
share, so paths of n / FAN nodes are shuffled and those of n leaves aren't.

All work is DataFrame functions; hot sources are split by their ids.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubflow.llm.common import stage, unstage
from hubflow.operators.ordering import global_position

FAN = 16
#: Equal rows that one row of the plan may stand for before they are dealt out in blocks of this size.
COPIES = 4096
PATH = "array<struct<left: string, right: string>>"


def _item(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(text: Column | None = None) -> Column:
    """Lowercase hex SHA-256 over doc_id, source, lang, n_chars and text: ``-`` for a null, else byte count, ``:``, value."""
    return F.sha2(F.concat(*[_item(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], _item(F.col("text") if text is None else text)), 256)


def bitmap_ranks(rows: DataFrame) -> DataFrame:
    """``rows`` (g string, key long, m long, ...) with ``rank``: the sum of m over the rows of the same g with a smaller key. No nulls in g, key, m."""
    word, lo = "shiftright(key, 6)", "cast(key & 63 as int)"
    ids = rows.groupBy("g", F.expr(word).alias("word"), "key").agg(F.sum("m").alias("w"))
    words = stage(ids.groupBy("g", "word").agg(
        F.expr(f"bit_or(shiftleft(1L, {lo}))").alias("bits"), F.sum("w").alias("n"),
        F.expr(f"collect_list(case when w > 1 then struct({lo} as lo, w - 1 as more) end)").alias("again")), "words")
    # the popcount directory, coarsest block first: rows before a block within the next coarser one
    sums = [words.select("g", F.col("word").alias("b0"), "n")]
    for i in range(3):
        sums.append(sums[-1].groupBy("g", F.expr(f"shiftright(b{i}, 16)").alias(f"b{i + 1}")).agg(F.sum("n").alias("n")))
    before = None
    for i in reversed(range(4)):
        here = (words.withColumn("b0", F.col("word")) if i == 0 else sums[i]).withColumn(f"b{i + 1}", F.expr(f"shiftright(b{i}, 16)") if i < 3 else F.lit(0))
        if before is None:
            here = here.withColumn("base", F.lit(0).cast("long"))
        else:
            here = here.join(before, ["g", f"b{i + 1}"])
        here = here.withColumn("base", F.expr(f"base + sum(n) over (partition by g, b{i + 1} order by b{i}) - n"))
        before = here.select("g", f"b{i}", "base") if i else here.select(F.col("g").alias("wg"), F.col("word").alias("ww"), "bits", "again", "base")
    found = rows.join(before, (F.col("g") == F.col("wg")) & (F.expr(word) == F.col("ww")))
    own = F.expr(f"base + bit_count(bits & ~shiftleft(-1L, {lo})) + aggregate(again, 0L, (s, x) -> s + if(x.lo < {lo}, x.more, 0L))")
    return found.withColumn("rank", own).drop("wg", "ww", "bits", "again", "base")


def _places(rows: DataFrame) -> DataFrame:
    """``rows`` (g, doc_id, leaf, m, ...) with ``rank``, the place of their first copy in the source: by doc_id (null first), then by leaf."""
    by_id = stage(bitmap_ranks(rows.where("doc_id is not null").withColumn("key", F.col("doc_id"))).drop("key"), "ranked")
    nameless = rows.where("doc_id is null")
    # ids that several different rows share: their rows have the same rank so far
    shared = stage(rows.groupBy("g", "doc_id").agg(F.count("*").alias("k")).where("k > 1 or doc_id is null"), "shared")
    if not shared.limit(1).count():
        return by_id
    same = F.expr("g = sg and doc_id <=> sid")
    keys = shared.select(F.col("g").alias("sg"), F.col("doc_id").alias("sid"))
    tied = by_id.join(keys, same, "left_semi").unionByName(nameless.withColumn("rank", F.lit(0).cast("long")))
    tied = stage(tied.withColumns({"sg": F.col("g"), "start": F.col("rank"), "key": F.conv(F.substring("leaf", 1, 15), 16, 10).cast("long"),
                                   "g": F.expr("concat(coalesce(cast(doc_id as string), '-'), ':', g)")}).drop("rank"), "tied")
    # 60 bits of the leaf decide; leaves that agree in them are too few to matter for the window
    tied = bitmap_ranks(tied).withColumn("rank", F.expr("start + rank + coalesce(sum(m) over (partition by g, key order by leaf rows between unbounded preceding and 1 preceding), 0)"))
    tied = tied.withColumn("g", F.col("sg")).drop("sg", "start", "key")
    # rows with an id come after those of their source without one
    before = nameless.groupBy(F.col("g").alias("sg")).agg(F.sum("m").alias("none"))
    out = by_id.join(keys, same, "left_anti").unionByName(tied)
    return out.join(before, F.col("g") == F.col("sg"), "left").withColumn("rank", F.expr("rank + if(doc_id is null, 0L, coalesce(none, 0L))")).drop("sg", "none")


def _copies(rows: DataFrame) -> DataFrame:
    """One row per copy: ranks rank to rank + m - 1; large numbers of copies are dealt out in blocks first."""
    few = rows.where(f"m <= {COPIES}")
    many = rows.where(f"m > {COPIES}").withColumn("block", F.expr(f"explode(sequence(0L, (m - 1) div {COPIES}))"))
    many = many.withColumns({"rank": F.expr(f"rank + block * {COPIES}"), "m": F.expr(f"least({COPIES}L, m - block * {COPIES})")}).drop("block")
    # the key is spread and needn't be whole: a block is a row
    both = few.unionByName(many.repartition(F.col("g"), F.col("rank")))
    return both.withColumn("copy", F.expr("explode(sequence(0L, m - 1))")).withColumn("rank", F.expr("rank + copy")).drop("copy", "m")


def _arrays(nodes: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(g, idx, slots, digest): ``nodes`` (g, rank, digest, extra) gathered by array; digest is that of the slots' digests, of a lone first slot too."""
    slot = F.struct((F.col("rank") % FAN).alias("slot"), "digest", *extra)
    return (nodes.groupBy("g", F.expr(f"rank div {FAN}").alias("idx")).agg(F.array_sort(F.collect_list(slot)).alias("slots"))
            .withColumn("digest", F.sha2(F.concat_ws("", F.col("slots.digest")), 256)))


#: An array with one slot at index 0 has a whole group's last node in it: it is no level.
LAST = "idx = 0 and size(slots) = 1"


def _levels(nodes: DataFrame, extra: tuple[str, ...] = ()) -> list[DataFrame]:
    """Written tables of arrays, from the leaves up; in the last all groups are down to one node."""
    levels = [stage(_arrays(nodes, extra), "level")]
    while levels[-1].where(f"not ({LAST})").limit(1).count():
        up = levels[-1].where(f"not ({LAST})").select("g", F.col("idx").alias("rank"), "digest")
        levels.append(stage(_arrays(up), "level"))
    return levels


def _tops(levels: list[DataFrame]) -> DataFrame:
    """(g, digest): the last node of every group."""
    out = None
    for level in levels:
        last = level.where(LAST).select("g", F.col("slots")[0]["digest"].alias("digest"))
        out = last if out is None else out.unionByName(last)
    return out


def _paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The slots of the lowest level with ``path``; ``tops`` (g, path) has the paths of the groups' last nodes."""
    up, found = None, None
    for k in reversed(range(len(levels))):
        last = levels[k].where(LAST).join(tops, "g").select("g", "idx", "slots", "path", F.lit(True).alias("is_last"))
        if up is not None:
            last = last.unionByName(levels[k].where(f"not ({LAST})").join(up, ["g", "idx"]).select("g", "idx", "slots", "path", F.lit(False).alias("is_last")))
        one = last.select("g", "idx", "slots", "path", "is_last", F.expr("explode(sequence(0, size(slots) - 1))").alias("at"))
        step = F.expr("struct(array_join(slice(slots.digest, 1, at), '') as left, array_join(slice(slots.digest, at + 2, size(slots)), '') as right)")
        # the last node is no member of an array: it has the group's path as it is
        found = one.select("g", F.expr(f"if(is_last, 0L, idx * {FAN} + at)").alias("idx"), F.expr("slots[at]").alias("slot"),
                           F.when(F.col("is_last"), F.col("path")).otherwise(F.concat(F.array(step), F.col("path"))).alias("path"))
        if k:
            up = found.select("g", "idx", "path")
    return found


@dataclass
class Manifest:
    """proofs: one row per document with its path; root: one row, the root; levels: the arrays of the sources, subroots: (source, subroot)."""
    proofs: DataFrame
    root: DataFrame
    subroots: DataFrame
    levels: list[DataFrame]


def manifest(docs: DataFrame, altered: Column | None = None) -> Manifest:
    """The manifest of ``docs`` (doc_id, source, lang, n_chars, text; other columns are ignored).

    ``proofs`` has, for every row, doc_id, source, leaf, altered_leaf (the leaf with the
    text ``altered`` in place of the row's; null where ``altered`` is), subroot, root and
    path: from the leaf up, the digests left and right of the row's own node in its array.

    Any column may be null; a null differs from an empty text. Sources are ordered by their
    UTF-8 bytes, null first; leaves by doc_id, null first, and rows that share an id by
    their leaf, so equal rows stand side by side and each has a place and a proof of its
    own. An empty table has no proofs and no root.
    """
    other = F.lit(None).cast("string") if altered is None else F.when(altered.isNotNull(), leaf_digest(altered))
    g = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    rows = docs.select(g.alias("g"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest().alias("leaf"), other.alias("altered"))
    rows = stage(rows.groupBy("g", "doc_id", "leaf", "altered").agg(F.count("*").alias("m")), "leaves")
    slots = _copies(_places(rows)).select("g", "rank", F.col("leaf").alias("digest"), "doc_id", "altered")
    levels = _levels(slots, ("doc_id", "altered"))
    unstage(rows)
    subroots = stage(_tops(levels), "subroots")
    order = global_position(subroots.withColumnRenamed("g", "source_key"), ["source_key"], "rank")
    upper = _levels(order.select(F.lit("").alias("g"), "rank", "digest", "source_key"), ("source_key",))
    root = stage(_tops(upper).select(F.col("digest").alias("root")), "root")
    ends = upper[-1].where(LAST).select("g", F.expr(f"cast(array() as {PATH})").alias("path"))
    sources = _paths(upper, ends).select(F.col("slot.source_key").alias("g"), "path")
    tops = stage(sources.join(subroots.withColumnRenamed("digest", "subroot"), "g"), "sources")
    # a subroot is the same for a whole source: it travels in the path's last element and is taken out again
    carried = tops.select("g", F.expr("concat(path, array(struct(subroot as left, '' as right)))").alias("path"))
    found = _paths(levels, carried)
    proofs = found.crossJoin(F.broadcast(root)).select(
        F.col("slot.doc_id").alias("doc_id"), F.expr("if(g = '', null, substr(g, 2))").alias("source"), F.col("slot.digest").alias("leaf"),
        F.col("slot.altered").alias("altered_leaf"), F.expr("element_at(path, -1).left").alias("subroot"), "root",
        F.expr("slice(path, 1, size(path) - 1)").alias("path"))
    named = subroots.select(F.expr("if(g = '', null, substr(g, 2))").alias("source"), F.col("digest").alias("subroot"))
    return Manifest(proofs, root, named, levels)


def proof_digest(path: str = "path") -> Column:
    """SHA-256 of a path's siblings, from the leaf up, left to right."""
    return F.sha2(F.expr(f"array_join(transform({path}, x -> concat(x.left, x.right)), '')"), 256)


def folded(leaf: Column, path: str = "path") -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(F.col(path), leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def tampering_report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    In rows whose crc32 of the decimal doc_id is divisible by 5 the text's A-Z are
    lower-cased (a null text and a row without an id stay); folded_root comes from that
    leaf and the untampered siblings, verified tells whether it is the root.
    """
    lowered = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    proofs = manifest(docs, F.when(chosen & F.col("text").isNotNull(), lowered)).proofs
    out = proofs.select("doc_id", "leaf", "subroot", "root", proof_digest().alias("proof_sha256"),
                        folded(F.coalesce("altered_leaf", "leaf")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
