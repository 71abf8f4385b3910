"""Prefix trie of conversations by collapsing whole sequences (operator 11).

Method. Conversations with the same turns are first collapsed into one weighted sequence
with the list of its members; only one member's turns go on, so a conversation copied a
thousand times costs as much as one. A prefix is named by two 64-bit sums (exclusive or)
of its turns' position-keyed hashes, so a whole sequence's name is a plain aggregate and
the names of its prefixes are running sums. Sequences that are proper prefixes of others
are dropped by an anti-join; the rest are the leaves. Aggregates of the weighted prefixes
give the nodes. What is summed over a subtree is first put down once, at the smallest
member of its node, summed from the end of each sequence towards its start, and then
aggregated by node: no pair of node and descendant is ever listed.

One conversation may hold a third of all turns, one sequence a third of all conversations:
turns are numbered by a range partition, running sums go by blocks of ``BLOCK`` turns, and
member lists are joined block by block. Only a list's digest has to read its blocks one
after the other, as SHA-256 can't be merged.

Names have 128 bits over SHA-256 digests of the turns; an error needs two prefixes of the
same depth with the same name (under 1e-18 for 10**10 nodes).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow.llm.common import ship_package, stage, unstage
from hubflow.operators.ordering import global_position

BLOCK = 4096
#: Turns that a conversation takes over from the first of its hundred: crc32 of its id modulo this.
SHARED = 6


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, t, chars): SHA-256 of role and text (null: empty) and the text's code points; rows without conv_id belong to no conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", t.alias("t"), F.char_length(text).cast("long").alias("chars"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, ids): every conversation's rebuilt turns (c, d, t, chars), d from 1, and all ids (c), turnless ones included.

    Conversation c has the first h turns of conversation c - c % 100 (all if it has fewer,
    none if there is none), then its own after its first h; h is crc32 of the decimal id
    modulo ``SHARED``. Turns are in order of ``turn`` (null first), ties by digest.
    """
    placed = stage(global_position(turn_digests(conversations), ["conv_id", "turn", "t"], "pos").select("conv_id", "pos", "t", "chars"), "turns")
    counts = placed.groupBy(F.col("conv_id").alias("c")).agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    counts = stage(counts.withColumns({"b": F.expr("c - c % 100"), "h": F.crc32(F.col("c").cast("string").cast("binary")) % SHARED}), "counts")
    ids = stage(counts.join(counts.select(F.col("c").alias("b"), F.col("n").alias("nb")), "b", "left")
                .select("c", "b", "h", "first", F.expr("least(h, coalesce(nb, 0))").alias("taken")), "ids")
    own = (placed.join(ids, F.col("conv_id") == F.col("c")).where("pos - first >= h")
           .select("c", F.expr("taken + pos - first - h + 1").alias("d"), "t", "chars"))
    heads = placed.join(counts.select(F.col("c").alias("conv_id"), "first"), "conv_id").where(f"pos - first < {SHARED - 1}")
    lent = (heads.select(F.col("conv_id").alias("b"), F.expr("pos - first + 1").alias("d"), "t", "chars")
            .join(ids.where("taken > 0").select("c", "b", "taken"), "b").where("d <= taken").select("c", "d", "t", "chars"))
    turns = stage(own.union(lent), "rebuilt")
    unstage(placed, counts)
    return turns, ids.select("c")


def _running(rows: DataFrame, ops: dict[str, str], backwards: bool = False) -> DataFrame:
    """``rows`` (rep, d, ...) with each column of ``ops`` summed up to and with the row, along d; by blocks, so that no window holds a whole long sequence.

    ops: column -> bit_xor or sum. From the end of the sequence if ``backwards``.
    """
    way = "desc" if backwards else "asc"
    merge = {"bit_xor": "coalesce({}, 0L) ^ {}", "sum": "coalesce({}, 0L) + {}"}
    rows = rows.withColumn("block", F.expr(f"d div {BLOCK}"))
    blocks = rows.groupBy("rep", "block").agg(*[F.expr(f"{op}({c}) as all_{c}") for c, op in ops.items()])
    blocks = blocks.select("rep", "block", *[F.expr(f"{op}(all_{c}) over (partition by rep order by block {way} rows between unbounded preceding and 1 preceding) as before_{c}") for c, op in ops.items()])
    summed = {c: F.expr(merge[op].format(f"before_{c}", f"{op}({c}) over (partition by rep, block order by d {way} rows between unbounded preceding and current row)")) for c, op in ops.items()}
    return rows.join(blocks, ["rep", "block"]).withColumns(summed).drop("block", *[f"before_{c}" for c in ops])


def member_digests(members: DataFrame) -> DataFrame:
    """(rep, ends_sha256): SHA-256 of the ids c of each rep, decimal, ascending, joined by commas."""
    placed = global_position(members.select("rep", "c"), ["rep", "c"], "pos")
    blocks = placed.groupBy("rep", F.expr(f"pos div {BLOCK}").alias("block")).agg(F.array_join(F.array_sort(F.collect_list("c")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, state = None, None
        for batch in batches:
            done = []
            for r, text in zip(batch.column("rep").to_pylist(), batch.column("ids").to_pylist()):
                if r == rep:
                    state.update(b",")
                else:
                    if state:
                        done.append((rep, state.hexdigest()))
                    rep, state = r, hashlib.sha256()
                state.update(text.encode())
            if done:
                yield _digests(done)
        if state:
            yield _digests([(rep, state.hexdigest())])

    ship_package(members.sparkSession)
    return blocks.repartition("rep").sortWithinPartitions("rep", "block").select("rep", "ids").mapInArrow(run, "rep long, ends_sha256 string")


def _digests(done: list[tuple[int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r for r, _ in done], pa.int64()), pa.array([s for _, s in done], pa.string())], ["rep", "ends_sha256"])


NONE = hashlib.sha256(b"").hexdigest()


def sequence_trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """The trie of the sequences in ``turns`` (c, d from 1 without gaps, t, chars) of the conversations ``ids`` (c, each once).

    One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. Without conversations there is no node.
    """
    hashed = turns.select("c", "d", F.xxhash64("t", "d").alias("x"), F.xxhash64("d", "t", F.lit(7)).alias("y"), "chars")
    whole = ids.withColumnRenamed("c", "i").join(hashed.groupBy("c").agg(F.expr("bit_xor(x)").alias("hx"), F.expr("bit_xor(y)").alias("hy"), F.count("*").alias("len")), F.col("i") == F.col("c"), "left")
    whole = stage(whole.select(F.col("i").alias("c"), *[F.coalesce(v, F.lit(0).cast("long")).alias(v) for v in ("len", "hx", "hy")]), "whole")
    # identical conversations: one weighted sequence, named after its smallest member
    seqs = stage(whole.groupBy("len", "hx", "hy").agg(F.min("c").alias("rep"), F.count("*").alias("weight")), "sequences")
    name = ["len", "hx", "hy"]
    digests = stage(member_digests(whole.join(seqs, name).select("rep", "c")), "ends")

    reps = seqs.select("rep", "weight", "len")
    start = reps.select("rep", "weight", "len", *[F.lit(0).cast("long").alias(c) for c in ("d", "x", "y", "chars")])
    steps = start.unionByName(hashed.join(reps, F.col("c") == F.col("rep")).drop("c"))
    prefixes = _running(steps.withColumns({"kx": F.col("x"), "ky": F.col("y")}), {"kx": "bit_xor", "ky": "bit_xor"})
    prefixes = stage(prefixes.select("rep", "weight", "len", "d", "chars", "kx", "ky", F.expr("kx ^ x").alias("ux"), F.expr("ky ^ y").alias("uy")), "prefixes")

    proper = prefixes.where("d < len").select(F.col("d").alias("len"), F.col("kx").alias("hx"), F.col("ky").alias("hy")).distinct()
    leaves = seqs.join(proper, name, "left_anti").select("rep", F.col("len").alias("d"))

    key = ["d", "kx", "ky"]
    nodes = stage(prefixes.groupBy(*key).agg(F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max("chars").alias("chars"),
                                             F.max("ux").alias("ux"), F.max("uy").alias("uy")), "nodes")
    zero = F.lit(0).cast("long")
    own = (nodes.select(F.col("conv_id").alias("rep"), "d", F.expr("(n_convs - 1) * chars").alias("saved"), zero.alias("leaf"))
           .unionByName(leaves.select("rep", "d", zero.alias("saved"), F.lit(1).cast("long").alias("leaf")))
           .groupBy("rep", "d").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf")))
    put = prefixes.select("rep", *key).join(own, ["rep", "d"], "left").withColumns({c: F.coalesce(c, zero) for c in ("saved", "leaf")})
    sums = _running(put, {"saved": "sum", "leaf": "sum"}, backwards=True).groupBy(*key).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))

    below = nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("ux").alias("kx"), F.col("uy").alias("ky")).agg(F.count("*").alias("n_children"))
    above = nodes.select((F.col("d") + 1).alias("d"), F.col("kx").alias("ux"), F.col("ky").alias("uy"), F.col("conv_id").alias("parent_conv_id"))
    ends = seqs.join(digests, "rep").select(F.col("len").alias("d"), F.col("hx").alias("kx"), F.col("hy").alias("ky"), "ends_sha256")
    out = nodes.join(sums, key).join(below, key, "left").join(ends, key, "left").join(above, ["d", "ux", "uy"], "left")
    return out.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all rebuilt conversations of a table (conv_id, turn, role, text); see ``rebuilt`` and ``sequence_trie``.

    Null role or text becomes empty; a null turn comes first; rows without conv_id belong
    to no conversation and are left out; repeated rows are turns of their own; turns that
    tie are ordered by their digest. Extra columns are ignored. An empty table has no node.
    """
    return sequence_trie(*rebuilt(conversations))


def node_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """``nodes`` (conv_id, depth, ...) with role and text of their last turn; null for the root."""
    turns, _ = rebuilt(conversations)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    words = conversations.select(role.alias("role"), text.alias("text")).distinct()
    words = words.withColumn("t", F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    last = turns.select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), "t").join(nodes.select("conv_id", "depth"), ["conv_id", "depth"])
    return nodes.join(last.join(words, "t").drop("t"), ["conv_id", "depth"], "left")
