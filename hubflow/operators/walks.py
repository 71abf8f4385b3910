"""Second-order biased random walks, and the health of embeddings.

Every step draws a hub by corridor weight × {1/p back to the previous hub, 1 if
previous → next exists, 1/q otherwise} (the published node2vec rule).

A corridor table of checked size goes to the tasks as arrays (``graph.pack``)
with a cumulative weight per corridor: a step draws one corridor by its weight
(one search, whatever the hub's number of corridors) and accepts it with the
probability its p/q factor has of the largest one, else it draws again.  Draws
are arithmetic on the walker's number, the step and the attempt, so a walk is
the same wherever and whenever it is computed, and SQL can replay it.

Larger graphs walk as DataFrames, one step per round for all walkers at once:
walkers join the corridor table on their hub and one candidate each is drawn
with a seeded exponential race — a ``min_by`` aggregate per walker.  These draws
follow the same distribution but are other walks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow.operators.graph import PACKED_EDGES, PackedGraph, pack
from hubflow.session import cut_lineage, materialize_round, ship_code

_M52 = (1 << 52) - 1

#: Modulus of the arithmetic draws (a prime).
DRAW_MOD = 2147483647


def draw(walker: np.ndarray, step: int, attempt: int, kind: int, seed: int) -> np.ndarray:
    """Numbers in [0, 1) from integer arithmetic that stays below 2**63: three squarings modulo ``DRAW_MOD``."""
    a = (walker % DRAW_MOD * 48271 + step * 69621 + attempt * 16807 + kind * 39373 + seed) % DRAW_MOD
    b = (a * a + 48271 * a + 12345) % DRAW_MOD
    c = (b * b + 69621 * a + 54321) % DRAW_MOD
    return (c * c + 16807 * b + 98765) % DRAW_MOD / DRAW_MOD


def draw_sql(walker: str, step: str, attempt: str, kind: int, seed: int) -> str:
    """The same as SQL."""
    m = DRAW_MOD
    a = f"(({walker}) % {m} * 48271 + ({step}) * 69621 + ({attempt}) * 16807 + {kind * 39373 + seed}) % {m}"
    return (f"list_transform([{a}], lambda a: list_transform([(a * a + 48271 * a + 12345) % {m}], lambda b: "
            f"list_transform([(b * b + 69621 * a + 54321) % {m}], lambda c: ((c * c + 16807 * b + 98765) % {m}) / cast({m} as double))[1])[1])[1]")


def _uniform(seed: int, *cols) -> F.Column:
    return (F.xxhash64(F.lit(seed), *cols).bitwiseAND(F.lit(_M52)).cast("double") / float(1 << 52))


def walk_paths(graph: PackedGraph, walkers: np.ndarray, begin: np.ndarray, length: int, p: float, q: float, seed: int) -> list[list[int]]:
    """The vertices of each walker's walk; all walkers of the batch step together."""
    n = len(graph.names)
    degree = np.diff(graph.start)
    source = np.repeat(np.arange(n), degree)
    upto = np.cumsum(graph.weight)
    before = np.concatenate(([0.0], upto))[graph.start[:-1]]
    total = np.concatenate(([0.0], upto))[graph.start[1:]] - before
    pairs = source.astype(np.int64) * n + graph.target
    most = max(1 / p, 1.0, 1 / q)
    path = np.full((walkers.size, length), -1, np.int32)
    path[:, 0] = begin
    live = np.flatnonzero(degree[begin] > 0)
    for step in range(1, length):
        waiting, attempt = live, 0
        while waiting.size:
            at = path[waiting, step - 1]
            u = draw(walkers[waiting], step, attempt, 0, seed)
            edge = np.clip(np.searchsorted(upto, before[at] + u * total[at], "right"), graph.start[at], graph.start[at + 1] - 1)
            to = graph.target[edge]
            if step == 1:
                ok = np.ones(to.size, bool)
            else:
                back = path[waiting, step - 2]
                key = back.astype(np.int64) * n + to
                found = pairs[np.minimum(np.searchsorted(pairs, key), pairs.size - 1)] == key
                factor = np.where(to == back, 1 / p, np.where(found, 1.0, 1 / q))
                ok = draw(walkers[waiting], step, attempt, 1, seed) * most < factor
            path[waiting[ok], step] = to[ok]
            waiting, attempt = waiting[~ok], attempt + 1
        live = live[degree[path[live, step]] > 0]
        if not live.size:
            break
    return [row[row >= 0].tolist() for row in path]


def random_walks(edges: DataFrame, vertices: DataFrame, num_walks: int = 200, walk_length: int = 30,
                 p: float = 1.0, q: float = 0.5, seed: int = 42, weight: str = "weight",
                 every: int = 5, packed_edges: int = PACKED_EDGES) -> DataFrame:
    """(walk_id, start, walk array<string>) — num_walks walks per vertex, up to walk_length hubs.

    Vertices are numbered in order of their names (endpoints of corridors
    included), walker ``i`` of vertex number ``v`` is walker v · num_walks + i.  A walk ends early at a hub
    without corridors.  Missing weights count 1, corridors without a positive weight are never taken.
    """
    e = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.coalesce(F.col(weight), F.lit(1.0)).alias("w"))
    v = vertices.select(F.col("v").cast("string").alias("v")).where("v is not null").distinct()
    graph = pack(cut_lineage(e.where("w > 0").groupBy("src", "dst").agg(F.sum("w").alias("w"))), packed_edges, v) if packed_edges else None
    if graph is None:
        return _walk_rounds(edges, vertices, num_walks, walk_length, p, q, seed, weight, every)
    spark = edges.sparkSession
    ship_code(spark)
    shared = spark.sparkContext.broadcast(graph)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        number = {name: i for i, name in enumerate(g.names)}
        for batch in batches:
            start = batch.column("v").to_pylist()
            begin, i = np.array([number[s] for s in start], np.int64), batch.column("i").to_numpy()
            paths = walk_paths(g, begin * num_walks + i, begin, walk_length, p, q, seed) if len(start) else []
            yield pa.RecordBatch.from_arrays([pa.array([f"{s}:{j}" for s, j in zip(start, i.tolist())], pa.string()), pa.array(start, pa.string()),
                                              pa.array([[g.names[x] for x in path] for path in paths], pa.list_(pa.string()))], ["walk_id", "start", "walk"])

    walkers = v.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(num_walks - 1)))).repartition("v", "i")
    return walkers.mapInArrow(run, "walk_id string, start string, walk array<string>")


def _walk_rounds(edges: DataFrame, vertices: DataFrame, num_walks: int, walk_length: int, p: float, q: float, seed: int, weight: str, every: int) -> DataFrame:
    """The walks of a graph too large to send along.

    The weighted choice among a walker's candidates is exponential-race
    sampling: candidate j gets key E_j / α_j with E_j = -ln U_j (U_j a seeded
    hash uniform of walk, step and candidate) and the smallest key wins, which
    selects j with probability α_j / Σα.  That is a plain ``min_by``
    aggregate per walker (partial aggregation, no sort, no window).
    """
    e = cut_lineage(edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"),
                                 F.coalesce(F.col(weight), F.lit(1.0)).alias("w")))
    exists = e.select(F.col("src").alias("prev"), F.col("dst").alias("nxt"), F.lit(True).alias("__back_edge"))
    walkers = (vertices.select(F.col("v").cast("string").alias("start"))
               .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(num_walks - 1))))
               .select(F.concat_ws(":", F.col("start"), F.col("i").cast("string")).alias("walk_id"), "start",
                       F.lit(None).cast("string").alias("back"), F.col("start").alias("cur"),
                       F.array(F.col("start")).alias("walk"), F.lit(False).alias("done")))
    state = cut_lineage(walkers.repartition("walk_id"))
    prev = None
    for step in range(1, walk_length):
        live = state.filter(~F.col("done"))
        cand = (live.join(e, F.col("cur") == F.col("src"))
                .join(exists, (F.col("back") == F.col("prev")) & (F.col("dst") == F.col("nxt")), "left")
                .select("walk_id", F.col("dst").alias("nxt"),
                        (F.col("w") * F.when(F.col("back").isNull(), F.lit(1.0))
                         .when(F.col("dst") == F.col("back"), F.lit(1.0 / p))
                         .when(F.col("__back_edge"), F.lit(1.0))
                         .otherwise(F.lit(1.0 / q))).alias("alpha")))
        u = _uniform(seed, F.col("walk_id"), F.lit(step), F.col("nxt"))
        race = -F.log(F.greatest(u, F.lit(1e-300))) / F.col("alpha")
        chosen = (cand.filter(F.col("alpha") > 0).groupBy("walk_id")
                  .agg(F.min_by("nxt", F.struct(race, F.col("nxt"))).alias("nxt")))
        moved = F.col("nxt").isNotNull()
        state = (state.join(chosen, "walk_id", "left").select(
            "walk_id", "start",
            F.when(moved, F.col("cur")).otherwise(F.col("back")).alias("back"),
            F.when(moved, F.col("nxt")).otherwise(F.col("cur")).alias("cur"),
            F.when(moved, F.concat(F.col("walk"), F.array(F.col("nxt")))).otherwise(F.col("walk")).alias("walk"),
            (F.col("done") | ~moved).alias("done")))
        # a sink ends a walk (done, path kept).  One job per step: the state is
        # persisted, and every ``every`` steps written to the checkpoint folder.
        state, _ = materialize_round(state, step, every=every, previous=prev)
        prev = state
    return state.select("walk_id", "start", "walk")


def embedding_health(emb: DataFrame, col: str = "embedding", dead: float = 1e-6) -> DataFrame:
    """Variance per dimension (population), with a dead-dimension flag."""
    return (emb.select(F.posexplode(col).alias("dim", "__x"))
            .groupBy("dim").agg(F.var_pop(F.col("__x").cast("double")).alias("variance"))
            .withColumn("dead", F.col("variance") < dead))


def embedding_health_summary(health: DataFrame, dead: float = 1e-6) -> DataFrame:
    return health.agg(F.count(F.lit(1)).alias("dims"), F.min("variance").alias("min_variance"),
                      F.avg("variance").alias("mean_variance"), F.max("variance").alias("max_variance"),
                      F.count_if(F.col("variance") < dead).alias("dead_dims"))
