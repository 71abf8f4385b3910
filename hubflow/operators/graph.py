"""Graph operators on a (vertices, edges) pair of DataFrames.

There is no graph object: a hub table and a corridor table *are* the graph.
Degree-type metrics are aggregates; a corridor table of checked size is sent to
the tasks as arrays where an operator searches paths (betweenness, walks).
Other iterative algorithms (components, betweenness of larger graphs) are DataFrame fixed-point loops whose state is checkpointed into
the session's reliable checkpoint folder every round, so lineage stays short
and a lost executor only recomputes one round.  Each round's only driver
traffic is one count to test convergence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from hubflow.schema import SLA_THRESHOLD
from hubflow.session import cut_lineage, materialize_round, ship_code


def vertices_of(edges: DataFrame, src="src", dst="dst", extra: DataFrame | None = None) -> DataFrame:
    v = edges.select(F.col(src).alias("v")).union(edges.select(F.col(dst).alias("v")))
    if extra is not None:
        v = v.union(extra.select(F.col(extra.columns[0]).alias("v")))
    return v.filter(F.col("v").isNotNull()).distinct()


def collapse(edges: DataFrame, src="src", dst="dst", weight="weight", how: str = "min",
             default: float = 1.0) -> DataFrame:
    """Multigraph -> simple digraph: one edge per (src, dst), minimum weight (missing -> default)."""
    w = F.coalesce(F.col(weight), F.lit(default))
    agg = {"min": F.min(w), "max": F.max(w), "mean": F.avg(w), "sum": F.sum(w)}[how]
    return edges.groupBy(F.col(src).alias("src"), F.col(dst).alias("dst")).agg(agg.alias("weight"))


def degrees(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """in/out degree (self-loops count on both), normalised by n-1, asymmetry."""
    v = vertices if vertices is not None else vertices_of(edges)
    n = v.agg(F.count(F.lit(1)).alias("__n"))
    outd = edges.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("out_degree"))
    ind = edges.groupBy(F.col("dst").alias("v")).agg(F.count(F.lit(1)).alias("in_degree"))
    d = (v.join(ind, "v", "left").join(outd, "v", "left").na.fill(0, ["in_degree", "out_degree"])
         .crossJoin(F.broadcast(n)))
    denom = F.greatest(F.col("__n") - 1, F.lit(1))
    return d.select(
        "v", "in_degree", "out_degree",
        (F.col("in_degree") / denom).alias("in_degree_centrality"),
        (F.col("out_degree") / denom).alias("out_degree_centrality"),
        ((F.col("in_degree") - F.col("out_degree"))
         / F.greatest(F.col("in_degree") + F.col("out_degree"), F.lit(1))).alias("degree_asymmetry"))


def strengths(edges: DataFrame, vertices: DataFrame | None = None, weight: str = "weight") -> DataFrame:
    """Σ weight of incoming / outgoing edges (0 for none)."""
    v = vertices if vertices is not None else vertices_of(edges)
    w = F.coalesce(F.col(weight), F.lit(1.0))
    o = edges.groupBy(F.col("src").alias("v")).agg(F.sum(w).alias("weighted_out_strength"))
    i = edges.groupBy(F.col("dst").alias("v")).agg(F.sum(w).alias("weighted_in_strength"))
    return (v.join(i, "v", "left").join(o, "v", "left")
            .na.fill(0.0, ["weighted_in_strength", "weighted_out_strength"]))


def structural_checks(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Nodes with out-edges, with in-edges, isolated nodes, self-loops (one row)."""
    srcs = edges.select(F.col("src").alias("v")).distinct()
    dsts = edges.select(F.col("dst").alias("v")).distinct()
    touched = srcs.union(dsts).distinct()
    iso = vertices.select("v").join(touched, "v", "left_anti")
    return (vertices.agg(F.count(F.lit(1)).alias("nodes"))
            .crossJoin(edges.agg(F.count(F.lit(1)).alias("edges"),
                                 F.count_if(F.col("src") == F.col("dst")).alias("self_loops")))
            .crossJoin(srcs.agg(F.count(F.lit(1)).alias("nodes_with_out_edges")))
            .crossJoin(dsts.agg(F.count(F.lit(1)).alias("nodes_with_in_edges")))
            .crossJoin(iso.agg(F.count(F.lit(1)).alias("isolated_nodes"))))


def graph_summary(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """nodes, edges, density m / (n (n-1)), chronic edges, weight range."""
    n = vertices.agg(F.count(F.lit(1)).alias("nodes"))
    m = edges.agg(F.count(F.lit(1)).alias("edges"),
                  F.count_if(F.col("weight") > SLA_THRESHOLD).alias("chronic_edges"),
                  F.min("weight").alias("weight_min"), F.max("weight").alias("weight_max"))
    return (n.crossJoin(m).withColumn(
        "density", F.try_divide(F.col("edges").cast("double"), F.col("nodes") * (F.col("nodes") - 1))))


def successors(edges: DataFrame, hub: str) -> DataFrame:
    return edges.filter(F.col("src") == hub)


# ---------------------------------------------------------------------------
# Weakly connected components: min-label propagation with pointer jumping.
# ---------------------------------------------------------------------------
def weak_components(edges: DataFrame, vertices: DataFrame | None = None, max_iter: int = 100) -> DataFrame:
    """(v, component) with component = smallest vertex id in the component.

    Raises if the labels still change after ``max_iter`` rounds.
    """
    v = vertices if vertices is not None else vertices_of(edges)
    und = (edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
           .union(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")))
           .filter(F.col("a") != F.col("b")).distinct())
    und = cut_lineage(und)
    labels = cut_lineage(v.select("v", F.col("v").alias("c")))
    for _ in range(max_iter):
        nb = (und.join(labels.withColumnRenamed("v", "a"), "a")
              .groupBy(F.col("b").alias("v")).agg(F.min("c").alias("nc")))
        step = (labels.join(nb, "v", "left")
                .select("v", F.least(F.col("c"), F.coalesce(F.col("nc"), F.col("c"))).alias("c")))
        # pointer jumping: adopt the label of my label
        hop = step.select(F.col("v").alias("c"), F.col("c").alias("cc"))
        jumped = (step.join(hop, "c", "left")
                  .select("v", F.least(F.col("c"), F.coalesce(F.col("cc"), F.col("c"))).alias("c")))
        jumped = cut_lineage(jumped)
        changed = (jumped.join(labels.withColumnRenamed("c", "old"), "v")
                   .filter(F.col("c") != F.col("old")).limit(1).count())
        labels = jumped
        if changed == 0:
            return labels.withColumnRenamed("c", "component")
    raise RuntimeError(f"components have not converged after {max_iter} rounds")


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def component_summary(components: DataFrame, top: int = 5) -> DataFrame:
    """count, is_connected, sizes of the largest ``top`` components (descending)."""
    sizes = component_sizes(components)
    largest = (sizes.orderBy(F.desc("size"), "component").limit(top)  # top-k, then a ≤ top-element list
               .agg(F.sort_array(F.collect_list("size"), asc=False).alias("largest_sizes")))
    return (sizes.agg(F.count(F.lit(1)).alias("components"), (F.count(F.lit(1)) == 1).alias("is_connected"))
            .crossJoin(largest))


# ---------------------------------------------------------------------------
# Weighted directed betweenness (Brandes semantics) as DataFrame iterations.
# ---------------------------------------------------------------------------
def pick_pivots(vertices: DataFrame, k: int | None = None, seed: int = 42) -> tuple[DataFrame, int, int]:
    """(sources, number of vertices, number of sources): all vertices, or with ``k`` the first k by
    the md5 of ``vertex:seed`` (sampling is only done when asked for)."""
    n = vertices.count()
    if k is None or k >= n:
        return vertices.select(F.col("v").alias("s")), n, n
    ordered = vertices.orderBy(F.md5(F.concat(F.col("v").cast("string"), F.lit(f":{seed}")).cast("binary")), "v").limit(k)
    return ordered.select(F.col("v").alias("s")), n, k


#: Graphs of up to this many edges are sent to the tasks as arrays (at most 16 bytes an edge and the vertex names).
PACKED_EDGES = 2_000_000


@dataclass
class PackedGraph:
    """A graph as arrays: vertex names in order, and per vertex the slice start[i]:start[i + 1] of targets (ascending) and weights."""
    names: list
    start: np.ndarray
    target: np.ndarray
    weight: np.ndarray


def pack(edges: DataFrame, limit: int = PACKED_EDGES, vertices: DataFrame | None = None) -> PackedGraph | None:
    """The arrays of ``edges`` (src, dst, w) and ``vertices`` (v), or None if there are more than ``limit`` edges or vertices."""
    if edges.count() > limit or (vertices is not None and vertices.count() > limit):
        return None
    rows = edges.select("src", "dst", "w").toArrow()
    src, dst = rows["src"].to_pylist(), rows["dst"].to_pylist()
    names = sorted({*src, *dst, *([r["v"] for r in vertices.select("v").collect()] if vertices is not None else [])})
    number = {v: i for i, v in enumerate(names)}
    a, b = (np.fromiter((number[v] for v in side), np.int32, len(side)) for side in (src, dst))
    order = np.lexsort((b, a))
    return PackedGraph(names, np.searchsorted(a[order], np.arange(len(names) + 1)), b[order], np.array(rows["w"].to_pylist(), float)[order])


def source_dependencies(graph: tuple[list, list, list], s: int, total: np.ndarray) -> None:
    """Add the dependencies of source ``s`` to ``total``: one heap-based shortest-path pass, then path counts backwards."""
    start, target, weight = graph
    dist, paths, before, order, done, heap = {s: 0.0}, {s: 1}, {}, [], set(), [(0.0, s)]
    while heap:
        d, u = heappop(heap)
        if u in done:
            continue
        done.add(u)
        order.append(u)
        for i in range(start[u], start[u + 1]):
            v, far = target[i], d + weight[i]
            old = dist.get(v)
            if old is None or far < old:
                dist[v], paths[v], before[v] = far, paths[u], [u]
                heappush(heap, (far, v))
            elif far == old:
                paths[v] += paths[u]
                before[v].append(u)
    depends = dict.fromkeys(order, 0.0)
    for v in reversed(order):
        for u in before.get(v, ()):
            depends[u] += paths[u] / paths[v] * (1.0 + depends[v])
        if v != s:
            total[v] += depends[v]


def _packed_dependencies(graph: PackedGraph, pivots: DataFrame) -> DataFrame:
    """(v, b): summed dependencies of all pivots; each task adds up its own pivots first."""
    spark = pivots.sparkSession
    ship_code(spark)
    shared = spark.sparkContext.broadcast(graph)
    kind = pivots.schema["s"].dataType
    schema = StructType([StructField("v", kind), StructField("b", DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        number = {v: i for i, v in enumerate(g.names)}
        lists, total = (g.start.tolist(), g.target.tolist(), g.weight.tolist()), np.zeros(len(g.names))
        for batch in batches:
            for v in batch.column(0).to_pylist():
                if v in number:
                    source_dependencies(lists, number[v], total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([g.names[i] for i in at.tolist()], arrow.field("v").type), pa.array(total[at])], schema=arrow)

    return pivots.repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, schema).groupBy("v").agg(F.sum("b").alias("b"))


def betweenness(edges: DataFrame, vertices: DataFrame | None = None, weight: str = "weight",
                k: int | None = None, seed: int = 42, max_iter: int = 1000,
                normalized: bool = True, packed_edges: int = PACKED_EDGES) -> DataFrame:
    """Betweenness centrality of every vertex, directed, weighted, 1/((n-1)(n-2)).

    Exact unless ``k`` asks for that many seeded pivots (``BETWEENNESS_PIVOTS``
    is the published choice for large networks): BC(v) = scale · Σ_s δ(s,v),
    scale × n/k when pivots are sampled; ``pivots`` in the output says how many
    were used.  Weights must be positive.

    Graphs of up to ``packed_edges`` edges go to the tasks as arrays; each task
    runs one shortest-path pass per pivot of its own and sums up.  Larger ones
    are iterated as DataFrames:
    1. single-source distances from every pivot: frontier Bellman–Ford
       (frontier ⋈ corridors, min per (s, v)), one job per round;
    2. shortest-path DAG: corridors with d(s,u) + w = d(s,v);
    3. DAG height per (s, v) (integer fixed point) gives the number of rounds
       for path counts σ (forward) and dependencies δ (backward).
    Their state is (pivot, vertex) pairs, k · n rows, not the trip volume; they
    raise if a loop has not converged after ``max_iter`` rounds.
    """
    v = vertices if vertices is not None else vertices_of(edges)
    e = cut_lineage(edges.filter(F.col("src") != F.col("dst"))
                    .select("src", "dst", F.coalesce(F.col(weight), F.lit(1.0)).alias("w")))
    if e.filter(~(F.col("w") > 0)).limit(1).count():
        raise ValueError("betweenness needs positive weights")
    pivots, n, kk = pick_pivots(v, k, seed=seed)
    graph = pack(e, packed_edges) if packed_edges else None
    if graph is not None:
        return _scaled(v, _packed_dependencies(graph, pivots), n, kk, normalized)

    dist = cut_lineage(pivots.select("s", F.col("s").alias("v"), F.lit(0.0).alias("d"),
                                     F.lit(True).alias("fresh")))
    for i in range(1, max_iter + 1):
        cand = (dist.filter("fresh").join(e, F.col("v") == F.col("src"))
                .groupBy("s", F.col("dst").alias("v")).agg(F.min(F.col("d") + F.col("w")).alias("nd")))
        nxt = (dist.select("s", "v", "d").join(cand, ["s", "v"], "full")
               .select("s", "v", F.least(F.col("d"), F.col("nd")).alias("d"),
                       (F.col("nd").isNotNull() & (F.col("d").isNull() | (F.col("nd") < F.col("d")))).alias("fresh")))
        dist, changed = materialize_round(nxt, i, "fresh", previous=dist)
        if changed == 0:
            break
    else:
        raise RuntimeError(f"distances have not converged after {max_iter} rounds")
    dist = cut_lineage(dist.select("s", "v", "d"))

    du = dist.select("s", F.col("v").alias("u"), F.col("d").alias("du"))
    dv = dist.select(F.col("s").alias("s2"), F.col("v").alias("x"), F.col("d").alias("dx"))
    dag = cut_lineage(
        du.join(e, F.col("u") == F.col("src"))
        .join(dv, (F.col("s") == F.col("s2")) & (F.col("dst") == F.col("x")))
        .filter(F.col("du") + F.col("w") == F.col("dx"))
        .select("s", "u", "x"))

    height = dist.select("s", "v", F.lit(0).alias("h"))
    for i in range(1, max_iter + 1):
        up = (dag.join(height.select("s", F.col("v").alias("x"), "h"), ["s", "x"])
              .groupBy("s", F.col("u").alias("v")).agg((F.max("h") + 1).alias("nh")))
        nxt = (height.join(up, ["s", "v"], "left")
               .select("s", "v", F.greatest(F.col("h"), F.coalesce(F.col("nh"), F.lit(0))).alias("h"),
                       (F.coalesce(F.col("nh"), F.lit(0)) > F.col("h")).alias("grew")))
        height, changed = materialize_round(nxt, i, "grew", previous=height if i > 1 else None)
        height = height.drop("grew")
        if changed == 0:
            break
    else:
        raise RuntimeError(f"path heights have not converged after {max_iter} rounds")
    rounds = height.agg(F.max("h")).first()[0] or 0

    seed_sigma = dist.select("s", "v", F.when(F.col("s") == F.col("v"), F.lit(1)).otherwise(F.lit(0))
                             .cast("bigint").alias("sigma"))
    sigma = seed_sigma
    for i in range(1, rounds + 1):
        inc = (dag.join(sigma.withColumnRenamed("v", "u"), ["s", "u"])
               .groupBy("s", F.col("x").alias("v")).agg(F.sum("sigma").alias("inc")))
        nxt = (seed_sigma.join(inc, ["s", "v"], "left")
               .select("s", "v", (F.col("sigma") + F.coalesce(F.col("inc"), F.lit(0))).alias("sigma")))
        sigma, _ = materialize_round(nxt, i, previous=sigma if i > 1 else None)
    sig_u = sigma.select("s", F.col("v").alias("u"), F.col("sigma").alias("su"))
    sig_x = sigma.select("s", F.col("v").alias("x"), F.col("sigma").alias("sx"))
    dag_w = cut_lineage(dag.join(sig_u, ["s", "u"]).join(sig_x, ["s", "x"])
                        .select("s", "u", "x", (F.col("su") / F.col("sx")).alias("frac")))

    delta = dist.select("s", "v", F.lit(0.0).alias("delta"))
    for i in range(1, rounds + 1):
        contrib = (dag_w.join(delta.select("s", F.col("v").alias("x"), "delta"), ["s", "x"])
                   .groupBy("s", F.col("u").alias("v"))
                   .agg(F.sum(F.col("frac") * (F.lit(1.0) + F.col("delta"))).alias("nd")))
        nxt = (dist.select("s", "v").join(contrib, ["s", "v"], "left")
               .select("s", "v", F.coalesce(F.col("nd"), F.lit(0.0)).alias("delta")))
        delta, _ = materialize_round(nxt, i, previous=delta if i > 1 else None)
    total = delta.filter(F.col("s") != F.col("v")).groupBy("v").agg(F.sum("delta").alias("b"))
    return _scaled(v, total, n, kk, normalized)


def _scaled(v: DataFrame, total: DataFrame, n: int, kk: int, normalized: bool) -> DataFrame:
    scale = (1.0 / ((n - 1) * (n - 2)) if normalized and n > 2 else 1.0) * n / max(kk, 1)
    return (v.select("v").join(total, "v", "left")
            .select("v", (F.coalesce(F.col("b"), F.lit(0.0)) * scale).alias("betweenness_centrality"),
                    F.lit(kk).cast("long").alias("pivots")))
