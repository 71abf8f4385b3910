"""Graph operators against brute force on small hand-made graphs."""

import heapq
import itertools
import random

import pytest
from pyspark.sql import functions as F

from hubflow.operators import graph as G
from hubflow.operators import neighbourhood as NB
from hubflow.operators import walks as W


def brandes(nodes, edges):
    """Textbook weighted directed Brandes, normalised 1/((n-1)(n-2)) (test oracle only)."""
    adj = {v: [] for v in nodes}
    for s, d, w in edges:
        if s != d:
            adj[s].append((d, w))
    bc = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, sigma, preds, order = {s: 0.0}, dict.fromkeys(nodes, 0), {v: [] for v in nodes}, []
        sigma[s] = 1
        heap, seen = [(0.0, s)], set()
        while heap:
            d, v = heapq.heappop(heap)
            if v in seen:
                continue
            seen.add(v)
            order.append(v)
            for u, w in adj[v]:
                nd = d + w
                if u not in dist or nd < dist[u]:
                    dist[u], sigma[u], preds[u] = nd, sigma[v], [v]
                    heapq.heappush(heap, (nd, u))
                elif nd == dist[u]:
                    sigma[u] += sigma[v]
                    preds[u].append(v)
        delta = dict.fromkeys(nodes, 0.0)
        for w_ in reversed(order):
            for v in preds[w_]:
                delta[v] += sigma[v] / sigma[w_] * (1 + delta[w_])
            if w_ != s:
                bc[w_] += delta[w_]
    n = len(nodes)
    return {v: b / ((n - 1) * (n - 2)) for v, b in bc.items()}


def _edges_df(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string, weight double")


def test_betweenness_matches_brandes_with_ties(spark):
    rng = random.Random(7)
    nodes = [f"h{i}" for i in range(9)]
    edges = []
    for a, b in itertools.permutations(nodes, 2):
        if rng.random() < 0.35:
            edges.append((a, b, rng.choice([0.5, 1.0, 1.5, 2.0])))  # dyadic weights: many ties
    edges.append(("h0", "h0", 1.0))  # self-loop never on a shortest path
    v = spark.createDataFrame([(n,) for n in nodes + ["iso"]], "v string")
    got = {r["v"]: r["betweenness_centrality"] for r in G.betweenness(_edges_df(spark, edges), v).collect()}
    want = brandes(nodes + ["iso"], edges)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-12)


def test_both_betweenness_paths_agree_exact_and_by_pivot(spark):
    rng = random.Random(11)
    edges = [(f"h{a}", f"h{b}", rng.choice([0.5, 1.0, 1.5])) for a in range(8) for b in range(8) if a != b and rng.random() < 0.4]
    v = spark.createDataFrame([(f"h{i}",) for i in range(9)], "v string")
    for k in (None, 3):
        arrays, loops = ({r["v"]: tuple(r)[1:] for r in G.betweenness(_edges_df(spark, edges), v, k=k, packed_edges=limit).collect()} for limit in (10_000, 0))
        assert arrays.keys() == loops.keys() and len(arrays) == 9
        for name in arrays:
            assert arrays[name][0] == pytest.approx(loops[name][0], abs=1e-12) and arrays[name][1] == loops[name][1] == (k or 9)
    assert G.pack(_edges_df(spark, edges).withColumnRenamed("weight", "w"), limit=5) is None


def test_degrees_and_strengths_with_self_loop_and_isolate(spark):
    e = _edges_df(spark, [("a", "b", 2.0), ("a", "a", 1.0), ("b", "c", 0.5)])
    v = spark.createDataFrame([("a",), ("b",), ("c",), ("z",)], "v string")
    d = {r["v"]: r for r in G.degrees(e, v).collect()}
    assert (d["a"]["in_degree"], d["a"]["out_degree"]) == (1, 2)
    assert d["z"]["in_degree"] == 0 and d["a"]["out_degree_centrality"] == pytest.approx(2 / 3)
    s = {r["v"]: r for r in G.strengths(e, v).collect()}
    assert s["a"]["weighted_out_strength"] == 3.0 and s["c"]["weighted_in_strength"] == 0.5
    chk = G.structural_checks(e, v).first()
    assert (chk["self_loops"], chk["isolated_nodes"]) == (1, 1)


def test_weak_components_long_chain_and_islands(spark):
    chain = [(f"c{i:02d}", f"c{i + 1:02d}", 1.0) for i in range(30)]
    edges = chain + [("x1", "x2", 1.0), ("x3", "x2", 1.0)]
    v = spark.createDataFrame([(n,) for n in {a for a, _, _ in edges} | {b for _, b, _ in edges} | {"solo"}], "v string")
    comp = {r["v"]: r["component"] for r in G.weak_components(_edges_df(spark, edges), v).collect()}
    assert len(set(comp.values())) == 3
    assert comp["c30"] == "c00" and comp["x3"] == "x1" and comp["solo"] == "solo"
    summ = G.component_summary(G.weak_components(_edges_df(spark, edges), v)).first()
    assert summ["components"] == 3 and summ["largest_sizes"] == [31, 3, 1]


def test_random_walks_follow_edges_and_are_deterministic(spark):
    edges = [("a", "b", 1.0), ("b", "c", 2.0), ("c", "a", 1.0), ("b", "a", 1.0), ("c", "d", 1.0)]
    e = _edges_df(spark, edges)
    v = spark.createDataFrame([(n,) for n in "abcd"], "v string")
    w1 = {r["walk_id"]: r["walk"] for r in W.random_walks(e, v, num_walks=5, walk_length=8, seed=3).collect()}
    w2 = {r["walk_id"]: r["walk"] for r in W.random_walks(e, v, num_walks=5, walk_length=8, seed=3).collect()}
    assert w1 == w2 and len(w1) == 20
    ok = {(a, b) for a, b, _ in edges}
    for walk in w1.values():
        assert 1 <= len(walk) <= 8
        assert all((x, y) in ok for x, y in zip(walk, walk[1:]))
        if len(walk) < 8:
            assert walk[-1] == "d"  # only the sink ends a walk early


def test_walks_follow_the_second_order_rule(spark):
    """Frequencies of the second step from a -> b against weight x p/q factor; graphs too large walk by rounds."""
    edges = [("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 2.0), ("b", "d", 3.0), ("a", "c", 1e-12), ("c", "a", 1.0), ("d", "a", 1.0), ("b", "z", 0.0)]
    p, q, n = 0.25, 2.0, 40_000
    v = spark.createDataFrame([("a",)], "v string")
    seen = {}
    for r in W.random_walks(_edges_df(spark, edges), v, num_walks=n, walk_length=3, p=p, q=q, seed=5).collect():
        assert r["walk"][:2] == ["a", "b"] and len(r["walk"]) == 3
        seen[r["walk"][2]] = seen.get(r["walk"][2], 0) + 1
    factor = {"a": 1 / p, "c": 2.0, "d": 3.0 / q}  # a is the hub before, c is its neighbour, d isn't
    for hub, f in factor.items():
        assert seen[hub] / n == pytest.approx(f / sum(factor.values()), abs=0.012)
    slow = W.random_walks(_edges_df(spark, edges), v, num_walks=4, walk_length=3, p=p, q=q, seed=5, packed_edges=2).collect()
    assert len(slow) == 4 and all(r["walk"][:2] == ["a", "b"] for r in slow)


def test_neighbour_mean_matches_numpy(spark):
    import numpy as np
    hubs = ["a", "b", "c"]
    x = {"a": [1.0, 2.0], "b": [3.0, 5.0], "c": [0.0, 1.0]}
    trips = [("a", "c"), ("a", "c"), ("b", "c"), ("c", "a")]
    xl = spark.createDataFrame([(h, i, v) for h in hubs for i, v in enumerate(x[h])],
                               "hub_id string, dim int, value double")
    te = NB.trip_edges(spark.createDataFrame(trips, "source_center string, destination_center string"))
    got = {(r["hub_id"], r["dim"]): r["value"] for r in NB.neighbour_mean(xl, te, hops=2).collect()}
    h = {k: np.array(v) for k, v in x.items()}
    for _ in range(2):
        nxt = {}
        for v in hubs:
            src = [u for u, d in trips if d == v]
            m = np.mean([h[u] for u in src], axis=0) if src else np.zeros_like(h[v])
            nxt[v] = np.concatenate([h[v], m])
        h = nxt
    for v in hubs:
        for i, val in enumerate(h[v]):
            assert got[(v, i)] == pytest.approx(val)
