"""Skip-gram with negative sampling: pairs against brute force, planted communities, blocks, odd walks."""

import random

import numpy as np
import pytest

from hubflow.operators import skipgram as SG

WALKS = "walk_id string, walk array<string>"


def _communities(seed: int = 3, groups: int = 4, size: int = 8, walks: int = 12, length: int = 20):
    """Walks that leave their group's hubs one step in twenty."""
    rng = random.Random(seed)
    hubs = [[f"g{g}h{i}" for i in range(size)] for g in range(groups)]
    out = []
    for g in range(groups):
        for n in range(size * walks):
            at, walk = g, []
            for _ in range(length):
                at = rng.randrange(groups) if rng.random() < 0.05 else at
                walk.append(rng.choice(hubs[at]))
            out.append((f"{g}:{n}", walk))
    return out


def test_pairs_equal_brute_force(spark):
    rows = [("1", ["a", "b", "a", None, "c"]), ("2", ["a"]), ("3", []), ("4", None), ("5", ["c", "c"])]
    got = {(r["center"], r["context"]): r["weight"] for r in SG.window_pairs(spark.createDataFrame(rows, WALKS), 3).collect()}
    want: dict = {}
    for _, walk in rows:
        for i, a in enumerate(walk or ()):
            for j, b in enumerate(walk):
                if i != j and abs(i - j) <= 3 and a and b:
                    want[a, b] = want.get((a, b), 0) + 4 - abs(i - j)
    assert got == want


@pytest.mark.parametrize("block_rows", [1000, 11])
def test_planted_communities_are_closest(spark, block_rows):
    """Whole and in blocks (three tasks that exchange their vectors), a hub's nearest hubs are those of its group."""
    walks = spark.createDataFrame(_communities(), WALKS)
    rows = SG.skipgram(walks, dim=16, window=5, epochs=4, block_rows=block_rows).collect()
    names = [r["hub_id"] for r in rows]
    x = np.array([r["embedding"] for r in rows])
    assert len(set(names)) == 32 and x.shape == (32, 16) and np.isfinite(x).all()
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T - 2 * np.eye(32)
    same = [names[i][:2] == names[j][:2] for i in range(32) for j in np.argsort(-near[i])[:7]]
    assert np.mean(same) > 0.95


def test_same_vectors_again_and_odd_walks(spark):
    walks = spark.createDataFrame([("1", ["a", "b", "c", "a"]), ("2", ["d"]), ("3", None), ("4", [None, "e"])], WALKS)
    one, two = ({r["hub_id"]: r["embedding"] for r in SG.skipgram(walks.repartition(n), dim=4, epochs=2).collect()} for n in (1, 5))
    assert one == two and set(one) == {"a", "b", "c", "d", "e"}
    assert {r["hub_id"] for r in SG.skipgram(walks, dim=4, epochs=1, min_count=2).collect()} == {"a"}
    assert SG.skipgram(walks.limit(0), dim=4, epochs=1).collect() == []
