"""Merkle manifest against a plain tree in Python: any number of leaves and sources, ties, nulls, hot ids, tampering."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

import hubflow.llm.merkle_manifest as M

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, g string, rank long, path string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    doc_id, _, source, lang, n_chars = row[:5]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree(nodes):
    """(top, paths): paths[i] lists (left, right) from node i up."""
    paths, members = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, inside = [], []
        for at in range(0, len(nodes), 16):
            run = nodes[at:at + 16]
            for i in range(len(run)):
                for m in members[at + i]:
                    paths[m].append(("".join(run[:i]), "".join(run[i + 1:])))
            up.append(H(*run))
            inside.append(sum(members[at:at + 16], []))
        nodes, members = up, inside
    return nodes[0], paths


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        new = lowered(r[1]) if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[1]
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r[0], leaf(r, new)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(groups[s], key=lambda x: x[:3]), *tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])])) for s in order}
    root, tops = tree([trees[s][1] for s in order])
    out = []
    for s, top in zip(order, tops):
        leaves, subroot, paths = trees[s]
        for (_, _, own, doc_id, new), path in zip(leaves, paths):
            path = path + top
            node = new
            for left, right in path:
                node = H(left, node, right)
            out.append((doc_id, own, subroot, root, H(*[a + b for a, b in path]), node, node == root))
    return Counter(out)


def check(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", 5, "y") for r in rows], SCHEMA).repartition(parts)
    assert Counter(map(tuple, M.tampering_report(df).collect())) == brute(rows)


def doc(i, source="s", text=None):
    return i, text if text is not None else f"Text {i}", source, "en", 3


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 300])
def test_one_source_of_any_size(spark, n):
    check(spark, [doc(i * 7) for i in range(n)])


def test_sources_of_many_sizes_in_byte_order(spark):
    names = [None, "", "a", "B", "é", "日", "\U0001F600", "￮", "z" * 40, "0"] + [f"n{i}" for i in range(30)]
    check(spark, [doc(1000 * i + j, s) for i, s in enumerate(names) for j in range(1 + 11 * (i % 4))])


def test_ids_from_end_to_end_of_the_range(spark):
    rng = random.Random(8)
    ids = {-2**63, 2**63 - 1, -1, 0, 63, 64, -64, -65} | {rng.randrange(-2**63, 2**63) for _ in range(60)} | set(range(-200, 200, 3))
    check(spark, [doc(i, f"s{i % 2}") for i in ids])


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, None, None, None, None)] * 20 + [(None, f"A{i}", None, "en", i) for i in range(19)]
    rows += [(5, "x", None, None, 1)] * 33 + [(5, f"Y{i}", None, "de", 1) for i in range(40)] + [(None, "B", "s", "", 0), (7, None, "s", "", 0), (7, "", "s", "", 0)]
    rows += [doc(i, "s") for i in (4, 5, 6, 8)] + [(9, "É ß ABC", "t", "fr", 7), (10, "Z" * 300_000, "t", "fr", 7)]
    check(spark, rows)


def test_many_copies_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(M, "COPIES", 8)
    check(spark, [(3, "Copy", "s", "en", 4)] * 100 + [doc(i) for i in range(20)])


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert M.tampering_report(df).collect() == [] and M.manifest(df).root.collect() == []


def test_a_path_leads_from_leaf_to_root(spark):
    df = spark.createDataFrame([(*doc(i, f"s{i % 3}"), "x", 5, "y") for i in range(100)], SCHEMA)
    m = M.manifest(df)
    root = m.root.first()["root"]
    for r in m.proofs.collect():
        node = r["leaf"]
        for step in r["path"]:
            node = H(step["left"], node, step["right"])
        assert node == root and r["altered_leaf"] is None
    assert {r["source"] for r in m.subroots.collect()} == {"s0", "s1", "s2"}
