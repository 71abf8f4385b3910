"""Toxicity: held-out accuracy, labels of held-out rows are never read, odd rows."""

import random
import zlib

import numpy as np

import hubflow.llm.toxicity as T
from tests.llm.conftest import ODD, by_id


def corpus(spark, n=700):
    rng = random.Random(2)
    words = ["".join(rng.choice("abdeiklmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    bad = ["horridly", "vilest", "scumbag", "wretched"]
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        w = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        if toxic:
            for b in rng.sample(bad, 2):
                w.insert(rng.randrange(len(w)), b.upper() if i % 3 else b)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, docs):
    rows, labels = corpus(spark)
    got = by_id(T.toxicity(docs(rows), labels))
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in got if got[i]["held_out"]} == set(held)
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.93
    flipped = labels.selectExpr("doc_id", "quality", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) as toxic")
    again = by_id(T.toxicity(docs(rows), flipped))
    assert all(again[i]["score"] == got[i]["score"] for i in got)


def test_stage_drops_toxic_rows_only(spark, docs):
    rows, labels = corpus(spark)
    got = by_id(T.toxicity(docs(rows), labels))
    kept = T.drop_toxic(docs(rows), labels)
    assert kept.columns == docs(rows).columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i in got if not got[i]["predicted"]}


def test_odd_rows(spark, docs):
    rows, labels = corpus(spark, 200)
    labels = labels.union(spark.createDataFrame([(None, 1, 1), (5, 1, None), (900, 0, 1)], labels.schema))
    out = T.toxicity(docs(rows + ODD[3:] + [(300, None), (301, ""), (0, rows[0][1])]), labels)
    assert out.count() == 200 + len(ODD) - 3 + 3 and out.where("score is null or score < 0 or score > 1").count() == 0
    assert by_id(out)[300]["score"] == by_id(out)[301]["score"]
    assert T.toxicity(docs(rows).limit(0), labels).collect() == []
    assert {r["score"] for r in T.toxicity(docs(rows[:5]), labels.limit(0)).collect()} == {0.5}


def test_blocks_of_a_long_text(monkeypatch):
    text = " ".join(map(str, range(5000))).encode()
    whole = T.features(text)
    monkeypatch.setattr(T, "BLOCK", 1000)
    assert np.array_equal(whole, T.features(text))


def test_stage_keeps_all_rows_without_both_labels(spark, docs):
    rows, labels = corpus(spark, 60)
    for some in (labels.limit(0), labels.where("toxic = 1"), labels.where("toxic = 0"), labels.selectExpr("doc_id + 1000 as doc_id", "quality", "toxic")):
        assert sorted(r["doc_id"] for r in T.drop_toxic(docs(rows), some).collect()) == list(range(60))


def test_bound_of_grams_takes_turns(spark, docs, monkeypatch):
    """Texts of 400 KB: the sample shrinks to the bound, both classes stay in it (a dozen rows are too few to judge the scores by)."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abdeiklmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    rows = [(i, " ".join(rng.choices(words, k=80_000)) + (" vilest scumbag" * 40 if i % 2 else "")) for i in range(1, 25)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    seen = []
    fit = T.fit
    monkeypatch.setattr(T, "fit", lambda r, ratio: seen.append(r) or fit(r, ratio))
    size = T.features(rows[0][1].encode()).size
    monkeypatch.setattr(T, "SAMPLE_GRAMS", 12 * size)
    assert T.toxicity(docs(rows), labels).count() == 24
    assert 8 <= len(seen[0]) < 24 and {y for _, y in seen[0]} == {0, 1}
    assert sum(x.size for x, _ in seen[0]) < size  # only the kept grams reach the driver


def test_ratios_equal_a_plain_count(spark, docs):
    rows, labels = corpus(spark, 150)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    pos, neg = np.zeros(1 << T.BITS), np.zeros(1 << T.BITS)
    for i, text in rows:
        (pos if truth[i] else neg)[T.features(text.encode())] += 1
    want = np.log((pos + 1) / (pos + 1).sum()) - np.log((neg + 1) / (neg + 1).sum())
    want[(pos + neg < T.MIN_DOCS) | (np.abs(want) < T.MIN_RATIO)] = 0
    sample = spark.createDataFrame([(bytearray(T.features(t.encode()).tobytes()), truth[i]) for i, t in rows], "x binary, y int").repartition(3)
    got = T.log_count_ratios(sample)
    assert np.allclose(got, want) and (got != 0).sum() > 20
