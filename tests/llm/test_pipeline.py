"""The corpus pipeline stage by stage against brute force on planted documents."""

import random

import corpus_pipeline as P
from tests.llm.test_ngram_join import brute as components
from tests.llm.test_suffix_dedup import brute as repeats


def planted(seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abdeiklmnorstu") for _ in range(rng.randint(3, 9))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, toxic = [], {}
    passage = text(60)
    for i in range(300):
        t = text(rng.randint(40, 120))
        toxic[i] = int(i % 4 == 0)
        if toxic[i]:
            t += " you wretched scumbag vermin"
        if i % 9 == 1:
            t = f"{t[:30]} {passage} {t[30:]}"
        rows.append((i, t))
    rows += [(300 + k, rows[k][1].upper() if k % 2 else rows[k][1]) for k in (1, 2, 3, 5)]
    rows += [(310 + k, rows[k][1].replace(rows[k][1].split()[20], "changed", 1)) for k in (6, 7, 9)]
    return rows, toxic


def test_stages(spark, docs, tmp_path):
    rows, toxic = planted()
    d = str(tmp_path)
    df = docs(rows)
    df.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert len(P.STAGES) == 5 and P.ORACLE_SQL is None
    now = spark.read.parquet(f"{d}/documents.parquet")
    steps = []
    for k, (name, fn) in enumerate(P.STAGES):
        fn(spark, now, d).write.parquet(f"{d}/{k}")
        now = spark.read.parquet(f"{d}/{k}")
        steps.append(now)
        assert k == 4 or now.columns == df.columns
    texts = [{r["doc_id"]: r["text"] for r in s.collect()} for s in steps[:4]]
    bad = {i for i, t in rows if "wretched" in t.lower()}
    assert len(bad & set(texts[0])) <= 2 and len(set(dict(rows)) - bad - set(texts[0])) <= 2
    last = {}
    for i, t in texts[0].items():
        last[t.lower()] = max(i, last.get(t.lower(), -1))
    assert set(texts[1]) == set(last.values())
    assert set(texts[2]) == {top for _, top in components(list(texts[1].items()), 5, 80).values()}
    assert {i: t.encode() for i, t in texts[3].items()} == {i: x[3] for i, x in repeats(list(texts[2].items())).items()}
    assert {r["doc_id"]: r["n_chars"] for r in steps[3].collect()} == {i: len(t) for i, t in texts[3].items()}
    assert {r["doc_id"] for r in steps[4].collect()} == set(texts[3])
    assert {r["doc_id"] for r in P.run(spark, d).collect()} == set(texts[3])


def test_rows_without_or_with_repeated_ids(spark, docs, tmp_path):
    from pyspark.sql import functions as F
    df = docs([(1, "alpha beta"), (1, "alpha beta"), (2, "Alpha beta"), (None, "x"), (None, None), (3, None), (4, "gamma")])
    kept = P.exact_stage(spark, df, "")
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, ""), (0, "x"), (2, "Alpha beta"), (3, ""), (4, "gamma")]
    near = P.near_stage(spark, df.where("doc_id = 1"), "")
    assert near.count() == 1
    assert P.repeats_stage(spark, df, "").select(F.sum("n_chars")).count() == 1
