"""Quality rules: base counts against brute force, boilerplate lines, odd rows, no Python in the plan."""

import re
from collections import Counter

from hubflow.llm.quality_rules import boilerplate_lines, quality_rules
from tests.llm.conftest import ODD, by_id

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    windows = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
    n = Counter(windows)
    cover = {p for k, x in enumerate(windows) if n[x] > 1 for p in range(k, k + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w))


TEXTS = [(50, "a b c d e a b c d e f"), (51, "a a a a a a a a a a"), (52, "x\ny\nx\n\n x\nx"), (53, "#*$ %&| <> é\u00a0é \u2028 z"), (54, " ".join(map(str, range(40)))),
         (55, " ".join(map(str, range(40))) + " 1 2 3 4 5"), (56, "a b c d e f a b c d e"), (57, "\u3000 wide\x0bblank\x0cs\x1c")]


def test_base_counts(docs):
    rows = ODD + TEXTS + [(50, TEXTS[0][1])]
    out = quality_rules(docs(rows)).collect()
    key = lambda r: tuple(str(x) for x in r)
    got = [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in out]
    assert sorted(got, key=key) == sorted([(i, *brute(t)) for i, t in rows], key=key)


def prose(i, n=20):
    return " ".join(f"w{i}x{k}" for k in range(n))


def test_lines_of_many_documents_are_taken_out(docs):
    common = "Share this story with all of your friends now and subscribe to our letter"
    rows = [(i, f"{prose(i)}\n{common.upper() if i % 2 else common}") for i in range(40)] + [(i, f"{prose(i, 3)}\n{common}") for i in range(40, 45)]
    rows += [(i, "the very same text of ten words and more in all copies") for i in range(50, 90)]
    df = docs(rows)
    assert boilerplate_lines(df, 20, 0.01).count() == 1  # copies count once
    got = by_id(quality_rules(df, max_docs=20, max_share=0.01))
    assert got[0]["n_boilerplate"] == 14 and got[0]["kept"]
    assert not got[40]["kept"] and not got[40]["base_failed"]  # depleted
    assert got[50]["kept"]
    assert boilerplate_lines(df, 45, 0.01).count() == 0
    other = df.withColumn("source", df["doc_id"].cast("string"))
    assert boilerplate_lines(other, 20, 0.01).count() == 0  # counted by host


def test_null_host_native_empty(docs):
    from pyspark.sql import functions as F
    rows = [(i, f"{prose(i)}\nsame line") for i in range(30)]
    got = quality_rules(docs(rows).withColumn("source", F.lit(None).cast("string")), 20, 0.01)
    assert {r["n_boilerplate"] for r in got.collect()} == {2}
    assert not re.search("Python|Arrow|Pandas", got._jdf.queryExecution().toString())
    assert quality_rules(docs(rows).limit(0)).collect() == []


def test_remaining_text_in_line_order(docs):
    common = "Share this story now"
    rows = [(i, f"{common}\n{prose(i)}\n\n share  THIS story now\nlast {i}\n") for i in range(30)] + [(30, f"{prose(30)}\n\nend"), (31, None), (32, common)]
    got = by_id(quality_rules(docs(rows), 20, 0.01))
    for i in range(30):
        assert got[i]["remaining"] == f"{prose(i)}\n\nlast {i}\n" and got[i]["n_boilerplate"] == 8
    assert got[30]["remaining"] == rows[30][1] and got[31]["remaining"] is None and got[32]["remaining"] == "" and got[32]["n_boilerplate"] == 4
