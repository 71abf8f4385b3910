"""Licence scan: base phrases against brute force, templates, odd rows, no Python in the plan."""

import re

from hubflow.llm.license_scan import BASE, license_labels
from tests.llm.conftest import ODD, by_id

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    w = WORD.findall((text or "").translate(AZ))
    found = [(k, label) for p, label in BASE.items() for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
    starts = [k for k, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


TEXTS = [
    (100, "Released under the MIT License."), (101, "mit-license mit license, MIT\nLICENSE and the mit licensee"), (102, "the license of mit"),
    (103, "GNU General Public License and general public general public license"), (104, "apache license " * 50), (105, "MIT Licen\u017fe mit licenſe \u212aey"),
    (106, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    (107, "Permission is hereby granted, free of charge. " + "filler " * 30 + "and associated documentation files"),
    (108, "Redistribution and use in source and binary forms, with or without modification, are permitted"), (109, "license"), (110, "general public mit license"),
    (111, "word " * 3000 + "apache license"), (111, "mit license"), (112, "éMIT License naïve"), (113, "mit license"), (113, "mit license"),
]


def test_base_places(docs):
    rows = ODD + TEXTS
    out = license_labels(docs(rows)).collect()
    assert len(out) == len(rows)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in out], key=key) == sorted([(i, *brute(t)) for i, t in rows], key=key)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_templates_need_every_phrase_at_one_alignment(docs):
    got = by_id(license_labels(docs(TEXTS)))
    assert got[106]["labels"] == "mit-notice" and got[107]["labels"] == "" and 0 < got[107]["score"] < 1
    assert got[108]["labels"] == "bsd" and got[106]["score"] > got[107]["score"]
    assert got[104]["labels"] == "apache" and got[104]["n_base"] == 50


def test_very_long_licence_texts(docs):
    """A million hits in one file: linear in the text, no context is kept."""
    rows = [(1, "mit license " * 500_000), (2, "the of and " * 300_000 + "general public license"), (3, "license " * 200_000 + "apache"), (None, "gnu apache license " * 1000)]
    out = license_labels(docs(rows)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in out], key=key) == sorted([(i, *brute(t)) for i, t in rows], key=key)


def test_native_and_empty(docs):
    out = license_labels(docs(TEXTS).limit(0))
    assert out.collect() == [] and not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().toString())
