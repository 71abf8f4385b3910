"""Registered queries over sf0.001: they run, name the contract's columns, and agree with SQL where there is some."""

import duckdb
import pytest

from hubflow.llm.queries import ORACLE, QUERIES
from tests.conftest import SF_SMALL

COLUMNS = {
    "op1": "doc_id n_shingles component_id", "op2": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op3": "doc_id n_pieces ids_crc32", "op4": "doc_id piece start length ids_crc32 sequence_id offset", "op5": "doc_id held_out score predicted",
    "op6": "doc_id keep_id group_size kept text_sha256", "op7": "page_id host path rule verdict",
    "op8": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op9": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op10": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op11": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    "op12": "doc_id leaf subroot root proof_sha256 folded_root verified", "op13": "doc_id n_tokens ids_sha256 decoded_sha256"}


def test_one_query_for_each_operator():
    assert sorted(q.split("_")[0] for q in QUERIES) == sorted(COLUMNS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns(spark, name):
    out = QUERIES[name](spark, SF_SMALL)
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(out.columns)
    assert out.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    out = QUERIES[name](spark, SF_SMALL)
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels"):
        con.execute(f"create view {t} as select * from '{SF_SMALL}/{t}.parquet'")
    cur = con.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    cols = sorted(out.columns)
    assert cols == sorted(names)
    rows = lambda records: sorted(str([r[c] for c in cols]) for r in records)
    assert rows(r.asDict() for r in out.collect()) == rows(dict(zip(names, r)) for r in cur.fetchall())
