import pytest

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, digest string, k string, size int, pos int"


@pytest.fixture
def docs(spark):
    """docs([(doc_id, text), ...]): a documents table with extra columns whose names clash with the operators' own."""
    def make(rows, source="s"):
        return spark.createDataFrame([(i, t, source, "en", len(t or ""), "x", "y", 7, 9) for i, t in rows], SCHEMA).repartition(3)
    return make



def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "One"), (None, "no id here at all"), (7, "word " * 30_000), (8, "a" * 50_000), (9, "é日本\U0001F600 ß")]
