"""The driver contract, with and without the training-data subpackage."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and {"index_terms", "grammar_rules", "search_match"} <= set(queries)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["lang", "lemma", "n_docs"] and df.limit(1).count() == 1


@pytest.mark.parametrize("name", ["index_terms", "tokenize_offsets", "normalize_tokens", "disambiguate_cascade", "search_match", "highlight_spans"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in df[columns].itertuples(index=False))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["contextual_stopword", "golden_stopwords"])
def test_stopword_defaults(spark, name):
    """Conjunctions are stopwords of the contextual predicate; the plain default list stays as its SQL has it."""
    got = sorted(map(str, map(tuple, entry.queries()[name](spark, SF).collect())))
    assert got == sorted(map(str, duckdb.connect().execute(entry.oracle_sql()[name]).fetchall()))
