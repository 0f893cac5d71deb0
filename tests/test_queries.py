"""Queries on small fixtures, against brute force and their SQL."""

import math
import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry


def tables(spark, folder, **rows):
    """Parquet files of the named tables; returns the folder."""
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).toPandas().to_parquet(f"{folder}/{name}.parquet")
    return str(folder)


def whole_sql(folder, name, names):
    """Sorted rows of a query's SQL."""
    sql = entry.oracle_sql()[name]
    con = duckdb.connect()
    for t in names:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return sorted(con.execute(sql).fetchall())


def rows(df):
    return sorted(map(tuple, df.collect()))


# -- bm25_top5


def brute_bm25(docs, queries, top=5):
    words = lambda t: [w.lower() for w in re.findall(r"[^\W\d_]+", t)]
    tf = {d: Counter(words(t)) for d, t in docs}
    tf = {d: c for d, c in tf.items() if c}
    mean, n = sum(sum(c.values()) for c in tf.values()) / len(tf), len(tf)
    df = Counter(w for c in tf.values() for w in c)
    out = []
    for q, text in queries:
        score = {}
        for d, c in tf.items():
            got = [math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in sorted(set(words(text))) if w in c]
            if got:
                score[d] = round(sum(got), 9)
        out += [(q, i, d, round(s, 5)) for i, (d, s) in enumerate(sorted(score.items(), key=lambda x: (-x[1], x[0]))[:top], 1)]
    return sorted(out)


def test_bm25_uses_all_words(spark, tmp_path):
    docs = [(1, "one two three four"), (2, "seven eight nine"), (3, "nine nine nine ten one"), (4, "five"), (5, "two two six"), (6, "ten eleven"), (7, "other"), (8, "")]
    asked = [(1, "one two three four five six seven eight nine ten"), (2, "none of these are here but Eleven"), (3, "other")]
    sf = tables(spark, tmp_path, documents=([(*d, "en") for d in docs], "doc_id long, text string, lang string"), benchmark=(asked, "item_id long, text string"))
    got = rows(entry.queries()["bm25_top5"](spark, sf))
    same = lambda a, b: [x[:3] for x in a] == [x[:3] for x in b] and [x[3] for x in a] == pytest.approx([x[3] for x in b], abs=2e-5)
    assert same(got, brute_bm25(docs, asked))
    assert (2, 1, 6) in [x[:3] for x in got]
    assert same(got, whole_sql(sf, "bm25_top5", ("documents", "benchmark")))


# -- compound_candidates, compound_best


def test_compounds_of_long_document_words(spark, tmp_path):
    left, right, long = "landbúnaðar", "ráðuneytisins", "landbúnaðarráðuneytisins"
    docs = [(1, f"{left} {right} hestur " * 20, "is"), (2, f"{long} hesturhestur ekki{right}", "is")]
    sf = tables(spark, tmp_path, documents=(docs, "doc_id long, text string, lang string"))
    found = {}
    for name in ("compound_candidates", "compound_best"):
        found[name] = rows(entry.queries()[name](spark, sf))
        want = whole_sql(sf, name, ("documents",))
        assert [x[:-1] for x in found[name]] == [x[:-1] for x in want]
        assert [x[-1] for x in found[name]] == pytest.approx([x[-1] for x in want], abs=1e-6)
    assert len(long) > 20 and (long, left, right) in [x[:3] for x in found["compound_candidates"]]
    assert [x[:2] for x in found["compound_best"]] == [("hesturhestur", "hestur"), (long, f"{left} {right}")]


# -- snippet_best


def test_snippets_deal_out_only_words_near_hits(spark):
    """What ``own_word_context`` cuts out of the row is what a window over all tokens gives."""
    from pyspark.sql import functions as F

    from ordspark.functions.tokenize import PATTERN, tokenize
    from ordspark.operators.search import own_word_context

    odd = ["", None, "a b c", "..", "İİİ İİİ x", "word\u0001word \u0002banana\u0003 Banana", "see http://banana.is/x, banana@x.is banana.is banana-split (banana) 5 kg 10 kr bananas", " \n\nhestur, HESTUR; x's hestur", "ΣΟΦΟΣ ΣΟΦΟΣ, σοφος", "x " * 30 + "lengst " + "y. " * 30 + "lengst's lengst", "a.b c: d:e f.\n", "😀hestarnir 😀 hestarnir."]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id int, text string")
    plain = F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))
    told = {r.doc_id: r.ts for r in docs.select("doc_id", F.transform(plain, lambda x: F.struct(x.alias("x"), F.length(x).alias("n"), F.lower(x).alias("low"))).alias("ts")).collect()}
    kinds = {(r.doc_id, r.pos): r.kind for r in tokenize(docs, offsets=False).collect()}
    want = []
    for d, ts in told.items():
        at, words = 0, []
        for pos, t in enumerate(ts or []):
            if kinds.get((d, pos)) == "word":
                words.append((at, at + t.n, t.low))
            at += t.n
        q = next((w[2] for w in words if len(w[2]) >= 6), None)
        hits = [i for i, w in enumerate(words) if w[2] == q]
        want += [(d, *w[:2], w[2] if i in hits else None) for i, w in enumerate(words) if any(abs(i - h) <= 7 for h in hits)]
    got = own_word_context(docs)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and len(want) < len(kinds)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
