"""Near, exact and line deduplication against brute force."""

import random
import re
from collections import defaultdict

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ordspark.llm import exact_dedup, line_dedup
from ordspark.llm import minhash_dedup as M
from ordspark.llm.common import keyed_sets, byte_rows
from ordspark.llm.components import components

import pyarrow as pa

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def classes(rows):
    sets = sets_of(rows)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus():
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, n = [], 0
    for g in range(12):
        base = [r.choice(vocabulary) for _ in range(r.choice([1, 3, 4, 5, 8, 40, 120, 600]))]
        for _ in range(r.choice([1, 3, 25])):
            w = list(base)
            for _ in range(r.choice([0, 1, 2, 5])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((n, (" " if n % 3 else "\t\n").join(x.upper() if n % 7 == 0 else x for x in w)))
            n += 1
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    rows += [(n + k, passage + " " + " ".join(r.choice(vocabulary) for _ in range(140))) for k in range(30)]
    return rows + [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "One "), (905, "one two")]


def test_near_duplicates(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows + [(3, rows[3][1]), (None, "one")], "doc_id long, text string").selectExpr("*", "1 as rep", "2 as label", "'x' as bands")
    got = M.near_duplicates(docs).collect()
    want = classes(rows)
    assert len(got) == len(rows) + 2
    for x in got:
        if x.doc_id is not None:
            assert (x.n_shingles, x.component_id) == want[x.doc_id] and x.kept == (x.doc_id == x.component_id)
    assert M.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    """Rows of one id are one document if their words agree, and do not link their neighbours if not."""
    rows = corpus()
    other = {n: n for n, _ in rows} | {5000: 2, 5001: 2, 5002: 14, 5003: 3}
    all_ = rows + [(5000, "nothing in common with any of the others"), (5001, rows[20][1]), (5002, rows[3][1]), (5003, rows[3][1].upper())]
    docs = spark.createDataFrame([(other[n], t) for n, t in all_], "doc_id long, text string")
    want, least = classes(all_), {}
    for n, (_, root) in want.items():
        least[root] = min(least.get(root, 1 << 60), other[n])
    got = M.near_duplicates(docs).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == sorted((other[n], size, least[root]) for n, (size, root) in want.items())


def test_rest_of_buckets_is_compared(spark, monkeypatch):
    """Blocks of one document: every pair of a bucket meets in some cell."""
    monkeypatch.setattr(M, "BLOCK", 0.5)
    rows = corpus()[:60]
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == classes(rows)


def test_keys_tell_word_sequences():
    texts = ["a b c", "A  b\tc", "a c b", "a b c d", "ab c", "", "a\x00", "a"]
    keys = [k for _, k in keyed_sets(*byte_rows(pa.array(texts)))]
    assert keys[0] == keys[1] and len(set(keys)) == len(texts) - 1


def test_signature_estimates():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 2**63, 3000).astype(np.uint64))
    b = np.unique(np.concatenate((a[:2400], r.integers(0, 2**63, 300).astype(np.uint64))))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((M.signature(a) == M.signature(b)).mean() - true) < 0.15
    assert (M.signature(a[:1]) == a[0]).all()
    assert M.likely(M.sketch(a)[None], M.sketch(b)[None])[0] and not M.likely(M.sketch(a)[None], M.sketch(r.integers(0, 2**63, 3000).astype(np.uint64))[None])[0]


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]} | {x: l for x, l in got.items() if x == l}


def digest(n):
    import hashlib

    return hashlib.sha256(str(n).encode()).digest()


def test_cuckoo_index_inserts_deletes_resizes():
    index, live, r = exact_dedup.DigestIndex(8), {}, random.Random(2)
    for step in range(6000):
        n = r.randrange(900)
        if n in live and r.random() < 0.4:
            assert index.delete(digest(n)) == live.pop(n)
        elif n in live:
            assert index.find(digest(n), n) is live[n]
        else:
            assert index.find(digest(n), n) is None
            live[n] = [n, 1, n]
            index.insert(digest(n), live[n])
    assert len(index) == len(live) and index.resizes > 0
    assert all(index.find(digest(n)) is live.get(n) for n in range(900))


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=200))
def test_cuckoo_filter_has_no_false_negatives(members):
    f = exact_dedup.CuckooFilter(400)
    for n in set(members):
        f.insert(digest(n))
    assert all(digest(n) in f for n in members)


def test_exact_duplicates(spark):
    rows = [(5, "a  b"), (2, "a\tb"), (9, "a b "), (7, None), (8, ""), (None, "a b"), (None, "solo"), (2, "a\tb"), (11, "x" * 200_000), (12, " "), (13, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as digest", "2 as rows").repartition(3)
    for live in (2, 1000):
        got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs, live=live).collect()}
        assert got == {(5, 2, 4, False), (2, 2, 4, True), (None, 2, 4, False), (9, 9, 1, True), (7, 7, 2, True), (8, 7, 2, False), (None, None, 1, True), (11, 11, 1, True), (12, 12, 1, True), (13, 13, 1, True)}
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def brute_lines(rows):
    seen, gone = set(), defaultdict(set)
    for i, t in sorted(rows):
        full = [(k, x.strip(" \t\r")) for k, x in enumerate(t.split("\n")) if x.strip(" \t\r")] if t is not None else []
        for k in range(len(full) - 2):
            w = tuple(x for _, x in full[k : k + 3])
            if w in seen:
                gone[i].update(p for p, _ in full[k : k + 3])
            seen.add(w)
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows}


def test_lines(spark):
    r = random.Random(4)
    rows = [(n, "\n".join(r.choice(["a", "b ", "\tc", "d", "", "  ", "e\r"]) for _ in range(r.randrange(9)))) for n in range(80)]
    rows += [(100, None), (101, ""), (102, "\n\n\n"), (103, "q\n" * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' as id", "'k' as gone", "5 as n_lines", "'k' as `a.b`")
    got = line_dedup.dedup_lines(docs)
    assert {x.doc_id: x.text for x in got.collect()} == brute_lines(rows)
    assert got.columns == ["doc_id", "text", "id", "gone", "a.b", "n_lines", "n_removed"]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
    same = spark.createDataFrame([(None, "x\ny\nz"), (1, "x\ny\nz"), (1, "x\ny\nz")], "doc_id long, text string")
    assert sorted(x.text for x in line_dedup.dedup_lines(same).collect()) == ["", "x\ny\nz", "x\ny\nz"]
