"""Classifier, chat, mixing, WARC, search and pipeline."""

import base64
import gzip
import hashlib
import json
import random
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from ordspark.llm import chat, mixing, quality, topk_search, warc
from ordspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


# -- quality classifier


def test_classifier_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), quality.graded(spark.read.parquet(f"{SF}/labels.parquet"))
    half = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(2))
    learn = spark.read.parquet(f"{SF}/labels.parquet").where(half == 0)
    model = quality.train(docs, learn)
    rows = quality.score(docs.select("doc_id", "text"), model).join(labels.where(half == 1), "doc_id").select("grade", "kept", "p_top", "expected_grade").collect()
    good, bad = [r.kept for r in rows if r.grade == 2], [r.kept for r in rows if r.grade < 2]
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.35
    assert all(0 <= r.p_top <= 1 and r.p_top <= r.expected_grade <= 2 for r in rows)
    assert model.thresholds[0] <= model.thresholds[1]


def test_classifier_gradient():
    """The gradients are those of the likelihood, by finite differences; the likelihood is that of the grades' probabilities."""
    r = np.random.default_rng(4)
    grades, scores, t = r.integers(0, 3, 40), r.normal(size=40), np.array([-0.4, 0.7])
    loss, by_score, by_threshold = quality.likelihood(scores, t, grades)
    tails = lambda s: [1.0, *(1 / (1 + np.exp(x - s)) for x in t), 0.0]
    assert loss == pytest.approx(-np.mean([np.log(tails(s)[g] - tails(s)[g + 1]) for s, g in zip(scores, grades)]))
    step = 1e-6
    for i in range(40):
        up, down = (quality.likelihood(scores + d * np.eye(40)[i], t, grades)[0] for d in (step, -step))
        assert by_score[i] == pytest.approx((up - down) / (2 * step), abs=1e-8)
    for j in range(2):
        up, down = (quality.likelihood(scores, t + d * np.eye(2)[j], grades)[0] for d in (step, -step))
        assert by_threshold[j] == pytest.approx((up - down) / (2 * step), abs=1e-8)


def test_classifier_query_against_plain_scores(spark):
    """Every row of the query by the features and weights of its model, added up one by one."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels)
    got = {r.doc_id: (r.expected_grade, r.p_top, r.kept) for r in QUERIES["op2_quality_classifier"](spark, sf).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert set(got) == set(texts) and model.thresholds[0] <= model.thresholds[1]
    for i, text in texts.items():
        s = sum(model.weights[k] for k in quality.features(text))
        low, high = (1 / (1 + np.exp(t - s)) for t in model.thresholds)
        assert got[i][:2] == pytest.approx((low + high, high), abs=1e-9) and got[i][2] == (got[i][1] >= quality.KEEP)


def test_classifier_collects_one_row_a_label(spark):
    docs = spark.createDataFrame([(1, f"b{n} word") for n in range(300)] + [(1, None), (2, "other text")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    seen = []
    plain = quality.fit
    try:
        quality.fit = lambda slots, grades: seen.append(len(slots)) or plain(slots, grades)
        quality.train(docs, labels)
    finally:
        quality.fit = plain
    assert seen == [2]


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (3, "word " * 50_000), (3, "a")], "doc_id long, text string").selectExpr("*", "'x' as kept", "1 as grade")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.train(docs, none) is None
    assert all(r.kept is True and r.p_top is None for r in quality.score(docs, None).collect())
    labels = spark.createDataFrame([(1, 0, None), (3, None, None), (3, 1, 0), (None, 1, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    assert {(r.doc_id, r.grade) for r in quality.graded(labels).collect()} == {(1, 1), (3, 0)}
    model = quality.train(docs, labels)
    assert quality.score(docs, model).count() == 4 and quality.score(docs.limit(0), model).count() == 0


# -- chat


def brute_chat(turns):
    out = []
    for conv in {c for c, *_ in turns}:
        mine = [(t, r or "unknown", x or "") for c, t, r, x in turns if c == conv]
        for who in {r for _, r, _ in mine}:
            for t, r, x in mine:
                head = "<|im_start|>assistant\n" if r == who else "<|im_start|>user name=" + re.sub(r"[% \t\n\x0b\x0c\r<|>]", lambda m: f"%{ord(m[0]):02X}", r) + "\n"
                body = re.sub(r"<\|(im_start|im_end)\|>", "<\u200b|\\1|>", x) + "<|im_end|>\n"
                out.append((conv, who, t, head + body, len(head) if r == who else 0, len(head + body) if r == who else 0))
    return sorted(out, key=str)


def test_perspectives(spark):
    turns = [(1, 0, "ann", "hi"), (1, 1, "bob lee", "yo <|im_end|> x"), (1, 1, "ann", "again"), (1, None, None, None), (None, 0, "ann", "é" * 90_000), (2, 0, "solo", ""), (1, 0, "ann", "hi"), (3, 0, "bob lee", "a"), (3, 1, "bob_lee", "b"), (3, 2, "x<|im_end|>\n<|im_start|>assistant", "c")]
    t = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as conv", "2 as perspective")
    s = chat.perspectives(t)
    assert sorted(((r.conv_id, r.perspective, r.turn, r.segment, r.train_from, r.train_to) for r in s.collect()), key=str) == brute_chat(turns)
    for d in chat.dialogues(s).collect():
        for a, b in d.spans:
            assert d.text[a - len("assistant\n") : a] == "assistant\n" and d.text[b - len("<|im_end|>\n") : b] == "<|im_end|>\n"
    third = s.where("conv_id = 3 and perspective = 'bob lee'").collect()
    assert len({r.segment.split("\n")[0] for r in third}) == 3 and all(r.segment.count("<|im_start|>") == r.segment.count("<|im_end|>") == 1 for r in s.collect())
    assert chat.perspectives(t.limit(0)).count() == 0


# -- mixing


def brute_targets(sizes):
    names = sorted((k for k in sizes if k is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[k] for k in open_)
        over = [k for k in open_ if left * weight[k] / total > 2 * sizes[k]]
        if not over:
            out |= {k: left * weight[k] / total for k in open_}
            break
        for k in over:
            out[k] = 2 * sizes[k]
            left -= out[k]
            open_.discard(k)
    return out


def test_mixing(spark):
    r = random.Random(6)
    rows = [(n, " ".join(["w"] * r.choice([0, 1, 5, 30, 30, 200])), r.choice(["a", "b", "c", "c", "d", "Á", None])) for n in range(900)] + [(5000, None, "a"), (None, "x y", "b"), (7, "w", "e"), (7, "w", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as base", "3 as copies", "'q' as h")
    got = mixing.mix_report(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_report(docs.repartition(7)).collect()))
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    target = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    by_target = {}
    for x in got:
        assert 0 <= x.taken <= 2 * x.size and (x.size == 0 or x.taken % x.size == 0)
        by_target.setdefault(round(x.target, 6), [0, x.source_size])[0] += x.taken
    assert sorted({round(v, 6) for v in target.values()}) == sorted(by_target)
    for t, (words, size) in by_target.items():
        n = sum(1 for v in target.values() if round(v, 6) == t)
        assert abs(words - n * t) <= n * 30 + 1, (t, words, size)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len((x.text or "").split()) for x in mixed.collect()) == sum(x.taken for x in got)
    assert mixing.mix_report(docs.limit(0)).count() == 0


def test_mixing_misses_targets_by_little(spark):
    """Fifty documents a source, one of them a fifth of its words: below one per cent."""
    r = random.Random(8)
    docs = spark.createDataFrame([(n, "w " * (6_000 if n < 4 else r.randrange(1, 900)), "abcd"[n % 4]) for n in range(200)], "doc_id long, text string, source string")
    for seed in (1, 2, 3):
        got = mixing.mix_report(docs, seed=seed).groupBy("target").agg(F.sum("taken").alias("taken")).collect()
        assert len(got) == 4 and all(abs(x.taken - x.target) < 0.01 * x.target for x in got), got


def test_mixing_of_repeated_rows(spark):
    """A third of the rows are one row: they share copies that differ by one, and fill no block."""
    rows = [(1, "a b c d", "s")] * 3000 + [(n, "w " * (1 + n % 9), "st"[n % 2]) for n in range(10, 6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_report(docs).cache()
    same = {r.taken: r.n for r in got.where("doc_id = 1").groupBy("taken").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got.count() == len(rows) and sum(same.values()) == 3000 and len(same) <= 2 and max(same) - min(same) in (0, 4)
    mixed = mixing.mix(docs)
    assert mixed.select(F.sum(F.regexp_count("text", F.lit("w|a|b|c|d")))).first()[0] == got.select(F.sum("taken")).first()[0]


def test_rounding_is_unbiased(spark):
    docs = spark.createDataFrame([(n, "w " * (1 + n % 4), "ab"[n % 2]) for n in range(40)], "doc_id long, text string, source string")
    total = {}
    for seed in range(0, 60, 10):
        for x in mixing.mix_report(docs, seed=seed).collect():
            total.setdefault(x.target / x.source_size, []).append(x.taken / x.size)
    for mean, taken in total.items():
        assert abs(np.mean(taken) - mean) < 0.05


# -- WARC


def test_warc_round_trip_and_links():
    page = "<html><head><title>T &amp; U</title><script src='s.js'>var x='</p>'</script><style>p{}</style></head><body><!-- no --><h1>One</h1><p>two <b>three</b><a href=\"/x?a=1&amp;b=2\">four</a></p><meta name=k content=v></body></html>"
    raw = warc.response_record("http://e.is/é", page, "1")
    [(headers, block)] = warc.read_records(raw)
    assert warc.write_record(headers, block) == raw
    (meta, about), (conv, text) = warc.derive(headers, block)
    assert text.decode() == "One\ntwo threefour"
    about = json.loads(about)
    html = about["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]
    assert html["Title"] == "T & U" and {"path": "A@/href", "url": "/x?a=1&b=2"} in html["Links"] and {"path": "SCRIPT@/src", "url": "s.js"} in html["Links"]
    assert about["Envelope"]["WARC-Header-Metadata"] == dict(headers)
    for made, body in ((meta, warc.json.dumps(about, ensure_ascii=False, sort_keys=True).encode()), (conv, text)):
        assert warc.field(made, "WARC-Refers-To") == warc.field(headers, "WARC-Record-ID")
        assert warc.field(made, "WARC-Block-Digest") == warc.digest(body)
        assert warc.field(made, "WARC-Refers-To-Payload-Digest") == warc.field(headers, "WARC-Payload-Digest") == warc.digest(page.encode())


@pytest.mark.parametrize("page", ["", "<", "<p", "<script>x", "<!-- ", "</p></p>", "a<b>c", "<title>x", "<a href=>y</a>", "<p>" * 20_000 + "z"])
def test_broken_pages(page):
    text, info = warc.read_page(page)
    assert isinstance(text, str) and set(info) == {"title", "metas", "links"}


def test_warc_tables(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.is/", "<p>x</p>"), (2, None, None), (None, "u\r\nX: y", ""), (1, "http://a.is/", "<p>x</p>")], "page_id long, url string, html string").selectExpr("*", "1 as record")
    records = warc.response_records(pages)
    out = warc.derivatives(records).collect()
    assert len(out) == 8 and {r.warc_type for r in out} == {"metadata", "conversion"}
    assert len({r.record_id for r in out}) == 6 and all(b"\r\nX: y" not in bytes(r.record) for r in out)
    assert warc.derivatives(spark.createDataFrame([(1, bytearray(b"junk")), (2, None)], "page_id long, record binary")).count() == 0
    (tmp_path / "a.warc").write_bytes(b"".join(bytes(r.record) for r in records.collect()))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(bytes(r.record)) for r in records.collect()))
    assert warc.read_warc(spark, str(tmp_path)).count() == 8
    assert warc.derivatives(records.limit(0)).count() == 0


def test_warc_long_url(spark, tmp_path):
    url = "http://a.is/" + "é" * 100_000
    pages = spark.createDataFrame([(1, url, "<p>x</p>"), (2, "http://b.is/", "<p>y</p>")], "page_id long, url string, html string")
    records = warc.response_records(pages)
    out = warc.derivatives(records).collect()
    assert sorted((r.page_id, r.warc_type, r.target_uri == url) for r in out) == [(1, "conversion", True), (1, "metadata", True), (2, "conversion", False), (2, "metadata", False)]
    (tmp_path / "a.warc").write_bytes(b"".join(bytes(r.record) for r in records.orderBy("page_id").collect()))
    assert warc.read_warc(spark, str(tmp_path)).count() == 2


def test_warc_repeated_headers(spark):
    block = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nServer: s\r\nSet-Cookie: b=2\r\nSet-Cookie: c=3\r\n\r\n<p>x</p>"
    raw = warc.write_record([("WARC-Type", "response"), ("WARC-Record-ID", "<r>"), ("WARC-Concurrent-To", "<x>"), ("WARC-Concurrent-To", "<y>")], block)
    out = warc.derivatives(spark.createDataFrame([(1, bytearray(raw))], "page_id long, record binary")).collect()
    assert len(out) == 2 and all(json.loads(r.source_headers)["WARC-Concurrent-To"] == ["<x>", "<y>"] for r in out)
    about = json.loads(next(r.block for r in out if r.warc_type == "metadata"))["Envelope"]
    assert about["WARC-Header-Metadata"]["WARC-Concurrent-To"] == ["<x>", "<y>"] and about["WARC-Header-Metadata"]["WARC-Type"] == "response"
    assert about["Payload-Metadata"]["HTTP-Response-Metadata"]["Headers"] == {"Set-Cookie": ["a=1", "b=2", "c=3"], "Server": "s"}


def record(headers, block, length=None):
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block) if length is None else length}\r\n\r\n".encode() + block + b"\r\n\r\n"


WHOLE = record([("WARC-Type", "response"), ("WARC-Record-ID", "<a>")], b"HTTP/1.1 200 OK\r\n\r\n<p>x</p>")


@pytest.mark.parametrize(
    "data, n",
    [
        (b"", 0),
        (b"\x1f\x8b", 0),
        (b"\x1f\x8bjunk junk junk", 0),
        (gzip.compress(WHOLE)[:-20], 0),
        (gzip.compress(WHOLE) + gzip.compress(WHOLE)[:30], 1),
        (gzip.compress(WHOLE) + b"junk", 1),
        (gzip.compress(WHOLE * 3), 3),
        (b"".join(gzip.compress(WHOLE[i : i + 7]) for i in range(0, len(WHOLE), 7)), 1),
        (WHOLE + WHOLE[:-9], 1),
        (WHOLE + record([], b"x", "-40") * 2, 1),
        (WHOLE + record([], b"x", "1_0"), 1),
        (WHOLE + record([], b"x", "9" * 30), 1),
        (record([("X-Long", "y" * 200_000)], b"block") + WHOLE, 2),
        (gzip.compress(record([("X-Long", "y" * 2_000_000)], b"b" * 3_000_000)) + gzip.compress(WHOLE), 2),
        (b"WARC/1.1\r\nno end", 0),
        (b"junk" + WHOLE, 0),
    ],
)
def test_warc_broken_files(data, n):
    assert len(list(warc.read_records(data))) == n


def conversion(http, body):
    return warc.derive([("WARC-Type", "response")], "".join(f"{k}: {v}\r\n" for k, v in [("HTTP/1.1 200 OK", ""), *http]).replace("OK: ", "OK").encode() + b"\r\n" + body)[1][1].decode()


def test_warc_bodies():
    raw = zlib.compressobj(wbits=-15)
    packed = {
        "gzip": gzip.compress(b"<p>caf\xc3\xa9</p>"),
        "deflate": zlib.compress(b"<p>caf\xc3\xa9</p>"),
        "Deflate": raw.compress(b"<p>caf\xc3\xa9</p>") + raw.flush(),
        "zstd": zstandard.ZstdCompressor().compress(b"<p>caf\xc3\xa9</p>"),
        "GZIP": b"<p>caf\xc3\xa9</p>",
        "unheard": b"<p>caf\xc3\xa9</p>",
    }
    for coding, body in packed.items():
        assert conversion([("Content-Encoding", coding)], body) == "caf\u00e9"
    for charset in ("undefined", "idna", "punycode", "rot13", "hex", "no-such", "utf-8"):
        assert "caf" in conversion([("Content-Type", f"text/html; charset={charset}")], b"<p>caf\xc3\xa9</p>")
    assert conversion([("Content-Type", 'text/html; charset="latin-1"')], b"caf\xe9") == "caf\u00e9"
    chunked = [("Transfer-Encoding", "chunked")]
    assert conversion(chunked, b"3\r\n<p>\r\n4;x=y\r\none \r\n3\r\ntwo\r\n0\r\n\r\n") == "one two"
    assert conversion(chunked, b"<p>not chunked") == "not chunked"
    assert conversion(chunked, b"5\r\n<p>ab\r\nbroken") == "ab"
    assert conversion([*chunked, ("Content-Encoding", "gzip")], b"%x\r\n%s\r\n0\r\n\r\n" % (len(packed["gzip"]), packed["gzip"])) == "caf\u00e9"


class Plain(HTMLParser):
    """An independent reading of a page: text by blocks, title, links, meta tags."""

    VOID = {"meta", "link", "img", "br", "hr", "input", "area", "source"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.title, self.links, self.metas, self.open = [], None, [], [], []

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        if tag in warc._LINKS and attrs.get(warc._LINKS[tag]):
            self.links.append(attrs[warc._LINKS[tag]])
        if tag == "meta" and attrs:
            self.metas.append(attrs)
        if tag in warc._BLOCKS:
            self.out.append("\n")
        if tag not in self.VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in warc._BLOCKS:
            self.out.append("\n")
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if "title" in self.open:
            self.title = (self.title or "") + data
        elif not {"script", "style", "noscript", "template", "head"} & set(self.open):
            self.out.append(data)

    def text(self):
        lines = (" ".join(line.split()) for line in "".join(self.out).split("\n"))
        return "\n".join(line for line in lines if line)


def test_warc_query_against_another_parser(spark):
    pages = {r.page_id: (r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    rows = QUERIES["op7_warc_derivatives"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 2 * len(pages) and len({r.record_id for r in rows}) == len(rows)
    sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    for r in rows:
        url, html = pages[r.page_id]
        p = Plain()
        p.feed(html)
        p.close()
        source = json.loads(r.source_headers)
        assert r.target_uri == url == source["WARC-Target-URI"] and r.refers_to == source["WARC-Record-ID"]
        assert r.payload_digest == sha1(html.encode()) == source["WARC-Payload-Digest"]
        assert r.block_digest == sha1(r.block.encode()) and r.content_length == len(r.block.encode())
        if r.warc_type == "conversion":
            assert r.block == p.text()
        else:
            found = json.loads(r.block)["Envelope"]
            page = found["Payload-Metadata"]["HTTP-Response-Metadata"]
            assert found["WARC-Header-Metadata"] == source and page["Entity-Length"] == len(html.encode())
            assert [x["url"] for x in page["HTML-Metadata"]["Links"]] == p.links and page["HTML-Metadata"]["Metas"] == p.metas
            assert page["HTML-Metadata"]["Title"] == (" ".join(p.title.split()) if p.title else None)


# -- search


def brute_top(rows, k=5):
    q = {i: [int(np.floor(256.0 * float(np.float32(x)))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i in q:
        if i % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i)
            out += [(i, n, j, -score) for n, (score, j) in enumerate(s[:k], 1)]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "CANDIDATE_BLOCK", 40)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk_search, "CHUNK", 16)
    monkeypatch.setattr(topk_search, "HEAD", 8)
    r = np.random.default_rng(2)
    rows = [(n, (r.normal(size=12) * r.choice([0.1, 1, 4])).astype(np.float32).tolist()) for n in range(400)]
    rows += [(n, rows[3][1]) for n in range(400, 520)] + [(600, None), (601, [1.0, None]), (602, [float("nan")]), (603, [float("inf")]), (None, [1.0]), (650, []), (700, [0.5]), (750, [0.0] * 12)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as norm", "2 as floor", "3 as band")
    got = sorted(map(tuple, topk_search.top_inner_products(v, "vec_id % 50 = 0").collect()))
    assert got == brute_top(rows)
    few = v.where("vec_id in (0, 1, 2)")
    assert sorted(map(tuple, topk_search.top_inner_products(few, "vec_id % 50 = 0").collect())) == brute_top(rows[:3])
    assert topk_search.top_inner_products(v.limit(0), "vec_id % 50 = 0").count() == 0


def test_top_k_of_repeated_ids(spark, tmp_path):
    import duckdb

    r = np.random.default_rng(3)
    rows = [(int(i), r.normal(size=6).astype(np.float32).tolist()) for i in r.integers(0, 120, 400)] + [(100, [9.0] * 6), (100, [9.0] * 6), (7, [8.0] * 6), (7, [7.0] * 6), (7, [7.0] * 6)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v.toPandas().to_parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    assert sorted(map(tuple, topk_search.top_inner_products(v, "vec_id % 50 = 0").collect())) == sorted(con.execute(topk_search.ORACLE).fetchall())


# -- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    columns, before = docs.columns, docs.count()
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == columns and 0 < out.count()
        if name in ("quality classifier", "minhash near-dedup"):
            assert out.count() <= before and out.join(docs.select("doc_id"), "doc_id", "left_anti").count() == 0
        if name == "line dedup":
            assert out.count() == before and out.where("n_chars <> length(text)").count() == 0
        docs, before = out, out.count()
    last = P.STAGES[-1][1](spark, docs, sf)
    assert last.count() == before and last.where("not round_trip").count() == 0


def test_every_operator_has_a_query():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 11))


def test_pipeline_dedup_stages_against_brute_force(spark):
    import corpus_pipeline as P
    from test_dedup import brute_lines, classes

    stages = dict(P.STAGES)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    lines = {r.doc_id: r.text for r in stages["line dedup"](spark, docs, None).collect()}
    assert lines == brute_lines(rows) and lines != dict(rows)
    near = {r.doc_id: r.text for r in stages["minhash near-dedup"](spark, docs, None).collect()}
    group = classes(rows)
    assert near == {i: t for i, t in rows if group[i][1] == i} and len(near) < len(rows)


def test_pipeline_other_stages_against_their_decisions(spark):
    """The classifier's stage keeps what plain scores keep; the mixing stage's rows repeat as the report counts."""
    import corpus_pipeline as P

    sf, stages = "/root/testdata/sf0.001", dict(P.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    plain = lambda text: 1 / (1 + np.exp(model.thresholds[-1] - sum(model.weights[k] for k in quality.features(text or ""))))
    kept = {r.doc_id: r.text for r in stages["quality classifier"](spark, docs, sf).collect()}
    assert kept == {i: t for i, t in rows.items() if plain(t) >= quality.KEEP} and 0 < len(kept) < len(rows)
    mixed = stages["mixing sources"](spark, docs, sf)
    times = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert times == {r.doc_id: r.taken // r.size for r in mixing.mix_report(docs).collect() if r.taken}
    ids = stages["byte-level bpe"](spark, docs, sf).collect()
    assert all(len(r.token_ids) == r.n_tokens and hashlib.sha256(" ".join(map(str, r.token_ids)).encode()).hexdigest() == r.ids_sha256 for r in ids)


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Nulls in every column, empty and repeated rows, a very long text, extra columns; and no rows at all."""
    import corpus_pipeline as P

    schema = "doc_id long, text string, lang string, source string, n_chars long, bands string, label int"
    line = "a line of many words that says nothing new at all"
    rows = [(1, f"{line}\n" * 4, "en", "s", 9, "x", 1), (1, f"{line}\n" * 4, "en", "s", 9, "x", 1), (2, None, None, None, None, None, None), (None, "no id here", None, "s", 1, None, 2), (3, "", "en", "t", 0, "", 3)]
    rows += [(4, "word " * 200_000, "en", "s", 1_000_000, "y", 4), (2, "another text of the same id", "en", None, 1, "z", 5), (5, "\u00fc \U0001f600 \x00", "de", "t", 5, None, None)]
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for name, data in (("some", rows), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        got = P.run(spark, str(folder)).collect()
        assert all(r.round_trip and len(r.token_ids) == r.n_tokens for r in got)
        assert {r.doc_id for r in got} <= {1, 2, 3, 4, 5, None} and (len(got) > 0) == (name == "some")
