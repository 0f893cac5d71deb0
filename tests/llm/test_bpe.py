"""Codec and token counts against the public libraries."""

import hashlib
import random

import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ordspark.llm.bpe_codec import Codec, Transducer, Utf8Machine, codec_digests, decode_ids, encode_texts, read_ranks
from ordspark.llm.pretokens import PATTERN, narrow
from ordspark.llm.token_counts import PairMerger, token_counts

RANKS = P.path("byte_bpe_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")
SOURCE = open(RANKS, "rb").read()
CODEC = Codec(SOURCE)
ENC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(SOURCE), special_tokens={})
MERGER = PairMerger(open(JSON, "rb").read())
LIB = Tokenizer.from_file(JSON)

EDGES = ["", " ", "\n\n  x", "it's we'll I'm", "a" * 5000, "ab" * 3000 + " " * 999, "éè中\U0001f600" * 40, "\x00\x1c\x85  x", "<|endoftext|> a<|endoftext|><|endo", "1234567890 $$$ %%%"]
TEXT = st.text(alphabet=st.one_of(st.sampled_from(list("abcdehinorst '.,!\n\t 019")), st.characters(blacklist_categories=("Cs",))), max_size=60)


@pytest.mark.parametrize("text", EDGES)
def test_edges(text):
    assert CODEC.encode(text) == ENC.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode(text)) == text
    assert MERGER.count(text) == len(LIB.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_random(text):
    assert CODEC.encode(text) == ENC.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode(text)) == text
    assert MERGER.count(text) == len(LIB.encode(text, add_special_tokens=False).ids)


def test_small_memory_gives_the_same_ids():
    small = Codec(SOURCE)
    small.transducer.most = 40
    text = "The quick brown fox jumps over thirteen lazy dogs " * 5 + "x" * 300 + "antidisestablishmentarianism"
    assert small.encode(text) == ENC.encode_ordinary(text)


@pytest.mark.parametrize("unit", ["a", "ab", "thequickbrownfox", "qzjxkvbp", None])
def test_lookahead_is_bounded(unit):
    """What configurations hold back on a piece of 1 MB is less than the longest token's bytes."""
    r = random.Random(1)
    piece = (unit * 2**20)[: 2**20] if unit else "".join(r.choices("etaoinshrdlu", k=2**20))
    t = Transducer(read_ranks(SOURCE))
    ids = t.encode(piece.encode())
    assert b"".join(map(t.spelled.__getitem__, ids)) == piece.encode()
    assert max(len(held) for s in t.states.values() for _, _, held in s.configurations) < max(map(len, t.ranks))
    assert t.encode(piece[:400].encode()) == tuple(ENC.encode_ordinary(piece[:400]))


def test_split_by_either_engine():
    assert narrow(PATTERN) is not None and narrow(r"\p{Lu}+|.") is None and narrow(r"\p{L}++") is None and narrow(r"(?i:x)") is None
    text = "".join(chr(c) + " x" for c in range(0x10000) if not 0xD800 <= c < 0xE000)
    assert narrow(PATTERN).findall(text) == regex.findall(PATTERN, text)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=30), st.integers(1, 5))
def test_utf8_machine(text, step):
    data, m = text.encode("utf-8", "surrogatepass") if not any("\ud800" <= c <= "\udfff" for c in text) else b"", Utf8Machine()
    out = "".join(m.feed(data[i : i + step]) for i in range(0, len(data), step)) + m.finish()
    assert out == data.decode()


def test_tables(spark):
    rows = [(1, "Hello wörld"), (2, None), (None, ""), (1, "Hello wörld"), (3, "x" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'e' as n_tokens", "'f' as `token ids`")
    got = sorted(codec_digests(docs, RANKS).collect(), key=str)
    want = []
    for i, t in rows:
        ids = ENC.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), True))
    assert got == sorted(want, key=str) or sorted(map(tuple, got), key=str) == sorted(want, key=str)
    with_ids = codec_digests(docs, RANKS, ids=True).collect()
    assert sorted(((r.doc_id, r.token_ids) for r in with_ids), key=str) == sorted(((i, ENC.encode_ordinary(t or "")) for i, t in rows), key=str)
    assert codec_digests(docs.limit(0), RANKS, ids=True).count() == 0
    counts = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, JSON).collect()}
    assert (2, 0, 0, False) in counts and (1, 12, len(ENC.encode_ordinary("Hello wörld")), False) in counts
    assert {r.over_limit for r in token_counts(docs, JSON, limit=10).where("doc_id = 3").collect()} == {True}
    back = decode_ids(encode_texts(docs.select("doc_id", "text"), RANKS), RANKS)
    assert sorted(map(str, back.select("doc_id", "text").collect())) == sorted(map(str, docs.fillna("", "text").select("doc_id", "text").collect()))
    assert codec_digests(docs.limit(0), RANKS).count() == 0 and token_counts(docs.limit(0), JSON).count() == 0


def test_ids_leave_in_small_batches(spark, monkeypatch):
    """A batch of many rows is not held together with the ids of all of them."""
    import pyarrow as pa

    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    runs = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: runs.append(run))
    codec_digests(docs, RANKS, ids=True)
    texts = [f"row {i}" if i % 7 else None for i in range(2001)]
    got = list(runs[0](iter([pa.RecordBatch.from_arrays([pa.array(range(2001)), pa.array(texts)], names=["doc_id", "text"])])))
    assert max(b.num_rows for b in got) <= 256
    told = pa.Table.from_batches(got).to_pylist()
    assert [r["doc_id"] for r in told] == list(range(2001)) and [r["token_ids"] for r in told] == [ENC.encode_ordinary(t or "") for t in texts]
