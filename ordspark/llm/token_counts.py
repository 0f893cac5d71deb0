"""Token counts by heap-and-linked-list byte-pair merging.

A piece starts as a doubly linked list of its bytes.  A heap holds the adjacent
pairs that have a merge, by rank and position; the lowest is popped, merged, and
the two new neighbours are pushed.  Stale heap entries are recognised by the
symbols they were pushed for.  The count is the number of bytes less the number
of merges: no token identifier is looked up or emitted.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, keep
from .pretokens import Memo, splitter

LIMIT = 1024


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabulary files: printable Latin-1
    characters stand for themselves, the other bytes for U+0100 and up."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class PairMerger:
    """Counts tokens of texts by the merges of a byte-level vocabulary file (JSON)."""

    def __init__(self, source: bytes | str):
        spec = json.loads(source)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"]:
            raise ValueError("a plain byte-level BPE vocabulary is expected")
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.ranks = {tuple(map(raw, m.split(" ") if isinstance(m, str) else m)): i for i, m in enumerate(spec["model"]["merges"])}
        special = [t["content"] for t in spec["added_tokens"]]
        #: the library's default: strings of added tokens inside a text count as one token each
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.split = splitter()
        self.counts = Memo(lambda piece: self.count_piece(piece.encode()))

    def count_piece(self, piece: bytes) -> int:
        n = len(piece)
        if n < 2:
            return n
        ranks = self.ranks
        symbol: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (r := ranks.get((symbol[i], symbol[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != left or j < 0 or symbol[j] != right:
                continue  # one of the two has been merged since
            merges += 1
            symbol[i], symbol[j] = left + right, None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get((symbol[i], symbol[k]))) is not None:
                    heapq.heappush(heap, (r, i, symbol[i], symbol[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((symbol[h], symbol[i]))) is not None:
                heapq.heappush(heap, (r, h, symbol[h], symbol[i]))
        return n - merges

    def count(self, text: str) -> int:
        look = self.counts.__getitem__
        total = 0
        spans = [text]
        if self.special and (hits := len(self.special.findall(text))):
            spans, total = self.special.split(text), hits
        for span in spans:
            for pieces in self.split(span):
                total += sum(map(look, pieces))
        return total


def _merger(source: bytes) -> PairMerger:
    return keep("counts", hashlib.sha256(source).hexdigest(), lambda: PairMerger(source))


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    ``vocabulary`` is the path of a byte-level BPE file; the driver reads it and
    broadcasts its bytes (a fixed file of a few MB).  Null texts are empty: 0
    bytes, 0 tokens.  Null ids and repeated rows pass through.  Texts of any
    length are counted whole.  No shuffle.
    """
    with open(vocabulary, "rb") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        count = _merger(source.value).count
        for batch in batches:
            n = pa.array([count(t.as_py()) if t.is_valid else 0 for t in column(batch, "text")], pa.int64())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "n_bytes"), n], names=["doc_id", "n_bytes", "n_tokens"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
