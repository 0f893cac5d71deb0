"""Exact deduplication through a cuckoo-filter index of live digests.

The filter keeps 16-bit fingerprints in buckets of four, each digest in one of
two buckets.  A miss proves that a digest is new; a hit is verified against the
content bucket (full digest and length).  Live digests can be deleted; a filter
that overflows is rebuilt at twice the size from the stored keys.

Spark runs the index twice.  Each input partition folds its own copies first,
so a text that a third of all rows share leaves each task as one row; partial
groups are then dealt by digest and folded again in digest order, where a digest
can be deleted from the index as soon as a later one arrives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RE, column, table

SLOTS = 4
#: Live digests a task holds before it hands the oldest on.
LIVE = 100_000


class Full(Exception):
    """No free slot was found after the allowed number of moves."""


class CuckooFilter:
    """Fingerprints of 32-byte digests, with insertion, lookup and deletion."""

    def __init__(self, capacity: int):
        self.buckets = 1 << max(4, (max(1, capacity) * 8 // 7 // SLOTS).bit_length())
        self.slots = np.zeros(self.buckets * SLOTS, dtype=np.uint16).tolist()
        self._turn = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        fingerprint = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:10], "little") & (self.buckets - 1)
        return fingerprint, first, self._other(first, fingerprint)

    def _other(self, bucket: int, fingerprint: int) -> int:
        return bucket ^ (fingerprint * 0x5BD1E995 & (self.buckets - 1))

    def _put(self, bucket: int, fingerprint: int) -> bool:
        for i in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not self.slots[i]:
                self.slots[i] = fingerprint
                return True
        return False

    def insert(self, digest: bytes, moves: int = 500) -> None:
        fingerprint, a, b = self._places(digest)
        if self._put(a, fingerprint) or self._put(b, fingerprint):
            return
        bucket, undo = b, []
        for _ in range(moves):
            self._turn = (self._turn + 1) % SLOTS
            at = bucket * SLOTS + self._turn
            undo.append((at, self.slots[at]))
            fingerprint, self.slots[at] = self.slots[at], fingerprint
            bucket = self._other(bucket, fingerprint)
            if self._put(bucket, fingerprint):
                return
        for at, old in reversed(undo):  # as before, so that nothing stored is lost
            self.slots[at] = old
        raise Full

    def __contains__(self, digest: bytes) -> bool:
        fingerprint, a, b = self._places(digest)
        s = self.slots
        return fingerprint in s[a * SLOTS : a * SLOTS + SLOTS] or fingerprint in s[b * SLOTS : b * SLOTS + SLOTS]

    def delete(self, digest: bytes) -> None:
        fingerprint, a, b = self._places(digest)
        for bucket in (a, b):
            for i in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.slots[i] == fingerprint:
                    self.slots[i] = 0
                    return
        raise KeyError(digest)


class DigestIndex:
    """Live digests with a value each: [smallest id or None, rows, length].

    ``false_hits`` counts filter hits that the content buckets refuted."""

    def __init__(self, capacity: int = 1024):
        self.filter = CuckooFilter(capacity)
        self.content: dict[int, dict[bytes, list]] = {}
        self.size = self.false_hits = self.resizes = 0

    def __len__(self) -> int:
        return self.size

    def _bucket(self, digest: bytes) -> int:
        return int.from_bytes(digest[10:14], "little") & 0xFFFFF

    def find(self, digest: bytes, length: int | None = None) -> list | None:
        if digest not in self.filter:
            return None
        found = self.content.get(self._bucket(digest), {}).get(digest)
        if found is None or length is not None and found[2] != length:
            self.false_hits += 1
            return None
        return found

    def insert(self, digest: bytes, value: list) -> None:
        """Add a digest that is not live."""
        self.content.setdefault(self._bucket(digest), {})[digest] = value
        self.size += 1
        try:
            self.filter.insert(digest)
        except Full:
            self._resize()

    def delete(self, digest: bytes) -> list:
        bucket = self._bucket(digest)
        value = self.content[bucket].pop(digest)
        if not self.content[bucket]:
            del self.content[bucket]
        self.filter.delete(digest)
        self.size -= 1
        return value

    def _resize(self) -> None:
        capacity = self.filter.buckets * SLOTS
        while True:
            capacity *= 2
            self.resizes += 1
            self.filter = CuckooFilter(capacity)
            try:
                for bucket in self.content.values():
                    for digest in bucket:
                        self.filter.insert(digest)
                return
            except Full:
                continue


def _fold(live: int):
    """Partial groups (digest, keep_id, rows, length) of rows of the same columns; the oldest are handed on beyond ``live``."""

    def run(batches):
        index, order = DigestIndex(), {}
        for batch in batches:
            out: list[tuple] = []
            for digest, doc, rows, length in zip(*(column(batch, c).to_pylist() for c in ("digest", "keep_id", "rows", "length"))):
                found = index.find(digest, length)
                if found is None:
                    if len(index) >= live:
                        for old in list(order)[: live // 2]:
                            del order[old]
                            out.append((old, *index.delete(old)))
                    index.insert(digest, [doc, rows, length])
                    order[digest] = True
                else:
                    found[1] += rows
                    if doc is not None and (found[0] is None or doc < found[0]):
                        found[0] = doc
            yield _groups(out)
        yield _groups([(d, *index.find(d)) for d in order])

    return run


def _groups(rows: list[tuple]) -> pa.RecordBatch:
    digest, doc, n, length = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(length, pa.int64())], names=["digest", "keep_id", "rows", "length"])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", live: int = LIVE) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    Texts are equal when they agree after every run of white space (space and
    U+0009-U+000D) becomes one space; null counts as empty.  Of a group the
    smallest doc_id stays.  Rows with a null id count in group_size and go when
    another row of the group has an id; if none has, keep_id is null and all
    stay.  Rows that repeat the id that stays are kept with it.
    """
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE_RE, " ")
    hashed = table(docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t")).select("doc_id", F.unhex(F.sha2("t", 256)).alias("digest"), F.octet_length("t").cast("long").alias("length")), "digests")
    schema = "digest binary, keep_id long, rows long, length long"
    single = hashed.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("rows"), "length")
    part = single.mapInArrow(_fold(live), schema)
    groups = part.repartition("digest").sortWithinPartitions("digest").mapInArrow(_fold(live), schema).select("digest", "keep_id", F.col("rows").alias("group_size"))
    out = hashed.select("doc_id", "digest").join(groups, "digest", "left")
    kept = F.col("keep_id").isNull() | F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256 FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
