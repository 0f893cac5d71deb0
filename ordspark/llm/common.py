"""Helpers shared by the training-data operators: scratch tables, whole-column
Arrow access and word/shingle hashing over raw UTF-8 bytes."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes that separate words in the contracts of this subpackage.
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: The same as a regular expression (Java, Python and RE2 agree on it).
WORD_RE = r"[^\x20\x09-\x0D]+"
SPACE_RE = r"[\x20\x09-\x0D]+"


# --------------------------------------------------------------------------
# scratch tables


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, one per application.

    Taken from ``spark.checkpoint.dir``.  Only a local-mode session without
    that setting (tests, benches) gets a temporary folder; a cluster without it
    is an error, because executors could not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="ordspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/ordspark-{spark.sparkContext.applicationId}"
    if path not in _CLEANED:
        _CLEANED.add(path)
        atexit.register(_remove, spark, path)
    return path


_CLEANED: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may already be stopped; the folder is then left to the cluster's cleaning
        pass


def table(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared scratch folder and read it
    back: lineage is cut, and a lost executor costs a re-read only."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# --------------------------------------------------------------------------
# what a Python worker remembers between tasks

_kept: dict = {}
_owner = ""


def release(owner: str) -> None:
    """Forget what other operators left in this worker: it is used again by
    later stages, and must hold one operator's tables at a time."""
    global _owner
    if _owner != owner:
        _kept.clear()
        _owner = owner
        gc.collect()
        trim()


def trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


def keep(owner: str, key, make):
    """The owner's value of ``key``, made once per worker and kept until another operator runs in it."""
    release(owner)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


# --------------------------------------------------------------------------
# Arrow access


def byte_rows(col):
    """(data, offsets) of a string/binary Arrow array: uint8 view and int64
    offsets of length n+1.  Nulls read as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], dtype=np.int64 if large else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data, offs


def slices(batches, rows: int = 256):
    """The batches in pieces of at most so many rows (an empty batch stays one)."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)


def column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


# --------------------------------------------------------------------------
# hashing

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)
_IS_SEP = np.zeros(256, dtype=bool)
_IS_SEP[list(SEPARATORS)] = True
_BASE = 0x9E3779B97F4A7C15
_CHUNK = 1 << 20
#: Multipliers of the words of a shingle.
_PLACE = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
_pow = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _pow
    if len(_pow) < n:
        base = np.full(max(n, 1024), _BASE, dtype=np.uint64)
        base[0] = 1
        full = np.cumprod(base, dtype=np.uint64)
        if n > 1 << 20:
            return full
        _pow = full
    return _pow


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of the texts ``data[offs[i]:offs[i+1]]``, A-Z
    lower-cased, and the offsets of each text's words."""
    lo, hi = int(offs[0]), int(offs[-1])
    block = data[lo:hi]
    inside = ~_IS_SEP[block]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offs[:-1][offs[:-1] < hi] - lo
    begins[edges] = inside[edges]  # a text's first byte starts a word even right after another text
    at = np.flatnonzero(inside)
    first = np.flatnonzero(begins[at])
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    lens = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, lens)
    vals = _LOWER[block[at]] * _powers(int(lens.max()))[place]
    words = mix(np.add.reduceat(vals, first))
    return words, np.searchsorted(at[first], offs - lo)


def text_blocks(offs: np.ndarray, most: int = _CHUNK):
    """Ranges of texts of about ``most`` bytes together (one text at least)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = j


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = 5):
    """For each text the sorted distinct hashes of its k-word shingles.  Fewer
    words: the whole sequence is the only shingle.  No words: empty."""
    for i, j in text_blocks(offs):
        for s, _ in _block_sets(data, offs[i : j + 1], k):
            yield s


def keyed_sets(data: np.ndarray, offs: np.ndarray, k: int = 5):
    """(shingle set, 128-bit key of the word sequence) of each text."""
    for i, j in text_blocks(offs):
        yield from _block_sets(data, offs[i : j + 1], k, keys=True)


def _block_sets(data, offs, k, keys=False):
    words, at = word_hashes(data, offs)
    n = len(words)
    with np.errstate(over="ignore"):
        roll = np.full(max(0, n - k + 1), k, dtype=np.uint64)
        for j in range(k):
            roll = roll * np.uint64(_BASE) + words[j : n - k + 1 + j] * _PLACE[j % len(_PLACE)]
        roll = mix(roll)
        counts = np.diff(at)
        if keys:
            place = np.arange(1, n + 1, dtype=np.uint64) - np.repeat(at[:-1], counts).astype(np.uint64)
            pad = np.zeros(1, np.uint64)
            a = np.append(np.cumsum(mix(words + place * np.uint64(_BASE)), dtype=np.uint64), pad)
            b = np.append(np.cumsum(mix((words ^ np.uint64(0xA0761D6478BD642F)) + place * np.uint64(0xE7037ED1A0B428DB)), dtype=np.uint64), pad)
            a, b = (np.concatenate((pad, x[:-1])) for x in (a, b))
            ka = (mix(a[at[1:]] - a[at[:-1]] + counts.astype(np.uint64))).view(np.int64).tolist()
            kb = (mix(b[at[1:]] - b[at[:-1]])).view(np.int64).tolist()
        for d, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            m = e - s
            if m >= k:
                x = np.sort(roll[s : e - k + 1])
                if len(x) > 1:
                    x = x[np.append(True, x[1:] != x[:-1])]
            elif m:
                v = np.full(1, m, dtype=np.uint64)
                for j in range(m):
                    v = v * np.uint64(_BASE) + words[s + j : s + j + 1] * _PLACE[j % len(_PLACE)]
                x = mix(v)
            else:
                x = words[:0]
            yield x, ((ka[d], kb[d]) if keys else None)
