"""Near-duplicate detection by one-permutation MinHash.

1. Every text becomes its set of distinct five-word shingles.  One hash
   permutation is cut into ``BINS`` bins; the smallest hash of each bin is the
   signature, and empty bins borrow from a hashed sequence of other bins
   (optimal densification, Shrivastava 2017).
2. ``BANDS`` bands of ``BINS / BANDS`` rows give bucket keys.  Equal texts are
   folded into one representative before banding.
3. Each bucket links its members to its smallest one: a star, so candidate
   edges grow with the number of (document, band) rows and not with the square
   of a bucket.  A 512-slot sketch drops edges that are far below the
   threshold; the others are confirmed on the full shingle sets.
4. Stars alone can miss a link between two members that both differ from the
   centre.  Buckets whose members still have different components are therefore
   compared in blocks: members outside the bucket's largest component against
   all others, each pair in the first band where it meets, by sketch and then
   on full sets.  Blocks emit only links that join components, so what they
   emit grows with the members and not with the pairs.  No bucket is capped.

A pair at similarity 0.75 shares no bucket with probability
(1 - 0.75**4)**32 = 5e-6, and lies below the sketch's cut by five standard
deviations of its estimate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_rows, column, keyed_sets, mix, release, shingle_sets, table
from .components import components

BINS = 128
BANDS = 32
SLOTS = 512
#: Sketch estimates below this are not confirmed on full sets.
SURE = 0.64
#: Unions of so few occupied slots are always confirmed.
SMALL = 24
#: Documents on one side of a block of comparisons.
BLOCK = 256
#: Pairs of a hub whose texts are confirmed together.
CELL = 64
#: Bytes of a document's sketch, and of its band keys (32 bits each) behind it.
SKETCH = SLOTS // 2
MARK = SKETCH + 4 * BANDS

_EDGES = (np.arange(BINS, dtype=np.uint64) << np.uint64(64 - 7))
_SLOT_EDGES = (np.arange(SLOTS, dtype=np.uint64) << np.uint64(64 - 9))
_probes: dict[int, np.ndarray] = {}


def _probe(width: int) -> np.ndarray:
    """Bins that an empty bin asks, in order; the same for every text."""
    if width not in _probes:
        with np.errstate(over="ignore"):
            cell = np.arange(BINS, dtype=np.uint64)[:, None] * np.uint64(1 << 32) + np.arange(1, width + 1, dtype=np.uint64)[None, :]
            _probes[width] = (mix(cell) % np.uint64(BINS)).astype(np.int64)
    return _probes[width]


def signature(s: np.ndarray) -> np.ndarray:
    """Densified one-permutation signature of a sorted, non-empty hash set."""
    at = np.searchsorted(s, _EDGES)
    end = np.append(at[1:], len(s))
    full = at < end
    sig = np.zeros(BINS, dtype=np.uint64)
    sig[full] = s[at[full]]
    empty = np.flatnonzero(~full)
    for width in (32, 2048):
        if not len(empty):
            break
        asked = _probe(width)[empty]
        hit = full[asked]
        found = hit.any(axis=1)
        sig[empty[found]] = sig[asked[found, hit[found].argmax(axis=1)]]
        empty = empty[~found]
    if len(empty):
        sig[empty] = sig[np.flatnonzero(full)[0]]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, BINS // BANDS)
    with np.errstate(over="ignore"):
        key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for j in range(rows.shape[1]):
            key = mix(key ^ (rows[:, j] * np.uint64(0xD6E8FEB86659FD93)))
    return key.view(np.int64)


def sketch(s: np.ndarray) -> np.ndarray:
    """512 slots of four bits: 0 if the slot is empty, else 1 + hash of its minimum mod 15."""
    at = np.searchsorted(s, _SLOT_EDGES)
    end = np.append(at[1:], len(s))
    full = at < end
    out = np.zeros(SLOTS, dtype=np.uint8)
    out[full] = (s[at[full]] & np.uint64(0xFFFF)) % np.uint64(15) + np.uint64(1)
    return out[::2] << 4 | out[1::2]


_ZEROS = np.array([(v >> 4 == 0) + (v & 15 == 0) for v in range(256)], dtype=np.uint8)


def likely(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sketches (rows of uint8) can belong to sets of the threshold's similarity."""
    blank = _ZEROS[a | b].sum(axis=1, dtype=np.int32)
    same = _ZEROS[a ^ b].sum(axis=1, dtype=np.int32) - blank
    used = SLOTS - blank
    est = (same / np.maximum(used, 1) - 1 / 15) * (15 / 14)
    return (used <= SMALL) | (est >= SURE)


_SIGNED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("t", T.LongType()),
        T.StructField("k1", T.LongType()),
        T.StructField("k2", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("sketch", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)


def _sign(batches):
    release("minhash")
    for batch in batches:
        data, offs = byte_rows(column(batch, "text"))
        n = len(batch)
        k1, k2, size, sk, bands = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), [b""] * n, np.zeros((n, BANDS), np.int64)
        for i, (s, key) in enumerate(keyed_sets(data, offs)):
            size[i] = len(s)
            if len(s):
                k1[i], k2[i] = key
                bands[i] = band_keys(signature(s))
                sk[i] = sketch(s).tobytes() + bands[i].astype("<i4").tobytes()
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands.reshape(-1)))
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "t"), pa.array(k1), pa.array(k2), pa.array(size), pa.array(sk, pa.binary()), lists], names=[f.name for f in _SIGNED])


def _likely_edges(batches):
    for batch in batches:
        side = [_rows_of(column(batch, c), MARK)[:, :SKETCH] for c in ("sa", "sb")]
        yield batch.filter(pa.array(likely(*side))).select(["a", "b"])


def _rows_of(col, width):
    data, offs = byte_rows(col)
    return data[offs[0] : offs[-1]].reshape(-1, width)


def _compare_blocks(batches):
    """Rows sorted by cell: the links that join components within each cell."""
    release("minhash")
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        cell = held.column("cell").to_numpy()
        cut = int(np.argmax(cell == cell[-1])) if len(cell) else 0  # the last cell may go on in the next batch
        if cut:
            yield _compare(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None and len(held):
        yield _compare(held)


def _compare(t: pa.Table) -> pa.RecordBatch:
    """Pairs of a cell with different labels that meet in this band first,
    tested until their labels are connected."""
    cell, doc, label, side, band = (t.column(c).to_numpy() for c in ("cell", "doc", "label", "side", "band"))
    marks = _rows_of(t.column("sketch"), MARK)
    sk, keys = marks[:, :SKETCH], np.ascontiguousarray(marks[:, SKETCH:]).view("<i4")
    data, offs = byte_rows(t.column("text"))
    sets: dict[int, np.ndarray] = {}
    root: dict[int, int] = {}

    def find(x):
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    def full(i):
        if i not in sets:
            sets[i] = next(shingle_sets(data, offs[i : i + 2]))
        return sets[i]

    out, step = [], 0
    while True:
        step += 1
        i = np.flatnonzero(cell[:-step] == cell[step:]) if step < len(cell) else np.zeros(0, int)
        if not len(i):
            break
        i = i[(label[i] != label[i + step]) & ((side[i] < 0) | (side[i] != side[i + step]))]
        for k in range(0, len(i), 8192):
            x = i[k : k + 8192]
            x = x[(keys[x] == keys[x + step]).argmax(axis=1) == band[x]]
            for a in x[likely(sk[x], sk[x + step])].tolist():
                b = a + step
                la, lb = find(int(label[a])), find(int(label[b]))
                if la != lb and similar(full(a), full(b)):
                    root[la] = lb
                    out.append((int(doc[a]), int(doc[b])))
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])


def _confirm(batches):
    """Rows sorted by cell, a cell's texts before its pairs.  Yields the pairs
    that are similar on full sets, without those that earlier ones of the cell
    connect already."""
    release("minhash")
    now, sets, root = None, {}, {}

    def find(x):
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    for batch in batches:
        cell, a = column(batch, "cell").to_pylist(), column(batch, "a").to_pylist()
        b = column(batch, "b").to_pylist()
        data, offs = byte_rows(column(batch, "text"))
        held = shingle_sets(data, offs)
        out = []
        for c, x, y, s in zip(cell, a, b, held):
            if c != now:
                now, sets, root = c, {}, {}
            if y is None:
                sets[x] = s
            elif x in sets and y in sets and (rx := find(x)) != (ry := find(y)) and similar(sets[x], sets[y]):
                root[rx] = ry
                out.append((x, y))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    if 100 * min(len(x), len(y)) < 75 * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= 75 * (len(x) + len(y) - both)


def _confirmed(pairs: DataFrame, texts: DataFrame, hub: str) -> DataFrame:
    """Pairs (hub, a, b) that hold on full sets.  A hub's pairs are dealt into
    cells of about CELL documents on either side, and each cell gets every
    text it needs once."""
    sizes = pairs.groupBy(hub).agg(F.approx_count_distinct("a").alias("na"), F.approx_count_distinct("b").alias("nb"))
    # only hubs of more than one cell, one row for every CELL pairs at most: pairs of the others do not move
    wide = table(sizes.where((F.col("na") > CELL) | (F.col("nb") > CELL)), "wide")
    part = lambda x, n: F.pmod(F.xxhash64(x), F.coalesce(F.ceil(F.col(n) / CELL), F.lit(1)))
    cells = pairs.join(wide, hub, "left").select(F.xxhash64(F.col(hub), part("a", "na"), part("b", "nb")).alias("cell"), "a", "b")
    cells = table(cells, "cells")
    needed = cells.select("cell", F.col("a").alias("doc")).union(cells.select("cell", F.col("b").alias("doc"))).distinct()
    sent = needed.join(texts, "doc").select("cell", F.col("doc").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    both = sent.union(cells.select("cell", "a", "b", F.lit(None).cast("string")))
    return both.repartition("cell").sortWithinPartitions("cell", F.col("b").asc_nulls_first()).mapInArrow(_confirm, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Null and word-less texts have n_shingles 0, link with nothing and are their
    own component.  Rows with a null id take no part: component_id is null and
    they are kept.  Rows that repeat an id are one document if their words are
    the same, and documents of their own otherwise.  Other columns, whatever
    their names, are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    signed = table(base.mapInArrow(_sign, _SIGNED), "signed")
    worded = signed.where("doc_id is not null and n_shingles > 0")
    least = worded.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "t", "sketch", "bands")).alias("r"))
    reps = table(least.select("k1", "k2", F.col("r.doc_id").alias("rep"), "r.t", "r.sketch", "r.bands"), "reps")
    names = reps.select("rep", "t", F.col("rep").alias("doc"))
    # a node is a word sequence, named by its smallest id; where an id names several, they are told apart by their keys
    repeated = not worded.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    if repeated:
        several = reps.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rep", F.lit(True).alias("several"))
        reps = reps.join(several, "rep", "left").withColumn("id", F.col("rep"))
        reps = reps.withColumn("rep", F.when(F.col("several"), F.xxhash64("k1", "k2", F.lit("node"))).otherwise(F.col("rep"))).drop("several")
        reps = table(reps, "nodes")
        names = reps.select(F.col("id").alias("rep"), "t", F.col("rep").alias("doc"))

    rows = reps.select("rep", F.posexplode("bands").alias("band", "bucket"))
    shared = rows.groupBy("bucket").agg(F.min("rep").alias("centre"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    members = table(rows.join(shared, "bucket").select("bucket", "band", "centre", "rep"), "members")

    sketches = reps.select(F.col("rep").alias("doc"), "sketch")
    star = members.where("rep != centre").select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct()
    star = star.join(sketches.select(F.col("doc").alias("a"), F.col("sketch").alias("sa")), "a").join(sketches.select(F.col("doc").alias("b"), F.col("sketch").alias("sb")), "b")
    star = table(star.mapInArrow(_likely_edges, "a long, b long"), "star")

    # texts of the documents that share a bucket; what follows reads no other text
    active = names.join(members.select(F.col("rep").alias("doc")).distinct(), "doc").select(F.col("rep").alias("doc_id"), "t", "doc")
    texts = base.join(active, ["doc_id", "t"]).select("doc", "text")
    texts = table(texts.groupBy("doc").agg(F.min("text").alias("text")) if repeated else texts, "texts")

    links = table(_confirmed(star.select("a", "b", F.col("b").alias("hub")), texts, "hub"), "links")
    label = components(links)

    # the rest: buckets that still hold several components
    tagged = members.join(label.select(F.col("node").alias("rep"), "label"), "rep", "left").select("bucket", "band", F.col("rep").alias("doc"), F.coalesce("label", "rep").alias("label"))
    tagged = table(tagged, "tagged")
    split = (
        tagged.groupBy("bucket", "label")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("all"), F.max(F.struct("n", "label")).alias("main"))
        .where("labels > 1")
        .select("bucket", F.col("main.label").alias("main"), F.ceil(F.col("main.n") / (2 * BLOCK)).cast("int").alias("n_main"), F.ceil((F.col("all") - F.col("main.n")) / (2 * BLOCK)).cast("int").alias("n_rest"))
    )
    left = tagged.join(split, "bucket").withColumn("part", F.pmod(F.xxhash64("doc"), F.when(F.col("label") == F.col("main"), F.col("n_main")).otherwise(F.col("n_rest"))).cast("int"))
    cell = lambda kind, x, y, side: F.struct(F.xxhash64("bucket", F.lit(kind), x, y).alias("cell"), side.cast("int").alias("side"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # cell (0, r, p): the rest's block r against the main component's block p, and against itself where p is 0
    of_main = F.transform(upto("n_rest"), lambda r: cell(0, r, F.col("part"), F.lit(1)))
    of_rest = F.transform(upto("n_main"), lambda p: cell(0, F.col("part"), p, F.when(p == 0, -1).otherwise(0)))
    # cell (1, r, q): two blocks of the rest
    across = F.transform(F.filter(upto("n_rest"), lambda q: q != F.col("part")), lambda q: cell(1, F.least("part", q), F.greatest("part", q), F.when(F.col("part") < q, 2).otherwise(3)))
    left = left.select("doc", "label", "band", F.explode(F.when(F.col("label") == F.col("main"), of_main).otherwise(F.concat(of_rest, across))).alias("x")).select("x.cell", "x.side", "doc", "label", "band")
    left = left.join(sketches, "doc").join(texts, "doc").select("cell", "side", "doc", "label", "band", "sketch", "text").repartition("cell").sortWithinPartitions("cell")
    more = table(left.mapInArrow(_compare_blocks, "a long, b long"), "more")

    label = table(components(links.union(more)), "label")
    own = reps.join(label.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    if repeated:  # a label may be a key: the component's smallest id instead
        own = own.join(own.groupBy("label").agg(F.min("id").alias("least")), "label").withColumn("label", F.col("least"))
    named = own.select(F.lit(True).alias("linked"), "k1", "k2", "label")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    # rows without words or id match nothing, and are dealt by their ids instead of meeting in one task
    out = signed.select("doc_id", "n_shingles", linked.alias("linked"), F.when(linked, F.col("k1")).otherwise(F.xxhash64("doc_id", "t")).alias("k1"), "k2")
    out = out.join(named, ["linked", "k1", "k2"], "left").withColumn("own", F.coalesce("label", "doc_id"))
    return out.select("doc_id", "n_shingles", F.col("own").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("own"), F.lit(True)).alias("kept"))
