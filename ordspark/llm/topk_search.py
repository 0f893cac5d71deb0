"""Exact top-k by integer inner product, over candidates sorted by length.

Components become floor(256 x).  All vectors are rotated into the right singular
basis of the whole table (the eigenvectors of the summed outer products), which
puts most of a product into its first coordinates.  Candidates are dealt into
blocks of similar length, and each block is read by descending length: a query
leaves a block, or never enters it, once |q| times the length still to come is
below its k-th best score; otherwise the product of the leading coordinates plus
the product of the residual lengths bounds the score from above
(Cauchy-Schwarz), and only pairs whose bound reaches the k-th best score are
multiplied out, in integers.  The k-th best score starts from the longest
``HEAD`` candidates, which every query sees first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import column, table

HEAD = 1024
QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 8192
CHUNK = 1024
#: Blocks hold lengths within a factor of 2**(1/BANDS_PER_OCTAVE).
BANDS_PER_OCTAVE = 16


def _matrix(col) -> np.ndarray:
    """Rows of little-endian int64 vectors, shorter ones padded with zeros."""
    rows = [np.frombuffer(v, dtype="<i8") for v in (col.to_pylist() if hasattr(col, "to_pylist") else col)]
    width = max(map(len, rows), default=0)
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def _quantise(batches):
    for batch in batches:
        ids, vectors, norms = [], [], []
        for i, v in zip(column(batch, "vec_id").to_pylist(), column(batch, "embedding")):
            if i is None or not v.is_valid:
                continue
            values = v.values
            if values.null_count:
                continue
            x = np.asarray(values.to_numpy(zero_copy_only=False), dtype=np.float64)
            if not np.isfinite(x).all():
                continue
            q = np.clip(np.floor(256.0 * x), -(2.0**52), 2.0**52).astype("<i8")
            ids.append(i)
            vectors.append(q.tobytes())
            norms.append(float(np.sqrt((q.astype(np.float64) ** 2).sum())))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.binary()), pa.array(norms, pa.float64())], names=["vec_id", "vector", "norm"])


def _outer_sums(batches):
    total = np.zeros((0, 0))
    for batch in batches:
        m = _matrix(column(batch, "vector")).astype(np.float64)
        d = max(total.shape[0], m.shape[1])
        grown = np.zeros((d, d))
        grown[: total.shape[0], : total.shape[0]] = total
        grown[: m.shape[1], : m.shape[1]] += m.T @ m
        total = grown
    d = total.shape[0]
    at = np.arange(d * d)
    yield pa.RecordBatch.from_arrays([pa.array(at // max(d, 1)), pa.array(at % max(d, 1)), pa.array(total.reshape(-1))], names=["i", "j", "v"])


def rotation(vectors: DataFrame) -> np.ndarray:
    """Right singular vectors of all rows, by descending singular value (d x d;
    what the driver receives depends on the dimension alone)."""
    cells = vectors.select("vector").mapInArrow(_outer_sums, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    d = 1 + max((c.i for c in cells), default=-1)
    m = np.zeros((d, d))
    for c in cells:
        m[c.i, c.j] = c.v
    values, basis = np.linalg.eigh(m) if d else (np.zeros(0), m)
    return np.ascontiguousarray(basis[:, ::-1])


def _wide(m: np.ndarray, d: int) -> np.ndarray:
    return m if m.shape[1] == d else np.pad(m, ((0, 0), (0, d - m.shape[1])))


def _best(qi, ids, scores, k):
    """Indices of the k best rows of each query: highest score, then smallest id."""
    order = np.lexsort((ids, -scores, qi))
    q = qi[order]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, int)
    nth = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[nth < k], order[nth == k - 1]


def search_block(basis, lead, q_ids, q, floor, c_ids, c, k):
    """(query index, candidate id, score) of the k best candidates of the block
    whose score reaches the query's floor."""
    d = basis.shape[0]
    q, c = _wide(q, d), _wide(c, d)
    qr, cr = q @ basis, c @ basis
    q_len, c_len = np.sqrt((qr**2).sum(1)), np.sqrt((cr**2).sum(1))
    order = np.argsort(-c_len, kind="stable")
    c, cr, c_ids, c_len = c[order], cr[order], c_ids[order], c_len[order]
    q_rest, c_rest = np.sqrt((qr[:, lead:] ** 2).sum(1)), np.sqrt((cr[:, lead:] ** 2).sum(1))
    slack = 0.25 + 1e-9 * (q_len * (c_len[0] if len(c_len) else 0))
    floor = floor.copy()
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    for s in range(0, len(c), CHUNK):
        here = slice(s, s + CHUNK)
        live = np.flatnonzero(q_len * c_len[s] + slack >= floor)
        if not len(live):
            break
        got = [best]
        for b in range(0, len(live), 256):
            rows = live[b : b + 256]
            bound = qr[rows, :lead] @ cr[here, :lead].T + np.outer(q_rest[rows], c_rest[here])
            x, y = np.nonzero(bound + slack[rows, None] >= floor[rows, None])
            for p in range(0, len(x), 100_000):
                qx, cy = rows[x[p : p + 100_000]], s + y[p : p + 100_000]
                score = np.einsum("ij,ij->i", q[qx], c[cy])
                ok = (score >= floor[qx]) & (c_ids[cy] != q_ids[qx])
                got.append((qx[ok], c_ids[cy[ok]], score[ok]))
        best = tuple(np.concatenate(z) for z in zip(*got))
        kept, kth = _best(*best, k)
        floor[best[0][kth]] = np.maximum(floor[best[0][kth]], best[2][kth])
        best = tuple(z[kept] for z in best)
    return best


def top_inner_products(vectors: DataFrame, queries, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner
    products with every other vector, ties to the smaller vec_id.

    ``queries`` is a condition on ``vec_id`` that names the query rows.  Vectors
    that are null or hold null or non-finite components, and rows without an id,
    take no part.  Every row of a repeated id is a candidate of all other ids,
    and the rows of a repeated query id share its k places.
    Shorter vectors are padded with zeros.  Components up to 2**20 in size give
    exact scores.  A query with fewer candidates gets them all.
    """
    spark = vectors.sparkSession
    typed = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    all_ = table(typed.mapInArrow(_quantise, "vec_id long, vector binary, norm double"), "vectors")
    basis = rotation(all_)
    d = basis.shape[0]
    if not d:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    lead = max(1, d // 4)
    head_rows = all_.orderBy(F.desc("norm"), "vec_id").limit(HEAD).collect()
    head = (np.array([r.vec_id for r in head_rows], dtype=np.int64), _wide(_matrix([bytes(r.vector) for r in head_rows]), d))
    shared = spark.sparkContext.broadcast((basis, lead, head))  # d x d and HEAD x d numbers

    def first_floor(batches):
        basis, lead, (ids, m) = shared.value
        for batch in batches:
            q_ids, q = column(batch, "vec_id").to_numpy(), _wide(_matrix(column(batch, "vector")), len(basis))
            scores = q @ m.T
            scores = np.where(ids[None, :] == q_ids[:, None], np.iinfo(np.int64).min, scores)
            kth = np.sort(scores, axis=1)[:, -k].astype(np.float64) if len(ids) >= k else np.full(len(q), -np.inf)
            kth[kth < -(2.0**62)] = -np.inf
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kth)], names=[*batch.schema.names, "floor"])

    asked = table(all_.where(queries).mapInArrow(first_floor, "vec_id long, vector binary, norm double, floor double"), "queries")
    band = F.floor(F.log2(F.col("norm") + 1) * BANDS_PER_OCTAVE).cast("int")
    banded = all_.withColumn("band", band)
    # one row per length band: at most BANDS_PER_OCTAVE for each power of two, whatever the table holds
    bands = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest")).withColumn("parts", F.ceil(F.col("n") / CANDIDATE_BLOCK).cast("int"))
    listed = bands.select("band", "longest", "parts").collect()
    open_to = F.array(*[F.struct(F.lit(b.band).alias("band"), F.lit(b.longest).alias("longest"), F.lit(b.parts).alias("parts")) for b in listed])
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    q_block = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int").alias("q")
    of_query = (
        asked.select(q_block, "vec_id", "vector", "floor", F.explode(F.filter(open_to, lambda b: F.col("norm") * b.longest * (1 + 1e-9) + 1 >= F.col("floor"))).alias("b"))
        .select("q", "b.band", F.explode(F.sequence(F.lit(0), F.col("b.parts") - 1)).alias("part"), "vec_id", "vector", "floor")
    )
    # blocks that some query opens; candidates go nowhere else
    opened = table(of_query.select("q", "band").distinct(), "opened")
    of_candidate = (
        banded.join(F.broadcast(bands), "band")
        .select("band", F.pmod(F.xxhash64("vec_id", "vector", F.lit(1)), F.col("parts")).cast("int").alias("part"), "vec_id", "vector")
        .join(opened, "band")
        .select("q", "band", "part", "vec_id", "vector", F.lit(None).cast("double").alias("floor"))
    )

    def run(t: pa.Table) -> pa.Table:
        basis, lead, _ = shared.value
        is_query = t.column("floor").is_valid()
        qs, cs = t.filter(is_query), t.filter(pa.compute.invert(is_query))
        if not len(qs) or not len(cs):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        q_ids = qs.column("vec_id").to_numpy()
        qi, ids, scores = search_block(basis, lead, q_ids, _matrix(qs.column("vector")), qs.column("floor").to_numpy().copy(), cs.column("vec_id").to_numpy(), _matrix(cs.column("vector")), k)
        return pa.table({"query_id": pa.array(q_ids[qi]), "vec_id": pa.array(ids), "score": pa.array(scores)})

    found = of_query.union(of_candidate).groupBy("q", "band", "part").applyInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""
