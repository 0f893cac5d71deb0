"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One vector of weights over hashed text features is shared by all grades, and
ordered thresholds cut its score: P(grade >= j) = sigmoid(score - threshold_j).
From these come the expected grade and the probability of the top grade, by
which documents are selected.

Grades are made of ``labels``: 0 for toxic, 1 for low quality, 2 for neither.
The model is fitted on at most ``SAMPLE`` labelled documents, those whose ids
have the smallest hashes; everything else reads all documents and whole texts.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, release
from .pretokens import Memo

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 6_000
DIMENSIONS = 1 << 18
#: Features seen in fewer fitted documents have no weight.
LEAST = 4
GRADES = 3
#: Words whose features a task remembers, in each of two generations.
REMEMBERED = 150_000
#: A document is kept if its top grade is at least this likely.
KEEP = 0.4

_EDGE = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")
_MARKS = regex.compile(r"([^\p{L}\p{N}\s])\1+")


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) & (DIMENSIONS - 1)


def _word(word: str) -> tuple[tuple[int, ...], tuple[str, ...]]:
    """(slots of a word's own features, shapes it counts for)."""
    core = _EDGE.sub("", word).lower()
    slots = (_slot(f"w:{core}"), *(_slot(f"p:{core[:k]}") for k in (4, 5, 6, 7) if len(core) > k)) if len(core) > 2 else ()
    shapes = []
    if not core:
        shapes.append("mark")
    elif word.isupper() and len(core) > 1:
        shapes.append("upper")
    if core and any(c.isdigit() for c in core):
        shapes.append("digit")
    if m := _MARKS.search(word):
        shapes.append("run")
        shapes.append(f"run{m[1]}")
    if "://" in word or "@" in word:
        shapes.append("link")
    return slots, tuple(shapes)


def features(text: str, words: Memo | None = None) -> set[int]:
    """Hashed features of a whole text: words, word beginnings, and logarithmic
    shares of shapes, repeated words and adjacent equal words."""
    look = (Memo(_word) if words is None else words).__getitem__
    tokens = text.split()
    n = len(tokens)
    if not n:
        return {_slot("empty")}
    out: set[int] = set()
    shape: Counter = Counter()
    counts = Counter(tokens)
    for token, k in counts.items():
        slots, shapes = look(token)
        out.update(slots)
        for s in shapes:
            shape[s] += k
    again = sum(map(str.__eq__, tokens, tokens[1:]))
    for name, k in (*shape.items(), ("again", again)):
        if k * 32 >= n:
            out.add(_slot(f"s:{name}:{int(math.log2(32 * k / n))}"))
    out.add(_slot(f"distinct:{int(-2 * math.log2(len(counts) / n))}"))
    out.add(_slot(f"top:{int(-math.log2(max(counts.values()) / n))}"))
    out.add(_slot(f"length:{min(8, n.bit_length())}"))
    return out


@dataclass
class Model:
    weights: np.ndarray
    #: Ascending; thresholds[j] separates grade j from j + 1.
    thresholds: np.ndarray

    def tails(self, score: float) -> list[float]:
        """P(grade >= 1), P(grade >= 2), ..."""
        return [1.0 / (1.0 + math.exp(min(50.0, max(-50.0, t - score)))) for t in self.thresholds]


def likelihood(scores: np.ndarray, thresholds: np.ndarray, grades: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of the grades, and its gradients by the rows' scores and by the thresholds.

    A row's likelihood is P(grade >= g) - P(grade >= g + 1).
    """
    n, last = len(grades), len(thresholds)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    cuts = np.concatenate(([-np.inf], thresholds, [np.inf]))
    upper, lower = np.where(grades > 0, sigmoid(scores - cuts[grades]), 1.0), np.where(grades < last, sigmoid(scores - cuts[grades + 1]), 0.0)
    p = np.maximum(upper - lower, 1e-9)
    du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
    by_threshold = np.array([du[grades == j + 1].sum() - dl[grades == j].sum() for j in range(last)]) / n
    return -float(np.log(p).mean()), (dl - du) / n, by_threshold


def fit(slots: list[np.ndarray], grades: np.ndarray, rounds: int = 400, rate: float = 0.2, penalty: float = 1e-3) -> Model | None:
    """Cumulative-logit likelihood with an L1 penalty, by proximal AdaGrad over
    all rows.  Every 50 rounds the features that have no weight then leave.
    None if fewer than two grades occur."""
    grades = np.asarray(grades, dtype=np.int64)
    if len(np.unique(grades)) < 2:
        return None
    n = len(grades)
    rows = np.repeat(np.arange(n), [len(s) for s in slots])
    cols = np.concatenate(slots).astype(np.int64)
    names, cols, seen = np.unique(cols, return_inverse=True, return_counts=True)
    keep = seen >= LEAST
    w = np.zeros(len(names))
    g2 = np.full(len(names), 1e-8)

    def narrowed():
        nonlocal names, rows, cols, w, g2
        at, new = keep[cols], np.cumsum(keep) - 1
        rows, cols, names, w, g2 = rows[at], new[cols[at]], names[keep], w[keep], g2[keep]

    narrowed()
    share = np.array([(grades > j).mean() for j in range(GRADES - 1)]).clip(1e-3, 1 - 1e-3)
    t = -np.log(share / (1 - share))
    t = np.maximum.accumulate(t + np.arange(GRADES - 1) * 1e-3)
    t2 = np.full(GRADES - 1, 1e-8)
    for nth in range(1, rounds + 1):
        _, by_score, gt = likelihood(np.bincount(rows, w[cols], minlength=n), t, grades)
        gw = np.bincount(cols, by_score[rows], minlength=len(names))
        g2 += gw**2
        t2 += gt**2
        step = rate / np.sqrt(g2)
        w = w - step * gw
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        t = np.maximum.accumulate(t - rate / np.sqrt(t2) * gt)
        if nth % 50 == 0:
            keep = w != 0
            narrowed()
    weights = np.zeros(DIMENSIONS)
    weights[names] = w
    return Model(weights, t)


def _features_of(batches):
    release("quality")
    words = Memo(_word, REMEMBERED)
    for batch in batches:
        slots = [sorted(features(x.as_py() or "", words)) for x in column(batch, "text")]
        yield pa.RecordBatch.from_arrays([column(batch, "grade"), pa.array(slots, pa.list_(pa.int32()))], names=["grade", "slots"])


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of a label table: the worst of an id's labels; rows without an id or any label are left out."""
    grade = F.when(F.max(F.coalesce("toxic", F.lit(0))) > 0, 0).when(F.min(F.coalesce("quality", F.lit(1))) < 1, 1).otherwise(2)
    return labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(grade.alias("grade"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """A model of at most ``sample`` labelled documents, one row each, which
    bounds what is broadcast and collected.  Of rows that repeat an id the
    smallest text counts."""
    chosen = graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("grade").alias("grade"))
    found = rows.select("text", "grade").mapInArrow(_features_of, "grade int, slots array<int>").toArrow()
    slots = [np.asarray(x.values) for x in found.column("slots").combine_chunks()] if len(found) else []
    return fit(slots, found.column("grade").to_numpy()) if slots else None


def score(docs: DataFrame, model: Model | None, keep: float = KEEP, text_col: str = "text") -> DataFrame:
    """``docs`` with expected_grade, p_top and kept (they replace columns of these
    names).  Null texts are empty texts.  Without a model (fewer than two grades
    among the labels) every row is kept and the two figures are null."""
    out = ["expected_grade", "p_top", "kept"]
    base = docs.drop(*out)
    if model is None:
        return base.select("*", F.lit(None).cast("double").alias(out[0]), F.lit(None).cast("double").alias(out[1]), F.lit(True).alias(out[2]))
    at = np.flatnonzero(model.weights)
    shared = docs.sparkSession.sparkContext.broadcast((dict(zip(at.tolist(), model.weights[at].tolist())), model.thresholds))
    schema = base.select("*", F.lit(0.0).cast("double").alias(out[0]), F.lit(0.0).cast("double").alias(out[1]), F.lit(True).alias(out[2])).schema

    def run(batches):
        release("quality")
        weights, thresholds = shared.value
        m = Model(np.zeros(0), thresholds)

        def known(word):  # only what has a weight matters
            slots, shapes = _word(word)
            return tuple(s for s in slots if s in weights), shapes

        words = Memo(known, REMEMBERED)
        for batch in batches:
            expected, top = [], []
            for cell in column(batch, text_col):
                tails = m.tails(sum(weights.get(s, 0.0) for s in sorted(features(cell.as_py() or "", words))))
                expected.append(sum(tails))
                top.append(tails[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(expected, pa.float64()), pa.array(top, pa.float64()), pa.array([p >= keep for p in top], pa.bool_())], names=[*batch.schema.names, *out])

    return base.mapInArrow(run, schema)
