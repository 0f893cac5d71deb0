"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame
functions only.

A document is to be taken c = target / source size times on average; floor(c)
copies are certain and the fraction is rounded.  Fractions are rounded in
pairs: word mass moves at random from one document of the pair to the other
until one of them is integral, so that expected copies stay what they were and
the source's words are preserved exactly.  Blocks of documents fold their pairs
one after the other; each block's last fractional document, its longest, goes up
a reduction tree of fan-in ``FAN`` until one is left per source.  That one takes
the nearer integer, and rounded documents of the source's first blocks, longest
first, change by one copy each to take up the words it gained or lost.  What
remains is less than the shortest of them that could still change.

Rows that repeat an id, text and source are one unit of several copies, so no
block grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD_RE, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
FAN = 64
#: Blocks of a source whose documents settle the last one's rounding.
SETTLING = 4


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n, target) from (source, source_size, n), a row per source.

    Sources by code point, null last, get the weights in turn.  They share
    ``share`` times all words by weight, none above ``most`` times its own; what
    is over goes to the others by weight.  With the sources ordered by
    most * size / weight the level that solves this is the largest of
    (words left) / (weight left).  Windows run over one row per source.
    """
    nth = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    w = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    every, before = W.partitionBy(), W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    w = w.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return w.select("source", "source_size", "n", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def _uniform(*cols: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") * F.lit(2.0**-53)


def _pair(i: Column, j: Column, seed: int) -> tuple[Column, Column]:
    """(the unit that became integral, the other) of two units (…, size, p)."""
    own, room = lambda u: u.p * u["size"], lambda u: (1 - u.p) * u["size"]
    up, down = F.least(room(i), own(j)), F.least(own(i), room(j))  # mass that can move to i, to j
    to_i = _uniform(F.lit(seed), i.h, j.h) * (up + down) < down
    i_done = F.when(to_i, room(i) <= own(j)).otherwise(own(i) <= room(j))
    end = F.when(to_i == i_done, 1.0).otherwise(0.0)
    left_i = F.when(to_i, i.p + up / i["size"]).otherwise(i.p - down / i["size"])
    left_j = F.when(to_i, j.p - up / j["size"]).otherwise(j.p + down / j["size"])
    bound = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    put = lambda u, p: u.withField("p", p)
    return F.when(i_done, put(i, end)).otherwise(put(j, end)), F.when(i_done, put(j, bound(left_j))).otherwise(put(i, bound(left_i)))


def _fold(units: Column, unit_type: str, seed: int) -> Column:
    """Struct (done: array of integral units, carry: the last one) of an array of units."""
    start = F.struct(F.array().cast(f"array<{unit_type}>").alias("done"), F.get(units, F.lit(0)).alias("carry"))

    def step(state: Column, unit: Column) -> Column:
        whole, rest = _pair(state.carry, unit, seed)
        return F.struct(F.concat(state.done, F.array(whole)).alias("done"), rest.alias("carry"))

    return F.aggregate(F.slice(units, 2, F.greatest(F.size(units) - 1, F.lit(0))), start, step)


def _settled(units: Column, words: Column, unit_type: str) -> Column:
    """``units`` (rounded, longest first) after some of them changed by one copy so
    that together they lose ``words`` words, or gain them if that is negative."""
    start = F.struct(words.cast("double").alias("left"), F.array().cast(f"array<{unit_type}>").alias("units"))

    def step(state: Column, unit: Column) -> Column:
        fits = ((state.left > 0) == (unit.p > 0.5)) & (unit["size"] <= F.abs(state.left))
        left = F.when(fits, state.left - F.signum(state.left) * unit["size"]).otherwise(state.left)
        return F.struct(left.alias("left"), F.concat(state.units, F.array(F.when(fits, unit.withField("p", 1 - unit.p)).otherwise(unit))).alias("units"))

    return F.aggregate(units, start, step, lambda state: state.units)


def grouped_copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, h, source, size, n, source_size, target, base, extra): for every
    distinct (id, text, source) its ``n`` rows, of which ``extra`` are taken
    base + 1 times and the others base times.  h is a hash of the text.

    Null texts have size 0 and get no rounded copy; a null source is a source of
    its own; null ids and repeated rows count like any others.  The result
    depends on ids, texts and sources only, so reruns agree.  Blocks hold about
    ``FAN`` units however large a source is.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_RE)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
    sized = table(rows.groupBy("doc_id", "h", "source", "size").agg(F.count(F.lit(1)).alias("n")), "sized")
    per_source = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("n"))
    goal = table(source_targets(per_source, weights, share, most).withColumn("source_id", F.xxhash64("source", F.lit("source"))), "targets")
    largest = goal.agg(F.max("n")).first()[0] or 0

    g = goal.select(F.col("source").alias("of"), "source_size", F.col("n").alias("units"), "target", "source_id")
    mean = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = sized.join(g, F.col("source").eqNullSafe(F.col("of"))).withColumn("mean", mean).withColumn("base", F.floor("mean"))
    more = F.when(F.col("size") > 0, F.col("n") * (F.col("mean") - F.col("base"))).otherwise(F.lit(0.0))  # rows that get one copy more, on average
    units = units.withColumn("more", more).withColumn("sure", F.floor("more")).withColumn("p", F.col("more") - F.col("sure"))
    row = F.struct("doc_id", "h", "source", "size", "n", "source_size", "target", "base", "sure")
    unit = F.struct((-F.col("size")).alias("order"), F.xxhash64("doc_id", "h", F.lit(seed)).alias("h"), F.col("size").cast("double").alias("size"), "p", row.alias("row"))
    block = F.pmod(F.xxhash64("doc_id", "h", F.lit(seed + 1)), F.ceil(F.col("units") / FAN))
    units = units.select(F.col("source_id").alias("s"), block.alias("block"), unit.alias("u"))
    kind = next(f for f in units.schema if f.name == "u").dataType.simpleString()

    done = [units.where("u.p <= 0").select("u")]
    still = units.where("u.p > 0")
    first, level, n_blocks = None, 0, -(-largest // FAN)
    while True:
        folded = still.groupBy("s", "block").agg(F.sort_array(F.collect_list("u")).alias("us")).select("s", "block", _fold(F.col("us"), kind, seed + 2 + level).alias("x"))
        folded = table(folded.select("s", "block", "x.done", "x.carry"), f"level{level}")
        if first is None:
            first = folded
        else:
            done.append(folded.select(F.explode("done").alias("u")))
        if n_blocks <= 1:
            break
        still = folded.select("s", F.floor(F.col("block") / FAN).alias("block"), F.col("carry").alias("u"))
        level, n_blocks = level + 1, -(-n_blocks // FAN)
    nearest = F.round(F.col("carry.p"))
    done.append(folded.select(F.col("carry").withField("p", nearest).alias("u")))
    gained = folded.select("s", ((nearest - F.col("carry.p")) * F.col("carry.size")).alias("words"))
    settling = first.where(F.col("block") < SETTLING).groupBy("s").agg(F.sort_array(F.flatten(F.collect_list("done"))).alias("us")).join(gained, "s")
    done.append(settling.select(F.explode(_settled(F.col("us"), F.col("words"), kind)).alias("u")))
    done.append(first.where(F.col("block") >= SETTLING).select(F.explode("done").alias("u")))
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    r = "u.row"
    extra = (F.col(f"{r}.sure") + F.col("u.p").cast("long")).alias("extra")
    return out.select(*[f"{r}.{c}" for c in ("doc_id", "h", "source", "size", "n", "source_size", "target", "base")], extra)


def copies(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, h, source, size, source_size, target, copies) for every row of ``docs``, by ``grouped_copies``."""
    one = F.transform(F.sequence(F.lit(1).cast("long"), F.col("n")), lambda nth: F.col("base") + (nth <= F.col("extra")).cast("long"))
    return grouped_copies(docs, **options).select("doc_id", "h", "source", "size", "source_size", "target", F.explode(one).alias("copies"))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken): words taken are copies times size."""
    return copies(docs, **options).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed table: each row of ``docs`` as often as it is taken, columns as
    they were.  Of rows that repeat an id, text and source the first by their
    other columns are taken once more."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keys = ["id", "h", "s"]
    key = lambda i, h, s: (F.coalesce(i, F.lit((1 << 63) - 1)).alias("id"), h.alias("h"), F.xxhash64(s, F.lit("source")).alias("s"))
    taken = grouped_copies(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options).select(*key(F.col("doc_id"), F.col("h"), F.col("source")), "n", "base", "extra")
    rows = docs.select(*key(F.col(id_col).cast("long"), F.xxhash64(text_col), F.col(source_col).cast("string")), row.alias("row"))
    # the join leaves rows dealt and sorted by the window's keys
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(F.when(F.col("n") > 1, F.to_json("row"))))
    numbered = rows.join(taken, keys).withColumn("nth", nth)
    out = numbered.select("row", (F.col("base") + (F.col("nth") <= F.col("extra")).cast("long")).alias("copies")).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")
