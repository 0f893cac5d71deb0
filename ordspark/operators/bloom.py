"""Bloom-filter membership over bitmaps.

The exact semi-join is the default way to test for known lemmas; this is the
probabilistic one, with the usual size formulas and double hashing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Bytes of a filter that is broadcast, at most.
SENT = 64 << 20


def size_for(n: int, p: float = 0.01, most_hashes: int | None = None) -> tuple[int, int]:
    """(bits, hashes) for n members and false-positive rate p."""
    bits = max(1, math.ceil(-max(1, n) * math.log(p) / math.log(2) ** 2))
    hashes = max(1, round(bits / max(1, n) * math.log(2)))
    return bits, min(hashes, most_hashes) if most_hashes else hashes


def positions(word: Column, bits: int, hashes: int) -> Column:
    low = F.lower(word)
    h1, h2 = F.pmod(F.xxhash64(low), F.lit(bits)), F.pmod(F.xxhash64(F.lit("second"), low), F.lit(bits))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(h1 + i * h2, F.lit(bits)))


def build(members: DataFrame, bits: int, hashes: int, word: str = "word") -> DataFrame:
    """(bucket, bitmap): the filter's bits as bitmaps of 4 KB, or'ed together before they move."""
    at = members.select(F.explode(positions(F.col(word), bits, hashes)).alias("bit"))
    return at.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))


def might_contain(words: DataFrame, filter_bits: DataFrame, bits: int, hashes: int, word: str = "word") -> DataFrame:
    """``words`` with ``maybe``: false only for words that were not members, null for null.

    A filter of at most ``SENT`` bytes is sent to every task as one row, and the
    words do not move; a larger one is joined by bucket.
    """
    if bits // 8 <= SENT:
        one = filter_bits.agg(F.map_from_entries(F.collect_list(F.struct("bucket", "bitmap"))).alias("_filter"))
        in_all = F.forall(positions(F.col(word), bits, hashes), lambda at: _is_set(F.try_element_at("_filter", F.bitmap_bucket_number(at)), at))
        return words.join(F.broadcast(one)).withColumn("maybe", in_all).drop("_filter")
    distinct = words.select(word).distinct()
    asked = distinct.select(word, F.explode(F.array_distinct(positions(F.col(word), bits, hashes))).alias("_bit")).withColumn("bucket", F.bitmap_bucket_number("_bit"))
    hits = asked.join(filter_bits, "bucket", "left").groupBy(word).agg(F.min(_is_set(F.col("bitmap"), F.col("_bit"))).alias("maybe"))
    return words.join(hits, word, "left")


def _is_set(bitmap: Column, at: Column) -> Column:
    """Whether a bitmap has the bit; false without a bitmap."""
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1, F.lit(False))
