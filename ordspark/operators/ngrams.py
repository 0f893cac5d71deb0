"""N-gram tables from texts or from frequency lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def valid_word(word: Column, single_letters_only: bool = False) -> Column:
    """Not empty, not markup; single characters must be letters if asked."""
    ok = word.isNotNull() & (word != "") & ~word.rlike(r"^[\[<]")
    return ok & ((F.length(word) > 1) | word.rlike(r"^\p{L}$")) if single_letters_only else ok


def unigrams_from_words(words: DataFrame, least: int = 5, word: str = "word") -> DataFrame:
    """(word, freq) by lower-cased word, of at least ``least``."""
    return words.where(valid_word(F.col(word))).groupBy(F.lower(word).alias("word")).agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= least)


def merge_unigrams(counts: DataFrame, least: int = 5) -> DataFrame:
    """(word, freq) of a frequency list: rows below ``least`` go, casings merge by their maximum."""
    return counts.where(valid_word(F.col("word")) & (F.col("freq") >= least)).groupBy(F.lower("word").alias("word")).agg(F.max("freq").alias("freq"))


def pairs_of(words: DataFrame, doc: str = "doc_id", pos: str = "pos", word: str = "word") -> DataFrame:
    """(w1, w2) of neighbours within a document."""
    nxt = F.lead(word).over(W.partitionBy(doc).orderBy(pos))
    return words.select(F.col(word).alias("w1"), nxt.alias("w2")).where(F.col("w2").isNotNull())


def pairs_in(words: Column) -> Column:
    """Array of (w1, w2): the neighbours in an array of words."""
    rest = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.zip_with(F.slice(words, 1, F.size(rest)), rest, lambda x, y: F.struct(x.alias("w1"), y.alias("w2")))


def pairs_of_texts(docs: DataFrame, words: Column) -> DataFrame:
    """(w1, w2) of neighbours in each row's array of words: no shuffle."""
    return docs.select(words.alias("ws")).select(F.explode(pairs_in(F.col("ws"))).alias("p")).select("p.w1", "p.w2")


def bigrams_from_words(words: DataFrame, least: int = 50, successors: int | None = 500, **columns) -> DataFrame:
    """``count_bigrams`` of a table of one word a row."""
    return count_bigrams(pairs_of(words, **columns), least, successors)


def count_bigrams(pairs: DataFrame, least: int = 50, successors: int | None = 500) -> DataFrame:
    """(w1, w2, freq): at least ``least``, the ``successors`` most frequent of each first word (ties by word).

    Counted with partial aggregation; the window below ranks distinct pairs,
    which Spark cuts to the group limit before they are shuffled.
    """
    valid = valid_word(F.col("w1"), True) & valid_word(F.col("w2"), True)
    counted = pairs.where(valid).groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= least)
    if successors is None:
        return counted
    nth = F.row_number().over(W.partitionBy("w1").orderBy(F.desc("freq"), "w2"))
    return counted.withColumn("_n", nth).where(F.col("_n") <= successors).drop("_n")


def by_frequency(ngrams: DataFrame) -> DataFrame:
    """N-grams in the order of a frequency list: most frequent first, ties by their words."""
    return ngrams.orderBy(F.desc("freq"), *[c for c in ngrams.columns if c != "freq"])


def merge_bigrams(bigrams: DataFrame) -> DataFrame:
    """Lower-cased bigrams; casings of a pair merge by their maximum."""
    return bigrams.groupBy(F.lower("w1").alias("w1"), F.lower("w2").alias("w2")).agg(F.max("freq").alias("freq"))
