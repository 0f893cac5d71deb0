"""Lexicon building and lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import resources as R


def parse_mark(mark: Column, word_class: Column) -> Column:
    """Struct (gcase, gender, gnumber) of a dictionary row's inflection mark.

    The case is the first of ÞGF, ÞF, NF, EF in the mark, the number FT before
    ET; the gender comes from the word class and needs a mark.
    """
    m = F.upper(F.coalesce(mark, F.lit("")))
    case = F.when(m.contains("ÞGF"), "þgf").when(m.contains("ÞF"), "þf").when(m.contains("NF"), "nf").when(m.contains("EF"), "ef")
    number = F.when(m.contains("FT"), "ft").when(m.contains("ET"), "et")
    gender = F.when((m != "") & word_class.isin(*R.GENDER_NAMES), word_class)
    return F.struct(case.alias("gcase"), gender.alias("gender"), number.alias("gnumber"))


def word_class_to_pos(word_class: Column) -> Column:
    """The two-letter word class of a source's code."""
    mapped = F.create_map(*[F.lit(x) for pair in R.WORD_CLASS_MAP.items() for x in pair])
    return F.coalesce(F.try_element_at(mapped, word_class), F.substring(word_class, 1, 2))


def dictionary_entries(rows: DataFrame, morphology: bool = True) -> DataFrame:
    """Distinct (word, lemma, pos, gcase, gender, gnumber) of dictionary rows;
    without ``morphology`` distinct (word, lemma, pos) with null features."""
    m = parse_mark(F.col("mark"), F.col("word_class"))
    feature = lambda name: (m[name] if morphology else F.lit(None).cast("string")).alias(name)
    return (
        rows.where(F.col("word_form").isNotNull() & F.col("lemma").isNotNull())
        .select(F.lower("word_form").alias("word"), F.lower("lemma").alias("lemma"), word_class_to_pos(F.col("word_class")).alias("pos"), feature("gcase"), feature("gender"), feature("gnumber"))
        .distinct()
    )


def limit_words(entries: DataFrame, unigrams: DataFrame, top_words: int | None = None, min_freq: int | None = None) -> DataFrame:
    """Entries of words of at least ``min_freq``, and of the ``top_words`` most frequent of them (ties by word)."""
    words = entries.select("word").distinct().join(unigrams, "word", "left").select("word", F.coalesce("freq", F.lit(0)).alias("freq"))
    if min_freq is not None:
        words = words.where(F.col("freq") >= min_freq)
    if top_words is not None:
        words = words.orderBy(F.desc("freq"), "word").limit(top_words)
    return entries.join(words.select("word"), "word", "left_semi")


def rank_entries(entries: DataFrame, unigrams: DataFrame) -> DataFrame:
    """The flat lexicon: readings of a word ranked by their lemma's frequency,
    then lemma, class, case, gender and number (null as '')."""
    by_lemma = unigrams.select(F.col("word").alias("lemma"), "freq")
    order = W.partitionBy("word").orderBy(F.coalesce("freq", F.lit(0)).desc(), "lemma", "pos", *[F.coalesce(c, F.lit("")) for c in ("gcase", "gender", "gnumber")])
    ranked = entries.join(by_lemma, "lemma", "left").withColumn("rank", F.row_number().over(order).cast("int"))
    return ranked.select("word", "rank", "lemma", "pos", "gcase", "gender", "gnumber")


def nest(lexicon: DataFrame) -> DataFrame:
    """One row per word with its readings by rank."""
    return lexicon.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("rank", "lemma", "pos", "gcase", "gender", "gnumber"))).alias("entries"))


def lemma_list(lexicon: DataFrame, unigrams: DataFrame | None = None) -> DataFrame:
    """Distinct lemmas; with ``unigrams`` also their frequency and place by (-freq, lemma)."""
    lemmas = lexicon.select("lemma").distinct()
    if unigrams is None:
        return lemmas
    found = lemmas.join(unigrams.withColumnRenamed("word", "lemma"), "lemma", "left").select("lemma", F.coalesce("freq", F.lit(0)).cast("long").alias("freq"))
    return found.orderBy(F.desc("freq"), "lemma")


def word_forms(lexicon: DataFrame) -> DataFrame:
    """The inverse lexicon: each lemma's forms, sorted."""
    return lexicon.groupBy("lemma").agg(F.sort_array(F.collect_set("word")).alias("forms"))


def describe(lexicon: DataFrame, bigrams: DataFrame | None = None) -> DataFrame:
    """One row of counters: lemmas, forms, entries, bigrams, morphology."""
    one = lexicon.agg(
        F.countDistinct("lemma").alias("lemmas"), F.countDistinct("word").alias("forms"), F.count(F.lit(1)).alias("entries"), F.coalesce(F.max(F.col("gcase").isNotNull()), F.lit(False)).alias("has_morphology")
    )
    n = F.lit(0).cast("long") if bigrams is None else F.col("n_bigrams")
    return (one if bigrams is None else one.join(bigrams.agg(F.count(F.lit(1)).alias("n_bigrams")))).select("lemmas", "forms", "entries", "has_morphology", n.alias("bigrams"))


# -- lookups: columns over a word and its entries array (null when the word is not known)


def lemmas_of(word: Column, entries: Column, pos: str | None = None) -> Column:
    """All candidate lemmas by rank; the lower-cased word itself if there is none."""
    read = F.coalesce(entries, F.array().cast("array<struct<rank:int,lemma:string,pos:string,gcase:string,gender:string,gnumber:string>>"))
    if pos is not None:
        read = F.filter(read, lambda e: e.pos == pos)
    found = F.array_distinct(F.transform(read, lambda e: e.lemma))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lower(word)))


def readings_of(entries: Column) -> Column:
    """Distinct (lemma, pos) by rank; empty for an unknown word."""
    found = F.array_distinct(F.transform(entries, lambda e: F.struct(e.lemma.alias("lemma"), e.pos.alias("pos"))))
    return F.coalesce(found, F.array().cast("array<struct<lemma:string,pos:string>>"))


def with_entries(words: DataFrame, nested: DataFrame, word: str = "word") -> DataFrame:
    """``words`` with the column ``entries`` of their lower-cased form, null when unknown.

    An equi-join: Spark broadcasts the lexicon only if it is below the session's
    broadcast threshold.
    """
    key = nested.select(F.col("word").alias("_form"), "entries")
    return words.join(key, F.lower(F.col(word)) == F.col("_form"), "left").drop("_form")


def bigram_freq(pairs: DataFrame, bigrams: DataFrame, w1: str = "w1", w2: str = "w2") -> DataFrame:
    """``pairs`` with ``freq``: the bigram's frequency, 0 when it is not listed."""
    known = bigrams.groupBy(F.lower("w1").alias("_a"), F.lower("w2").alias("_b")).agg(F.max("freq").alias("freq"))
    return pairs.join(known, (F.lower(w1) == F.col("_a")) & (F.lower(w2) == F.col("_b")), "left").drop("_a", "_b").withColumn("freq", F.coalesce("freq", F.lit(0)).cast("long"))
