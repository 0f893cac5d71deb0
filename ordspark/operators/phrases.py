"""Multi-word phrases: longest match of two to four words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import resources as R


def phrase_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(R.PHRASES), "phrase string, lemma string, is_stopword boolean, pos string")


def phrase_info(phrase: Column) -> Column:
    """Struct (lemma, is_stopword, pos) of a phrase of the table, whatever its case; null for any other."""
    table = F.create_map(*[x for p, lemma, stop, pos in R.PHRASES for x in (F.lit(p), F.struct(F.lit(lemma).alias("lemma"), F.lit(stop).alias("is_stopword"), F.lit(pos).alias("pos")))])
    return F.try_element_at(table, F.lower(phrase))


def is_known_phrase(phrase: Column) -> Column:
    """Whether the table has the phrase; false for null."""
    return phrase_info(phrase).isNotNull()


def match_phrases(words: DataFrame, phrases: DataFrame, longest: int = 4, doc: str = "doc_id", pos: str = "pos", word: str = "word") -> DataFrame:
    """``match_in_texts`` of a table of one word a row: a document's words are
    gathered first, so it is for documents that fit a task."""
    rows = words.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), F.col(word).alias("word")))).alias("ws"))
    found = match_in_texts(rows.select(doc, F.transform("ws", lambda w: w.word).alias("words"), F.transform("ws", lambda w: w.pos).alias("at")), phrases, longest, doc)
    return found.select(doc, F.get("at", F.col("pos")).alias(pos), "words", "phrase", "lemma", "is_stopword")


def match_in_texts(docs: DataFrame, phrases: DataFrame, longest: int = 4, doc: str = "doc_id") -> DataFrame:
    """(doc_id, …, pos, words, phrase, lemma, is_stopword) of the longest phrase
    that starts at each element of the array ``words``.

    Runs of two to ``longest`` words are cut in the row and joined with the phrases.
    """
    kept = [c for c in docs.columns if c != "words"]
    low = F.transform("words", lambda w: F.lower(w))
    rows = docs.select(*kept, low.alias("_w"))
    run = lambda i: F.transform(F.sequence(F.lit(2), F.least(F.lit(longest), F.size("_w") - i)), lambda n: F.struct(i.alias("pos"), n.alias("words"), F.array_join(F.slice("_w", i + 1, n), " ").alias("phrase")))
    runs = F.flatten(F.transform(F.sequence(F.lit(0), F.size("_w") - 2), run))
    cut = rows.where(F.size("_w") >= 2).select(*kept, F.explode(runs).alias("g")).select(*kept, "g.*")
    hit = cut.join(phrases.select("phrase", "lemma", "is_stopword"), "phrase")
    best = hit.groupBy(*kept, "pos").agg(F.max(F.struct("words", "phrase", "lemma", "is_stopword")).alias("b"))
    return best.select(*kept, "pos", "b.words", "b.phrase", "b.lemma", "b.is_stopword")
