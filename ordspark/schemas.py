"""Schemas of the library's tables."""

from __future__ import annotations

from pyspark.sql import types as T

ENTRY = T.StructType([T.StructField(n, T.IntegerType() if n == "rank" else T.StringType()) for n in ("rank", "lemma", "pos", "gcase", "gender", "gnumber")])
#: One row per word form and reading; ``rank`` orders a word's readings.
LEXICON = T.StructType([T.StructField("word", T.StringType()), *ENTRY.fields])
#: One row per word form, so that a lookup never fans out.
LEXICON_NESTED = T.StructType([T.StructField("word", T.StringType()), T.StructField("entries", T.ArrayType(ENTRY))])
UNIGRAMS = T.StructType([T.StructField("word", T.StringType()), T.StructField("freq", T.LongType())])
BIGRAMS = T.StructType([T.StructField("w1", T.StringType()), T.StructField("w2", T.StringType()), T.StructField("freq", T.LongType())])
#: Rows of a dictionary file.
DICTIONARY = T.StructType([T.StructField(n, T.StringType()) for n in ("lemma", "bin_id", "word_class", "domain", "word_form", "mark")])
GOLD = T.StructType(
    [
        T.StructField("docId", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("sentenceIndex", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("tokens", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("form", "lemma", "pos")]))),
    ]
)
SAMPLED = T.StructType([T.StructField(n, T.StringType()) for n in ("config", "uuid", "text")])
