"""Lemmas of words, with fallbacks for words the lexicon does not list.

Everything works on distinct lower-cased words and is joined back to tokens:
frequent words cost one lookup, and joins on words have no hot keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import resources as R
from ..session import materialize
from .lexicon import lemmas_of, readings_of, with_entries

STRINGS = "array<string>"
#: Words shorter than this are not stripped, nor stripped again; stems shorter than LEAST_STEM do not count.
LEAST_WORD = 4
LEAST_STEM = 2


def only_itself(word: Column, lemmas: Column) -> Column:
    """Whether the word's single lemma is the word: true for unknown words and for base forms."""
    return (F.size(lemmas) == 1) & (F.get(lemmas, F.lit(0)) == F.lower(word))


def _round(words: DataFrame, nested: DataFrame, suffixes: Sequence[str], least_stem: int) -> DataFrame:
    """(word, current, first, at, hit): of ``current``'s stems the first one in
    suffix order, and the first that is known by another lemma with its lemmas."""
    tried = F.array(*[F.when(F.col("current").endswith(s) & (F.length("current") - len(s) >= least_stem), F.struct(F.lit(i).alias("at"), F.expr(f"left(current, length(current) - {len(s)})").alias("stem"))) for i, s in enumerate(suffixes)])
    stems = words.select("word", "current", F.explode(F.filter(tried, lambda x: x.isNotNull())).alias("s")).select("word", "current", "s.at", "s.stem")
    looked = with_entries(stems, nested, "stem").withColumn("lemmas", lemmas_of(F.col("stem"), F.col("entries")))
    hit = F.when(~only_itself(F.col("stem"), F.col("lemmas")), F.struct("at", "lemmas"))
    first = F.when(only_itself(F.col("stem"), F.col("lemmas")), F.struct("at", "stem"))
    return looked.groupBy("word", "current").agg(F.min(first).alias("first"), F.min(hit).alias("hit"))


def suffix_fallback(words: DataFrame, nested: DataFrame, suffixes: Sequence[str] = R.UNKNOWN_SUFFIXES, rounds: int = 2, least_word: int = LEAST_WORD, least_stem: int = LEAST_STEM, keep_stems: bool = True) -> DataFrame:
    """(word, fallback) of words of at least ``least_word`` letters that some stripping helps.

    Each round takes the first suffix whose stem the lexicon knows by a lemma
    other than the stem itself; otherwise the first stem is kept as a candidate
    and, if it is long enough, stripped in the next round.
    """
    open_ = words.select("word", F.col("word").alias("current"), F.array().cast(STRINGS).alias("stems"))
    open_ = open_.where(F.length("word") >= least_word)
    done = None
    for nth in range(rounds):
        found = _round(open_.select("word", "current"), nested, suffixes, least_stem).join(open_, ["word", "current"])
        earlier = F.col("first").isNotNull() & (F.col("hit").isNull() | (F.col("first.at") < F.col("hit.at")))
        stems = F.when(earlier, F.concat("stems", F.array("first.stem"))).otherwise(F.col("stems")) if keep_stems else F.col("stems")
        found = materialize(found.select("word", F.col("first.stem").alias("next"), F.col("hit.lemmas").alias("lemmas"), stems.alias("stems")), "stems")
        ends = F.col("lemmas").isNotNull() | F.col("next").isNull() | (F.length("next") < least_word) | F.lit(nth == rounds - 1)
        part = found.where(ends).select("word", F.array_distinct(F.concat("stems", F.coalesce("lemmas", F.array().cast(STRINGS)))).alias("fallback"))
        done = part if done is None else done.union(part)
        # words that no suffix fits in a later round keep the stems of the rounds before
        carried = found.where(~ends).select("word", F.col("next").alias("current"), "stems")
        if nth + 1 < rounds:
            fits = carried.where(F.col("current").rlike(f"(?:{'|'.join(suffixes)})$"))
            fits_enough = [F.col("current").endswith(s) & (F.length("current") - len(s) >= least_stem) for s in suffixes]
            some = fits_enough[0]
            for c in fits_enough[1:]:
                some = some | c
            done = done.union(carried.where(~some).select("word", F.array_distinct("stems").alias("fallback")))
            open_ = fits.where(some)
    return done.where(F.size("fallback") > 0)


def word_lemmas(words: DataFrame, nested: DataFrame, strip: bool = True, **options) -> DataFrame:
    """(word, entries, readings, known, lemmas) of distinct lower-cased words.

    Unknown words get themselves, followed by what ``suffix_fallback`` finds.
    """
    base = with_entries(words.select("word").distinct(), nested).select("word", "entries", F.col("entries").isNotNull().alias("known"), lemmas_of(F.col("word"), F.col("entries")).alias("own"))
    if strip:
        base = materialize(base, "looked")
        more = suffix_fallback(base.where("not known").select("word"), nested, **options)
        base = base.join(more, "word", "left").withColumn("lemmas", F.when(F.col("fallback").isNotNull(), F.array_distinct(F.concat("own", "fallback"))).otherwise(F.col("own")))
    else:
        base = base.withColumn("lemmas", F.col("own"))
    return base.select("word", "entries", readings_of(F.col("entries")).alias("readings"), "known", "lemmas")


def hyphen_parts(looked: DataFrame, nested: DataFrame, strip: bool = True) -> DataFrame:
    """(word, lemmas) of words with a hyphen whose only lemma is the word: the
    word, then the lemmas of its parts in order."""
    parts = (
        looked.where(only_itself(F.col("word"), F.col("lemmas")) & F.col("word").contains("-"))
        .select(F.col("word").alias("whole"), F.posexplode(F.split("word", "-")).alias("at", "word"))
        .where("word <> ''")
    )
    found = parts.join(word_lemmas(parts.select("word"), nested, strip).select("word", "lemmas"), "word")
    merged = found.groupBy("whole").agg(F.array_sort(F.collect_list(F.struct("at", "lemmas"))).alias("p"))
    lemmas = F.array_distinct(F.concat(F.array("whole"), F.flatten(F.transform("p", lambda x: x.lemmas))))
    return merged.select(F.col("whole").alias("word"), lemmas.alias("lemmas"))
