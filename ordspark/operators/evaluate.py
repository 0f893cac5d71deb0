"""Corpus-level evaluation: gold recall, lexicon overlap, coverage, latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def gold_scores(tokens: DataFrame, by: str = "category") -> DataFrame:
    """Recall, OOV and candidate figures of ``tokens`` (sentence, form, gold,
    candidates, known, category), per category and in total (null category)."""
    found = F.array_contains("candidates", F.lower("gold"))
    n = F.size("candidates")
    t = tokens.select(by, "sentence", found.cast("int").alias("f"), (~F.col("known")).cast("int").alias("o"), n.alias("n"), F.when(found, n - 1).otherwise(n).alias("x"))
    g = t.rollup(by).agg(F.countDistinct("sentence").alias("sentences"), F.count(F.lit(1)).alias("tokens"), F.sum("f").alias("found"), F.sum("o").alias("oov"), F.sum("n").alias("candidates"), F.sum("x").alias("extra"))
    recall = _ratio(F.col("found"), F.col("tokens"))
    return g.select(
        by, "sentences", "tokens", recall.alias("recall"), (1 - recall).alias("missing_rate"), _ratio(F.col("oov"), F.col("tokens")).alias("oov_rate"), _ratio(F.col("candidates"), F.col("tokens")).alias("avg_candidates"),
        _ratio(F.col("extra"), F.col("tokens")).alias("extra_per_token"), _ratio(F.col("extra"), F.col("candidates")).alias("extra_rate"),
    )


def external_scores(gold: DataFrame, parsed: DataFrame, by: str = "category") -> DataFrame:
    """Figures of another parser, whose output is aligned with the gold tokens by
    place, per category and in total (null category).

    ``gold`` is (category, sentence, pos, form, gold), ``parsed`` is (sentence,
    pos, form, lemma) with a row of null ``pos`` for a sentence that was parsed
    without words.  A sentence without any row was not parsed: its tokens are
    out of vocabulary.  A token without a counterpart is that too; a counterpart
    of another form counts as a mismatch, and its lemma is compared all the same.
    """
    nth = lambda c: F.row_number().over(W.partitionBy("sentence").orderBy(c))
    told = parsed.groupBy("sentence").agg(F.count("pos").alias("told"))
    theirs = parsed.where("pos is not null").select("sentence", nth("pos").alias("nth"), F.col("form").alias("their_form"), F.lower("lemma").alias("lemma"))
    t = gold.select(by, "sentence", "form", F.lower("gold").alias("gold"), nth("pos").alias("nth")).join(theirs, ["sentence", "nth"], "left").join(told, "sentence", "left")
    had = F.coalesce(F.col("lemma") != "", F.lit(False))
    one = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    right = had & (F.col("lemma") == F.col("gold"))
    sentences = t.groupBy(by, "sentence").agg(
        F.count(F.lit(1)).alias("tokens"), one(right).alias("found"), one(~had).alias("oov"), one(had).alias("candidates"), one(had & ~right).alias("extra"),
        one(F.col("told").isNotNull() & (~had | (F.col("their_form") != F.col("form")))).alias("mismatches"), F.coalesce(F.max("told"), F.lit(0)).alias("told"), F.max(F.col("told").isNull().cast("long")).alias("failed"),
    )
    counts = ("tokens", "found", "oov", "candidates", "extra", "mismatches", "told", "failed")
    g = sentences.rollup(by).agg(F.count(F.lit(1)).alias("sentences"), *[F.sum(c).alias(c) for c in counts])
    recall = _ratio(F.col("found"), F.col("tokens"))
    return g.select(
        by, "sentences", "tokens", recall.alias("recall"), (1 - recall).alias("missing_rate"), _ratio(F.col("oov"), F.col("tokens")).alias("oov_rate"), _ratio(F.col("candidates"), F.col("tokens")).alias("avg_candidates"),
        _ratio(F.col("extra"), F.col("tokens")).alias("extra_per_token"), _ratio(F.col("extra"), F.col("candidates")).alias("extra_rate"), _ratio(F.col("failed"), F.col("sentences")).alias("parse_failure_rate"),
        F.col("candidates").alias("parsed_tokens"), _ratio(F.col("found"), F.col("candidates")).alias("parsed_recall"), "mismatches", F.col("told").alias("parser_tokens"),
    )


def lexicon_overlap(sentences: DataFrame, by: str = "domain") -> DataFrame:
    """Recall and precision of lemma set ``b`` against ``a`` per sentence, by
    domain and in total.  With the columns words, oov, candidates and compounds
    (of ``b``'s word tokens) also their rates."""
    told = [c for c in ("words", "oov", "candidates", "compounds") if c in sentences.columns]
    s = sentences.select(by, F.size(F.array_intersect("a", "b")).alias("o"), F.size("a").alias("na"), F.size("b").alias("nb"), *told)
    g = s.rollup(by).agg(F.count(F.lit(1)).alias("sentences"), *[F.sum(c).alias(c) for c in ("o", "na", "nb", *told)])
    rates = (
        [F.col("words").alias("word_tokens"), _ratio(F.col("oov"), F.col("words")).alias("oov_rate"), _ratio(F.col("candidates"), F.col("words")).alias("avg_candidates"), _ratio(F.col("compounds"), F.col("sentences")).alias("compounds_per_sentence")]
        if len(told) == 4
        else []
    )
    return g.select(by, "sentences", _ratio(F.col("o"), F.col("na")).alias("recall"), _ratio(F.col("o"), F.col("nb")).alias("precision"), *rates)


def coverage_by(words: DataFrame, by: str = "config") -> DataFrame:
    """(config, docs, tokens, known_tokens, coverage) of ``words`` (doc_id, word, known)."""
    g = words.groupBy(by).agg(F.countDistinct("doc_id").alias("docs"), F.count(F.lit(1)).alias("tokens"), F.sum(F.col("known").cast("int")).alias("known_tokens"))
    return g.withColumn("coverage", _ratio(F.col("known_tokens"), F.col("tokens")))


def unknown_by(words: DataFrame, by: str = "config", most: int = 100) -> DataFrame:
    """(config, unknown): up to ``most`` distinct unknown words of each config, the first by code point."""
    distinct = words.where("not known").select(by, F.lower("word").alias("word")).distinct()
    nth = F.row_number().over(W.partitionBy(by).orderBy("word"))
    first = distinct.withColumn("_n", nth).where(F.col("_n") <= most)
    return first.groupBy(by).agg(F.array_sort(F.collect_list("word")).alias("unknown"))


def unknown_words(words: DataFrame, known: DataFrame, top: int = 30) -> DataFrame:
    """(word, freq): the most frequent words that are not in ``known`` (ties by word)."""
    counted = words.groupBy(F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("freq"))
    return counted.join(known.select("word").distinct(), "word", "left_anti").orderBy(F.desc("freq"), "word").limit(top)


def latency(times: DataFrame, value: str = "value", by: str | None = None) -> DataFrame:
    """Mean, sample variance, extremes and interpolated percentiles of a measurement."""
    p = lambda q: F.percentile(value, F.lit(q))
    g = times.groupBy(by) if by else times
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance"), F.min(value).alias("least"), F.max(value).alias("most"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))
