"""Queries on fixtures: what the operators give for a small dictionary whose
words have several readings.  Their SQL is the result, typed by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.tokenize import normal_form, normalize_token, tokenize
from .operators import compounds, disambiguate, evaluate, lexicon, ngrams, search, stopwords
from .plans import pipeline
from .queries import query
from .schemas import LEXICON

#: (word, rank, lemma, class, case, gender, number)
ROWS = (
    ("hestur", 1, "hestur", "no", "nf", "kk", "et"),
    ("hestinum", 1, "hestur", "no", "þgf", "kk", "et"),
    ("barn", 1, "barn", "no", "nf", "hk", "et"),
    ("börnin", 1, "barn", "no", "nf", "hk", "ft"),
    ("bíl", 1, "bíll", "no", "þf", "kk", "et"),
    ("borðinu", 1, "borð", "no", "þgf", "hk", "et"),
    ("borgar", 1, "borg", "no", "ef", "kvk", "et"),
    ("fundar", 1, "fundur", "no", "ef", "kk", "et"),
    ("fundar", 2, "funda", "so", None, None, None),
    ("fóru", 1, "fara", "so", None, None, None),
    ("fóru", 2, "fóra", "no", "þf", "kvk", "et"),
    ("húsnæði", 1, "húsnæði", "no", "nf", "hk", "et"),
    ("lán", 1, "lán", "no", "nf", "hk", "et"),
    ("simon", 1, "simon", "no", None, None, None),
    ("stjóri", 1, "stjóri", "no", "nf", "kk", "et"),
    ("til", 1, "til", "fs", None, None, None),
    ("við", 1, "við", "fs", None, None, None),
    ("við", 2, "við", "fn", None, None, None),
    ("á", 1, "á", "fs", None, None, None),
    ("á", 2, "eiga", "so", None, None, None),
    ("á", 3, "á", "no", None, None, None),
    ("ég", 1, "ég", "fn", "nf", None, "et"),
    ("úr", 1, "úr", "fs", None, None, None),
    ("úr", 2, "úr", "no", "nf", "hk", "et"),
)
BIGRAMS = (("Fara", "barn", 100), ("fara", "Barn", 40), ("fóra", "barn", 10), ("barn", "fóra", 500))
COMPOUNDS = "struct<parts:array<string>,index_terms:array<string>,confidence:double>"


def _lexicon(spark) -> DataFrame:
    return spark.createDataFrame(list(ROWS), LEXICON)


def _bigrams(spark) -> DataFrame:
    return spark.createDataFrame(list(BIGRAMS), "w1 string, w2 string, freq long")


def _texts(spark, *texts: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id int, text string")


def _words(spark, *words: str) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "word string")


def _joined(array) -> F.Column:
    return F.array_join(array, " ")


@query("""SELECT * FROM (VALUES
  ('Á', 'á eiga', 'eiga', 'á/fs eiga/so á/no', 'á:fs::: eiga:so::: á:no:::'),
  ('fundar', 'fundur funda', 'funda', 'fundur/no funda/so', 'fundur:no:ef:kk:et funda:so:::'),
  ('BÖRNIN', 'barn', 'börnin', 'barn/no', 'barn:no:nf:hk:ft'),
  ('óþekkt', 'óþekkt', 'óþekkt', '', '')) AS t(word, lemmas, verbs, readings, morph)""")
def golden_lookup(spark, sf):
    """All lemmas, those of verbs, readings with class, and readings with morphology."""
    t = lexicon.with_entries(_words(spark, "Á", "fundar", "BÖRNIN", "óþekkt"), lexicon.nest(_lexicon(spark)))
    low, entries = F.lower("word"), F.col("entries")
    readings = F.transform(lexicon.readings_of(entries), lambda r: F.concat_ws("/", r.lemma, r.pos))
    part = lambda c: F.coalesce(c, F.lit(""))
    morph = F.transform(entries, lambda e: F.concat_ws(":", e.lemma, e.pos, part(e.gcase), part(e.gender), part(e.gnumber)))
    return t.select("word", _joined(lexicon.lemmas_of(low, entries)).alias("lemmas"), _joined(lexicon.lemmas_of(low, entries, "so")).alias("verbs"), _joined(readings).alias("readings"), F.coalesce(_joined(morph), F.lit("")).alias("morph"))


@query("SELECT * FROM (VALUES ('FARA', 'barn', 100::BIGINT), ('barn', 'Fóra', 500), ('barn', 'fara', 0)) AS t(w1, w2, freq)")
def golden_bigram_freq(spark, sf):
    """Frequencies of pairs, whatever their case; 0 for pairs that are not listed."""
    pairs = spark.createDataFrame([("FARA", "barn"), ("barn", "Fóra"), ("barn", "fara")], "w1 string, w2 string")
    return lexicon.bigram_freq(pairs, _bigrams(spark))


@query("SELECT 19::BIGINT AS lemmas, 18::BIGINT AS forms, 24::BIGINT AS entries, true AS has_morphology, 4::BIGINT AS bigrams")
def golden_describe(spark, sf):
    """Counters of the fixture lexicon."""
    return lexicon.describe(_lexicon(spark), _bigrams(spark))


@query("""SELECT * FROM (VALUES
  (true, 'hesti', 1::INTEGER, 'hest', 'so', NULL, NULL, NULL), (true, 'hesti', 2, 'hestur', 'no', 'þf', 'kk', 'et'), (true, 'hesti', 3, 'hestur', 'no', 'þgf', 'kk', 'et'), (true, 'þeir', 1, 'hann', 'fn', 'nf', NULL, 'ft'),
  (false, 'hesti', 1, 'hest', 'so', NULL, NULL, NULL), (false, 'hesti', 2, 'hestur', 'no', NULL, NULL, NULL), (false, 'þeir', 1, 'hann', 'fn', NULL, NULL, NULL)) AS t(morphology, word, rank, lemma, pos, gcase, gender, gnumber)""")
def golden_build(spark, sf):
    """Ranked entries of dictionary rows, with and without morphology."""
    rows = [("Hestur", "1", "kk", "alm", "hesti", "ÞGFET"), ("hestur", "1", "kk", "alm", "Hesti", "ÞFET"), ("hestur", "1", "kk", "alm", "hesti", "ÞGFET"), ("hest", "2", "so", "alm", "hesti", ""), ("hann", "3", "pfn", "alm", "þeir", "NFFT"), (None, "4", "so", "x", "a", "")]
    d = spark.createDataFrame(rows, "lemma string, bin_id string, word_class string, domain string, word_form string, mark string")
    uni = spark.createDataFrame([("hest", 9), ("hestur", 5)], "word string, freq long")
    both = [lexicon.rank_entries(lexicon.dictionary_entries(d, m), uni).select(F.lit(m).alias("morphology"), "*") for m in (True, False)]
    return both[0].union(both[1])


@query("SELECT * FROM (VALUES (1::INTEGER, 'og', 40::BIGINT), (2, 'á', 9), (3, 'hestur', 5)) AS t(place, word, freq)")
def golden_unigrams(spark, sf):
    """A frequency list: rare words and markup go, casings merge by their maximum, the most frequent come first."""
    counts = spark.createDataFrame([("Og", 40), ("og", 30), ("á", 9), ("Á", 3), ("hestur", 5), ("fágætt", 4), ("<s>", 90), ("[x]", 80)], "word string, freq long")
    listed = ngrams.by_frequency(ngrams.merge_unigrams(counts)).collect()
    return spark.createDataFrame([(i, *r) for i, r in enumerate(listed, 1)], "place int, word string, freq long")


@query("SELECT * FROM (VALUES ('Ég á hest og börn', 'hest börn', 'hest og börn')) AS t(text, given, plain)")
def golden_stopwords(spark, sf):
    """Words that are left by a given list, and by the default one."""
    t = _texts(spark, "Ég á hest og börn").select("text", F.split("text", " ").alias("ws"))
    return t.select("text", _joined(stopwords.remove_stopwords(F.col("ws"), ("ég", "á", "og"))).alias("given"), _joined(stopwords.remove_stopwords(F.col("ws"))).alias("plain"))


_FORMS = (
    ("telno", "4569876", "4569876"),
    ("telno", "+354-456-9876", "+3544569876"),
    ("email", "Nafn@Stofa.IS", "nafn@stofa.is"),
    ("domain", "Stofa.IS", "stofa.is"),
    ("ssn", "1201743399", "120174-3399"),
    ("dateabs", "3.11.2021", "2021-11-03"),
    ("timestampabs", "2021-11-03T16:45", "2021-11-03T16:45:00"),
    ("year", "1998", "1998"),
    ("ordinal", "17.", "17"),
    ("number", "1.250,50", "1250.5"),
    ("amount", "900 kr", "900 ISK"),
    ("measurement", "1,5kg", "1.5 kg"),
    ("word", "hestur", None),
)
_text = lambda v: "NULL" if v is None else f"'{v}'"


@query("SELECT * FROM (VALUES " + ", ".join(f"({_text(k)}, {_text(t)}, {_text(n)})" for k, t, n in _FORMS) + ") AS t(kind, token, normal)")
def golden_normal_forms(spark, sf):
    """Normal forms of kinds that the tables have none of, other tokenizers' among them."""
    t = spark.createDataFrame([x[:2] for x in _FORMS], "kind string, token string")
    return t.select("kind", "token", normal_form(F.col("kind"), F.col("token")).alias("normal"))


@query("""SELECT * FROM (VALUES ('daterel', 'á morgun', '05-03'), ('dateabs', 'í dag', '2024-05-03'), ('timestamprel', 'nú', '2024-05-03T07:08:09'), ('time', 'sjö', '07:08:09'), ('year', 'í fyrra', '2024'),
  ('ordinal', 'annar', '2.5'), ('amount', 'tvær og hálf', '2.5 ISK'), ('username', 'x', '@abc')) AS t(kind, token, normal)""")
def golden_field_forms(spark, sf):
    """Normal forms from the fields that a tokenizer tells."""
    kinds = [("daterel", "á morgun"), ("dateabs", "í dag"), ("timestamprel", "nú"), ("time", "sjö"), ("year", "í fyrra"), ("ordinal", "annar"), ("amount", "tvær og hálf"), ("username", "x")]
    t = spark.createDataFrame(kinds, "kind string, token string")
    year = F.when(F.col("kind") != "daterel", 2024)
    values = {"cc": F.lit(None), "number": F.lit(None), "year": year, "month": F.lit(5), "day": F.lit(3), "hour": F.lit(7), "minute": F.lit(8), "second": F.lit(9), "value": F.lit(2.5), "currency": F.lit("ISK"), "unit": F.lit(None), "username": F.lit("Abc")}
    fields = F.struct(*[v.alias(k) for k, v in values.items()])
    return t.withColumn("f", fields).select("kind", "token", normalize_token(F.col("kind"), F.col("token"), F.col("f")).alias("normal"))


@query("""SELECT * FROM (VALUES
  ('simons', false, 'simons simon', '', ''), ('q-á', false, 'q-á q á eiga', '', ''), ('börnin', true, 'barn', '', ''),
  ('húsnæðislán', false, 'húsnæðislán húsnæði lán', 'húsnæði lán', 'húsnæði lán'), ('borgarstjóri', false, 'borgarstjóri borgarstjór borg stjóri', 'borg stjóri', 'borg stjóri')) AS t(word, known, lemmas, parts, compound_lemmas)""")
def golden_words(spark, sf):
    """Lemmas of words with stripped suffixes, hyphen parts and compound parts."""
    lex = _lexicon(spark)
    words = _words(spark, "simons", "q-á", "börnin", "húsnæðislán", "borgarstjóri")
    t = pipeline.word_table(words, lexicon.nest(lex), compounds.known_lemmas(lex), pipeline.Options(split_mode="balanced"))
    text = lambda c: F.coalesce(_joined(c), F.lit(""))
    return t.select("word", "known", _joined("lemmas").alias("lemmas"), text("compound.parts").alias("parts"), text("compound_lemmas").alias("compound_lemmas"))


_SENTENCES = ("Ég á bíl", "fóru börnin", "til fundar", "á borðinu", "við Akureyri", "úr Borgarnesi", "hestur á", "óþekkt")


@query("""SELECT * FROM (VALUES
  (1::INTEGER, 'Ég', 'ég', 'fn', 1.0::DOUBLE, 'unambiguous'), (1, 'á', 'á', 'fs', 0.9, 'grammar_rules'), (1, 'bíl', 'bíll', 'no', 1.0, 'unambiguous'),
  (2, 'fóru', 'fara', 'so', 0.901786, 'word_bigrams'), (2, 'börnin', 'barn', 'no', 1.0, 'unambiguous'),
  (3, 'til', 'til', 'fs', 1.0, 'unambiguous'), (3, 'fundar', 'fundur', 'no', 0.9, 'grammar_rules'),
  (4, 'á', 'á', 'fs', 0.9, 'grammar_rules'), (4, 'borðinu', 'borð', 'no', 1.0, 'unambiguous'),
  (5, 'við', 'við', 'fs', 0.85, 'preference_rules'), (5, 'Akureyri', 'akureyri', NULL, 0.0, 'none'),
  (6, 'úr', 'úr', 'fs', 0.85, 'preference_rules'), (6, 'Borgarnesi', 'borgarnesi', NULL, 0.0, 'none'),
  (7, 'hestur', 'hestur', 'no', 1.0, 'unambiguous'), (7, 'á', 'á', 'fs', 0.333333, 'fallback'),
  (8, 'óþekkt', 'óþekkt', NULL, 0.0, 'none')) AS t(doc_id, text, lemma, pos, confidence, resolved_by)""")
def golden_cascade(spark, sf):
    """Every phase of disambiguation."""
    return _chosen(spark).select("doc_id", "text", "lemma", F.col("reading_pos").alias("pos"), F.round("confidence", 6).alias("confidence"), "resolved_by")


def _chosen(spark, **options) -> DataFrame:
    words = tokenize(_texts(spark, *_SENTENCES)).where("kind = 'word'").withColumn("word", F.lower("text"))
    looked = lexicon.with_entries(words, lexicon.nest(_lexicon(spark)))
    looked = looked.withColumn("readings", lexicon.readings_of(F.col("entries"))).withColumn("lemmas", lexicon.lemmas_of(F.col("word"), F.col("entries")))
    return disambiguate.disambiguate(looked.select("doc_id", "pos", "text", "readings", "entries", "lemmas"), _bigrams(spark), **options)


@query("""SELECT * FROM (VALUES
  ('no rules', 1::INTEGER, 'á', 'á', 'fallback'), ('no rules', 2, 'fóru', 'fara', 'word_bigrams'), ('no rules', 3, 'fundar', 'fundur', 'fallback'), ('no rules', 4, 'á', 'á', 'fallback'), ('no rules', 5, 'við', 'við', 'fallback'), ('no rules', 6, 'úr', 'úr', 'fallback'), ('no rules', 7, 'á', 'á', 'fallback'),
  ('no right side', 1, 'á', 'á', 'grammar_rules'), ('no right side', 2, 'fóru', 'fara', 'fallback'), ('no right side', 3, 'fundar', 'fundur', 'grammar_rules'), ('no right side', 4, 'á', 'á', 'grammar_rules'), ('no right side', 5, 'við', 'við', 'preference_rules'), ('no right side', 6, 'úr', 'úr', 'preference_rules'), ('no right side', 7, 'á', 'á', 'fallback')
  ) AS t(options, doc_id, text, lemma, resolved_by)""")
def golden_cascade_options(spark, sf):
    """Ambiguous words without rules, and with a weight of 0 for the following word."""
    runs = [("no rules", {"preference_rules": False, "grammar_rules": False}), ("no right side", {"right_weight": 0.0})]
    out = [_chosen(spark, **o).where("ambiguous").select(F.lit(name).alias("options"), "doc_id", "text", "lemma", "resolved_by") for name, o in runs]
    return out[0].union(out[1])


@query("""SELECT * FROM (VALUES
  ('aggressive', 'húsnæðislán', true, 'húsnæði lán', 'húsnæði lán húsnæðislán'), ('balanced', 'húsnæðislán', true, 'húsnæði lán', 'húsnæði lán húsnæðislán'), ('conservative', 'húsnæðislán', false, 'húsnæðislán', 'húsnæðislán'),
  ('aggressive', 'hús-lán', false, 'hús-lán', 'hús-lán'), ('balanced', 'hús-lán', false, 'hús-lán', 'hús-lán'), ('conservative', 'hús-lán', true, 'hús lán', 'hús lán hús-lán'),
  ('aggressive', 'lánstjóri', true, 'lán stjóri', 'lán stjóri lánstjóri'), ('balanced', 'lánstjóri', false, 'lán', 'lán'), ('conservative', 'lánstjóri', false, 'lán', 'lán'),
  ('aggressive', 'ísland', false, 'ísland', 'ísland'), ('balanced', 'ísland', false, 'ísland', 'ísland'), ('conservative', 'ísland', false, 'ísland', 'ísland')) AS t(mode, word, is_compound, parts, index_terms)""")
def golden_compounds(spark, sf):
    """Splitting by mode: a plain compound, a hyphen, a known word of one other lemma, a protected word."""
    lex = _lexicon(spark)
    looked = spark.createDataFrame([("húsnæðislán", ["húsnæðislán"]), ("hús-lán", ["hús-lán"]), ("lánstjóri", ["lán"]), ("ísland", ["ísland"])], "word string, lemmas array<string>")
    out = None
    for mode in compounds.MODES:
        one = compounds.split_compounds(looked, lexicon.nest(lex), compounds.known_lemmas(lex), mode).select(F.lit(mode).alias("mode"), "word", "is_compound", _joined("parts").alias("parts"), _joined("index_terms").alias("index_terms"))
        out = one if out is None else out.union(one)
    return out


def _processed(spark, *texts: str, **options) -> DataFrame:
    lex = _lexicon(spark)
    options = pipeline.Options(include_offsets=True, **options)
    return pipeline.process_text(_texts(spark, *texts), lexicon.nest(lex), _bigrams(spark), compounds.known_lemmas(lex), options)


@query("""SELECT * FROM (VALUES
  (1::INTEGER, 'Börnin', 'word', 'barn', false, 'barn'), (1, 'fóru', 'word', 'fara fóra', false, 'fóra'), (1, '25%', 'percent', '25%', false, NULL),
  (1, '#Sumar', 'hashtag', '#sumar', false, NULL), (2, 'Jón Jónsson', 'person', '', true, NULL), (2, '1998', 'year', '1998', false, NULL), (2, 'á', 'word', 'á eiga', false, 'á')) AS t(doc_id, original, kind, lemmas, is_entity, chosen)""")
def golden_routing(spark, sf):
    """Kinds of tokens: words, others with a normal form, numbers that go, and those of another tokenizer."""
    own = _processed(spark, "Börnin fóru 25% 17 #Sumar !")

    def told(docs):
        rows = [(2, 0, "Jón Jónsson", "person", 0, 11), (2, 1, "1998", "year", 12, 16), (2, 2, "á", "word", 17, 18), (2, 3, ".", "punctuation", 18, 19)]
        return spark.createDataFrame(rows, "doc_id int, pos int, text string, kind string, start int, end int")

    lex = lexicon.nest(_lexicon(spark))
    other = pipeline.process_text(_texts(spark), lex, _bigrams(spark), options=pipeline.Options(include_offsets=True), tokenizer=told)
    shown = lambda t: t.select("doc_id", "original", "kind", _joined("lemmas").alias("lemmas"), "is_entity", F.col("disambiguated").alias("chosen"))
    return shown(own).union(shown(other))


@query("""SELECT * FROM (VALUES
  ('plain', 'fara | fóra & barn & á | eiga'), ('wrapped', '(fara | fóra) & barn & (á | eiga)'), ('original', '(fara | fóra | fóru) & (barn | börnin) & (á | eiga)'), ('chosen', 'fara & barn & á'), ('without', '(fara | fóra) & barn & eiga')) AS t(options, query)""")
def golden_search_queries(spark, sf):
    """Boolean queries by option."""
    tokens = _processed(spark, "fóru börnin á")
    runs = [
        ("plain", pipeline.Options(), {"wrap_groups": False}, None),
        ("wrapped", pipeline.Options(), {}, None),
        ("original", pipeline.Options(), {"include_original": True}, None),
        ("chosen", pipeline.Options(index_all_candidates=False), {}, None),
        ("without", pipeline.Options(remove_stopwords=True), {}, ("á",)),
    ]
    out = [pipeline.search_queries(tokens, o, stop, **more).select(F.lit(name).alias("options"), "query") for name, o, more, stop in runs]
    for x in out[1:]:
        out[0] = out[0].union(x)
    return out[0]


@query("SELECT * FROM (VALUES (1::INTEGER, 'barn'), (1, 'fara'), (1, 'og'), (2, 'á'), (2, 'ég'), (2, 'bíll')) AS t(doc_id, lemma)")
def golden_best_lemmas(spark, sf):
    """The best lemma of every word."""
    return pipeline.disambiguated_lemmas(_texts(spark, "fóru börnin (og) börnin!", "Ég á bíl"), lexicon.nest(_lexicon(spark)), _bigrams(spark))


@query("""SELECT * FROM (VALUES ('naive', 6::BIGINT, 3::BIGINT, 2::BIGINT, 0::BIGINT), ('tokenized', 5, 4, 3, 0), ('disambiguated', 5, 4, 3, 0), ('full', 5, 4, 3, 1)) AS t(strategy, word_count, lemmatized_count, ambiguous_count, compounds_found)""")
def golden_strategies(spark, sf):
    """Figures of one text by strategy."""
    lex = _lexicon(spark)
    m = pipeline.strategy_metrics(_texts(spark, "Börnin fóru á borgarstjóri (xyz) 42."), lexicon.nest(lex), _bigrams(spark), compounds.known_lemmas(lex))
    return m.select("strategy", "word_count", "lemmatized_count", "ambiguous_count", "compounds_found")


_LONG = "Orð " * 30


@query(f"""SELECT * FROM (VALUES
  (1::INTEGER, 0::INTEGER, 19::INTEGER, 22::INTEGER, 'Hestur og barn hér.', 4::INTEGER, 2::BIGINT),
  (2, 104, 143, 11, '…Orð Orð Orð Orð Hestur var hér í gær.…', 4, 1),
  (3, 0, 6, 11, 'hestur', 1, 1)) AS t(doc_id, "start", "end", score, text, n_segments, total_matches)""")
def golden_snippets(spark, sf):
    """Snippets: a whole short text, a sentence of a long one whose end is trimmed, a text of one word."""
    docs = _texts(spark, "Hestur og barn hér.", f"{_LONG}Hestur var hér í gær.\n\n{_LONG}", "hestur")
    lex = _lexicon(spark)
    t = pipeline.process_text(docs, lexicon.nest(lex), options=pipeline.Options(include_offsets=True))
    hits = search.query_hits(t, docs.select("doc_id", F.array(F.lit("hestur"), F.lit("barn")).alias("query")))
    s = search.snippets(docs, t.where("kind = 'word'").select("doc_id", "start", "end"), hits, size=8)
    return s.select("doc_id", "start", "end", "score", "text", F.size("segments").alias("n_segments"), "total_matches")


@query("""SELECT * FROM (VALUES
  ('blog', 2::BIGINT, 4::BIGINT, 0.25::DOUBLE, 0.5::DOUBLE, 0.5::DOUBLE, 2::BIGINT, 0.5::DOUBLE, 1::BIGINT, 2::BIGINT), ('news', 1, 2, 0.5, 0.0, 0.0, 2, 0.5, 1, 3), (NULL, 3, 6, 0.333333, 0.333333, 0.333333, 4, 0.5, 2, 5)
  ) AS t(category, sentences, tokens, recall, oov_rate, parse_failure_rate, parsed_tokens, parsed_recall, mismatches, parser_tokens)""")
def golden_external_scores(spark, sf):
    """Another parser against gold lemmas: a sentence it failed on, words of other forms, a word too many."""
    gold = [("blog", "a", 0, "Hestar", "hestur"), ("blog", "a", 1, "fóru", "fara"), ("blog", "b", 0, "Barn", "barn"), ("blog", "b", 1, "á", "eiga"), ("news", "c", 0, "til", "til"), ("news", "c", 1, "fundar", "fundur")]
    parsed = [("a", 0, "Hestar", "Hestur"), ("a", 1, "fóru út", "fóra"), ("c", 0, "til", "til"), ("c", 2, "Fundar", "funda"), ("c", 3, "x", "x")]
    s = evaluate.external_scores(spark.createDataFrame(gold, "category string, sentence string, pos int, form string, gold string"), spark.createDataFrame(parsed, "sentence string, pos int, form string, lemma string"))
    rounded = ("recall", "oov_rate", "parse_failure_rate", "parsed_recall")
    return s.select("category", "sentences", "tokens", *[F.round(c, 6).alias(c) for c in rounded[:3]], "parsed_tokens", F.round("parsed_recall", 6).alias("parsed_recall"), "mismatches", "parser_tokens")


@query("""SELECT * FROM (VALUES ('a', 1::BIGINT, 0.5::DOUBLE, 1.0::DOUBLE, 4::BIGINT, 0.25::DOUBLE, 1.5::DOUBLE, 1.0::DOUBLE), ('b', 1, 1.0, 0.5, 4, 0.0, 1.0, 0.0), (NULL, 2, 0.666667, 0.666667, 8, 0.125, 1.25, 0.5)
  ) AS t(domain, sentences, recall, precision, word_tokens, oov_rate, avg_candidates, compounds_per_sentence)""")
def golden_lexicon_overlap(spark, sf):
    """Overlap of two lexicons' lemma sets with the second one's rates."""
    rows = [("a", ["x", "y"], ["x"], 4, 1, 6, 1), ("b", ["z"], ["z", "w"], 4, 0, 4, 0)]
    s = evaluate.lexicon_overlap(spark.createDataFrame(rows, "domain string, a array<string>, b array<string>, words long, oov long, candidates long, compounds long"))
    return s.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in s.dtypes])


@query("""SELECT * FROM (VALUES (1::INTEGER, 1::INTEGER, 10::INTEGER, 0.060793::DOUBLE), (1, 2, 11, 0.030396), (2, 1, 10, 0.060793), (2, 2, 11, 0.060793)) AS t(query_id, rank, doc_id, score)""")
def golden_any_rank(spark, sf):
    """Documents with any of a query's lemmas, by the share of them they have."""
    q = spark.createDataFrame([(1, "hestur"), (1, "barn"), (2, "barn"), (3, "enginn")], "query_id int, lemma string")
    p = spark.createDataFrame([(10, "hestur"), (10, "barn"), (10, "x"), (11, "barn"), (12, "x")], "doc_id int, lemma string")
    return search.any_rank(q, p).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))
