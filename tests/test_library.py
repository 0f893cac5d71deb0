"""Golden cases of the library's operators."""

import gzip

import pytest
from pyspark.sql import functions as F

from ordspark import resources as R
from ordspark.functions import grammar as G
from ordspark.functions.tokenize import kind_of, naive_tokens, normal_form, normalize_token, token_fields, tokenize
from ordspark.operators import bloom, compounds, disambiguate, evaluate, lexicon, ngrams, phrases, search, stopwords, unknown
from ordspark.plans import pipeline
from ordspark.schemas import LEXICON
from ordspark.sources import lexicons, search_index, tei

ROWS = """hestinum hestur no þgf kk et|hestur hestur no nf kk et|hesti hestur no þgf kk et|hestar hestur no nf kk ft|hestarnir hestur no nf kk ft|hesturinn hestur no nf kk et
börnin barn no nf hk ft|barn barn no nf hk et|keypti kaupa so|fóru fara so|fóru fóra no|hús hús no nf hk et|á á fs|á eiga so|á á no|við við fs|við ég fn|við viður no
borðinu borð no þgf hk et|bíl bíll no þf kk et|til til fs|fundar fundur no ef kk et|fundar funda so|app app no|appið app no|köttur köttur no nf kk et|borgar borg no ef kvk et
stjóri stjóri no nf kk et|landbúnaðar landbúnaður no ef kk et|ráðherra ráðherra no nf kk et|húsnæði húsnæði no nf hk et|lán lán no nf hk et|simon simon no|góðan góður lo|og og st"""


def entries():
    rank = {}
    for row in ROWS.replace("\n", "|").split("|"):
        w, lemma, pos, *m = row.split()
        rank[w] = rank.get(w, 0) + 1
        yield (w, rank[w], lemma, pos, *(m or [None] * 3))


@pytest.fixture(scope="module")
def lex(spark):
    return lexicons.lexicon_from_rows(spark, list(entries())).cache()


@pytest.fixture(scope="module")
def nested(lex):
    return lexicon.nest(lex).cache()


def texts(spark, *ts):
    return spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")


def test_tables():
    assert {"ég", "á", "til", "þetta"} <= R.stopwords() and not any(" " in w for w in R.stopwords())
    assert len(R.PREPOSITION_CASES) == 32 and len(R.DISAMBIGUATION_RULES) == 15 and len(R.PHRASES) == 93
    assert len(R.PROTECTED_LEMMAS) == 75 and len(R.COMPOUND_TAILS) == 30 and len(R.COMMON_STANDALONE) == 18 and len(R.UNKNOWN_SUFFIXES) == 16


def test_lookup(spark, nested):
    w = spark.createDataFrame([(x,) for x in ("Börnin", "á", "xyz123", "", "HESTINUM", "fóru")], "word string")
    got = {r.word: (r.l, r.so, len(r.r)) for r in lexicon.with_entries(w, nested).select("word", lexicon.lemmas_of(F.col("word"), F.col("entries")).alias("l"), lexicon.lemmas_of(F.col("word"), F.col("entries"), "so").alias("so"), lexicon.readings_of(F.col("entries")).alias("r")).collect()}
    assert got["Börnin"][0] == ["barn"] and got["á"] == (["á", "eiga"], ["eiga"], 3) and got["xyz123"] == (["xyz123"], ["xyz123"], 0)
    assert got[""][0] == [""] and got["HESTINUM"][0] == ["hestur"] and got["fóru"][0] == ["fara", "fóra"] and got["fóru"][1] == ["fara"]


def test_build(spark):
    rows = [("Hestur", "1", "kk", "alm", "hesti", "ÞGFET"), ("hestur", "1", "kk", "alm", "hesti", "ÞGFET"), ("hest", "2", "so", "alm", "hesti", ""), (None, "3", "so", "x", "a", "")]
    e = lexicon.dictionary_entries(spark.createDataFrame(rows, "lemma string, bin_id string, word_class string, domain string, word_form string, mark string"))
    uni = spark.createDataFrame([("hest", 9), ("hestur", 5)], "word string, freq long")
    assert [(r.rank, r.lemma, r.pos, r.gcase) for r in lexicon.rank_entries(e, uni).orderBy("rank").collect()] == [(1, "hest", "so", None), (2, "hestur", "no", "þgf")]
    assert [r.lemma for r in lexicon.lemma_list(e, uni).collect()] == ["hest", "hestur"]
    assert ngrams.merge_bigrams(spark.createDataFrame([("A", "b", 3), ("a", "B", 7)], "w1 string, w2 string, freq long")).collect()[0].freq == 7


#: (token, kind, normal form)
GOLD = (
    ("4569876", "telno", "4569876"),
    ("+354-456-9876", "telno", "+3544569876"),
    ("Nafn@Stofa.IS", "email", "nafn@stofa.is"),
    ("https://stofa.is/leid?a=1", "url", "https://stofa.is/leid?a=1"),
    ("Stofa.IS", "domain", "stofa.is"),
    ("3.11.2021", "date", "2021-11-03"),
    ("2021-11-03", "date", "2021-11-03"),
    ("16:45", "time", "16:45"),
    ("07:05:10", "time", "07:05:10"),
    ("2021-11-03T16:45:00", "timestamp", "2021-11-03T16:45:00"),
    ("120174-3399", "ssn", "120174-3399"),
    ("1201743399", "ssn", "120174-3399"),
    ("$250", "amount", "250 USD"),
    ("€75", "amount", "75 EUR"),
    ("900 kr", "amount", "900 ISK"),
    ("8km", "measurement", "8 m"),
    ("1,5kg", "measurement", "1.5 kg"),
    ("40%", "percent", "40%"),
    ("7,25%", "percent", "7.25%"),
    ("#Sumar", "hashtag", "#sumar"),
    ("@Nafn", "username", "@nafn"),
    ("17", "number", "17"),
    ("hestur", "word", None),
    (".", "punctuation", None),
)


def test_normalization(spark):
    t = spark.createDataFrame([(c[0],) for c in GOLD], "token string").withColumn("kind", kind_of(F.col("token")))
    t = t.select("token", "kind", normal_form(F.col("kind"), F.col("token")).alias("n"), normalize_token(F.col("kind"), F.col("token"), token_fields(F.col("kind"), F.col("token"))).alias("m"))
    got = {r.token: (r.kind, r.n, r.m) for r in t.collect()}
    assert got == {a: (b, c, c) for a, b, c in GOLD}


def test_tokens(spark):
    text = "Halló, heimur! COVID-sýking kl. 20:00 á Example.IS 𝕏a"
    got = tokenize(texts(spark, text, None, ""), spaces=True).orderBy("pos").collect()
    assert "".join(r.text for r in got) == text and all(text[r.start : r.end] == r.text for r in got)
    assert [r.text for r in got if r.kind == "word"][:3] == ["Halló", "heimur", "COVID-sýking"]
    assert texts(spark, " «Halló», (x) -- 7! ").select(naive_tokens(F.col("text")).alias("t")).first().t == ["Halló", "x", "7"]


def test_stopwords(spark, tmp_path):
    (tmp_path / "stop.txt").write_text("Og\n\n  en \nog\n")
    words = lexicons.read_stopwords(spark, str(tmp_path / "stop.txt"))
    rows = spark.createDataFrame([("og",), ("hestur",), ("En",)], "lemma string")
    assert words == ["en", "og"] and rows.where(~stopwords.is_stopword(F.col("lemma"), words)).collect() == [("hestur",)]
    assert stopwords.without_stopwords(rows, spark.createDataFrame([(w,) for w in words], "word string")).collect() == [("hestur",)]
    t = spark.createDataFrame([(["Ég", "á", "hest"],)], "a array<string>")
    assert t.select(stopwords.remove_stopwords(F.col("a"))).first()[0] == ["hest"]
    assert lexicons.unpack_entry(7 << 10 | 1 << 9 | 2 << 7 | 3 << 4 | 0, 2) == (7, "no", "þgf", "kvk", "ft")


def test_preference_rule_lookup(spark):
    t = spark.createDataFrame([("Á",), ("hestur",), (None,)], "w string")
    got = t.select(G.has_rules(F.col("w")).alias("has"), G.rules_for(F.col("w")).alias("r")).collect()
    assert [(x.has, [tuple(r) for r in x.r]) for x in got] == [(True, [("á", "so", "fs", "after_pronoun"), ("á", "fs", "so", "before_noun")]), (False, []), (False, [])]


def test_search_index(spark, nested, tmp_path):
    docs = spark.createDataFrame([(1, "Hestinum börnin"), (2, ""), (3, None)], "doc_id long, text string")
    terms = pipeline.index_terms(pipeline.process_text(docs, nested))
    rows = search_index.search_documents(docs, terms)
    want = [(1, "Hestinum börnin", "hestur barn"), (2, "", ""), (3, None, "")]
    assert [tuple(r) for r in rows.orderBy("doc_id").collect()] == want
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    search_index.write_jdbc(rows, url, "documents", mode="overwrite", connections=2, driver="org.apache.derby.jdbc.EmbeddedDriver")
    back = search_index.read_jdbc(spark, url, "documents", driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert [tuple(r) for r in back.orderBy("doc_id").collect()] == want


def test_suffix_cases(spark):
    t = spark.createDataFrame([(w,) for w in ("borðinu", "þakinu", "hestunum", "hestinn", "pabbi", "konráð")], "w string")
    assert {r.w: r.c for r in t.select("w", G.infer_case(F.col("w")).alias("c")).collect()} == {"borðinu": ["þgf"], "þakinu": ["þgf"], "hestunum": ["þgf"], "hestinn": ["nf", "þf"], "pabbi": [], "konráð": []}
    g = spark.createDataFrame([("á", "þgf"), ("til", "þf"), ("af", "nf"), ("unknown", "þgf"), ("á", None)], "p string, c string").select(G.can_govern(F.col("p"), F.col("c")).alias("g"))
    assert [r.g for r in g.collect()] == [True, False, False, False, False]


def test_unknown_words(spark, nested):
    w = spark.createDataFrame([("simons",), ("hestinumx",), ("obamas",), ("xy",), ("börnin",)], "word string")
    got = {r.word: (r.known, r.lemmas) for r in unknown.word_lemmas(w, nested).collect()}
    assert got["simons"] == (False, ["simons", "simon"]) and got["obamas"][1] == ["obamas", "obama", "obam"]
    assert got["xy"] == (False, ["xy"]) and got["börnin"] == (True, ["barn"])
    h = unknown.hyphen_parts(unknown.word_lemmas(spark.createDataFrame([("q-börnin",)], "word string"), nested, strip=False), nested, strip=False)
    assert h.first().lemmas == ["q-börnin", "q", "barn"]


def test_compounds(spark, lex, nested):
    words = spark.createDataFrame([(w,) for w in ("landbúnaðarráðherra", "húsnæðislán", "borgarstjóri", "hestur", "xyzabcdef", "ísland")], "word string")
    looked = unknown.word_lemmas(words, nested, strip=False)
    got = {r.word: r for r in compounds.split_compounds(looked, nested, compounds.known_lemmas(lex)).collect()}
    assert got["landbúnaðarráðherra"].parts == ["landbúnaður", "ráðherra"] and abs(got["landbúnaðarráðherra"].confidence - 0.868421) < 1e-6
    assert got["borgarstjóri"].parts == ["borg", "stjóri"] and got["borgarstjóri"].confidence == pytest.approx(0.9)
    assert got["húsnæðislán"].parts == ["húsnæði", "lán"] and not any(got[w].is_compound for w in ("hestur", "xyzabcdef", "ísland"))
    hy = compounds.split_compounds(spark.createDataFrame([("a-b", ["a-b"])], "word string, lemmas array<string>"), nested, compounds.known_lemmas(lex), "conservative").first()
    assert (hy.parts, hy.confidence) == (["a", "b"], 0.9)


def test_cascade(spark, nested):
    bigrams = spark.createDataFrame([("fara", "barn", 100), ("fóra", "barn", 10)], "w1 string, w2 string, freq long")
    t = pipeline.process_text(texts(spark, "Ég á bíl", "fóru börnin", "til fundar"), nested, bigrams)
    got = {(r.doc_id, r.original): (r.disambiguated, r.confidence) for r in t.collect()}
    assert got[0, "á"] == ("á", 0.9) and got[2, "fundar"] == ("fundur", 0.9)
    assert got[1, "fóru"][0] == "fara" and got[1, "fóru"][1] == pytest.approx(101 / 112) and got[0, "bíl"] == ("bíll", 1.0)


def test_strategies(spark, lex, nested):
    docs = texts(spark, "Börnin fóru til borgarstjóri (og) 42.")
    bigrams = spark.createDataFrame([("barn", "fara", 9)], "w1 string, w2 string, freq long")
    best = {r.lemma for r in pipeline.disambiguated_lemmas(docs, nested, bigrams, ("til", "og"), remove_stopwords=True).collect()}
    assert best == {"barn", "fara", "borgarstjóri", "42"}
    got = {r.strategy: r for r in pipeline.strategy_metrics(docs, nested, bigrams, compounds.known_lemmas(lex)).collect()}
    assert set(got) == set(pipeline.STRATEGIES) and got["naive"].word_count == 6 and got["tokenized"].word_count == 5
    assert got["full"].compounds_found == 1 and got["disambiguated"].compounds_found == 0 and got["full"].unique_lemmas > got["tokenized"].unique_lemmas


def test_search(spark, lex, nested):
    options = pipeline.Options(remove_stopwords=True, split_mode="balanced", include_offsets=True)
    docs = texts(spark, "Hestarnir og börnin.", "Köttur til.", "Húsnæðislán eru dýr. " + "Orð " * 40 + "Hesturinn var hér. " + "Orð " * 40, "")
    d = pipeline.process_text(docs, nested, known=compounds.known_lemmas(lex), options=options)
    q = pipeline.process_text(texts(spark, "hestur", "lán", "á"), nested, options=options)
    queries = pipeline.search_queries(q, options)
    assert {r.doc_id: r.query for r in queries.collect()} == {0: "hestur", 1: "lán", 2: "eiga"}
    hit = search.match(queries.select(F.col("doc_id").alias("query_id"), "groups"), pipeline.postings(d, options)).collect()
    assert {(r.query_id, r.doc_id) for r in hit} == {(0, 0), (0, 2), (1, 2)}
    wanted = docs.select("doc_id", F.array(F.lit("hestur")).alias("query"))
    hits = search.query_hits(d, wanted).cache()
    marked = {r.doc_id: r for r in search.highlight(docs, hits).collect()}
    assert [tuple(s) for s in marked[0].segments] == [("Hestarnir", True), (" og börnin.", False)] and marked[1].match_count == 0 and marked[3].segments == []
    words = d.where("kind = 'word'").select("doc_id", "start", "end")
    s = {r.doc_id: r for r in search.snippets(docs, words, hits, size=8).collect()}
    assert "…" in s[2].text and "Hesturinn" in s[2].text and not s[0].text.startswith("…") and s[2].total_matches == 1
    m = pipeline.metrics(d, pipeline.postings(d, options)).first()
    assert m.word_count == 91 and m.compounds_found == 1


def test_phrases_and_bloom(spark):
    w = spark.createDataFrame([(1, i, x) for i, x in enumerate("Við fórum til dæmis í raun og veru heim".split())], "doc_id long, pos int, word string")
    got = {(r.pos, r.phrase) for r in phrases.match_phrases(w, phrases.phrase_table(spark)).collect()}
    assert got == {(2, "til dæmis"), (4, "í raun og veru")}
    t = spark.createDataFrame([("Til Dæmis",), ("til",), (None,)], "p string")
    got = [(r.known, r.i and tuple(r.i)) for r in t.select(phrases.is_known_phrase(F.col("p")).alias("known"), phrases.phrase_info(F.col("p")).alias("i")).collect()]
    assert got == [(True, ("til dæmi", True, "ao")), (False, None), (False, None)]
    assert bloom.size_for(1000) == (9586, 7)
    members = spark.range(500).selectExpr("concat('w', id) as word")
    bits = bloom.build(members, *bloom.size_for(500))
    assert bloom.might_contain(members, bits, *bloom.size_for(500)).where("not maybe").count() == 0
    assert bloom.might_contain(spark.range(2000).selectExpr("concat('x', id) as word"), bits, *bloom.size_for(500)).where("maybe").count() < 50


def test_evaluation(spark):
    t = spark.createDataFrame([("a", 1, "Barn", ["barn"], True), ("a", 1, "x", ["y", "z"], False), ("b", 2, "q", ["q", "r"], True)], "category string, sentence long, gold string, candidates array<string>, known boolean")
    got = {r.category: r for r in evaluate.gold_scores(t).collect()}
    assert got[None].recall == pytest.approx(2 / 3) and got["a"].extra_rate == pytest.approx(2 / 3) and got[None].oov_rate == pytest.approx(1 / 3)


def test_sources(spark, tmp_path):
    (tmp_path / "d.csv").write_text("Hestur;1;kk;alm;hesti;ÞGFET;x\nbarn;2;hk;alm;barn\nshort;3\n")
    assert [(r.lemma, r.mark) for r in lexicons.read_dictionary(spark, str(tmp_path / "d.csv")).collect()] == [("Hestur", "ÞGFET"), ("barn", "")]
    (tmp_path / "u.json").write_text('{"og": 5, "á": 7}')
    (tmp_path / "b.json").write_text('[["a", "b", 3]]')
    assert {(r.word, r.freq) for r in lexicons.read_unigrams(spark, str(tmp_path / "u.json")).collect()} == {("og", 5), ("á", 7)}
    assert tuple(lexicons.read_bigrams(spark, str(tmp_path / "b.json")).first()) == ("a", "b", 3)
    rows = sorted(entries())
    packed = lexicons.pack(rows)
    assert sorted((w, r, l, p, c, g) for w, r, l, p, c, g, _ in lexicons.parse_packed(packed)) == sorted((w, r, l, p, c, g) for w, r, l, p, c, g, _ in rows)
    (tmp_path / "l.bin").write_bytes(packed)
    assert lexicons.read_packed(spark, str(tmp_path / "l.bin")).count() == len(rows)
    for bad in (b"", b"\0" * 40, packed[:4] + b"\x09\0\0\0" + packed[8:]):
        with pytest.raises(ValueError):
            lexicons.parse_packed(bad)
    pairs = [("fara", "barn", 100), ("á", "hestur", 7), ("á", "borð", 1 << 31)]
    for version in (1, 2):
        both = lexicons.pack(rows, version, pairs)
        assert lexicons.parse_packed_bigrams(both) == sorted(pairs) and [x[:4] for x in lexicons.parse_packed(both)] == [x[:4] for x in rows]
        with pytest.raises(ValueError):
            lexicons.parse_packed(both[:-4])
    (tmp_path / "b.bin").write_bytes(both)
    assert sorted(map(tuple, lexicons.read_packed_bigrams(spark, str(tmp_path / "b.bin")).collect())) == sorted(pairs)
    assert lexicons.read_packed_bigrams(spark, str(tmp_path / "l.bin")).count() == 0
    (tmp_path / "u.json.gz").write_bytes(gzip.compress(b'{"og": 5}'))
    assert lexicons.read_unigrams(spark, str(tmp_path / "u.json.gz")).collect() == [("og", 5)]
    with pytest.warns(UserWarning, match="not found"):
        assert lexicons.read_unigrams(spark, str(tmp_path / "none.json")).count() == lexicons.read_bigrams(spark, str(tmp_path / "none.json")).count() == 0
    folder = tmp_path / "corpus" / "blog"
    folder.mkdir(parents=True)
    (folder / "a.xml").write_text('<T xmlns="u"><s><w lemma="hestur" type="n">Hestur</w><c>,</c><w lemma="og" type="c">og</w><c>.</c></s></T>')
    (folder / "b.xml").write_text("<broken")
    got = tei.read_tei(spark, str(tmp_path / "corpus")).collect()
    assert [(r.category, r.text, [w.lemma for w in r.tokens]) for r in got] == [("blog", "Hestur, og.", ["hestur", "og"])]
    lexicons.write_lexicon(spark.createDataFrame(rows, LEXICON), str(tmp_path / "out"))
    assert lexicons.read_lexicon(spark, str(tmp_path / "out")).count() == len(rows)


def test_stream(spark, nested, tmp_path):
    from ordspark.streaming.index_stream import index_stream

    texts(spark, "Börnin fóru", "á").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    index_stream(stream, nested, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert {(r.doc_id, r.word): r.lemmas for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(0, "Börnin"): ["barn"], (0, "fóru"): ["fara", "fóra"], (1, "á"): ["á", "eiga"]}


def test_process_text_deals_out_rare_and_open_words_only(spark, monkeypatch):
    """The same tokens whatever share of the words is frequent, with the neighbours and offsets of a scan over each text."""
    import re

    from ordspark.functions.tokenize import is_word, start_of, tokens_in_place, word_beside

    odd = ["", None, "x", "the cats", "the " + ". " * 500 + "cats " + "1 " * 30 + "dogs", "cats\nthe 5\nkr cats", "cats http://x.y/\u0001the\u0001 dogs \u0001 cats, dogs-cats", "the cats the 12 the. 7 % 3\t\n a@b.is dogs 1.2.2020 1234567 1.5 1234567890", "İİ cats İİ 😀 the cats " * 40]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    t = tokens_in_place(docs).where(is_word(F.col("text")))
    got = [tuple(r) for r in t.select("doc_id", "pos", "text", start_of(F.col("all"), F.col("blocks"), F.col("pos")), *[word_beside(F.col("all"), F.col("pos"), b) for b in (True, False)]).collect()]
    want, whole = [], tokenize(docs).where("kind = 'word'").orderBy("doc_id", "pos").collect()
    for i, r in enumerate(whole):
        beside = [whole[j].text if 0 <= j < len(whole) and whole[j].doc_id == r.doc_id else None for j in (i - 1, i + 1)]
        want.append((r.doc_id, r.pos, r.text, r.start, *beside))
    assert sorted(got, key=lambda x: x[:2]) == want and len({x[0] for x in want}) == 7

    entries = "word string, entries array<struct<rank:int,lemma:string,pos:string,gcase:string,gender:string,gnumber:string>>"
    reading = lambda i, lemma: (i, lemma, "no", None, None, None)
    nested = spark.createDataFrame([("the", [reading(1, "the")]), *[(w, [reading(1, w[:-1]), reading(2, w)]) for w in ("cats", "dogs")]], entries)
    bigrams = spark.createDataFrame([("the", "cats", 9), ("dog", "cat", 3)], "w1 string, w2 string, freq long")
    found = {}
    for frequent in (0, 2, 1 << 17):
        monkeypatch.setattr(pipeline, "FREQUENT", frequent)
        out = pipeline.process_text(docs, nested, bigrams, options=pipeline.Options(include_offsets=True))
        found[frequent] = sorted(map(str, map(tuple, out.collect())))
    assert found[0] == found[2] == found[1 << 17] and len(found[0]) > len(want)
    kinds = "date 1.2.2020, telno 1234567, ssn 1234567890, email a@b.is, percent 7 %"
    assert [f"{r.kind} {r.original}" for r in out.where("doc_id = 7 and kind <> 'word'").orderBy("pos").collect()] == [x for p in (4, 3, 0, 1, 2) for x in [kinds.split(", ")[p]]]
    plan = out.where("doc_id >= 0")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Window|hashpartitioning\(doc_id#\d+L?, \d+\)", plan)
