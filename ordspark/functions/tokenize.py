"""Tokenizers and token normalization as column expressions.

The full tokenizer consumes every character by one alternation of patterns; a
token's kind is the first pattern that matches all of it.  Offsets are in code
points.  Patterns are in the common subset of Java and RE2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

NUMBER = r"\d+(?:[.,]\d+)*"
WORD = r"\p{L}+(?:[-'’]\p{L}+)*"
#: Kinds and their patterns, in the order they are tried.
KINDS = (
    ("url", r"https?://[^\s]+"),
    ("email", r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"),
    ("timestamp", r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2})?"),
    ("date", r"\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}"),
    ("ssn", r"\d{6}-\d{4}\b|\d{10}\b"),
    ("telno", r"\+\d{1,3}[- ]?\d{3}-?\d{4}|\d{3}-\d{4}\b|\d{7}\b"),
    ("time", r"\d{1,2}:\d{2}(?::\d{2})?"),
    ("amount", rf"[$€£]{NUMBER}|{NUMBER}\s?(?:kr|ISK|USD|EUR|GBP)\b"),
    ("percent", rf"{NUMBER}\s?%"),
    ("measurement", rf"{NUMBER}\s?(?:km|kg|cm|mm|m|g|l)\b"),
    ("hashtag", r"#[\p{L}\p{N}_]+"),
    ("username", r"@[\p{L}\p{N}_]+"),
    ("domain", r"[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.(?i:is|com|org|net|edu|gov|io|eu)\b"),
    ("number", NUMBER),
    ("word", WORD),
    ("space", r"\s+"),
)
PATTERN = "(?s)" + "|".join(p for _, p in KINDS) + "|."
#: ``PATTERN`` for Spark: white space and plain words come first where no other pattern could match there.  The same tokens in half of the time.
QUICK = r"(?s)\s+|\p{L}++(?=[.:]?(?:\s|\z)|[^\p{L}\p{N}._%+@:'’-])|" + PATTERN.removeprefix("(?s)")
#: Before a token; around a word; what stands for these characters in a text.
TOKEN, BEGIN, END, OTHER = "\u0001", "\u0002", "\u0003", "\u0004"
CURRENCIES = {"$": "USD", "€": "EUR", "£": "GBP", "kr": "ISK"}
#: Base units that measurements are given in (the number stays as written).
UNITS = {"km": "m", "cm": "m", "mm": "m"}


def naive_tokens(text: Column) -> Column:
    """White-space tokens without leading and trailing characters that are neither letters nor numbers."""
    edges = F.transform(F.split(text, r"[\s\x{A0}]+"), lambda x: F.regexp_replace(x, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.filter(edges, lambda x: x != "")


def benchmark_tokens(text: Column) -> Column:
    """The variant of throughput runs: some punctuation removed anywhere, lower-cased."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, r'[.,!?;:"„]', "")), r"\s+"), lambda x: x != "")


def words_of(text: Column) -> Column:
    """Word tokens only, hyphenated ones whole; the fast path of corpus jobs."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def words_in_context(docs: DataFrame, words: Column, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, pos, text, prev_text, next_text) of an array of words, each with its neighbours."""
    beside = lambda ws: F.transform(ws, lambda w, i: F.struct(i.alias("pos"), w.alias("text"), F.get(ws, i - 1).alias("prev_text"), F.get(ws, i + 1).alias("next_text")))
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(let(words, beside)).alias("w")).select("doc_id", "w.*")


def kind_of(token: Column) -> Column:
    """Kind of a whole token.  Words and spaces, the bulk, are tested first: no other pattern matches all of one."""
    by = F.when(token.rlike(rf"^(?:{WORD})$"), "word").when(token.rlike(r"^\s+$"), "space")
    for kind, pattern in KINDS:
        if kind not in ("word", "space"):
            by = by.when(token.rlike(rf"^(?:{pattern})$"), kind)
    return by.otherwise("punctuation")


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is read."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True, spaces: bool = False) -> DataFrame:
    """(doc_id, pos, text, kind[, start, end]): every token of every text.  Null
    texts have none.  Offsets are running sums over a document's tokens, by a window."""
    t = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(QUICK), F.lit(0))).alias("pos", "text"))
    if offsets:
        upto = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
        t = t.withColumn("start", F.coalesce(F.sum(F.length("text")).over(upto), F.lit(0)).cast("int")).withColumn("end", (F.col("start") + F.length("text")).cast("int"))
    t = t.withColumn("kind", kind_of(F.col("text")))
    out = t if spaces else t.where("kind <> 'space'")
    return out.select("doc_id", "pos", "text", "kind", *(["start", "end"] if offsets else []))


#: Between tokens when they are joined to be searched: no token has it inside, nor makes it with the next one.
BETWEEN = "\u0001\n"
#: Tokens searched for a neighbour at first, and how many times more each time none is found.
NEAR, WIDER = 6, 64


def is_word(token: Column) -> Column:
    return token.rlike(rf"^(?:{WORD})$")


def is_number(token: Column) -> Column:
    """Whether the kind is number: no pattern before it matches, as that of dates does."""
    names = [k for k, _ in KINDS]
    earlier = "|".join(p for _, p in KINDS[: names.index("number")])
    return token.rlike(rf"^(?:{NUMBER})$") & ~token.rlike(rf"^(?:{earlier})$")


def tokens_in_place(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, text, all, blocks): the tokens of ``tokenize`` without the
    blanks, each with its text's array of tokens, which ``word_beside`` and
    ``start_of`` read; where these are not used, it is not carried along."""
    t = docs.select(F.col(id_col).alias("doc_id"), F.regexp_extract_all(F.col(text_col), F.lit(QUICK), F.lit(0)).alias("all"))
    t = t.withColumn("blocks", _blocks(F.col("all")))
    # not the bare column: Spark would then test its size first, and cut the text into tokens twice
    t = t.select("doc_id", "all", "blocks", F.posexplode(F.concat("all", F.array().cast("array<string>"))).alias("pos", "text"))
    return t.where("text <> ' '")


def _block_size(all_: Column) -> Column:
    return F.greatest(F.lit(64), F.floor(F.sqrt(F.size(all_)))).cast("int")


def _blocks(all_: Column) -> Column:
    """Offsets at which blocks of tokens begin, so that a token's own is a sum over its block."""
    size = _block_size(all_)
    lengths = F.transform(F.sequence(F.lit(0), F.greatest(F.size(all_), F.lit(0)), size), lambda i: F.length(F.array_join(F.slice(all_, i + 1, size), "")))
    return let(lengths, lambda ls: F.transform(ls, lambda _, i: F.aggregate(F.slice(ls, F.lit(1), i), F.lit(0), lambda a, x: a + x)))


def start_of(all_: Column, blocks: Column, pos: Column) -> Column:
    """Offset of the token at ``pos``, in code points."""
    size = _block_size(all_)
    nth = F.floor(pos / size).cast("int")
    return F.get(blocks, nth) + F.length(F.array_join(F.slice(all_, nth * size + 1, pos - nth * size), ""))


def word_beside(all_: Column, pos: Column, before: bool) -> Column:
    """The nearest word before or after the token at ``pos``, null if there is
    none.  Further tokens are searched only where nearer ones are no words."""
    left = pos if before else F.size(all_) - 1 - pos
    pattern = rf"(?s)^(?:.*{BETWEEN})?({WORD})(?={BETWEEN}|\z)" if before else rf"(?:^|{BETWEEN})({WORD})(?={BETWEEN}|\z)"
    found, sought = [], 0
    for n in (NEAR, NEAR * WIDER, None):
        many = left if n is None else F.least(left, F.lit(n))
        part = F.slice(all_, (pos - many if before else pos + 1) + 1, many)
        found.append(F.when(left > sought, F.get(F.regexp_extract_all(F.array_join(part, BETWEEN), F.lit(pattern), F.lit(1)), F.lit(0))))
        sought = n
    return F.coalesce(*found)


def marked_words(text: Column) -> Column:
    """The text with BEGIN before and END after each token that is a word: words
    are counted, found and cut out of it by native string functions."""
    plain = F.translate(text, TOKEN + BEGIN + END, OTHER * 3)
    tokens = F.regexp_replace(plain, QUICK, f"{TOKEN}$0")
    return F.replace(F.regexp_replace(tokens, rf"{TOKEN}({WORD})(?={TOKEN}|\z)", f"{BEGIN}$1{END}"), F.lit(TOKEN), F.lit(""))


# -- normalization


def js_number(value: Column) -> Column:
    """A double as text: no fraction when it is whole."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def parse_number(text: Column) -> Column:
    """Value of a number with '.' between thousands and ',' before decimals."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\.(\d{3})", "$1"), ",", ".")
    return plain.try_cast("double")


def token_fields(kind: Column, text: Column) -> Column:
    """The attributes of a token: cc, number, year … second, value, currency, unit, username."""
    part = lambda p, g=1: F.nullif(F.regexp_extract(text, p, g), F.lit(""))
    whole = lambda c: c.try_cast("int")
    dated, iso, dmy = kind.isin("date", "timestamp"), r"^(\d{4})-(\d{2})-(\d{2})", r"^(\d{1,2})\.(\d{1,2})\.(\d{4})"
    clock = r"(?:^|T)(\d{1,2}):(\d{2})(?::(\d{2}))?"
    timed = kind.isin("time", "timestamp")
    digits = F.regexp_replace(text, r"[^\d]", "")
    cc = F.when(kind == "telno", part(r"^\+(\d{1,3})[- ]?\d{3}-?\d{4}$"))
    currency = F.create_map(*[F.lit(x) for kv in CURRENCIES.items() for x in kv])
    sign = F.coalesce(part(r"^([$€£])"), part(r"\s?([a-zA-Z]+)$"))
    unit = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    valued = kind.isin("amount", "percent", "measurement", "number")
    return F.struct(
        F.when(cc.isNotNull(), F.concat(F.lit("+"), cc)).alias("cc"),
        F.when(kind == "telno", F.right(digits, F.lit(7))).when(kind == "ssn", digits).alias("number"),
        F.when(dated, whole(F.coalesce(part(iso), part(dmy, 3)))).alias("year"),
        F.when(dated, whole(F.coalesce(part(iso, 2), part(dmy, 2)))).alias("month"),
        F.when(dated, whole(F.coalesce(part(iso, 3), part(dmy, 1)))).alias("day"),
        F.when(timed, whole(part(clock))).alias("hour"),
        F.when(timed, whole(part(clock, 2))).alias("minute"),
        F.when(timed, F.coalesce(whole(part(clock, 3)), F.lit(0))).alias("second"),
        F.when(valued, parse_number(part(rf"({NUMBER})"))).alias("value"),
        F.when(kind == "amount", F.coalesce(F.try_element_at(currency, sign), sign)).alias("currency"),
        F.when(kind == "measurement", F.coalesce(F.try_element_at(unit, part(r"([a-z]+)$")), part(r"([a-z]+)$"))).alias("unit"),
        F.when(kind == "username", F.substring(text, 2, 1 << 30)).alias("username"),
    )


def normalize_token(kind: Column, text: Column, fields: Column, include_numbers: bool = True) -> Column:
    """The normal form of a token that is no word, null if it has none."""
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    f = fields
    day = F.concat_ws("-", pad(f.month), pad(f.day))
    date = F.when(f.year > 0, F.concat_ws("-", f.year.cast("string"), day)).otherwise(day)
    minute = F.concat_ws(":", pad(f.hour), pad(f.minute))
    stamp = F.concat(f.year.cast("string"), F.lit("-"), day, F.lit("T"), minute, F.lit(":"), pad(f.second))
    value = js_number(f.value)
    out = (
        F.when(kind == "telno", F.concat(F.coalesce(f.cc, F.lit("")), f.number))
        .when(kind.isin("email", "domain"), F.lower(text))
        .when(kind == "url", text)
        .when(kind.isin("date", "dateabs", "daterel"), date)
        .when(kind == "time", F.when(f.second > 0, F.concat(minute, F.lit(":"), pad(f.second))).otherwise(minute))
        .when(kind.isin("timestamp", "timestampabs", "timestamprel"), stamp)
        .when(kind == "ssn", F.concat(F.substring(f.number, 1, 6), F.lit("-"), F.substring(f.number, 7, 100)))
        .when(kind == "amount", F.concat(value, F.lit(" "), f.currency))
        .when(kind == "measurement", F.concat(value, F.lit(" "), f.unit))
        .when(kind == "percent", F.concat(value, F.lit("%")))
        .when(kind == "hashtag", F.concat(F.lit("#"), F.lower(F.substring(text, 2, 1 << 30))))
        .when(kind == "username", F.concat(F.lit("@"), F.lower(f.username)))
        .when(kind == "year", f.year.cast("string"))
    )
    return out.when(kind.isin("number", "ordinal"), value) if include_numbers else out


def number_form(text: Column) -> Column:
    """The first number of a text, as ``js_number`` of ``parse_number`` shows it."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, f"({NUMBER})", 1), r"\.(\d{3})", "$1"), ",", ".")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", ""), r"^0+(?=\d)", "")


def normal_form(kind: Column, text: Column, include_numbers: bool = True) -> Column:
    """``normalize_token`` straight from the token's text, in one small expression;
    the form of corpus jobs.  Tokenizers that tell more than the text does give
    fields, which ``normalize_token`` reads."""
    currency = F.create_map(*[F.lit(x) for kv in CURRENCIES.items() for x in kv])
    unit = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    symbol, letters = F.regexp_extract(text, r"^([$€£])|([a-zA-Z]+)$", 0), F.regexp_extract(text, r"[a-z]+$", 0)
    out = (
        F.when(kind == "telno", F.regexp_replace(text, r"[- ]", ""))
        .when(kind.isin("email", "domain", "hashtag", "username"), F.lower(text))
        .when(kind == "url", text)
        .when(kind.isin("date", "dateabs", "daterel"), F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"^(\d)\.", "0$1."), r"\.(\d)\.", ".0$1."), r"^(\d{2})\.(\d{2})\.(\d{4})$", "$3-$2-$1"))
        .when(kind == "time", F.regexp_replace(F.regexp_replace(text, r"^(\d):", "0$1:"), r"^(\d{2}:\d{2}):00$", "$1"))
        .when(kind.isin("timestamp", "timestampabs", "timestamprel"), F.regexp_replace(text, r"(T\d{2}:\d{2})$", "$1:00"))
        .when(kind == "year", F.nullif(F.regexp_extract(text, r"\d+", 0), F.lit("")))
        .when(kind == "ssn", F.regexp_replace(text, r"^(\d{6})-?(\d{4})$", "$1-$2"))
        .when(kind == "amount", F.concat_ws(" ", number_form(text), F.coalesce(F.try_element_at(currency, symbol), symbol)))
        .when(kind == "measurement", F.concat_ws(" ", number_form(text), F.coalesce(F.try_element_at(unit, letters), letters)))
        .when(kind == "percent", F.concat(number_form(text), F.lit("%")))
    )
    return out.when(kind.isin("number", "ordinal"), number_form(text)) if include_numbers else out
