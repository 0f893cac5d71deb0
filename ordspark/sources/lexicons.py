"""Reading and writing lexicons, n-gram lists and gold corpora."""

from __future__ import annotations

import struct
import warnings

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import resources as R
from ..schemas import BIGRAMS, DICTIONARY, GOLD, LEXICON, LEXICON_NESTED, SAMPLED, UNIGRAMS


def _checked(df: DataFrame, schema) -> DataFrame:
    missing = set(schema.names) - set(df.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema])


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """The flat lexicon from Parquet on any Hadoop file system."""
    return _checked(spark.read.parquet(path), LEXICON)


def read_nested(spark: SparkSession, path: str) -> DataFrame:
    return _checked(spark.read.parquet(path), LEXICON_NESTED)


def write_lexicon(lexicon: DataFrame, path: str) -> None:
    """Parquet sorted by word, so that lookups of word ranges prune row groups."""
    lexicon.repartitionByRange("word").sortWithinPartitions("word", *(["rank"] if "rank" in lexicon.columns else [])).write.mode("overwrite").parquet(path)


def lexicon_from_rows(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(rows, LEXICON)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon-separated dictionary rows; five columns have no mark, fewer are dropped, more are ignored."""
    raw = spark.read.text(path).select(F.split("value", ";").alias("c")).where(F.size("c") >= 5)
    return raw.select(*[F.coalesce(F.get("c", F.lit(i)), F.lit("")).alias(f.name) for i, f in enumerate(DICTIONARY)])


def _present(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern names a file; warns if not."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    if not found:
        warnings.warn(f"{path} not found, read as empty", stacklevel=3)
    return bool(found)


def read_unigrams(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object {word: frequency} per file, gzip or plain; a missing file is empty, with a warning."""
    if not _present(spark, path):
        return spark.createDataFrame([], UNIGRAMS)
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,bigint>")).alias("word", "freq")).to(UNIGRAMS)


def read_bigrams(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of [w1, w2, frequency] per file, gzip or plain; a missing file is empty, with a warning."""
    if not _present(spark, path):
        return spark.createDataFrame([], BIGRAMS)
    t = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<array<string>>")).alias("t"))
    return t.select(F.get("t", F.lit(0)).alias("w1"), F.get("t", F.lit(1)).alias("w2"), F.get("t", F.lit(2)).cast("long").alias("freq")).to(BIGRAMS)


def read_stopwords(spark: SparkSession, path: str) -> list[str]:
    """The words of a text file, one a line (a list of some hundred words), lower-cased, as operators take them."""
    words = spark.read.text(path).select(F.lower(F.btrim("value")).alias("w")).where("w <> ''").distinct()
    return sorted(r.w for r in words.collect())


def write_lookup_tsv(nested: DataFrame, lemmas: DataFrame, path: str) -> None:
    """Legacy text form ``word<TAB>index:pos,…``; ``lemmas`` is (lemma, idx).
    Words whose only lemma is the word itself are left out."""
    flat = nested.select("word", F.posexplode("entries").alias("at", "e")).select("word", "at", "e.lemma", "e.pos").join(lemmas, "lemma")
    rows = flat.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("at", "idx", "pos", "lemma"))).alias("x"))
    rows = rows.where(~((F.size("x") == 1) & (F.get("x", F.lit(0)).lemma == F.col("word"))))
    cell = F.array_join(F.transform("x", lambda e: F.concat_ws(":", e.idx.cast("string"), e.pos)), ",")
    rows.select(F.concat_ws("\t", "word", cell).alias("value")).write.mode("overwrite").text(path)


def write_lemma_list(lemmas: DataFrame, path: str) -> None:
    lemmas.select(F.col("lemma").alias("value")).write.mode("overwrite").text(path)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold sentences, one JSON object a line, with their tokens."""
    return spark.read.schema(GOLD).json(path)


def gold_tokens(gold: DataFrame) -> DataFrame:
    return gold.select(F.concat_ws("#", "docId", "sentenceIndex").alias("sentence"), "category", F.posexplode("tokens").alias("pos", "t")).select("sentence", "category", "pos", "t.form", F.col("t.lemma").alias("gold"), F.col("t.pos").alias("gold_pos"))


def read_sampled(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLED).json(path)


def sample_documents(docs: DataFrame, per_config: int, least: int = 100, most: int = 5_000) -> DataFrame:
    """Documents of at least ``least`` trimmed characters, cut to ``most``, up to ``per_config`` of each config by id."""
    from pyspark.sql import Window as W

    nth = F.row_number().over(W.partitionBy("config").orderBy("uuid"))
    return docs.where(F.length(F.btrim("text")) >= least).withColumn("n", nth).where(F.col("n") <= per_config).select("config", "uuid", F.substring("text", 1, most).alias("text"))


# -- packed lexicon files

# Magic number and supported versions of packed lexicon files.
MAGIC = 0x4C454D41
VERSIONS = (1, 2)


def unpack_entry(value: int, version: int) -> tuple[int, str, str | None, str | None, str | None]:
    """(lemma index, pos, case, gender, number) of a packed entry.  Number code 0 is singular."""
    code = lambda table, i: table[i] if i < len(table) else None
    pos = code(R.POS_CODES, value & 15) or ""
    if version == 1:
        return value >> 4, pos, None, None, "et"
    return value >> 10, pos, code(R.CASE_CODES, value >> 4 & 7), code(R.GENDER_CODES, value >> 7 & 3), code(R.NUMBER_CODES, value >> 9 & 1)


class _Packed:
    """The sections of a packed file.

    Header of eight 32-bit words: magic, version, pool size, lemmas, words,
    entries, bigrams, reserved.  Then, each 4-byte aligned: the string pool,
    lemma offsets (u32) and lengths (u8), word offsets and lengths, entry
    offsets (words + 1), entries, offsets and lengths of the bigrams' first
    words, of their second words, and frequencies (u32).
    """

    def __init__(self, data: bytes):
        if len(data) < 32:
            raise ValueError("too short for a packed lexicon")
        magic, self.version, pool, *counts, _ = struct.unpack_from("<8I", data)
        if magic != MAGIC:
            raise ValueError("bad magic number")
        if self.version not in VERSIONS:
            raise ValueError(f"unsupported version {self.version}")
        n_lemmas, n_words, n_entries, n_bigrams = counts
        self._data, self._at = data, 32 + -(-pool // 4) * 4
        self._pool = data[32 : 32 + pool]
        try:
            self.lemmas, self.words = self._strings(n_lemmas), self._strings(n_words)
            self.first, self.entries = self._numbers("I", n_words + 1), self._numbers("I", n_entries)
            w1, w2 = self._strings(n_bigrams), self._strings(n_bigrams)
            self.bigrams = list(zip(w1, w2, self._numbers("I", n_bigrams)))
        except struct.error as e:
            raise ValueError("a packed lexicon ends early") from e

    def _numbers(self, kind: str, n: int) -> tuple[int, ...]:
        out = struct.unpack_from(f"<{n}{kind}", self._data, self._at)
        self._at += -(-struct.calcsize(f"<{n}{kind}") // 4) * 4
        return out

    def _strings(self, n: int) -> list[str]:
        places = zip(self._numbers("I", n), self._numbers("B", n))
        return [self._pool[at : at + size].decode() for at, size in places]


def parse_packed(data: bytes) -> list[tuple]:
    """(word, rank, lemma, pos, gcase, gender, gnumber) rows of a packed file."""
    p = _Packed(data)
    rows = []
    for i, word in enumerate(p.words):
        for rank, value in enumerate(p.entries[p.first[i] : p.first[i + 1]], 1):
            lemma, *rest = unpack_entry(value, p.version)
            rows.append((word, rank, p.lemmas[lemma], *rest))
    return rows


def parse_packed_bigrams(data: bytes) -> list[tuple[str, str, int]]:
    """(w1, w2, freq) rows of a packed file; none if it was built without bigrams."""
    return _Packed(data).bigrams


def pack(rows: list[tuple], version: int = 2, bigrams: list[tuple[str, str, int]] = ()) -> bytes:
    """The packed file of flat lexicon rows and bigrams (the inverse of
    ``parse_packed`` and ``parse_packed_bigrams``); bigrams are stored by (w1, w2)."""
    bigrams = sorted(bigrams)
    lemmas = sorted({r[2] for r in rows})
    words = sorted({r[0] for r in rows})
    number = {x: i for i, x in enumerate(lemmas)}
    pool, place = bytearray(), {}
    for s in dict.fromkeys([*lemmas, *words, *(w for x in bigrams for w in x[:2])]):
        place[s] = (len(pool), len(s.encode()))
        pool += s.encode()
    code = lambda table, x: table.index(x) if x in table else 0
    by_word: dict[str, list[int]] = {w: [] for w in words}
    for word, _, lemma, pos, case, gender, num in sorted(rows, key=lambda r: (r[0], r[1])):
        p = R.POS_CODES.index(pos) if pos in R.POS_CODES else 10
        e = number[lemma] << 4 | p if version == 1 else number[lemma] << 10 | code(R.NUMBER_CODES, num) << 9 | code(R.GENDER_CODES, gender) << 7 | code(R.CASE_CODES, case) << 4 | p
        by_word[word].append(e)
    pad = lambda b: bytes(b) + b"\0" * (-len(b) % 4)
    first = [0]
    for w in words:
        first.append(first[-1] + len(by_word[w]))
    entries = [e for w in words for e in by_word[w]]
    out = struct.pack("<8I", MAGIC, version, len(pool), len(lemmas), len(words), len(entries), len(bigrams), 0) + pad(pool)
    numbers = lambda kind, values: pad(struct.pack(f"<{len(values)}{kind}", *values))
    strings = lambda names: numbers("I", [place[s][0] for s in names]) + numbers("B", [place[s][1] for s in names])
    out += strings(lemmas) + strings(words) + numbers("I", first) + numbers("I", entries)
    return out + strings([x[0] for x in bigrams]) + strings([x[1] for x in bigrams]) + numbers("I", [x[2] for x in bigrams])


def _read_files(spark: SparkSession, path: str, parse, schema) -> DataFrame:
    kinds = [pa.int64() if f.dataType.simpleString() == "bigint" else pa.int32() if f.dataType.simpleString() == "int" else pa.string() for f in schema]

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = parse(content.as_py())
                columns = zip(*rows) if rows else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """The flat lexicon of packed files; a file (tens of MB) is one task's work."""
    return _read_files(spark, path, parse_packed, LEXICON)


def read_packed_bigrams(spark: SparkSession, path: str) -> DataFrame:
    """(w1, w2, freq) of packed files."""
    return _read_files(spark, path, parse_packed_bigrams, BIGRAMS)
