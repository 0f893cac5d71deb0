"""TEI-XML corpora: gold sentences with lemmas and tags, in document order."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SENTENCES = "path string, category string, sentence_index int, text string, tokens array<struct<form:string,lemma:string,pos:string>>"
_CLOSE = regex.compile(r"\s+([.,;:!?)\]»”’])")
_OPEN = regex.compile(r"([(\[«„‘])\s+")


def join_tokens(tokens: list[str]) -> str:
    """Sentence text without spaces before closing and after opening marks."""
    return _OPEN.sub(r"\1", _CLOSE.sub(r"\1", " ".join(tokens)))


def sentences_of(data: bytes) -> list[tuple[str, list[tuple[str, str, str]]]]:
    """(text, word tokens) of each ``<s>``; empty for a file that is not well-formed XML."""
    try:
        root = ET.fromstring(data)
    except ET.ParseError:
        return []
    local = lambda e: e.tag.rpartition("}")[2]
    out = []
    for s in (e for e in root.iter() if local(e) == "s"):
        shown, words = [], []
        for e in s.iter():
            if local(e) in ("w", "c", "pc"):
                form = "".join(e.itertext()).strip()
                if form:
                    shown.append(form)
                    if local(e) == "w":
                        words.append((form, e.get("lemma") or "", e.get("type") or e.get("pos") or ""))
        if words:
            out.append((join_tokens(shown), words))
    return out


def read_tei(spark: SparkSession, path: str, pattern: str = "*.xml", skip: tuple[str, ...] = ("otbHdr.xml",), recursive: bool = True, max_sentences: int | None = None) -> DataFrame:
    """Sentences of TEI files; the category is the file's folder below ``path``.  Broken files give none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    base = path.rstrip("/").rpartition("/")[2]
    rest = F.element_at(F.split("path", f"/{base}/"), -1)
    files = files.where(~name.isin(*skip)).select("path", F.when(rest.contains("/"), F.element_at(F.split(rest, "/"), 1)).otherwise(F.lit("")).alias("category"), "content")

    def run(batches):
        kind = pa.list_(pa.struct([("form", pa.string()), ("lemma", pa.string()), ("pos", pa.string())]))
        for batch in batches:
            rows = [(p, c, i, text, [dict(zip(("form", "lemma", "pos"), w)) for w in words]) for p, c, x in zip(*(col.to_pylist() for col in batch.columns)) for i, (text, words) in enumerate(sentences_of(x))]
            cells = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, (pa.string(), pa.string(), pa.int32(), pa.string(), kind))], names=["path", "category", "sentence_index", "text", "tokens"])

    out = files.mapInArrow(run, SENTENCES)
    return out if max_sentences is None else out.orderBy("path", "sentence_index").limit(max_sentences)
