"""Index terms of a document stream.

Context stays inside a row (arrays and higher-order functions), so the query is
stateless: a projection and a stream-static join, in append mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokenize import words_of
from ..operators.lexicon import lemmas_of, with_entries


def stream_postings(docs: DataFrame, nested: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, word, lemmas) of a batch or streaming table; the lexicon is static."""
    words = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(words_of(F.col(text_col))).alias("pos", "word"))
    return with_entries(words, nested).select("doc_id", "pos", "word", lemmas_of(F.col("word"), F.col("entries")).alias("lemmas"))


def index_stream(docs: DataFrame, nested: DataFrame, sink: str, checkpoint: str, trigger: dict | None = None):
    """Write ``stream_postings`` of a stream to Parquet; returns the running query."""
    return stream_postings(docs, nested).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def process_stream(docs: DataFrame, process, sink: str, checkpoint: str, trigger: dict | None = None):
    """Apply a batch function (DataFrame -> DataFrame, such as ``process_text``)
    to every micro-batch.  Each batch writes its own folder, so a batch that is
    run again after a failure replaces its rows instead of repeating them."""

    def each(batch: DataFrame, n: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{sink}/batch={n}")

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
