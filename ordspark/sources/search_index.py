"""Searchable document tables, and their sink in a relational database."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def search_documents(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, body, lemmas) with a document's index terms joined by spaces, as a
    database's plain text search takes them; documents without terms have "".
    ``terms`` is the result of ``index_terms``."""
    joined = terms.select("doc_id", F.array_join("terms", " ").alias("lemmas"))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body"))
    return base.join(joined, "doc_id", "left").select("doc_id", "body", F.coalesce("lemmas", F.lit("")).alias("lemmas"))


def write_jdbc(rows: DataFrame, url: str, table: str, mode: str = "append", connections: int = 8, batch: int = 1000, **options: str) -> None:
    """Write ``rows`` to a database over JDBC.  Each task commits its own rows, so
    a lost executor can leave repeated ones: give the table a key, or use
    mode="overwrite" and read it only afterwards.  ``connections`` bounds how many
    tasks write at a time."""
    rows.coalesce(connections).write.mode(mode).options(url=url, dbtable=table, batchsize=str(batch), **options).format("jdbc").save()


def read_jdbc(spark, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
