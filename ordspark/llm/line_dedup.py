"""Removal of repeated three-line windows, in DataFrame functions only.

Blank lines are set aside; every three consecutive other lines of a document
form a window, and windows overlap.  A window's identity is a 128-bit hash of
its trimmed lines.  Over the whole table the first occurrence of a window, by
(doc_id, position), stays; the lines that later occurrences cover are merged
into one set of positions per document and removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows without an id come after all others.
_LAST = (1 << 63) - 1
#: Characters trimmed from both ends of a line before it is compared.
TRIM = " \t\r"


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``docs`` with repeated lines removed from the text, and two more columns,
    n_lines and n_removed (longs; they replace columns of these names).

    Null texts stay null with 0 lines.  Texts of fewer than ``width`` non-blank
    lines have no window and stay as they are; blank lines always stay.  Rows
    that repeat an id and a text are one document and get the same result; rows
    with a null id rank after all others, by a hash of their text.

    Windows are counted with partial aggregation before they move; the join back
    is an equi-join that Spark can split where a window is frequent.  A
    document's removed positions are bounded by its own lines.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    base = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"),
        F.xxhash64(text_col).alias("h"),
        F.split(F.col(text_col), "\n", -1).alias("lines"),
        row.alias("row"),
    )
    full = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("at"), F.btrim(x, F.lit(TRIM)).alias("line"))), lambda x: x.line != "")
    windows = (
        base.select("id", "h", full.alias("full"))
        .where(F.size("full") >= width)
        .select(
            "id",
            "h",
            F.explode(
                F.transform(
                    F.sequence(F.lit(1), F.size("full") - (width - 1)),
                    lambda i: F.struct(
                        F.xxhash64(*[F.element_at("full", i + k).line for k in range(width)]).alias("w1"),
                        F.xxhash64(F.lit("second"), *[F.element_at("full", i + k).line for k in range(width)]).alias("w2"),
                        F.array(*[F.element_at("full", i + k)["at"] for k in range(width)]).alias("covers"),
                    ),
                )
            ).alias("w"),
        )
        .select("id", "h", "w.w1", "w.w2", "w.covers")
    )
    place = F.struct("id", "h", F.col("covers")[0].alias("at"))
    repeated = windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select("w1", "w2", "first")
    later = windows.join(repeated, ["w1", "w2"]).where(place > F.col("first"))
    removed = later.groupBy("id", "h").agg(F.array_distinct(F.flatten(F.collect_list("covers"))).alias("gone"))
    out = base.select("id", "h", "row").join(removed, ["id", "h"], "left")
    lines = F.split(F.col(f"row.`{text_col}`"), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col(f"row.`{text_col}`")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    keep = [text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*keep, F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL
), filled AS (
  SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13)) AS a FROM lines WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''
), windows AS (
  SELECT doc_id, pos, a, lead(a) OVER w AS b, lead(a, 2) OVER w AS c, lead(pos) OVER w AS pos_b, lead(pos, 2) OVER w AS pos_c FROM filled WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS nth FROM windows WHERE c IS NOT NULL
), gone AS (
  SELECT doc_id, pos FROM ranked WHERE nth > 1 UNION SELECT doc_id, pos_b FROM ranked WHERE nth > 1 UNION SELECT doc_id, pos_c FROM ranked WHERE nth > 1
), marked AS (
  SELECT l.doc_id, l.line, l.pos, g.pos IS NOT NULL AS removed FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos
), joined AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT removed), '') AS text, count(*) AS n_lines, count(*) FILTER (WHERE removed) AS n_removed FROM marked GROUP BY doc_id
)
SELECT d.doc_id, j.text, coalesce(j.n_lines, 0) AS n_lines, coalesce(j.n_removed, 0) AS n_removed FROM documents d LEFT JOIN joined j ON d.doc_id = j.doc_id
"""
