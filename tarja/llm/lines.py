r"""Operator 8: line dedup with overlapping three-line windows.

The lines of a text (split at \n) that hold something other than space and U+0009 to U+000D are
numbered, and each three in a row make a window, filed under 128 bits of hash. Of the windows that
stand twice or more anywhere, the first by doc_id and place stays and the later ones are covered; a line
in a covered window is removed with its line break. Blank lines stay. So of a block of at
least three lines that repeats, one copy remains, and single lines that repeat are left alone.

Windows are counted by hash with map-side combine, so a window in a third of all texts sends one row
from each task; only hashes that repeat meet the windows again, in a join whose large
keys adaptive execution splits. The texts are shuffled once, to meet their removed lines.

A null text stays null and has no lines. Rows alike in doc_id are told apart by their text; rows alike in both are one text,
which is its own first occurrence. A null doc_id orders first. A text of under three such lines stays
as it is; an empty table gives an empty result; extra columns are kept by ``dedup_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import forget, shared_folder, table, written

WINDOW = 3

ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents
), n AS (
  SELECT doc_id, text, lines, list_filter(range(1, len(lines) + 1), lambda i: regexp_matches(lines[i], '[^\x20\x09-\x0D]')) AS full_at FROM d
), w AS (
  SELECT doc_id, k, full_at, [lines[full_at[k]], lines[full_at[k + 1]], lines[full_at[k + 2]]] AS win
  FROM (SELECT doc_id, lines, full_at, unnest(range(1, len(full_at) - 1)) AS k FROM n)
), f AS (
  SELECT doc_id, k, full_at, row_number() OVER (PARTITION BY win ORDER BY doc_id, k) AS nth FROM w
), c AS (
  SELECT doc_id, list_distinct(flatten(list([full_at[k], full_at[k + 1], full_at[k + 2]]))) AS gone FROM f WHERE nth > 1 GROUP BY doc_id
)
SELECT n.doc_id, CAST(len(n.full_at) AS INTEGER) AS n_lines, CAST(coalesce(len(c.gone), 0) AS INTEGER) AS n_removed,
  CASE WHEN c.gone IS NULL THEN n.text
       ELSE array_to_string([n.lines[i] FOR i IN range(1, len(n.lines) + 1) IF NOT list_contains(c.gone, i)], chr(10)) END AS text
FROM n LEFT JOIN c USING (doc_id)
"""


def _lines() -> Column:
    return F.split(F.coalesce(F.col("text"), F.lit("")), "\n")


def _full(lines: Column) -> Column:
    """The indices, from 0, of lines that aren't blank."""
    marked = F.transform(lines, lambda x, i: F.when(x.rlike(r"[^\x20\x09-\x0D]"), i))
    return F.array_compact(marked)


def covered_lines(docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, th, gone): for each text that loses lines, their indices. th: hash of the text."""
    own = docs.select("doc_id", F.xxhash64("text").alias("th"), _lines().alias("lines")).withColumn("full", _full(F.col("lines"))).where(F.size("full") >= WINDOW)
    # the hash runs over lines in front of one another, so a window is hashed as an array
    kept = own.select("doc_id", "th", "full", F.transform("full", lambda i: F.get("lines", i)).alias("lines"))
    hashed = F.transform(
        F.sequence(F.lit(1), F.size("lines") - (WINDOW - 1)),
        lambda k: F.struct(F.xxhash64(F.slice("lines", k, WINDOW)).alias("h1"), F.xxhash64(F.lit(11), F.slice("lines", k, WINDOW)).alias("h2"), F.slice("full", k, WINDOW).alias("at")),
    )
    windows = written(kept.select("doc_id", "th", F.explode(hashed).alias("w")).select("doc_id", "th", "w.h1", "w.h2", F.get("w.at", F.lit(0)).alias("a"), F.get("w.at", F.lit(1)).alias("b"), F.get("w.at", F.lit(2)).alias("c")), folder, "windows")
    place = F.struct("doc_id", "a", "th")
    repeated = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).select("h1", "h2", "first")
    # written, so that both sides of the join are plain shuffles, and a window in very many texts can be split
    repeated = written(repeated, folder, "repeated")
    later = windows.join(repeated, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    gone = later.groupBy("doc_id", "th").agg(F.array_distinct(F.flatten(F.collect_list(F.array("a", "b", "c")))).alias("gone"))
    gone = written(gone, folder, "gone")
    forget(docs.sparkSession, folder, "windows", "repeated")
    return gone


def _without_gone(docs: DataFrame) -> DataFrame:
    folder = shared_folder(docs.sparkSession)
    base = docs.withColumn("text", F.col("text").cast("string"))
    own = base.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gone = covered_lines(own, folder).select(F.col("doc_id").alias("__doc"), F.col("th").alias("__th"), F.col("gone").alias("__gone"))
    gone = gone.hint("merge")  # what is lost grows with the rows, so it isn't broadcast where it happens to be small
    met = base.join(gone, base["doc_id"].cast("long").eqNullSafe(gone["__doc"]) & (F.xxhash64(base["text"]) == gone["__th"]), "left")

    def kept(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))  # by hash, so linear in the lines
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    return met.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(let(_lines(), kept)))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts that remain, all other columns as they were; n_chars, if there, follows the text."""
    out = _without_gone(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))) if "n_chars" in docs.columns else out


def line_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, text): lines that aren't blank, how many went, and what remains."""
    gone = F.coalesce(F.size("__gone"), F.lit(0))
    out = _without_gone(docs.select("doc_id", "text"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), (F.size(_full(_lines())) + gone).alias("n_lines"), gone.alias("n_removed"), "text")


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))
