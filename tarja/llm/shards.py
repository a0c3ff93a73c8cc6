"""Operator 10: sharding along a Hilbert curve.

Three metadata dimensions, language, source and size, are quantised to 16 steps each, by rank: a value's
step is 16 times the part of all rows with a smaller value, so steps are ordered ranges of values that hold
about as many rows each. A cell's place on the Hilbert curve through the 4,096 cells orders the rows, so that a
shard covers a small box of all three, and smallest and largest values of its files let a reader that filters
on any of them skip most files. The ordered rows are cut into runs under the law ``rows``: counts
differ by one at most.

A row's rank needs no global sort. Values are counted, and counts summed up in ranges of values, one partition
each; rows are counted by cell and by parts of a cell, and the counts are summed up along the
curve (4,096 rows at most in one task, and the parts within each cell); only the rank inside a part
is a sorted window. Inside a cell rows are ordered by the MD5 of doc_id, and a part is a range of it, of about
PART rows if all rows were in one cell. So a cell that holds a third of all rows is many tasks' work.

Order inside a part: MD5 of doc_id, doc_id, size, then CRC of the text, nulls first. A null language or source
counts as an empty one, a null text as an empty text. Repeated rows each get a slot. Fewer rows than shards leave the
last shards short; an empty table gives an empty result. Extra columns are ignored by ``assign_shards`` and kept by
``write_shards``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder, table, written

SHARDS = 16
BITS = 4
#: Rows of one part of a cell, about.
PART = 1 << 17
DIMENSIONS = ("lang", "source", "size")

def hilbert_index(cell: tuple[int, ...], bits: int) -> int:
    """The place of a cell on the Hilbert curve, by walking down the cube: at each level the half
    of each axis is read, mapped through the orientation so far, and the orientation turns."""
    n = len(cell)
    entry, direction, index = 0, 0, 0

    def left(x: int, by: int) -> int:
        by %= n
        return ((x << by) | (x >> (n - by))) & ((1 << n) - 1)

    for level in range(bits - 1, -1, -1):
        halves = sum(((c >> level) & 1) << k for k, c in enumerate(cell))
        gray = left(halves ^ entry, n - (direction + 1))
        step, rest = gray, gray >> 1
        while rest:
            step ^= rest
            rest >>= 1
        index = (index << n) | step
        start = 0 if step == 0 else 2 * ((step - 1) // 2)
        start ^= start >> 1
        turn = 0
        if step:
            odd = step if step % 2 else step - 1
            while odd >> turn & 1:
                turn += 1
        entry ^= left(start, direction + 1)
        direction = (direction + turn + 1) % n
    return index


def curve(bits: int = BITS) -> list[int]:
    """Place on the curve by x * side² + y * side + z."""
    side = range(1 << bits)
    return [hilbert_index((x, y, z), bits) for x in side for y in side for z in side]


def _steps(rows: DataFrame, name: str, total: int, folder: str) -> DataFrame:
    """(value, step) for each value of a column: 16 times the part of all rows with a smaller value."""
    counts = rows.groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n"))
    ranges = written(counts.repartitionByRange("value").withColumn("range", F.spark_partition_id()), folder, f"values-{name}")
    sums = ranges.groupBy("range").agg(F.sum("n").alias("m"))
    none, before = F.lit(0).cast("long"), lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("range", F.coalesce(F.sum("m").over(before("range")), none).alias("ahead"))
    smaller = F.col("ahead") + F.coalesce(F.sum("n").over(before("range", "value")), none)
    return ranges.join(sums, "range").select(F.col("value").alias(name), smaller.alias("smaller")).select(name, F.expr(f"cast(({1 << BITS} * smaller) div {total}L as int)").alias(f"{name}_step"))


def _described(docs: DataFrame) -> dict:
    """The columns that decide a row's place."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    return {"doc_id": F.col("doc_id").cast("long"), "lang": name("lang"), "source": name("source"), "size": F.octet_length(text).cast("long") + 1, "text_crc32": F.crc32(F.encode(text, "UTF-8"))}


def _ranked(rows: DataFrame, shards: int, folder: str) -> DataFrame:
    """``rows`` (the columns of ``_described``, written, and others) with shard, slot and curve_index."""
    total = max(1, rows.count())
    steps = [f"{c}_step" for c in DIMENSIONS]
    placed = rows
    for c in DIMENSIONS:
        placed = placed.join(_steps(rows, c, total, folder), c)
    cell = F.col(steps[0]) * 256 + F.col(steps[1]) * 16 + F.col(steps[2])
    digits = max(1, math.ceil(math.log(max(1, total / PART), 16)))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    placed = placed.withColumns({"curve_index": F.element_at(F.array(*(F.lit(x) for x in curve())), cell + 1), "__key": key}).withColumn("__part", F.substring("__key", 1, digits))
    placed = written(placed.drop(*steps), folder, "cells")
    counts = placed.groupBy("curve_index", "__part").agg(F.count("*").alias("n"))
    along = Window.orderBy("curve_index").rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.groupBy("curve_index").agg(F.sum("n").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(along), F.lit(0))).select("curve_index", "base")
    within = Window.partitionBy("curve_index").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0))).join(cells, "curve_index").select("curve_index", "__part", (F.col("base") + F.col("before")).alias("offset"))
    ranked = placed.withColumn("nth", F.row_number().over(Window.partitionBy("curve_index", "__part").orderBy("__key", "doc_id", "size", "text_crc32")))
    found = ranked.join(offsets, ["curve_index", "__part"]).withColumn("rank", F.col("offset") + F.col("nth") - 1).withColumn("shard", F.expr(f"(rank * {shards}) div {total}L"))
    # the first rank r with r * shards div total = s is ceil(s * total / shards)
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return found.withColumn("slot", F.col("rank") - first).withColumn("shard", F.col("shard").cast("int")).withColumn("curve_index", F.col("curve_index").cast("int")).drop("nth", "offset", "rank", "__part", "__key")


def assign_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve_index) for every row; see the module."""
    folder = shared_folder(docs.sparkSession)
    own = _described(docs)
    rows = written(docs.select(*(x.alias(c) for c, x in own.items())), folder, "rows")
    return _ranked(rows, shards, folder).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve_index")


def own_names(taken: list[str], names: tuple[str, ...]) -> list[str]:
    """``names``, each with as many underscores behind it as it takes to be none of ``taken``."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        out.append(name)
    return out


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, files: int = 1) -> None:
    """``docs`` as Parquet, a folder for each shard with about ``files`` files, rows in the order of their slots; with
    ``shard``, ``slot`` and ``size``. Columns of ``docs`` stay as they are: where one has such a name, the new one has an
    underscore behind it (``shard_``)."""
    folder = shared_folder(docs.sparkSession)
    shard, slot, size, row = own_names(docs.columns, ("shard", "slot", "size", "__row"))
    keyed = written(docs.withColumn(row, F.monotonically_increasing_id()), folder, "keyed")
    own = _described(docs)
    rows = written(keyed.select(F.col(row).alias("__row"), *(x.alias(c) for c, x in own.items())), folder, "rows")
    places = _ranked(rows, shards, folder).select(F.col("__row").alias(row), F.col("shard").alias(shard), F.col("slot").alias(slot), F.col("size").alias(size))
    placed = keyed.join(places, row).drop(row)
    placed.repartitionByRange(shards * files, shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
    FROM (SELECT unnest(range(0, 256)) AS i))
), d AS (
  SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size, coalesce(lang, '') AS lang, coalesce(source, '') AS source, count(*) OVER () AS total FROM documents
), q AS (
  SELECT *, [{", ".join(f"16 * (rank() OVER (ORDER BY {c}) - 1) // total" for c in DIMENSIONS)}] AS step FROM d
), c AS (
  SELECT doc_id, size, total, {curve()}[step[1] * 256 + step[2] * 16 + step[3] + 1] AS curve_index,
    CAST(xor(list_reduce(list_concat([4294967295], [CAST(('0x' || h) AS BIGINT) FOR h IN regexp_extract_all(hex(encode(text)), '..')]),
      lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS BIGINT) AS text_crc32
  FROM q, crc_table
), r AS (
  SELECT *, row_number() OVER (ORDER BY curve_index, md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size, text_crc32) - 1 AS rank FROM c
), s AS (
  SELECT *, rank * {SHARDS} // total AS shard FROM r
)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
  rank - (shard * total + {SHARDS - 1}) // {SHARDS} AS slot, CAST(NULL AS INTEGER) AS grown_shard, CAST(curve_index AS INTEGER) AS curve_index
FROM s
"""
