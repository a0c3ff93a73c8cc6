"""Operator 13: a Merkle manifest with nested-interval labels.

Each row is a leaf: H of its fields. Leaves of a language ascend by doc_id, two neighbours at a time become a node, up
to the language's subroot, and the subroots, by language, make a tree of their own up to the root. A node is known by the
interval of leaf ranks that it covers. Two facts about intervals replace pointers:

- the ancestor of a leaf at a level is the node whose interval contains its rank. Levels are bucketed in bands of BAND: a
  join on the rank without its lowest BAND bits attaches, for a whole band, the node at its top;
- the sibling of a node is what its parent's interval holds beside its own, before it or behind it, or nothing.

A leaf's rank needs no sort of a whole language: rows are dealt by ranges of (language, doc_id), rows of each range are
counted and numbered, and the counts are summed up. All leaves under one node at the top of a band, 2 ** BAND at most, are one
row with an array, whose levels are arrays of half the size each. Its top node goes on to the next band with a
2 ** BAND-th of the rows, until each language has one node. So the work is that of the leaves and each band is
one shuffle; the paths above a band's top are found once for all leaves below it.

Proofs are the siblings from the leaf to the root; folding a leaf, as it is or tampered with, along its proof gives the
root that a reader of the manifest would compute.

Leaves alike in language and doc_id are ordered by their digests; a null doc_id comes first and isn't tampered with. Equal rows
are leaves each. A null language is one of its own, before all others. Null texts and numbers count as ``-``. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .common import shared_folder, table, written

#: Levels of a band; a row holds the leaves below one node at its top.
BAND = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def leaf_digest(fields: list[Column]) -> Column:
    """H of the fields, each as ``-`` or with its length in bytes."""
    return digest(F.concat(*(F.when(f.isNull(), "-").otherwise(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f)) for f in fields)))


def _ranked(rows: DataFrame, by: list[str], folder: str, name: str) -> DataFrame:
    """``rows`` (grp, *by, ...), a written table, with ``rank``, the place from 0 in its group by ``by``, and ``n``, the group's size."""
    placed = written(rows.repartitionByRange("grp", *by).withColumn("range", F.spark_partition_id()), folder, f"{name}-placed")
    counts = placed.groupBy("grp", "range").agg(F.count("*").alias("m"))
    own = Window.partitionBy("grp")
    ahead = F.coalesce(F.sum("m").over(own.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    counts = written(counts.select("grp", "range", ahead.alias("ahead"), F.sum("m").over(own).alias("n")), folder, f"{name}-counts")
    nth = F.row_number().over(Window.partitionBy("grp", "range").orderBy(*by)) - 1
    return placed.withColumn("nth", nth).join(counts, ["grp", "range"]).withColumn("rank", F.col("ahead") + F.col("nth")).drop("range", "nth", "ahead")


def _levels(leaves: Column, n: Column) -> Column:
    """array<array<string>>: the digests of a node's level below, ..., its own; ``n``: leaves of the whole tree."""

    def above(below: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.shiftright(F.size(below) - 1, 1))
        return F.transform(pairs, lambda i: digest(F.concat(F.get(below, 2 * i), F.coalesce(F.get(below, 2 * i + 1), F.lit("")))))

    high = F.when(n > 1 << BAND, BAND).otherwise(F.ceil(F.log2(n.cast("double"))).cast("int"))
    steps = F.filter(F.sequence(F.lit(0), F.lit(BAND)), lambda k: (k > 0) & (k <= high))
    return F.aggregate(steps, F.array(leaves), lambda levels, _: F.concat(levels, F.array(let(F.element_at(levels, -1), above))))


def _steps(levels: Column, low: Column, n: Column, rank: Column) -> Column:
    """array<struct<left, other>> for the node of ``rank``: at each level below the top the sibling's digest, null if it has
    none, and whether it comes first. The levels' nodes begin at ``low``; ``n`` ranks are covered in all."""

    def step(k: Column) -> Column:
        def of(x: Column) -> Column:
            start, end = x["parent"], F.least(x["parent"] + 2 * x["width"], n)
            own = F.call_function("shiftright", rank, k) * x["width"]
            behind = own + x["width"]
            place = F.when(own > start, start).when(behind < end, behind)  # where the rest of the parent's interval begins
            other = F.get(F.get(levels, k), ((place - low) / x["width"]).cast("int"))
            return F.struct((own > start).alias("left"), other.alias("other"))

        width = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        return let(F.struct(width.alias("width"), (F.call_function("shiftright", rank, k + 1) * 2 * width).alias("parent")), of)

    return F.transform(F.slice(F.sequence(F.lit(0), F.lit(BAND)), F.lit(1), F.size(levels) - 1), step)


def _tree(nodes: DataFrame, folder: str, name: str) -> tuple[DataFrame, DataFrame]:
    """For ``nodes`` (grp, node, hash, n, own), which are the ranks 0 to n - 1 of their group: (grp, hash, own, node, path,
    top), the steps from each node to its group's top and the top's digest; and the tops, a written table (grp, hash)."""
    item = F.struct("node", "hash", "own")
    own = nodes.groupBy("grp", F.shiftright("node", BAND).alias("over")).agg(F.array_sort(F.collect_list(item)).alias("below"), F.first("n").alias("n"))
    own = written(own.withColumn("levels", _levels(F.col("below.hash"), F.col("n"))), folder, f"{name}-bands")
    above = own.select("grp", F.col("over").alias("node"), F.get(F.element_at("levels", -1), F.lit(0)).alias("hash"), F.ceil(F.col("n") / (1 << BAND)).cast("long").alias("n"))
    above = written(above.withColumn("own", F.lit(None).cast("string")), folder, f"{name}-above")
    if above.where("n > 1").isEmpty():
        tops = above.select("grp", "hash")
        higher = above.select("grp", F.col("node").alias("over"), F.array().cast("array<struct<left:boolean,other:string>>").alias("path"), F.col("hash").alias("top"))
    else:
        higher, tops = _tree(above, folder, f"{name}-up")
        higher = written(higher.select("grp", F.col("node").alias("over"), "path", "top"), folder, f"{name}-higher")
    # each band's row meets the path above it; then its members' own steps come in front
    met = own.join(higher, ["grp", "over"])

    def paths(x: Column) -> Column:
        low = F.call_function("shiftleft", x["over"], F.lit(BAND))
        return F.transform(F.col("below"), lambda b: F.struct(b["hash"].alias("hash"), b["own"].alias("own"), b["node"].alias("node"), F.concat(_steps(x["levels"], low, x["n"], b["node"]), x["path"]).alias("path")))

    every = met.select("grp", "top", F.explode(let(F.struct("levels", "over", "n", "path"), paths)).alias("b"))
    return every.select("grp", "b.hash", "b.own", "b.node", "b.path", "top"), tops


def _folded(leaf: Column, path: Column) -> Column:
    put = lambda h, s: digest(F.when(s["other"].isNull(), h).when(s["left"], F.concat(s["other"], h)).otherwise(F.concat(h, s["other"])))
    return F.aggregate(path, leaf, put)


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, changed) for every row: ``path`` as ``_tree`` gives it, from the leaf to the root;
    ``changed``: the leaf if n_chars were one more, where that is tried, else null."""
    folder = shared_folder(docs.sparkSession)
    doc_id, n_chars = F.col("doc_id").cast("long"), F.col("n_chars").cast("long")
    as_text = {c: F.col(c).cast("string") for c in FIELDS} | {"doc_id": doc_id.cast("string"), "n_chars": n_chars.cast("string")}
    other = as_text | {"n_chars": (n_chars + 1).cast("string")}
    tried = F.crc32(as_text["doc_id"].cast("binary")) % 7 == 0
    lang = F.when(as_text["lang"].isNull(), "").otherwise(F.concat(F.lit("="), as_text["lang"]))
    rows = docs.select(lang.alias("grp"), doc_id.alias("doc_id"), leaf_digest([as_text[c] for c in FIELDS]).alias("leaf"), F.when(tried, leaf_digest([other[c] for c in FIELDS])).alias("changed"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, folder, "rows")
    leaves = _ranked(rows, ["doc_id", "leaf", "row"], folder, "leaf")
    leaves, tops = _tree(leaves.select("grp", F.col("rank").alias("node"), F.col("leaf").alias("hash"), "n", F.struct("doc_id", "changed").alias("own")), folder, "leaf")

    subroots = written(tops.select(F.lit("").alias("grp"), F.col("grp").alias("lang"), "hash"), folder, "subroots")
    subroots = _ranked(subroots, ["lang"], folder, "lang").select("grp", F.col("rank").alias("node"), "hash", "n", F.col("lang").alias("own"))
    subroots, _ = _tree(subroots, folder, "lang")
    subroots = written(subroots.select(F.col("own").alias("grp"), F.col("path").alias("higher"), F.col("top").alias("root")), folder, "higher")

    met = leaves.join(subroots, "grp")
    return met.select("own.doc_id", F.col("hash").alias("leaf"), F.col("top").alias("subroot"), "root", F.concat("path", "higher").alias("path"), "own.changed")


def proofs(listed: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) from ``manifest``."""
    siblings = F.array_join(F.transform("path", lambda s: s["other"]), "")  # a null is passed over
    own = listed.withColumn("folded_root", _folded(F.coalesce("changed", "leaf"), F.col("path")))
    return own.select("doc_id", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    return proofs(manifest(table(spark, sf_dir, "documents")))


def _s_fields(n_chars: str) -> str:
    values = ["CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text"]
    return " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values)


def _s_tree(name: str, source: str) -> str:
    """The nodes (grp, level, i, h) of the trees over ``source`` (grp, i, h)."""
    return f"""{name} AS (
  SELECT grp, 0 AS level, i, h, n FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {source})
  UNION ALL
  SELECT grp, any_value(level) + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM {name} WHERE n > 1 GROUP BY grp, i // 2
)"""


def _s_paths(name: str, nodes: str, leaves: str) -> str:
    """(grp, i, path): of each leaf its siblings up to the top, each with its side in front; ``-`` for none."""
    return f"""{name} AS (
  SELECT l.grp, l.i, list(CASE WHEN s.h IS NULL THEN '-' WHEN s.i < (l.i // p.w) THEN 'L' || s.h ELSE 'R' || s.h END ORDER BY p.level) FILTER (p.level IS NOT NULL) AS path
  FROM {leaves} l LEFT JOIN (SELECT grp, level, n, CAST(pow(2, level) AS BIGINT) AS w FROM {nodes} WHERE i = 0 AND n > 1) p ON p.grp = l.grp
  LEFT JOIN {nodes} s ON s.grp = l.grp AND s.level = p.level AND s.i = xor(l.i // p.w, 1) GROUP BY l.grp, l.i
)"""


ORACLE_SQL = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
    FROM (SELECT unnest(range(0, 256)) AS i))
), d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS grp, sha256({_s_fields("n_chars")}) AS h, CASE WHEN crc % 7 = 0 THEN sha256({_s_fields("n_chars + 1")}) END AS changed
  FROM (SELECT *, xor(list_reduce(list_concat([4294967295], [CAST(ord(x) AS BIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS crc FROM documents, crc_table)
), l AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM d
), {_s_tree("nodes", "l")}, {_s_paths("paths", "nodes", "l")}, s AS (
  SELECT 'all' AS grp, grp AS lang, h, row_number() OVER (ORDER BY grp) - 1 AS i FROM nodes WHERE n = 1
), {_s_tree("top", "s")}, {_s_paths("ways", "top", "s")}, f AS (
  SELECT l.doc_id, l.h AS leaf, l.changed, s.h AS subroot, r.h AS root, list_concat(coalesce(p.path, []), coalesce(w.path, [])) AS path
  FROM l JOIN paths p ON p.grp = l.grp AND p.i = l.i JOIN s ON s.lang = l.grp JOIN ways w ON w.i = s.i JOIN (SELECT h FROM top WHERE n = 1) r ON true
), o AS (
  SELECT *, list_reduce(list_concat([coalesce(changed, leaf)], path), lambda h, x: sha256(CASE x[1] WHEN 'L' THEN x[2:] || h WHEN 'R' THEN h || x[2:] ELSE h END)) AS folded_root FROM f
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string([x[2:] FOR x IN path], '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM o
"""
