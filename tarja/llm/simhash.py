"""Operator 11: SimHash near-dedup with tables of distances to references.

A text's fingerprint has 64 bits; each is 1 if it is set in over half of the XXH64 digests of its four-word
shingles, repeats included. Two texts link when their fingerprints differ in NEAR bits or fewer; the result is the
connected components.

1. Equal fingerprints are one class, counted with map-side combine, so copies cost nothing more.
2. Partition keys that lose no link: the bits are dealt to b blocks, and fingerprints that differ in NEAR
   bits agree in b - NEAR blocks at least; each such choice of blocks is a key. b follows the number of
   classes, so that a key of bits at random has some hundred members. It decides the work, never the result.
3. A key's members meet in one task. For each the distances to REFERENCES fixed fingerprints, spread over the space,
   are computed beforehand. Distances of linked fingerprints to any reference differ by NEAR at most (the triangle
   inequality), so pairs in the order of the first distance whose largest difference is greater go, and true distances
   decide on the rest. Only the edges of a spanning tree leave the task.
4. A key with over BLOCK members, as large families of near copies make, isn't one task's: of the bits that vary in it,
   as evenly as they do, NEAR + 1 blocks are made, and its members are keyed anew by each. Keys of keys go on until
   they are small, or NEAR bits at most vary, and then all members link. Each round is a few aggregates and joins
   of written tables, which adaptive execution splits.

Every row is a document and gives its row. A text without words, or null, has the fingerprint zero and links like any
other. A component's id is the smallest doc_id that isn't null among its rows, or null if there is none. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import components, shared_folder, table, written
from .hashing import U

WORDS = 4
SEED = 42
NEAR = 4
#: Members of a key that one task compares, and how many a key of random bits should have.
BLOCK = 4096
USUAL = 512
#: Shingles that are hashed, rows of whole keys and pairs that are compared at a time.
HASHED = 1 << 16
ROWS = 1 << 16
PAIRS = 1 << 21
#: Walsh words: any two are 32 bits apart. The first is zero, so its distance is the number of bits set.
REFERENCES = np.array([sum(((i & j).bit_count() & 1) << i for i in range(64)) for j in range(32)], dtype=U)


def fingerprint(text: bytes) -> int:
    words = text.lower().split()  # of bytes: A-Z only, and at U+0020 and U+0009 to U+000D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - WORDS + 1)
    ends = ends[len(words) - n :]
    count = np.zeros(64, dtype=np.int64)
    for k in range(0, n, HASHED):
        spans = zip(starts[k : min(n, k + HASHED)].tolist(), ends[k : k + HASHED].tolist(), strict=True)
        h = np.array([xxhash.xxh64_intdigest(joined[a:z], SEED) for a, z in spans], dtype="<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for b in batches:
        found = np.array([fingerprint(t or b"") for t in b.column("text").cast(pa.large_binary()).to_pylist()], dtype=U)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def blocks(n: int) -> int:
    """How many blocks the bits are dealt to for n classes."""
    b = NEAR + 1
    while b < 10 and n > USUAL * 2 ** (64 * (b - NEAR) / b):
        b += 1
    return b


def key_masks(b: int) -> list[int]:
    own = [sum(1 << i for i in range(64) if i % b == k) for k in range(b)]
    return [sum(c) for c in combinations(own, b - NEAR)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masked(mask: Column) -> Column:
    return F.col("fp").bitwiseAND(mask)


def joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins the trees of i and j in ``label`` (each row's root, the smallest of its tree); pairs of roots that were joined."""
    found = [np.zeros(0, dtype=np.int64)] * 2
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return found[0], found[1]
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        low, high = np.minimum(a, b), np.maximum(a, b)
        parent = np.arange(len(label))
        np.minimum.at(parent, high, low)
        moved = np.unique(high)
        found = [np.concatenate([found[0], moved]), np.concatenate([found[1], parent[moved]])]
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        label[:] = parent[label]


def linked(group: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints that join all that are linked within their group; groups stand together."""
    distance = np.bitwise_count(fp[:, None] ^ REFERENCES)
    order = np.lexsort((distance[:, 0], group))
    group, fp, distance = group[order], fp[order], distance[order].astype(np.int16)
    lead = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]])) * 128 + distance[:, 0]
    many = np.searchsorted(lead, lead + NEAR, side="right") - np.arange(len(lead)) - 1
    label = np.arange(len(fp))
    found = []
    ahead = np.concatenate([[0], np.cumsum(many)])
    a = 0
    while a < len(fp):
        z = max(a + 1, int(np.searchsorted(ahead, ahead[a] + PAIRS, side="right")) - 1)
        i = np.repeat(np.arange(a, z), many[a:z])
        j = i + 1 + np.arange(len(i)) - np.repeat(ahead[a:z] - ahead[a], many[a:z])
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
        for k in range(1, len(REFERENCES)):
            near = np.abs(distance[i, k] - distance[j, k]) <= NEAR
            i, j = i[near], j[near]
            if not len(i):
                break
        near = np.bitwise_count(fp[i] ^ fp[j]) <= NEAR
        found.append(joined(label, i[near], j[near]))
        a = z
    x, y = (np.concatenate([f[s] for f in found]) if found else np.zeros(0, dtype=np.int64) for s in (0, 1))
    return fp[x], fp[y]


def _linked(batches):
    """From rows (g, fp) sorted by g."""

    def edges(g, fp):
        x, y = linked(g, fp.view(U))
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    g, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        g, fp = np.concatenate([g, b.column("g").to_numpy()]), np.concatenate([fp, b.column("fp").to_numpy()])
        if len(g) >= ROWS:
            cut = int(np.searchsorted(g, g[-1], side="left"))
            if cut:
                yield edges(g[:cut], fp[:cut])
            g, fp = g[cut:], fp[cut:]
    if len(g):
        yield edges(g, fp)


def _own_masks(members: DataFrame) -> DataFrame:
    """(g, masks): for each group of ``members`` NEAR + 1 masks, to which the bits that vary in it are dealt in turn, the
    most evenly set first."""
    ones = [F.sum(F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(64)]
    count = members.groupBy("g").agg(F.count("*").alias("n"), *ones)
    bits = F.filter(F.array(*(F.struct(F.abs(2 * F.col(f"b{i}") - F.col("n")).alias("bias"), F.lit(i).alias("i")) for i in range(64))), lambda x: x["bias"] < F.col("n"))
    count = count.select("g", F.array_sort(bits).alias("bits"))

    def mask(dealt: Column) -> Column:
        return F.aggregate(dealt, F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x["i"])))

    masks = [let(F.col("bits"), lambda bits, t=t: mask(F.filter(bits, lambda x, k: k % (NEAR + 1) == t))) for t in range(NEAR + 1)]
    return count.select("g", F.array(*masks).alias("masks"))


def near_links(classes: DataFrame, folder: str) -> DataFrame:
    """(a, b): pairs of the distinct fingerprints of ``classes`` (fp), a written table, whose components are those of all links."""
    masks = key_masks(blocks(classes.count()))
    keys = F.array(*(F.xxhash64(F.lit(k), _masked(F.lit(signed(m)))) for k, m in enumerate(masks)))
    members = classes.select(F.explode(keys).alias("g"), "fp")
    found, level = [], 0
    while True:
        sizes = members.groupBy("g").agg(F.count("*").alias("n"), F.min("fp").alias("least"), F.bit_count(F.bit_or("fp").bitwiseXOR(F.bit_and("fp"))).alias("vary")).where("n > 1")
        sizes = written(sizes, folder, f"sizes-{level}")
        few = members.join(sizes.where(F.col("n") <= BLOCK).select("g"), "g")
        found.append(written(few.repartition("g").sortWithinPartitions("g").mapInArrow(_linked, "a long, b long").distinct(), folder, f"links-{level}"))
        large = sizes.where(F.col("n") > BLOCK)
        alike = large.where(F.col("vary") <= NEAR).select("g", "least")
        found.append(members.join(alike, "g").select(F.col("least").alias("a"), F.col("fp").alias("b")).where("a <> b"))
        rest = large.where(F.col("vary") > NEAR).select("g")
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, found)
        members = written(members.join(rest, "g"), folder, f"large-{level}")
        own = members.join(written(_own_masks(members), folder, f"masks-{level}"), "g")
        own = own.select("g", "fp", F.posexplode("masks").alias("k", "mask"))
        members = written(own.select(F.xxhash64("g", "k", _masked(F.col("mask"))).alias("g"), "fp"), folder, f"members-{level}")
        level += 1


def simhash_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; see the module."""
    folder = shared_folder(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = written(own.mapInArrow(_fingerprints, "doc_id long, fp long"), folder, "prints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("doc")), folder, "classes")
    part = components(near_links(classes, folder), folder, "components").withColumnRenamed("id", "fp")
    met = written(classes.join(part, "fp", "left").withColumn("component", F.coalesce("component", "fp")), folder, "met")
    least = met.groupBy("component").agg(F.min("doc").alias("component_id"))
    found = written(met.join(least, "component").select("fp", "component_id"), folder, "found")
    # both sides are written tables, so a fingerprint of very many copies can be split
    return prints.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
