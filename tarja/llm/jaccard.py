"""Operator 3: n-gram Jaccard join by a count-vector R-tree.

A document's set is its distinct five-word shingles (``shingles``). Two documents link when
100 * intersection >= 75 * union; the result is the connected components of the links.

1. Equal sets are one class: two 64-bit digests of the set, grouped with map-side combine. Words and
   shingles are hashed modulo a prime under two bases, so no pattern of letters makes unlike words meet.
2. Partition keys that lose no link: of two linked sets of n and m tokens, the n // 4 + 1
   first tokens of one and the m // 4 + 1 first of the other, in any common order, share a token.
   The order puts rare tokens first. Counts come from all texts by lossy counting (a
   token seen once in a stretch of a partition is not reported there); the list of frequent tokens is at most
   HOT_TOKENS long and is broadcast (6.4 MB). The order decides the work, never the result.
3. Members of a token's group become points: shingles hashed into 256 groups or, for larger sets, more,
   counted. An R-tree bounds the overlap by summed coordinate minima; pairs whose bound suffices join in a
   union-find, and only its tree edges leave the task. Their components, the clusters, contain
   every true link. A token of over BLOCK rows or BLOCK_BYTES is only passed on by the task that sorts it; its members are
   counted, and told apart by size, with partial aggregates, first bounded with a few pivots, and outsiders
   then meet in blocks that Spark shuffles.
4. Only texts in clusters are read again for their sets. Each cluster's sets meet once, the R-tree names the pairs, and true overlaps decide. A cluster
   of over BLOCK sets or BLOCK_BYTES is first compared with a few pivots; blocks of those that no pivot took are
   then compared with blocks of all, so memory stays bounded and no pair that could join two
   components is passed over.

Every row is a document and gives its row. Nulls and texts without words have empty sets and stay alone: their
component is their own doc_id. A component's id is the smallest doc_id that isn't null among its rows, or null if
there is none. Rows that share a doc_id are linked only if their texts are. Extra columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, forget, shared_folder, table, written
from .hashing import U, text_slices
from .rtree import count_vector, fold, needed, spanning, vectors
from .shingles import set_digests, shingle_sets

#: Most frequent tokens that the order knows, 16 bytes each.
HOT_TOKENS = 400_000
#: A token in so many sets may be called frequent.
HOT_FROM = 6
#: Sets that are compared in one task, and rows of a token that make one group there; and their bytes.
BLOCK = 2048
BLOCK_BYTES = 32 << 20
PIVOTS = 8
#: Texts and sets that a task remembers, and tokens that it counts at a time.
SEEN = 1 << 20
COUNTED = 1 << 22
#: Bits of the map of wanted texts, and how many it takes at most.
BITMAP_BITS = 25
MAPPED = 1 << 22


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)
), r AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(doc_id, coalesce(min(r.b), doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = doc_id GROUP BY doc_id
"""


def weight(n):
    """About the bytes that a set of n tokens takes in a task, with its count vector."""
    return 256 + 10 * n


def identity(d1: np.ndarray, d2: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """A set's id: its first digest, or, where unlike sets share it, both. The same as ``_named`` gives."""
    return np.where(np.isin(d1, shared), d1 ^ d2, d1) if len(shared) else d1


def _unseen(b: pa.RecordBatch, seen: set[int]) -> pa.RecordBatch:
    """The rows whose text this task hasn't had yet."""
    if len(seen) > SEEN:
        seen.clear()
    return b.filter(pa.array([h not in seen and not seen.add(h) for h in b.column("th").to_pylist()], pa.bool_()))


def _signatures(batches):
    for b in batches:
        ids, th = b.column("doc_id"), b.column("th")
        for row, data, offsets in text_slices(b.column("text")):
            h, starts = shingle_sets(data, offsets)
            d1, d2 = set_digests(h, starts)
            k = len(d1)
            yield pa.RecordBatch.from_arrays([ids.slice(row, k), th.slice(row, k), pa.array(np.diff(starts)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64))], ["doc_id", "th", "n", "d1", "d2"])


def _frequent(batches):
    """Tokens that a stretch of this partition's texts holds twice or more. Over all texts, over a
    third of each one's tokens: those of small hash, where first tokens come from."""
    seen: set[int] = set()
    held, size = [], 0

    def counted():
        token, count = np.unique(np.concatenate(held), return_counts=True)
        token, count = token[count > 1], count[count > 1]
        return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(count)], ["token", "count"])

    for b in batches:
        for _, data, offsets in text_slices(_unseen(b, seen).column("text")):
            h, _ = shingle_sets(data, offsets)
            held.append(h[h < U(int(0.36 * 2**64))])
            size += len(held[-1])
            if size > COUNTED:
                yield counted()
                held, size = [], 0
    if held:
        yield counted()


def _first_tokens(hot: np.ndarray, counts: np.ndarray, shared: np.ndarray):
    def run(batches):
        texts: set[int] = set()
        seen: set[int] = set()
        for b in batches:
            for _, data, offsets in text_slices(_unseen(b, texts).column("text")):
                h, starts = shingle_sets(data, offsets)
                if not len(h):
                    continue
                d1 = identity(*set_digests(h, starts), shared)
                n = np.diff(starts)
                fresh = np.zeros(len(n), dtype=bool)
                for i, d in enumerate(d1.tolist()):
                    if n[i] and d not in seen:
                        seen.add(d)
                        fresh[i] = True
                of = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(h)) - starts[of]
                if len(hot):
                    k = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                    rank = np.where(hot[k] == h, counts[k], 0)
                    if rank.any():
                        order = np.lexsort((h, rank, of))
                        h = h[order]
                take = fresh[of] & (place <= (n // 4)[of])
                yield pa.RecordBatch.from_arrays([pa.array(h[take].view(np.int64)), pa.array(d1[of[take]].view(np.int64)), pa.array(n[of[take]])], ["token", "d1", "n"])
            if len(seen) > SEEN:
                seen.clear()

    return run


def _groups(block: int):
    """From rows sorted by token: the members of groups of two sets or more, under a fingerprint of
    the membership, so that tokens with the same members make one group. Linked sets differ by a
    third in size at most, so a token's members are cut into groups where the next size is further off.
    A token of over ``block`` rows, or BLOCK_BYTES, is passed on row by row under itself, with the sizes, as ``large``."""

    def small(t, d, n):
        order = np.lexsort((d, n, t))
        t, d, n = t[order], d[order], n[order]
        new = np.ones(len(t), dtype=bool)
        new[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1])
        t, d, n = t[new], d[new], n[new]
        first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (3 * n[1:] > 4 * n[:-1])]))
        size = np.diff(np.append(first, len(t)))
        _, prints = set_digests(d.view(U), np.append(first, len(t)))
        g = np.repeat(np.arange(len(size)), size)
        many = size[g] > 1
        return rows(prints[g][many].view(np.int64), False, np.zeros(int(many.sum()), np.int64), d[many])

    def rows(g, large, n, d):
        return pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.full(len(g), large)), pa.array(n), pa.array(d)], ["g", "large", "n", "d1"])

    def closed(t, d, n):
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        count = np.diff(np.append(first, len(t)))
        far = np.repeat((count > block) | (np.add.reduceat(weight(n), first) > BLOCK_BYTES), count)
        if far.any():
            yield rows(t[far], True, n[far], d[far])
        if not far.all():
            yield small(t[~far], d[~far], n[~far])

    def run(batches):
        rest = t, d, n = tuple(np.zeros(0, np.int64) for _ in range(3))
        open_token = None
        for b in batches:
            t, d, n = (np.concatenate([r, b.column(c).to_numpy()]) for r, c in zip(rest, ("token", "d1", "n"), strict=True))
            if open_token is not None:
                k = int(np.searchsorted(t, open_token, side="right"))
                if k:
                    yield rows(t[:k], True, n[:k], d[:k])
                t, d, n = t[k:], d[k:], n[k:]
            rest = t, d, n
            if not len(t):
                continue
            open_token = None
            cut = int(np.searchsorted(t, t[-1], side="left"))
            if cut:
                yield from closed(t[:cut], d[:cut], n[:cut])
            rest = t[cut:], d[cut:], n[cut:]
            if len(rest[0]) > block or weight(rest[2]).sum() > BLOCK_BYTES:
                yield rows(rest[0], True, rest[2], rest[1])
                open_token, rest = int(t[-1]), (t[:0], d[:0], n[:0])
        if len(rest[0]):
            yield from closed(*rest)

    return run


def _candidates(bits: np.ndarray | None, whole: bool, shared: np.ndarray):
    def run(batches):
        texts: set[int] = set()
        seen: set[int] = set()
        for b in batches:
            if bits is not None:
                at = b.column("th").to_numpy() & ((1 << BITMAP_BITS) - 1)
                b = b.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            if len(seen) > SEEN:
                seen.clear()
            for _, data, offsets in text_slices(_unseen(b, texts).column("text")):
                h, starts = shingle_sets(data, offsets)
                d1 = identity(*set_digests(h, starts), shared).view(np.int64).tolist()
                own = [i for i, d in enumerate(d1) if starts[i] < starts[i + 1] and d not in seen and not seen.add(d)]
                sets = [h[starts[i] : starts[i + 1]] for i in own]
                cols = [pa.array([d1[i] for i in own], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([count_vector(x) for x in sets], pa.binary())]
                names = ["id", "n", "vec"]
                if whole:
                    cols.append(pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary()))
                    names.append("tokens")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _points(texts: DataFrame, wanted: DataFrame, whole: bool, shared: np.ndarray) -> DataFrame:
    """(id, n, vec) of the sets of the wanted texts (th), with their tokens if ``whole``, and perhaps of some more. Up
    to MAPPED texts are told to the scan by a bit map of 4 MB; beyond that all texts are shuffled to
    meet them. A set that several tasks have met comes once."""
    form = "id long, n long, vec binary" + ", tokens binary" * whole
    if wanted.count() > MAPPED:
        found = texts.join(wanted, "th", "left_semi").mapInArrow(_candidates(None, whole, shared), form)
    else:
        bit = F.pmod("th", F.lit(1 << BITMAP_BITS))
        pages = wanted.groupBy(F.floor(bit / 32768).alias("page")).agg(F.bitmap_construct_agg(F.pmod(bit, F.lit(32768))).alias("bits"))
        bits = np.zeros((1 << BITMAP_BITS) // 8, dtype=np.uint8)
        for r in pages.collect():  # at most 1,024 pages of 4 KB
            bits[r["page"] * 4096 : (r["page"] + 1) * 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
        found = texts.mapInArrow(_candidates(bits, whole, shared), form)
    return found.groupBy("id").agg(*(F.first(c).alias(c) for c in ("n", "vec", "tokens")[: 2 + whole]))


def _by_key(batches, keys: list[str]):
    """Whole groups, as tables, from rows sorted by ``keys``; a task holds one group and one batch."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        if not t.num_rows:
            continue
        change = np.zeros(t.num_rows, dtype=bool)
        for k in keys:
            x = t.column(k).to_numpy()
            change[1:] |= x[1:] != x[:-1]
        cuts = [0, *np.flatnonzero(change).tolist()]
        for a, z in zip(cuts, cuts[1:], strict=False):
            yield t.slice(a, z - a)
        rest = t.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])


def _bounded(batches):
    for t in _by_key(batches, ["g", "low", "high"]):
        if t.num_rows < 2:
            continue
        sides = t.column("own").to_numpy() if t.column("low")[0] != t.column("high")[0] else None
        if found := spanning(t.column("id").to_numpy(), t.column("vec").to_pylist(), t.column("n").to_numpy(), None, sides):
            yield _edges(found)


def _verified(batches):
    for t in _by_key(batches, ["cluster", "low", "high"]):
        if t.num_rows < 2:
            continue
        sides = t.column("own").to_numpy() if t.column("low")[0] != t.column("high")[0] else None
        sets = [np.frombuffer(x, dtype="<u8") for x in t.column("tokens").to_pylist()]
        if found := spanning(t.column("id").to_numpy(), t.column("vec").to_pylist(), t.column("n").to_numpy(), sets, sides):
            yield _edges(found)


def _with_pivot(batches):
    for b in batches:
        found = []
        for i, p, x, y in zip(b.column("id").to_pylist(), b.column("pivot").to_pylist(), b.column("tokens").to_pylist(), b.column("pivot_tokens").to_pylist(), strict=True):
            x, y = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
            if i != p and 7 * len(np.intersect1d(x, y, assume_unique=True)) >= 3 * (len(x) + len(y)):
                found.append((min(i, p), max(i, p)))
        yield _edges(found)


def _near_pivot(batches):
    for b in batches:
        found = []
        for i, p, n, m, x, y in zip(*(b.column(c).to_pylist() for c in ("id", "pivot", "n", "pivot_n", "vec", "pivot_vec")), strict=True):
            _, (x, y) = vectors([x, y], np.array([n, m]))
            groups = min(len(x), len(y))
            if np.minimum(fold(x, groups), fold(y, groups)).sum(dtype=np.int64) >= needed(n, m):
                found.append((min(i, p), max(i, p)))
        yield _edges(found)


def _sorted_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys)


def _pivots(members: DataFrame, key: str) -> DataFrame:
    """(key, pivot): a few members of each group of ``members`` (key, size, id), mostly the same ones for groups with mostly the same members."""
    every = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.lit(1.0), F.col("size") / (8 * PIVOTS))))).cast("long")
    some = F.array_sort(F.collect_set(F.when(F.pmod(F.xxhash64("id"), every) == 0, F.col("id"))))
    return members.groupBy(key).agg(F.slice(some, 1, PIVOTS).alias("pivot")).select(key, F.explode("pivot").alias("pivot"))


def _block_pairs(members: DataFrame, key: str, linked: DataFrame, folder: str, name: str) -> DataFrame:
    """``members`` (key, id, n, ...) once for each pair of blocks (low, high) that its block ``own`` meets.

    Links to pivots join members to parts. Outsiders of a group's main part, in blocks, meet one
    another and all others; those of the main part need not meet."""
    rank = F.xxhash64("id")
    part = components(linked, folder, name)
    members = members.join(part, "id", "left").withColumn("part", F.coalesce("component", "id"))
    main = members.groupBy(key, "part").count().groupBy(key).agg(F.max(F.struct("count", "part"))["part"].alias("main"))
    members = members.join(main, key).withColumn("out", F.col("part") != F.col("main"))
    size = lambda side: F.greatest(F.ceil(F.count_if(side) / BLOCK), F.ceil(F.coalesce(F.sum(F.when(side, weight(F.col("n")))), F.lit(0)) / BLOCK_BYTES))
    blocks = members.groupBy(key).agg(size(F.col("out")).alias("outs"), size(~F.col("out")).alias("ins"))
    members = members.join(blocks.where("outs > 0"), key).withColumn("own", F.when(F.col("out"), F.pmod(rank, F.col("outs"))).otherwise(F.col("outs") + F.pmod(rank, F.col("ins"))))
    pairs = members.withColumn("other", F.explode(F.when(F.col("out"), F.sequence(F.lit(0).cast("long"), F.col("outs") + F.col("ins") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("outs") - 1))))
    return pairs.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))


def _large_groups(texts: DataFrame, large: DataFrame, classes: DataFrame, shared: np.ndarray, folder: str) -> tuple[DataFrame, DataFrame]:
    """Of tokens with many members, ``large`` (g, n, id): bounded links to pivots (a, b), and the
    members (g, low, high, own, id, n, vec) of the pairs of blocks that are left to bound."""
    sizes = Window.partitionBy("g").orderBy("n")
    bands = large.select("g", "n").distinct().withColumn("cut", F.coalesce((3 * F.col("n") > 4 * F.lag("n").over(sizes)).cast("int"), F.lit(0)))
    bands = bands.select("g", "n", F.sum("cut").over(sizes).alias("band"))
    members = large.join(bands, ["g", "n"]).select(F.xxhash64("g", "band").alias("g"), "id", "n")
    prints = members.groupBy("g").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y"))
    one = prints.where("size > 1").groupBy("size", "x", "y").agg(F.min("g").alias("g")).select("g", "size")
    members = written(members.join(one, "g").select("g", "size", "id", "n").distinct(), folder, "large-members")
    points = written(_points(texts, written(_texts_of(members, classes), folder, "large-wanted"), False, shared), folder, "large-points")
    pairs = members.join(_pivots(members, "g"), "g").select("id", "pivot").where("id <> pivot").distinct()
    pairs = pairs.join(points, "id").join(points.select(F.col("id").alias("pivot"), F.col("n").alias("pivot_n"), F.col("vec").alias("pivot_vec")), "pivot")
    linked = written(pairs.select("id", "pivot", "n", "pivot_n", "vec", "pivot_vec").mapInArrow(_near_pivot, "a long, b long").distinct(), folder, "group-pivot-links")
    left = _block_pairs(members, "g", linked, folder, "group-pivot-parts").select("g", "low", "high", "own", "id")
    return linked, left.join(points, "id").select("g", "low", "high", "own", "id", "n", "vec")


def _large_clusters(large: DataFrame, folder: str) -> DataFrame:
    """Verified links inside clusters of over BLOCK sets."""
    pivots = _pivots(large, "cluster").join(large.select(F.col("id").alias("pivot"), F.col("tokens").alias("pivot_tokens")), "pivot")
    linked = written(large.join(pivots, "cluster").select("id", "pivot", "tokens", "pivot_tokens").mapInArrow(_with_pivot, "a long, b long"), folder, "pivot-links")
    pairs = _block_pairs(large, "cluster", linked, folder, "pivot-parts").select("cluster", "low", "high", "own", "id", "n", "vec", "tokens")
    return linked.unionByName(_sorted_groups(pairs, ["cluster", "low", "high"]).mapInArrow(_verified, "a long, b long"))


def _texts_of(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(th): a text for each set (id)."""
    return members.select("id").distinct().join(classes, "id").select("th").distinct()


def _shared_digests(classes: DataFrame) -> np.ndarray:
    """The first digests that unlike sets share: about n ** 2 / 2 ** 65 of n sets, so some ten of 3 * 10 ** 10."""
    twice = classes.groupBy("d1").agg(F.count("*").alias("n")).where("n > 1").select("d1")
    return np.array([r["d1"] for r in twice.collect()], dtype=np.int64).view(U)


def _named(classes: DataFrame, shared: np.ndarray) -> DataFrame:
    """``classes`` with ``id``, which tells them apart by both digests."""
    both = F.col("d1").bitwiseXOR(F.col("d2"))
    return classes.withColumn("id", F.when(F.col("d1").isin(shared.view(np.int64).tolist()), both).otherwise(F.col("d1")) if len(shared) else F.col("d1"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row; see the module."""
    folder = shared_folder(docs.sparkSession)
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    texts = docs.select("th", "text")
    sets = written(docs.mapInArrow(_signatures, "doc_id long, th long, n long, d1 long, d2 long"), folder, "sets")
    classes = written(sets.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("doc"), F.min("th").alias("th")), folder, "classes")
    shared = _shared_digests(classes)
    named = _named(classes, shared)

    frequent = texts.mapInArrow(_frequent, "token long, count long").groupBy("token").agg(F.sum("count").alias("count")).where(F.col("count") >= HOT_FROM)
    top = frequent.orderBy(F.desc("count"), "token").limit(HOT_TOKENS).toPandas()
    token = top["token"].to_numpy(dtype=np.int64).view(U)
    order = np.argsort(token)
    hot, counts = token[order], top["count"].to_numpy(dtype=np.int64)[order]

    first = texts.mapInArrow(_first_tokens(hot, counts, shared), "token long, d1 long, n long")
    groups = _sorted_groups(first, ["token"]).mapInArrow(_groups(BLOCK), "g long, large boolean, n long, d1 long").withColumnRenamed("d1", "id")
    groups = written(groups.distinct(), folder, "groups")
    few, large = groups.where("not large").select("g", "id"), groups.where("large").select("g", "n", "id")

    points = _points(texts, written(_texts_of(few, named), folder, "wanted"), False, shared)
    zero = F.lit(0).cast("long")
    members = few.join(points, "id").select("g", zero.alias("low"), zero.alias("high"), zero.alias("own"), "id", "n", "vec")
    near = None
    if not large.isEmpty():
        near, left = _large_groups(texts, large, named, shared, folder)
        members = members.unionByName(left)
    bounded = _sorted_groups(members, ["g", "low", "high"]).mapInArrow(_bounded, "a long, b long")
    may = written((bounded.unionByName(near) if near else bounded).distinct(), folder, "may")
    clusters = components(may, folder, "clusters").withColumnRenamed("component", "cluster")
    held = written(_points(texts, written(_texts_of(clusters, named), folder, "clustered"), True, shared).join(clusters, "id"), folder, "held")
    size = held.groupBy("cluster").agg(F.count("*").alias("size"), F.sum(weight(F.col("n"))).alias("bytes"))
    size = written(size.select("cluster", "size", ((F.col("size") > BLOCK) | (F.col("bytes") > BLOCK_BYTES)).alias("large")), folder, "sizes")
    held = held.join(size, "cluster")
    small = held.where("not large").select("cluster", zero.alias("low"), zero.alias("high"), zero.alias("own"), "id", "n", "vec", "tokens")
    links = written(_sorted_groups(small, ["cluster", "low", "high"]).mapInArrow(_verified, "a long, b long"), folder, "links")
    if not size.where("large").isEmpty():
        links = written(links.unionByName(_large_clusters(written(held.where("large"), folder, "large"), folder)), folder, "all-links")
    linked = written(components(links, folder, "components").join(named, "id").select("id", "component", "doc"), folder, "linked")
    forget(docs.sparkSession, folder, "groups", "wanted", "may", "clustered", "held", "sizes", "links", "all-links", "large", "large-members", "large-wanted", "large-points", "pivot-links", "group-pivot-links")

    least = linked.groupBy("component").agg(F.min("doc").alias("component_id"))
    # written, so that a set of very many copies can be split where it meets its rows
    found = named.join(linked.join(least, "component").select("id", "component_id"), "id", "left")
    found = found.select("d1", "d2", F.when(F.col("component_id").isNull(), F.col("doc")).otherwise(F.col("component_id")).alias("component_id"))
    found = written(found, folder, "found")
    met = sets.join(found, ["d1", "d2"], "left")
    return met.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each component one row of ``docs`` stays, all its columns as they are: the one with the smallest
    doc_id, a null coming last; of equal ones the first as read. Rows decide, not doc_ids: a
    text that links to nothing stays, whatever its doc_id. Texts without words all stay."""
    folder = shared_folder(docs.sparkSession)
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), folder, "rows")
    parts = jaccard_components(rows.select(F.col("__row").alias("doc_id"), "text"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").cast("long").alias("doc_id"), "__row")
    met = parts.select(F.col("doc_id").alias("__row"), "component_id").join(rows.select("__row", "doc_id"), "__row")
    stay = met.groupBy("component_id").agg(F.min(order)["__row"].alias("__row")).select("__row")
    return rows.join(stay, "__row", "left_semi").drop("__row")


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
