"""Operator 5: exact top-k search with segment statistics at several resolutions.

Vectors are floor(1024 * x) of their components; the score is the integer inner product. A vector
is summed up at each resolution by the mean and deviation of each of its 1, 2, 4, ... segments.
With these, |q - x|^2 is at least sum(len * ((mq - mx)^2 + (sq - sx)^2)), so the inner product,
(|q|^2 + |x|^2 - |q - x|^2) / 2, is at most sum(len * (mq * mx + sq * sx)). Chunks of vectors are
bounded from coarse to fine against each query's k-th score so far, and only pairs that survive
every resolution are computed exactly.

Vectors are put in the order of a curve through their coarse means and cut into parts of about PART components, so
that a part's vectors are alike. What a part can hold is bounded by its envelope, the smallest and largest statistics of its
vectors, and envelopes come in blocks of ENVELOPES parts. Each query meets each block and picks the part that promises most; the k-th score
that it finds there is its first threshold. Then only parts whose envelope reaches the threshold get the query. A task
holds one part's vectors and a block of QUERIES queries at a time. Nothing is collected or broadcast. Vectors without any
order, as random ones, make all envelopes alike, and then each query goes to every part.

Vectors that are null, or hold a null or non-finite component (or one whose 1024-fold isn't finite), take no part, nor do rows with a
null vec_id; a vec_id with unlike vectors stands for each of them, like rows once. Of vectors of
different lengths the shorter is filled with zeros; an empty vector scores 0 with all. Scores are exact whatever the size of components; one beyond
63 bits counts as the nearest number of 63 bits. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder, table, written

K = 10
SCALE = 1024.0
#: Components of the vectors of one part, 8 bytes each.
PART = 1 << 21
#: Queries that a task compares at a time, and vectors that are bounded at once.
QUERIES = 512
CHUNK = 2048
#: Parts whose envelopes a task holds at a time, and segments of a vector that they are made of at most: up to so many
#: components each is a segment, and an envelope is the box around the part.
ENVELOPES = 1024
SEGMENTS = 64
#: Vectors shorter than this have products that stay whole numbers in doubles.
SAFE = float(1 << 26)
MOST = (1 << 63) - 1

ORACLE_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def integer_vectors(df: DataFrame) -> DataFrame:
    e = F.col("embedding")
    scaled = lambda x: F.lit(SCALE) * x.cast("double")
    whole = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(scaled(x)) != float("inf")))
    own = df.where(F.col("vec_id").isNotNull() & e.isNotNull() & whole)
    # from 2 ** 53 on doubles are whole numbers, and floor() would cut them off at 63 bits
    floor = lambda y: F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)
    return own.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda x: floor(scaled(x))).alias("v"))


def _matrix(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def _summaries(x: np.ndarray) -> list[np.ndarray]:
    """For each resolution, a matrix whose products are the bounds."""
    out, width, parts = [], x.shape[1], 1
    while parts <= width // 4 or parts == 1:
        cut = x.reshape(len(x), parts, width // parts)
        out.append(np.hstack([cut.mean(axis=2), cut.std(axis=2)]) * np.sqrt(width // parts))
        parts *= 4
    return out


def _lengths(rows: list) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.array([np.sqrt(np.square(np.asarray(r, dtype=np.float64)).sum()) if len(r) else 0.0 for r in rows])


class _Part:
    """The vectors of a part in chunks, each with its summaries; those too long for sums in doubles apart."""

    def __init__(self, ids: list[int], rows: list):
        self.longest = max(map(len, rows), default=0)
        safe = _lengths(rows) < SAFE
        self.every = (np.array(ids, dtype=np.int64), rows)
        self.odd = (self.every[0][~safe], [r for r, ok in zip(rows, safe, strict=True) if not ok])
        ids, rows = self.every[0][safe], [r for r, ok in zip(rows, safe, strict=True) if ok]
        self.chunks = [(ids[a : a + CHUNK], rows[a : a + CHUNK]) for a in range(0, len(rows), CHUNK)]
        self.ready: dict[int, list] = {}

    def matrices(self, width: int) -> list:
        if width not in self.ready:
            self.ready = {width: [(x := _matrix(rows, width), _summaries(x)) for _, rows in self.chunks]}
        return self.ready[width]


def _folded(best, found, k: int, n: int):
    """The k best of each of n queries among those so far and these (query, score, id), and the k-th scores."""
    q, s, i = (np.concatenate([x, y]) for x, y in zip(best, found, strict=True))
    order = np.lexsort((i, -s, q))
    q, s, i = q[order], s[order], i[order]
    first = np.searchsorted(q, np.arange(n))
    keep = np.arange(len(q)) - first[q] < k
    q, s, i = q[keep], s[keep], i[keep]
    least = np.full(n, -np.inf)
    full = np.bincount(q, minlength=n) >= k
    least[full] = s[(np.searchsorted(q, np.arange(n), side="right") - 1)[full]]
    return (q, s, i), least


def _products(a: np.ndarray, b: np.ndarray, at: np.ndarray, cand: np.ndarray, dense: float) -> np.ndarray:
    """Products of the pairs (at, cand) of rows of a and b: by one matrix product if there are many."""
    if len(at) > dense * len(a) * len(b):
        return (a @ b.T)[at, cand]
    return np.concatenate([np.einsum("ij,ij->i", a[at[c : c + 65536]], b[cand[c : c + 65536]]) for c in range(0, max(1, len(at)), 65536)])


def _width(longest: int) -> int:
    return max(4, 1 << (longest - 1).bit_length()) if longest else 4


def _scores(asked: tuple[np.ndarray, list], held: tuple[np.ndarray, list]):
    """(query's place, score, id) of all pairs, in Python's numbers."""
    whole = [[int(x) for x in r] for r in asked[1]], [[int(x) for x in r] for r in held[1]]
    pairs = [(m, max(-MOST - 1, min(MOST, sum(x * y for x, y in zip(u, v, strict=False)))), i) for m, u in zip(asked[0].tolist(), whole[0], strict=True) for i, v in zip(held[0].tolist(), whole[1], strict=True)]
    return [np.array([p[c] for p in pairs], dtype=np.int64) for c in range(3)]


def _answers(part: _Part, ids: np.ndarray, queries: list, floor: np.ndarray, k: int) -> pd.DataFrame:
    """The part's k best for each query, of those that reach ``floor``."""
    n = len(ids)
    none = np.zeros(0, dtype=np.int64)
    best, least = (none, none, none), floor.copy()

    def taken(at, score, own):
        nonlocal best, least
        good = (own != ids[at]) & (score >= least[at])
        best, reached = _folded(best, (at[good], score[good], own[good]), k, n)
        least = np.maximum(floor, reached)

    safe = _lengths(queries) < SAFE
    for some, held in ((np.flatnonzero(~safe), part.every), (np.flatnonzero(safe), part.odd)):
        if len(some) and len(held[0]):
            taken(*_scores((some, [queries[m] for m in some]), held))
    to = np.flatnonzero(safe)
    if len(to) and part.chunks:
        width = _width(max(part.longest, max(map(len, queries), default=0)))
        q = _matrix([queries[m] for m in to], width)
        coarse = _summaries(q)
        most = (q * q).sum(axis=1).max()
        for (own, _), (x, levels) in zip(part.chunks, part.matrices(width), strict=True):
            size = np.sqrt((x * x).sum(axis=1).max() * most)
            slack = 1e-6 * size + 1e-6  # doubles' rounding; it only lets more pairs through
            at, cand = np.nonzero(coarse[0] @ levels[0].T + slack >= least[to][:, None])
            for qs, xs in zip(coarse[1:], levels[1:], strict=True):
                ok = _products(qs, xs, at, cand, 0.2) + slack >= least[to[at]]
                at, cand = at[ok], cand[ok]
            taken(to[at], _products(q, x, at, cand, 0.05).astype(np.int64), own[cand])
    return pd.DataFrame({"query_id": ids[best[0]], "vec_id": best[2], "score": best[1]})


def _search(k: int):
    """From rows (part, query, id, v, floor) sorted by part, its vectors first: each part's k best for each query that reach its floor."""

    def run(frames):
        at, part, ids, rows = None, None, [], []
        for f in frames:
            new = np.flatnonzero(np.diff(f["part"].to_numpy(), prepend=f["part"].iloc[0] - 1)) if len(f) else []
            for a, z in zip(new, [*new[1:], len(f)], strict=True):
                own = f.iloc[a:z]
                if own["part"].iloc[0] != at:
                    at, part, ids, rows = own["part"].iloc[0], None, [], []
                held = own[~own["query"]]
                ids += held["id"].tolist()
                rows += held["v"].tolist()
                asked = own[own["query"]]
                if len(asked) and rows:
                    part = part or _Part(ids, rows)
                    for c in range(0, len(asked), QUERIES):
                        block = asked.iloc[c : c + QUERIES]
                        yield _answers(part, block["id"].to_numpy(dtype=np.int64), block["v"].tolist(), block["floor"].to_numpy(dtype=np.float64), k)

    return run


def _stats(x: np.ndarray) -> np.ndarray:
    """The statistics that envelopes are made of: scaled means, then deviations, of at most SEGMENTS segments."""
    parts = min(SEGMENTS, x.shape[1])
    with np.errstate(over="ignore", invalid="ignore"):
        cut = x.reshape(len(x), parts, x.shape[1] // parts)
        out = np.hstack([cut.mean(axis=2), cut.std(axis=2)]) * np.sqrt(x.shape[1] // parts)
    return np.nan_to_num(out, nan=np.inf, posinf=np.inf, neginf=-np.inf)


def curve_key(means: np.ndarray) -> np.ndarray:
    """A place on the Z curve through four coarse means on a logarithmic scale: vectors alike in all of them are near."""
    four = means.reshape(len(means), min(4, means.shape[1]), -1).mean(axis=2)
    with np.errstate(invalid="ignore"):
        steps = np.clip(np.nan_to_num(np.sign(four) * np.log2(1 + np.abs(four))) + 64, 0, 127.99) * 256
    steps = steps.astype(np.uint64)
    key = np.zeros(len(means), dtype=np.uint64)
    for bit in range(15):
        for c in range(steps.shape[1]):
            key |= ((steps[:, c] >> np.uint64(bit)) & np.uint64(1)) << np.uint64(bit * 4 + c)
    return key.view(np.int64)


def _described(width: int):
    def run(frames):
        for f in frames:
            if len(f):
                stats = _stats(_matrix(f["v"].tolist(), width))
                yield pd.DataFrame({"id": f["vec_id"], "v": f["v"], "key": curve_key(stats[:, : stats.shape[1] // 2])})

    return run


def _enveloped(width: int):
    """From rows (part, v): the envelope of each part's vectors in a batch."""

    def run(frames):
        for f in frames:
            for part, own in f.groupby("part"):
                stats = _stats(_matrix(own["v"].tolist(), width))
                yield pd.DataFrame({"part": [part], "low": [stats.min(axis=0)], "high": [stats.max(axis=0)]})

    return run


def envelope_bounds(stats: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each query (its statistics) and each envelope a bound of the inner product with any vector in it."""
    n = stats.shape[1] // 2
    with np.errstate(over="ignore", invalid="ignore"):
        mean, spread = stats[:, :n], stats[:, n:]
        up, down = np.maximum(mean, 0), np.minimum(mean, 0)
        bound = up @ high[:, :n].T + down @ low[:, :n].T + spread @ high[:, n:].T
        size = np.abs(mean) @ np.maximum(np.abs(low[:, :n]), np.abs(high[:, :n])).T + spread @ high[:, n:].T
        bound = bound + 1e-6 * size + 1e-6
    return np.where(np.isnan(bound), np.inf, bound)


def _reached(width: int, best: bool):
    """From rows (block, query, id, v, floor, avoid, parts, low, high) sorted by block, its envelopes first: the parts that each query
    goes to, by ``best`` only the one that promises most, else all whose envelope reaches the floor but ``avoid``."""

    def run(frames):
        at, parts, low, high = None, None, None, None
        for f in frames:
            for block, own in f.groupby("block", sort=False):
                for r in own[~own["query"]].itertuples():
                    at, parts = block, np.asarray(r.parts, dtype=np.int64)
                    low, high = (np.asarray(x, dtype=np.float64).reshape(len(parts), -1) for x in (r.low, r.high))
                asked = own[own["query"]]
                for c in range(0, len(asked) if at == block else 0, QUERIES):
                    q = asked.iloc[c : c + QUERIES]
                    bound = envelope_bounds(_stats(_matrix(q["v"].tolist(), width)), low, high)
                    if best:
                        m, p = np.arange(len(q)), bound.argmax(axis=1)
                    else:
                        m, p = np.nonzero((bound >= q["floor"].to_numpy(dtype=np.float64)[:, None]) & (parts[None, :] != q["avoid"].to_numpy(dtype=np.int64)[:, None]))
                    if len(m):
                        yield pd.DataFrame({"part": parts[p], "id": q["id"].to_numpy()[m], "v": q["v"].iloc[m].tolist(), "floor": q["floor"].to_numpy()[m], "bound": bound[m, p]})

    return run


def _routed(asked: DataFrame, envelopes: DataFrame, blocks: int, width: int, best: bool) -> DataFrame:
    """(part, id, v, floor, bound): the queries ``asked`` (id, v, floor, avoid) for the parts that they go to."""
    every = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(True).alias("query"), "id", "v", "floor", "avoid")
    both = envelopes.withColumn("query", F.lit(False)).unionByName(every, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "query")
    return both.mapInPandas(_reached(width, best), "part long, id long, v array<double>, floor double, bound double")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, shuffled: list | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): see the module. Both inputs as ``integer_vectors`` gives them. ``shuffled``, a list, gets the number of
    pairs of part and query that were compared, and of all there are."""
    folder = shared_folder(vectors.sparkSession)
    vectors = written(vectors.distinct(), folder, "vectors")
    asked = written(queries.distinct().select(F.col("vec_id").alias("id"), "v"), folder, "queries")
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    longest = max(size["width"] or 0, asked.agg(F.max(F.size("v"))).first()[0] or 0)
    width = _width(longest)
    parts = max(1, -(-size["n"] * (size["width"] or 1) // PART))
    described = written(vectors.mapInPandas(_described(width), "id long, v array<double>, key long"), folder, "described")
    held = written(described.repartitionByRange(parts, "key", "id").withColumn("part", F.spark_partition_id().cast("long")), folder, "held")
    several = held.select("part", "v").mapInPandas(_enveloped(width), "part long, low array<double>, high array<double>").groupBy("part").agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high"))
    joined = lambda c, f: F.reduce(F.slice(c, 2, F.size(c)), F.get(c, F.lit(0)), lambda x, y: F.zip_with(x, y, lambda a, b: f(a, b))).alias(c)
    envelopes = several.select("part", joined("low", F.least), joined("high", F.greatest), F.floor(F.col("part") / ENVELOPES).alias("block"))
    item = F.sort_array(F.collect_list(F.struct("part", "low", "high")))
    envelopes = envelopes.groupBy("block").agg(item.alias("e")).select("block", F.col("e.part").alias("parts"), F.flatten("e.low").alias("low"), F.flatten("e.high").alias("high"))
    envelopes = written(envelopes, folder, "envelopes")
    blocks = -(-parts // ENVELOPES)

    def found(pairs: DataFrame) -> DataFrame:
        rows = held.select("part", F.lit(False).alias("query"), "id", "v", F.lit(None).cast("double").alias("floor"))
        both = rows.join(pairs.select("part").distinct(), "part", "left_semi").unionByName(pairs.select("part", F.lit(True).alias("query"), "id", "v", "floor"))
        return both.repartition("part").sortWithinPartitions("part", "query").mapInPandas(_search(k), "query_id long, vec_id long, score long")

    none = asked.withColumns({"floor": F.lit(float("-inf")), "avoid": F.lit(-1).cast("long")})
    promised = _routed(none, envelopes, blocks, width, True)
    first = promised.groupBy("id", "v").agg(F.max(F.struct("bound", "part"))["part"].alias("part"))
    first = written(first.withColumn("floor", F.lit(float("-inf"))), folder, "first")
    near = written(found(first), folder, "near")
    kth = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("kth"))
    # a vec_id with several vectors is one query id: its threshold is that of none of them, so it has none
    once = asked.groupBy("id").agg(F.count("*").alias("m"))
    known = first.drop("floor").join(kth, first["id"] == kth["query_id"], "left").join(once, "id").select("id", "v", F.coalesce(F.when(F.col("m") == 1, F.col("kth")), F.lit(float("-inf"))).alias("floor"), F.col("part").alias("avoid"))
    more = written(_routed(written(known, folder, "known"), envelopes, blocks, width, False), folder, "more")
    if shuffled is not None:
        shuffled += [first.count() + more.count(), parts * asked.count()]
    every = near.unionByName(found(more))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk_search(spark, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))
