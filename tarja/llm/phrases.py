r"""Operator 12: phrase collocations, from mergeable Misra-Gries summaries and an exact second pass.

Texts, in lower case (A-Z), are split at ``[.,;:!?\x0A-\x0D]`` into pieces and those into words ``[^\x20\x09]+``. A phrase of
one to four words is counted with all its occurrences inside pieces, for each language of its own. Phrases of two words or more that
occur LEAST times or more are candidates.

1. First pass: phrases are hashed, and the hash's front says which of P partitions they belong to. A task sums up its texts in one
   summary for each partition (keys of 32 bits and counts). Summaries of a partition are merged: keys are added up, and beyond its capacity
   the largest count that doesn't fit is taken from all. What is taken in all is at most mass / capacity, and as the
   capacity is MARGIN times the partition's mass divided by LEAST, every phrase that occurs LEAST times keeps a
   counter. P grows with the text, so that a partition's counters fit one task.
2. The fronts of the hashes that survive are marked in a bit map of 32 MB at most, which tells the second pass what to
   count. Strange phrases may be marked too, so that they are counted in vain; none that is frequent is missed.
3. Second pass: marked occurrences are counted as what they are, their bytes, by task and then by Spark, and those under LEAST go.
   Everything behind this is joins of the frequent phrases, of which parts of a frequent phrase are some.

Cutting a candidate after k words gives l and r, the counts of its parts, and the score floor(2000000 * a / (l + r));
the least one counts, then the smallest k. Candidates inside a longer one that occurs nearly as often
(100 * f >= 80 * a) go. Products are decimals of 38 digits. Of each language the first TOP are returned; they are ranked
in parts first, so that a language of very many candidates is no task's alone.

A null text is empty, a null language is ``und``; rows are counted as often as they stand, whatever their doc_id. A text
without phrases adds its words to n. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, shared_folder, table, written
from .hashing import RangeDigest, U, mix, text_slices
from .shingles import _LOWER

LONGEST = 4
LEAST = 30
INSIDE = 80
TOP = 2000
#: By how much a summary's capacity exceeds its mass divided by LEAST.
MARGIN = 4
#: Phrases of one partition, about, and partitions at least.
MASS = 1 << 25
PARTS = 256
#: Hashes that a task sums up at a time, and counted phrases that it holds.
HELD = 1 << 20
COUNTED = 1 << 17
#: Bytes of text that are cut into phrases at a time.
SLICE = 1 << 17
#: Bits of the map of survivors, as a power of two: at most, and beyond that of their number.
MAP_BITS = 28
SPARSE = 6
SALT = 64

_SPLITS = np.zeros(256, dtype=bool)
_SPLITS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_IN_WORD = ~_SPLITS
_IN_WORD[[0x20, 0x09]] = False


def language(lang: Column) -> Column:
    return F.coalesce(lang.cast("string"), F.lit("und"))


class _Words:
    """The words of a slice of texts: where they begin and end, and of which row and piece they are."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.low = _LOWER[data]
        inside = np.concatenate([[False], _IN_WORD[self.low], [False]])
        first = np.zeros(len(data) + 1, dtype=bool)
        first[offsets] = True
        here, before = inside[1:], inside[:-1]
        self.begins = np.flatnonzero(here[:-1] & (~before[:-1] | first[:-1]))
        self.ends = np.flatnonzero(before & (~here | first))
        self.row = np.searchsorted(offsets, self.begins, side="right") - 1
        self.piece = np.cumsum(_SPLITS[self.low])[self.begins] + self.row  # both only grow

    def hashes(self, seeds: np.ndarray):
        """For each length: the first words of the phrases of it, and their hashes. ``seeds``: of the rows' languages."""
        words = RangeDigest(self.low)(self.begins, self.ends)
        h = mix(seeds[self.row] + words)
        yield np.arange(len(h)), h
        for k in range(1, LONGEST):
            if len(words) <= k:
                return
            h = mix(h[:-1] * U(3) + words[k:])
            whole = np.flatnonzero(self.piece[:-k] == self.piece[k:])
            yield whole, h[whole]

    def spaced(self) -> tuple[np.ndarray, np.ndarray]:
        """All words with one space behind each, and where they begin."""
        size = self.ends - self.begins
        ahead = np.concatenate([[0], np.cumsum(size + 1)])
        at = np.arange(ahead[-1]) - np.repeat(ahead[:-1] - self.begins, size + 1)
        out = self.low[np.minimum(at, len(self.low) - 1)]
        out[ahead[1:] - 1] = 0x20
        return out, ahead


def _seeds(langs: list[str]) -> np.ndarray:
    known = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(langs)}
    return np.array([known[x] for x in langs], dtype=U)


def _slices(b: pa.RecordBatch):
    langs = b.column("lang").to_pylist()
    for row, data, offsets in text_slices(b.column("text"), SLICE):
        own = langs[row : row + len(offsets) - 1]
        words = _Words(data, offsets)
        if len(words.begins):
            yield own, words, _seeds(own)


# --- summaries: sorted keys of 32 bits and their counts. As bytes: differences of keys, then counts, each by places of the byte.


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    both = np.concatenate([np.diff(keys, prepend=keys.dtype.type(0)), counts]).astype("<u4")
    return both.view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(value: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(np.frombuffer(value, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel()
    n = len(both) // 2
    return np.cumsum(both[:n], dtype=np.int64), both[n:].astype(np.int64)


def merged(parts: list[tuple[np.ndarray, np.ndarray]], capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The summary of several: (keys, counts, what was taken from every count)."""
    keys, counts = (np.concatenate([p[c] for p in parts]) for c in (0, 1))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
    if len(keys) <= capacity:
        return keys, counts, 0
    taken = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    left = counts > taken
    return keys[left], counts[left] - taken, taken


def _summed(bits: int):
    """Rows (part, mass, summary) of a task's phrases; ``bits``: of the number of partitions."""

    def summaries(held):
        ids = np.concatenate(held)
        ids.sort()
        at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        counts, ids = np.diff(np.append(at, len(ids))), ids[at]
        part = (ids >> U(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        keys = (ids & U(0xFFFFFFFF)).astype(np.uint32)
        own = [(int(part[a]), int(counts[a:z].sum()), packed(keys[a:z], counts[a:z])) for a, z in zip(first.tolist(), [*first[1:].tolist(), len(ids)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*own, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "mass", "summary"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            for _, words, seeds in _slices(b):
                for _, h in words.hashes(seeds):
                    held.append(h >> U(32 - bits))
                    n += len(h)
                if n > HELD:
                    yield summaries(held)
                    held, n = [], 0
        if n:
            yield summaries(held)

    return run


def _survivors(bits: int):
    """From rows (part, mass, summary, total) sorted by part, total being the part's mass: the fronts of the hashes whose phrases may occur LEAST times."""

    def kept(part, state, taken):
        keys, counts = state
        ids = (U(part) << U(32)) | keys[counts + taken >= LEAST].astype(U)
        return pa.RecordBatch.from_arrays([pa.array(np.unique(ids >> U(bits + 32 - MAP_BITS)).view(np.int64))], ["bit"])

    def run(batches):
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        at, state, taken = None, none, 0
        for b in batches:
            parts = b.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if a == z:
                    continue
                if parts[a] != at:
                    if at is not None:
                        yield kept(at, state, taken)
                    at, state, taken = int(parts[a]), none, 0
                capacity = MARGIN * b.column("total")[a].as_py() // LEAST + 1
                keys, counts, more = merged([state, *(unpacked(x) for x in b.column("summary").slice(a, z - a).to_pylist())], capacity)
                state, taken = (keys, counts), taken + more
        if at is not None:
            yield kept(at, state, taken)

    return run


def _bit_map(survivors: DataFrame) -> tuple[np.ndarray, int]:
    """The survivors' bits and how many make a place in them; at most 2 ** MAP_BITS, 32 MB, in pages of 4 KB."""
    map_bits = min(MAP_BITS, max(15, survivors.count().bit_length() + SPARSE))
    survivors = survivors.select(F.shiftright("bit", MAP_BITS - map_bits).alias("bit"))
    pages = survivors.groupBy(F.floor(F.col("bit") / 32768).alias("page")).agg(F.bitmap_construct_agg(F.pmod("bit", F.lit(32768))).alias("bits"))
    out = np.zeros(max(4096, (1 << map_bits) // 8), dtype=np.uint8)
    for r in pages.toLocalIterator():
        out[r["page"] * 4096 : (r["page"] + 1) * 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out, map_bits


def _counted(marks: np.ndarray, map_bits: int):
    """Rows (lang, phrase, f) of the marked phrases of a task; under the phrase "" all words."""

    def marked(langs, words, seeds):
        text, at = words.spaced()
        starts, ends, rows = [], [], []
        for k, (i, h) in enumerate(words.hashes(seeds)):
            bit = h >> U(64 - map_bits)
            i = i[(marks[(bit >> U(3)).astype(np.int64)] >> (bit & U(7)).astype(np.uint8)) & 1 == 1]
            starts.append(at[i])
            ends.append(at[i + k + 1] - 1)
            rows.append(words.row[i])
        starts, ends, rows = map(np.concatenate, (starts, ends, rows))
        size = ends - starts
        offsets = np.concatenate([[0], np.cumsum(size)])
        data = text[np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts, size)]
        phrases = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
        names = pa.array(langs, pa.string()).dictionary_encode()
        lang = pa.array(names.indices.to_numpy()[rows])
        t = pa.table({"lang": lang, "phrase": phrases}).group_by(["lang", "phrase"]).aggregate([([], "count_all")])
        totals = np.bincount(names.indices.to_numpy()[words.row], minlength=len(names.dictionary))
        every = pa.table({"lang": pa.array(np.arange(len(totals)), lang.type), "phrase": pa.array([b""] * len(totals), pa.large_binary()), "count_all": totals})
        t = pa.concat_tables([t, every])
        return pa.table({"lang": names.dictionary.take(t.column("lang").combine_chunks()), "phrase": t.column("phrase"), "f": t.column("count_all").cast(pa.int64())})

    def run(batches):
        held, n = [], 0

        def summed():
            t = pa.concat_tables(held).group_by(["lang", "phrase"]).aggregate([("f", "sum")])
            return pa.table({"lang": t.column("lang"), "phrase": t.column("phrase").cast(pa.binary()), "f": t.column("f_sum")})

        for b in batches:
            for langs, words, seeds in _slices(b):
                held.append(marked(langs, words, seeds))
                n += held[-1].num_rows
                if n > COUNTED:
                    t = summed()
                    if t.num_rows > COUNTED // 2:
                        held, n = [], 0
                        yield from t.to_batches(max_chunksize=1 << 15)
                        del t
                        pa.default_memory_pool().release_unused()
                    else:
                        held, n = [t.cast(held[0].schema)], t.num_rows
        if held:
            yield from summed().to_batches(max_chunksize=1 << 15)

    return run


def counted_phrases(docs: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of the phrases that occur LEAST times or more, a written table, and (lang, n), the words of each language."""
    texts = docs.select(language(F.col("lang")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(PARTS, -(-size * LONGEST // (2 * MASS))).bit_length() - 1  # a word takes two bytes at least
    rows = written(texts.mapInArrow(_summed(bits), "part long, mass long, summary binary"), folder, "summaries")
    mass = written(rows.groupBy("part").agg(F.sum("mass").alias("total")), folder, "masses")
    own = rows.join(F.broadcast(mass), "part") if mass.count() <= 1 << 16 else rows.join(mass, "part")
    found = own.repartition("part").sortWithinPartitions("part").mapInArrow(_survivors(bits), "bit long")
    marks, map_bits = _bit_map(written(found, folder, "survivors"))
    every = texts.mapInArrow(_counted(marks, map_bits), "lang string, phrase binary, f long")
    every = every.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= LEAST) | (F.col("phrase") == F.lit(b"")))
    every = written(every.withColumn("phrase", F.col("phrase").cast("string")), folder, "counted")
    forget(docs.sparkSession, folder, "summaries", "masses", "survivors")
    return every.where("phrase <> ''"), every.where("phrase = ''").select("lang", F.col("f").alias("n"))


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` of each language; see the module."""
    folder = shared_folder(docs.sparkSession)
    frequent, words = counted_phrases(docs, folder)
    phrase = F.split("phrase", " ", -1)
    every = frequent.withColumn("w", phrase).withColumn("m", F.size("w"))
    parts = lambda a, n: F.array_join(F.slice("w", a, n), " ")

    cuts = every.where("m >= 2").select("lang", "phrase", F.col("f").alias("a"), "w", "m", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", parts(F.lit(1), F.col("k")).alias("left"), parts(F.col("k") + 1, F.col("m") - F.col("k")).alias("right"))
    side = lambda name, f: frequent.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    scored = cuts.withColumn("score", F.expr("(cast(2000000 as decimal(18,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))").cast("long"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("s")).select("lang", "phrase", "s.a", "s.l", "s.r", "s.score")

    spans = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(n).alias("n")) for n in range(2, LONGEST) for i in range(1, LONGEST - n + 2)))
    inner = every.where("m >= 3").select("lang", "f", "w", F.explode(F.filter(spans, lambda s: (s["n"] < F.col("m")) & (s["i"] + s["n"] <= F.col("m") + 1))).alias("s"))
    inner = inner.select("lang", parts(F.col("s.i"), F.col("s.n")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | F.expr(f"cast(100 as decimal(18,0)) * cast(longer as decimal(20,0)) < cast({INSIDE} as decimal(18,0)) * cast(a as decimal(20,0))")).drop("longer")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALT))).orderBy(*order))).where(F.col("rank") <= top)
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return few.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (
  SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d
), g AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (SELECT unnest(range(1, {LONGEST + 1})) AS m) WHERE len(w) >= m)
), f AS (
  SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL
), n AS (
  SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang
), c AS (
  SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND f >= {LEAST}
), k AS (
  SELECT lang, phrase, a, k, array_to_string(w[:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM c)
), s AS (
  SELECT k.lang, k.phrase, a, k, x.f AS l, y.f AS r, CAST(2000000 AS HUGEINT) * a // (x.f + y.f) AS score FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.x JOIN f y ON y.lang = k.lang AND y.phrase = k.y
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), i AS (
  SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, m - n + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS n FROM c WHERE m >= 3)) GROUP BY ALL
), o AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.longer IS NULL OR 100 * i.longer < {INSIDE} * a
)
SELECT o.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o JOIN n USING (lang) WHERE rank <= {TOP}
"""
