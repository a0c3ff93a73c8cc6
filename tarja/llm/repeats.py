"""Operator 2: removal of long repeated byte strings with two-stage suffix sorting.

Every byte of a document covered by a string of LENGTH bytes that also starts anywhere else is
removed. Suffixes of all the bytes together don't fit one task, so equal strings meet as follows:

1. Texts are known by a hash of 128 bits. A text of two documents or more is covered as a whole; its
   windows stand for all its copies.
2. Each window of LENGTH bytes is filed under the least key among its byte runs of ANCHOR
   bytes. Equal windows hold the same runs, so they share that key, at the same place. Adjacent
   windows with one such run form a segment, about one for each 85 bytes.
3. Segments are counted by key before the shuffle, and those alone under their key go. Of the
   others, equal ones (by digest) collapse to one representative with a flag that it is covered.
   Both are partial aggregates and joins that adaptive execution splits, so a passage
   that a third of the documents hold fills no task.
4. Of each key that has unlike representatives, a suffix array over their bytes, by two-stage
   sorting, and the common prefixes of neighbours in it name the repeated windows.
5. A key with over BLOCK representatives would fill a task. Its segments are cut into runs of WIDTHS
   places relative to the anchor, and filed under the bytes that all windows of such a run hold, so
   that windows which can be equal stay together; counting, collapsing and sorting start over on
   those. At the last width a run is one window, and its bytes themselves say which are equal.
6. Covered ranges meet the text again and cut it.

A null text is empty. Texts shorter than LENGTH keep everything. Rows alike in doc_id and text
are one document, which is no repetition of itself, and each gives its row; rows with one
doc_id and different texts are different documents. A null doc_id is a doc_id. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, table, written
from .hashing import U, RangeDigest, mix, run_keys, text_slices
from .suffix import repeated

LENGTH = 200
ANCHOR = 32
#: Unlike segments of one key that one task sorts; about 290 bytes each.
BLOCK = 2048
#: Window places of one run when the segments of a key are cut, from one round to the next.
WIDTHS = (24, 4, 1)
#: Bytes that are sorted at a time.
SORTED = 1 << 19
#: Texts that a task remembers so as not to cut copies again.
SEEN = 1 << 20

ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, {2 * LENGTH})) AS x FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {LENGTH - 1})) AS i FROM d WHERE length(h) >= {2 * LENGTH})
), r AS (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {LENGTH} THEN 0 ELSE 1 END AS new
  FROM (SELECT *, count(*) OVER (PARTITION BY x) AS n FROM w) WHERE n > 1
), s AS (
  SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS z FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM r) GROUP BY doc_id, g
), k AS (
  SELECT doc_id, h, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS e FROM d JOIN s USING (doc_id)
), c AS (
  SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * e + 1, 2 * (a - e)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept FROM k GROUP BY doc_id
)
SELECT d.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""

SEGMENT = "h long, digest long, th long, start int, windows int, lead int"


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return np.minimum(h[: len(h) - (width - step)], h[width - step :]) if width > step else h


def _by_anchor(runs: np.ndarray, least: np.ndarray, first: np.ndarray, last: np.ndarray, reach: int):
    """(first window, last window, anchor) of segments: windows first..last of one least key, cut where the
    leftmost run that has it changes. So equal windows hold that run, the anchor, at the same place,
    and no two windows of a segment are equal."""
    n = len(runs) + 1
    keys, rank = np.unique(least[first], return_inverse=True)
    at = np.flatnonzero(runs <= keys[-1])
    k = np.minimum(np.searchsorted(keys, runs[at]), len(keys) - 1)
    hit = keys[k] == runs[at]
    places = np.sort(k[hit] * n + at[hit])
    low = np.searchsorted(places, rank * n + first)
    many = np.searchsorted(places, rank * n + last + reach, side="right") - low
    owner = np.repeat(np.arange(len(first)), many)
    place = places[np.repeat(low - np.cumsum(many) + many, many) + np.arange(len(owner))] - rank[owner] * n
    inner = place < last[owner]
    start = np.concatenate([first, place[inner] + 1])
    of = np.concatenate([np.arange(len(first)), owner[inner]])
    order = np.argsort(start, kind="stable")
    start, of = start[order], of[order]
    end = last[of]
    same = of[1:] == of[:-1]
    end[:-1][same] = start[1:][same] - 1
    anchor = places[np.searchsorted(places, rank[of] * n + end)] - rank[of] * n
    return start, end, anchor


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _segments(length: int):
    """From (th, text): SEGMENT, and ``more``, the places of the text's other segments equal to this one."""

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            if len(seen) > SEEN:
                seen.clear()
            fresh = [h not in seen and not seen.add(h) for h in b.column("th").to_pylist()]
            b = b.filter(pa.array(fresh, pa.bool_()))
            th = b.column("th").to_numpy()
            for row, data, offsets in text_slices(b.column("text")):
                if len(data) < length:
                    continue
                runs = run_keys(data, ANCHOR)
                least = _sliding_min(runs, length - ANCHOR + 1)
                size = np.diff(offsets)
                long = np.flatnonzero(size >= length)
                inside = np.zeros(len(least) + 1, dtype=np.int8)
                inside[offsets[long]] = 1
                inside[offsets[long] + size[long] - length + 1] -= 1
                inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
                first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])]))
                last = np.append(first[1:], len(least)) - 1
                first, last = first[inside[first]], last[inside[first]]
                if not len(first):
                    continue
                first, last, anchor = _by_anchor(runs, least, first, last, length - ANCHOR)
                of = np.searchsorted(offsets, first, side="right") - 1
                key, digest, lead = least[first], RangeDigest(data)(first, last + length), anchor - last
                # equal segments of one text are one row with the places of the others
                order = np.lexsort((first, digest, key, of))
                first, last, of, key, digest, lead = (x[order] for x in (first, last, of, key, digest, lead))
                head = np.ones(len(first), dtype=bool)
                head[1:] = (of[1:] != of[:-1]) | (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])
                at = np.flatnonzero(head)
                many = np.diff(np.append(at, len(first))) - 1
                more = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), pa.array((first - offsets[of])[~head].astype(np.int32)))
                first, last, of, key, digest, lead = (x[at] for x in (first, last, of, key, digest, lead))
                cols = [_signed(mix(key)), _signed(digest), pa.array(th[row + of]), pa.array((first - offsets[of]).astype(np.int32)), pa.array((last - first + 1).astype(np.int32)), pa.array(lead.astype(np.int32)), more]
                yield pa.RecordBatch.from_arrays(cols, ["h", "digest", "th", "start", "windows", "lead", "more"])

    return run


def _bytes_of(column: pa.Array, i: int) -> bytes:
    value = column[i].as_py()
    return value.encode("utf-8") if value else b""


def _cut(length: int):
    """From (th, text, places): the places with their bytes, once for each text of a task."""

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            if len(seen) > SEEN:
                seen.clear()
            own, pieces, of = [], [], []
            for i, (h, places) in enumerate(zip(b.column("th").to_pylist(), b.column("places"), strict=True)):
                if h in seen:
                    continue
                seen.add(h)
                text = _bytes_of(b.column("text"), i)
                part = places.values
                starts = part.field("start").to_numpy()
                ends = starts + part.field("windows").to_numpy() - 1 + length
                own.append(part)
                of += [h] * len(part)
                pieces += [text[a:z] for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
            if own:
                t = pa.Table.from_batches([pa.RecordBatch.from_struct_array(x) for x in own]).combine_chunks()
                yield from t.append_column("th", pa.array(of, pa.int64())).append_column("piece", pa.array(pieces, pa.binary())).select(["h", "th", "start", "windows", "lead", "kinds", "piece"]).to_batches()

    return run


def _runs(length: int, width: int):
    """Segments with their bytes -> runs of at most ``width`` window places relative to the anchor, filed
    under the bytes that every window at such places holds."""

    def run(batches):
        for b in batches:
            for row, data, offsets in text_slices(b.column("piece")):
                n = len(offsets) - 1
                h, th, start, windows, lead = (b.column(c).slice(row, n).to_numpy(zero_copy_only=False) for c in ("h", "th", "start", "windows", "lead"))
                # a window's distance is what lies between its start and the anchor
                far = (lead + windows - 1).astype(np.int64)
                low, many = lead // width, far // width - lead // width + 1
                of = np.repeat(np.arange(n), many)
                block = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + low[of]
                high = np.minimum(far[of], (block + 1) * width - 1)
                least = np.maximum(lead[of], block * width)
                at = offsets[of] + far[of] - high
                count = high - least + 1
                digest = RangeDigest(data)
                core = offsets[of] + far[of] - block * width
                key = mix(mix(digest(core, core + length - width + 1) + h.view(U)[of]) + (block * 64 + width).astype(U))
                piece = [data[a:z].tobytes() for a, z in zip(at.tolist(), (at + count - 1 + length).tolist(), strict=True)]
                cols = [_signed(key), _signed(digest(at, at + count - 1 + length)), pa.array(th[of]), pa.array((start[of] + far[of] - high).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(least.astype(np.int32)), pa.array(piece, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["h", "digest", "th", "start", "windows", "lead", "piece"])

    return run


def _sorted_repeats(length: int):
    """From pieces sorted by key: the ranges (th, start, windows) that stand twice under their key."""

    def run(batches):
        held = None

        def found(t: pa.Table):
            new = np.zeros(t.num_rows, dtype=bool)
            new[:1] = True
            for c in ("h", "th", "start"):  # a text that two tasks have cut gives each piece twice
                x = t.column(c).to_numpy()
                new[1:] |= x[1:] != x[:-1]
            t = t if new.all() else t.filter(pa.array(new))
            starts = t.column("start").to_numpy()
            hits = repeated(t.column("piece").to_pylist(), length)
            rows, first, count = [], [], []
            for i, at in enumerate(hits):
                if len(at):
                    cut = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
                    rows.append(np.full(len(cut), i))
                    first.append(starts[i] + at[cut])
                    count.append(np.diff(np.append(cut, len(at))))
            if rows:
                own = t.select(["th"]).take(pa.array(np.concatenate(rows))).combine_chunks()
                yield from own.append_column("start", pa.array(np.concatenate(first), pa.int32())).append_column("windows", pa.array(np.concatenate(count), pa.int32())).to_batches()

        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            if not t.num_rows:
                continue
            h = t.column("h").to_numpy()
            size = np.cumsum(pc.binary_length(t.column("piece").combine_chunks()).to_numpy(zero_copy_only=False))
            group = np.append(np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])), len(h))
            a = 0
            for z, nxt in zip(group[1:-1], group[2:], strict=True):
                if size[nxt - 1] - (size[a - 1] if a else 0) > SORTED:
                    yield from found(t.slice(a, z - a))
                    a = z
            held = t.slice(a)
        if held is not None and held.num_rows:
            yield from found(held)

    return run


def _kept(length: int):
    """From (doc_id, text, places): what is removed, as merged spans of bytes, and what remains."""

    def run(batches):
        for b in batches:
            n, spans, rest = [], [], []
            for i, places in enumerate(b.column("places")):
                text = _bytes_of(b.column("text"), i)
                n.append(len(text))
                if not places.is_valid:
                    spans.append([])
                    rest.append(text)
                    continue
                at = places.values.field("start").to_numpy()
                end = np.minimum(at + places.values.field("windows").to_numpy() - 1 + length, len(text))
                order = np.argsort(at, kind="stable")
                at, end = at[order], np.maximum.accumulate(end[order])
                new = np.flatnonzero(np.concatenate([[True], at[1:] > end[:-1]]))
                start, stop = at[new], end[np.append(new[1:], len(at)) - 1]
                spans.append([{"start": a, "end": z} for a, z in zip(start.tolist(), stop.tolist(), strict=True)])
                rest.append(b"".join(text[a:z] for a, z in zip([0, *stop.tolist()], [*start.tolist(), len(text)], strict=True)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(rest, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return run


def _decided(segments: DataFrame, folder: str, name: str, same: str) -> DataFrame:
    """``segments`` that matter, with ``covered`` (its equal stands elsewhere), ``first`` (it
    represents its equals) and ``kinds`` (unlike representatives of its key). Segments of a key are equal by ``same``."""
    place = F.xxhash64("th", "start")
    more = F.max(F.size("more") > 0)
    busy = segments.groupBy("h").agg(F.min(place).alias("a"), F.max(place).alias("z"), more.alias("m")).where("a <> z or m").select("h")
    # written, so that both sides of the join are plain shuffles, which adaptive execution can split
    busy = written(busy, folder, f"{name}-busy")
    shared = written(segments.join(busy, "h"), folder, f"{name}-shared")
    equal = shared.groupBy("h", same).agg(F.min(place).alias("a"), F.max(place).alias("z"), more.alias("m"))
    equal = written(equal.select("h", same, F.col("a").alias("place"), (F.expr("a <> z") | F.col("m")).alias("covered")), folder, f"{name}-equal")
    kinds = written(equal.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"), folder, f"{name}-kinds")
    told = equal.join(kinds, "h", "left").where("covered or kinds > 1").withColumn("kinds", F.coalesce("kinds", F.lit(1).cast("long")))
    met = shared.join(told, ["h", same]).withColumn("first", place == F.col("place")).drop("place")
    return written(met.where(F.col("covered") | F.col("first")), folder, f"{name}-decided")


def removed_spans(docs: DataFrame, folder: str, length: int = LENGTH) -> DataFrame:
    """(th, start, windows): starts of repeated strings of ``length`` bytes, in runs, for docs (doc_id, th, text)."""
    bytes_ = F.octet_length(F.coalesce("text", F.lit("")))
    copies = docs.groupBy("th").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.max(F.col("doc_id").isNull()).alias("none"), F.max(bytes_).alias("n"))
    ranges = copies.where((F.expr("a <> z") | (F.col("none") & F.col("a").isNotNull())) & (F.col("n") >= length))
    ranges = ranges.select("th", F.lit(0).alias("start"), (F.col("n") - (length - 1)).cast("int").alias("windows"))
    texts = docs.select("th", "text")
    segments = written(texts.mapInArrow(_segments(length), f"{SEGMENT}, more array<int>"), folder, "segments")
    for k, width in enumerate((*WIDTHS, 0)):
        met = _decided(segments, folder, f"round-{k}", "digest" if width else "piece")
        places = F.explode(F.concat(F.array("start"), "more"))
        ranges = ranges.unionByName(met.where("covered").select("th", places.alias("start"), "windows"))
        unlike = met.where(F.col("first") & (F.col("kinds") > 1))
        if k == 0:
            own = written(unlike.groupBy("th").agg(F.collect_list(F.struct("h", "start", "windows", "lead", "kinds")).alias("places")), folder, "places")
            pieces = texts.join(own, "th").mapInArrow(_cut(length), "h long, th long, start int, windows int, lead int, kinds long, piece binary")
            unlike = written(pieces, folder, "pieces")
        few = unlike if not width else unlike.where(F.col("kinds") <= BLOCK)
        ranges = ranges.unionByName(few.select("h", "th", "start", "piece").repartition("h").sortWithinPartitions("h", "th", "start").mapInArrow(_sorted_repeats(length), "th long, start int, windows int"))
        many = unlike.where(F.col("kinds") > BLOCK)
        if not width or many.isEmpty():
            return ranges
        runs = many.select("h", "th", "start", "windows", "lead", "piece").mapInArrow(_runs(length, width), f"{SEGMENT}, piece binary")
        segments = written(runs.withColumn("more", F.array().cast("array<int>")), folder, f"runs-{k}")
    return ranges


def _with_text_key(docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, th, text): a 64-bit key for each text. Where unlike texts, told apart by 128 bits, share their first 64,
    the key is made of all of them."""
    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.xxhash64(F.lit(7), text).alias("__h2"), text.alias("text"))
    keys = own.groupBy("th").agg(F.min("__h2").alias("a"), F.max("__h2").alias("z"))
    shared = written(keys.where("a <> z").select("th", F.lit(True).alias("__shared")), folder, "shared-keys")
    if shared.isEmpty():
        return own.drop("__h2")
    return own.join(shared, "th", "left").select("doc_id", F.when(F.col("__shared"), F.xxhash64(F.lit(11), "th", "__h2")).otherwise(F.col("th")).alias("th"), "text")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for every row: the size of the text, the maximal removed runs of
    its bytes, and the bytes that remain, which may split a character; see the module."""
    folder = shared_folder(docs.sparkSession)
    docs = _with_text_key(docs, folder)
    # written, so that a text with very many copies can be split in the join
    own = written(removed_spans(docs, folder, length).groupBy("th").agg(F.collect_list(F.struct("start", "windows")).alias("places")), folder, "removed")
    return docs.join(own, "th", "left").select("doc_id", "text", "places").mapInArrow(_kept(length), "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")


def repeat_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row."""
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    found = remove_repeats(docs, length)
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents"))
