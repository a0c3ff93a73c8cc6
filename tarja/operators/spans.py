"""Spans: finding them in a text, and algebra on arrays and on rows (doc_id, start, end, ...).

Offsets count code points from 0; ``end`` is exclusive. Operators on arrays work inside a row, and none of them
lets an array or a text grow step by step, so the work follows the length of the text. Operators on rows
partition by ``by`` and carry no text, so one very long document costs a sort of its spans and no more.
``by`` must tell texts apart: an id that is unique and not null (the flows give each row one)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..sources.shared import run_folder, written

OPEN, CLOSE = "\u0001", "\u0002"
MARKS = f"[{OPEN}{CLOSE}]"
NO_SPANS = "array<struct<start:int,end:int>>"
LOCATED = "array<struct<start:int,end:int,found:string>>"
#: Code points of one chunk of a text that is to be cut at many places.
CHUNK = 1024


def clean_marks(text: Column) -> Column:
    """Spaces for the two control characters that mark matches."""
    return F.replace(F.replace(text, F.lit(OPEN), F.lit(" ")), F.lit(CLOSE), F.lit(" "))


#: How far apart the neighbours lie that ``running`` joins, round by round.
REACHES = [4**k for k in range(13)]


def running(values: Column, op: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """For each place of an array of int the sum (or ``op``) of all values up to it.

    Each round joins four neighbours of the round before, which lie four times as far apart, in an array of the same
    size; a round that an array is too short for passes it on."""

    none = F.lit(-1 if op is F.greatest else 0)  # offsets are 0 or more

    def joined(a: Column, reach: Column) -> Column:
        def value(x: Column, i: Column) -> Column:
            for k in (1, 2, 3):
                x = op(x, F.coalesce(F.get(a, i - k * reach), none))
            return x

        return F.when(F.size(a) > reach, F.transform(a, value)).otherwise(a)

    return F.aggregate(F.array(*map(F.lit, REACHES)), values, joined)


def marked(text: Column, pattern: Column | str) -> Column:
    """The text with each match between two marks."""
    return F.regexp_replace(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(f"{OPEN}$0{CLOSE}"))


def located(text: Column) -> Column:
    """array<struct<start, end, found>> of what stands between marks in a marked text, empty matches left out.

    The text is split at the marks; a match ends where the lengths of the pieces so far add up to."""

    def of(p: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.shiftright(F.size(p), 1) - 1), lambda j: F.length(F.get(p, 2 * j)) + F.length(F.get(p, 2 * j + 1)))

        def span(end: Column, j: Column) -> Column:
            found = F.get(p, 2 * j + 1)
            return F.struct((end - F.length(found)).alias("start"), end.alias("end"), found.alias("found"))

        return F.filter(F.transform(running(pairs), span), lambda s: s["end"] > s["start"])

    return let(F.split(text, MARKS), lambda p: F.when(F.size(p) > 1, of(p)).otherwise(F.array().cast(LOCATED)))


def find_matches(text: Column, pattern: Column | str) -> Column:
    """D0 with what was found: all matches, left to right, without overlaps. Built-in functions only, so it
    runs inside one stage; the work grows with the text and the logarithm of the number of matches."""
    return let(clean_marks(text), lambda t: let(marked(t, pattern), lambda m: F.when(m != t, located(m)).otherwise(F.array().cast(LOCATED))))


def find_spans(text: Column, pattern: Column | str) -> Column:
    """array<struct<start, end>> of all matches."""
    return F.transform(find_matches(text, pattern), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def chunks(text: Column) -> Column:
    """The text in pieces of CHUNK code points, for ``cut``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """The text from start to end, of which ``parts`` are the chunks: only the chunks it touches are read. Offsets
    beyond the text are cut off."""
    start = F.greatest(start, F.lit(0))
    each = F.transform(F.sequence(F.floor(start / CHUNK).cast("int"), F.floor((end - 1) / CHUNK).cast("int")), lambda c: F.substring(F.get(parts, c), F.greatest(start - c * CHUNK, F.lit(0)) + 1, F.least(end - c * CHUNK, F.lit(CHUNK)) - F.greatest(start - c * CHUNK, F.lit(0))))
    return F.when(end > start, F.array_join(each, "")).otherwise("")


def merge_array(spans: Column) -> Column:
    """E3 inside a row: overlapping and touching spans of an array become one."""

    def of(s: Column) -> Column:
        def islands(reach: Column) -> Column:
            heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["start"] > F.get(reach, i - 1)))
            return let(heads, lambda h: F.transform(h, lambda i, j: F.struct(F.get(s, i)["start"].alias("start"), F.get(reach, F.coalesce(F.get(h, j + 1), F.size(s)) - 1).alias("end"))))

        return F.when(F.size(s) > 1, let(running(F.transform(s, lambda x: x["end"]), F.greatest), islands)).otherwise(s)

    return let(F.array_sort(spans), of)


def inside_any(start: Column, end: Column, spans: Column) -> Column:
    """E1 inside a row, for one span: it lies fully in one of the array's."""
    return F.exists(spans, lambda p: (p["start"] <= start) & (end <= p["end"]))


#: More than any offset: sets groups of one array apart.
BASE = 1 << 32


def _bases(s: Column, key: Callable[[Column], Column]) -> Column:
    """For each place of an array, in which equal keys stand together, BASE times the number of its group, from 0."""
    return running(F.transform(s, lambda x, i: F.when((i > 0) & (key(x) != key(F.get(s, i - 1))), F.lit(BASE)).otherwise(F.lit(0).cast("long"))))


def dedupe_array(spans: Column) -> Column:
    """E2 inside a row, for an array<struct<entity, rule, score, start, end, ...>>, by entity and start.

    One sweep for each score that occurs: the widest reach, so far, of the entity's spans of at least that score."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["entity"].alias("e"), s["start"].alias("a"), (-s["end"]).alias("z"), (-s["score"]).alias("k"), s["rule"].alias("r"), s.alias("s"))))

    def of(s: Column) -> Column:
        def swept(b: Column) -> Column:
            def reach(level: Column) -> Column:
                return running(F.transform(s, lambda x, i: F.when(x["score"] >= level, x["end"] + F.get(b, i)).otherwise(F.lit(-1).cast("long"))), F.greatest)

            def kept(o: Column) -> Column:
                before = lambda x, i: F.get(F.get(o["reach"], (F.array_position(o["levels"], x["score"]) - 1).cast("int")), i - 1)
                return F.filter(s, lambda x, i: (i == 0) | (before(x, i) < x["end"] + F.get(b, i)))

            levels = F.array_distinct(F.transform(s, lambda x: x["score"]))
            return let(let(levels, lambda l: F.struct(l.alias("levels"), F.transform(l, reach).alias("reach"))), kept)

        return F.when(F.size(s) > 1, let(_bases(s, lambda x: x["entity"]), swept)).otherwise(s)

    return let(F.transform(order, lambda x: x["s"]), of)


def resolve_array(spans: Column) -> Column:
    """E7 inside a row: array<struct<start, end, entity, score>>, by start, of an array with at least these fields."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["entity"].alias("entity"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"))))

    def merged(s: Column) -> Column:
        def islands(o: Column) -> Column:
            heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["start"] + F.get(o["base"], i) >= F.get(o["reach"], i - 1)))

            def island(h: Column, i: Column, j: Column) -> Column:
                after = F.coalesce(F.get(h, j + 1), F.size(s))
                end = (F.get(o["reach"], after - 1) - F.get(o["base"], i)).cast("int")
                score = F.array_max(F.transform(F.slice(s, i + 1, after - i), lambda x: x["score"]))
                return F.struct(F.get(s, i)["start"].alias("start"), (-end).alias("k"), (-score).alias("q"), F.get(s, i)["entity"].alias("entity"), end.alias("end"), score.alias("score"))

            return let(heads, lambda h: F.transform(h, lambda i, j: island(h, i, j)))

        reach = lambda b: F.struct(b.alias("base"), running(F.transform(s, lambda x, i: x["end"] + F.get(b, i)), F.greatest).alias("reach"))
        return let(let(_bases(s, lambda x: x["entity"]), reach), islands)

    def alone(m: Column) -> Column:
        return let(running(F.transform(m, lambda x: x["end"]), F.greatest), lambda r: F.filter(m, lambda x, i: (i == 0) | (x["end"] > F.get(r, i - 1))))

    def cut_off(a: Column) -> Column:
        return F.transform(a, lambda x, i: F.struct(x["start"].alias("start"), F.least(x["end"], F.coalesce(F.get(a, i + 1)["start"], x["end"])).alias("end"), x["entity"].alias("entity"), x["score"].alias("score")))

    one = lambda s: F.transform(s, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["entity"].alias("entity"), x["score"].alias("score")))
    return let(order, lambda s: F.when(F.size(s) > 1, let(let(F.array_sort(merged(s)), alone), cut_off)).otherwise(one(s)))


def outside_all(spans: Column, protected: Column) -> Column:
    """E1 inside a row: array<struct<start, end>> of the spans that lie fully inside none of ``protected``, by start.

    Both in one order by start; the widest reach of the protected ones so far decides."""
    order = F.array_sort(F.concat(F.transform(protected, lambda p: F.struct(p["start"].alias("start"), F.lit(0).alias("own"), p["end"].alias("end"))), F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("own"), s["end"].alias("end")))))

    def of(both: Column) -> Column:
        reach = running(F.transform(both, lambda s: F.when(s["own"] == 0, s["end"]).otherwise(-1)), F.greatest)
        return let(reach, lambda r: F.filter(both, lambda s, i: (s["own"] == 1) & (F.get(r, i) < s["end"])))

    return F.transform(let(order, of), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def _one_after_another(spans: Column) -> Column:
    """Of spans sorted by start, those that don't start before the end of the one used last."""
    kind = "struct<at:int,used:array<int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("used")).cast(kind)
    step = lambda acc, i: F.when(F.get(spans, i)["start"] < acc["at"], acc).otherwise(F.struct(F.get(spans, i)["end"].alias("at"), F.concat(acc["used"], F.array(i)).alias("used")).cast(kind))
    return F.transform(F.aggregate(F.sequence(F.lit(0), F.size(spans) - 1), start, step)["used"], lambda i: F.get(spans, i))


def apart(spans: Column) -> Column:
    """Spans sorted by start without those that start before the end of the one used last. Only where some cross, they are gone through in turn."""

    def of(s: Column) -> Column:
        crossed = F.exists(F.sequence(F.lit(1), F.size(s)), lambda i: F.coalesce(F.get(s, i)["start"] < F.get(s, i - 1)["end"], F.lit(False)))
        return F.when(F.size(s) < 2, s).when(crossed, _one_after_another(s)).otherwise(s)

    return let(spans, of)


def splice_array(text: Column, spans: Column) -> Column:
    """E6 inside a row: the text with each span of array<struct<start, end, put>> replaced. A span that
    starts before the end of the one used last is passed over."""

    def spliced(s: Column) -> Column:
        n = F.size(s)

        def whole(parts: Column) -> Column:
            def piece(i: Column) -> Column:
                kept = cut(parts, F.when(i == 0, 0).otherwise(F.get(s, i - 1)["end"]), F.when(i == n, CHUNK * F.size(parts)).otherwise(F.get(s, i)["start"]))
                return F.concat(kept, F.when(i == n, "").otherwise(F.get(s, i)["put"]))

            return F.array_join(F.transform(F.sequence(F.lit(0), n), piece), "")

        return let(chunks(text), whole)

    def own(s: Column) -> Column:
        return F.when(F.size(s) == 0, text).otherwise(let(apart(s), spliced))

    return let(F.array_sort(spans), own)


# --- steps: how one text became another. A step is the spans that were replaced in one go, with what was put there.

STEPS = "array<struct<source:string,spans:array<struct<start:int,end:int,put:string>>>>"


def step(source: str, spans: Column) -> Column:
    """An array of one step, or of none if nothing was replaced. ``spans``: array<struct<start, end, put>>, disjoint, by start."""
    return F.when(F.size(spans) > 0, F.array(F.struct(F.lit(source).alias("source"), spans.alias("spans")))).otherwise(F.array()).cast(STEPS)


def tables(steps: Column) -> Column:
    """For each step its replaced stretches with their places before (start, end) and after (at, upto), by prefix sums."""

    def table(s: Column) -> Column:
        grown = running(F.transform(s, lambda x: F.length(x["put"]) - (x["end"] - x["start"])))
        place = lambda g: F.transform(s, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), (x["end"] + F.get(g, i) - F.length(x["put"])).alias("at"), (x["end"] + F.get(g, i)).alias("upto")))
        return let(grown, place)

    return F.transform(steps, lambda s: table(s["spans"]))


def _before(table: Column, offset: Column, end: bool) -> Column:
    """An offset after a step as one before it. An offset inside a replaced stretch becomes that stretch's start, or its end if
    it is a span's end. The stretch is found by bisection."""

    def halved(x: Column, _: Column) -> Column:
        def of(m: Column) -> Column:
            left = F.get(table, m)["at"] < offset if end else F.get(table, m)["at"] <= offset
            return F.when(x["low"] >= x["high"], x).when(left, F.struct((m + 1).alias("low"), x["high"].alias("high"))).otherwise(F.struct(x["low"].alias("low"), m.alias("high")))

        return let(F.shiftright(x["low"] + x["high"], 1), of)

    def placed(e: Column) -> Column:
        return F.when(e.isNull(), offset).when(offset < e["upto"], e["end"] if end else e["start"]).otherwise(offset - e["upto"] + e["end"])

    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size(table) + 1.0)).cast("int"))
    found = F.aggregate(rounds, F.struct(F.lit(0).alias("low"), F.size(table).alias("high")), halved)
    return let(F.get(table, found["low"] - 1), placed)


def traced(start: Column, end: Column, tables: Column) -> Column:
    """struct<start, end>: a span's place in the text before all the steps that ``tables`` are of."""
    kind = "struct<start:int,end:int>"
    back = lambda x, t: F.struct(_before(t, x["start"], False).alias("start"), _before(t, x["end"], True).alias("end")).cast(kind)
    return F.aggregate(F.reverse(tables), F.struct(start.alias("start"), end.alias("end")).cast(kind), back)


def drop_contained(spans: DataFrame, protected: DataFrame, by: str = "doc_id") -> DataFrame:
    """Without the spans that lie fully inside a protected span of their document.

    The widest reach of all protected spans that start no later decides, so one sorted pass does
    it, without pairs."""
    both = spans.withColumn("__p", F.lit(False)).unionByName(protected.select(by, "start", "end").withColumn("__p", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(F.col("__p"), F.col("end"))).over(w)
    return both.withColumn("__reach", reach).where(~F.col("__p") & (F.col("__reach").isNull() | (F.col("__reach") < F.col("end")))).drop("__p", "__reach")


def dedupe_same_entity(spans: DataFrame, by: str = "doc_id") -> DataFrame:
    """Of one entity's spans, those inside another with at least their score go; of equal ones
    the one with the highest score stays, then the first by rule name.

    A span is compared with the widest reach of those that start no later and score no less. For that each
    span joins the level of every score of its entity in the document up to its own; an entity has a handful of rules,
    so of scores. No pairs are made."""
    key = [by, "entity"]
    best = F.row_number().over(Window.partitionBy(*key, "start", "end").orderBy(F.desc("score"), "rule"))
    one = spans.withColumn("__nth", best).where(F.col("__nth") == 1).drop("__nth")
    scored = one.withColumn("__scores", F.collect_set("score").over(Window.partitionBy(*key)))
    levels = scored.withColumn("__level", F.explode(F.filter("__scores", lambda s: s <= F.col("score")))).drop("__scores")
    w = Window.partitionBy(*key, "__level").orderBy("start")
    before, same = F.max("end").over(w.rangeBetween(Window.unboundedPreceding, -1)), F.max("end").over(w.rangeBetween(0, 0))
    told = levels.withColumn("__beaten", F.coalesce(before >= F.col("end"), F.lit(False)) | (same > F.col("end")))
    return told.where((F.col("__level") == F.col("score")) & ~F.col("__beaten")).drop("__level", "__beaten")


def merge_spans(spans: DataFrame, *more: str, by: str = "doc_id") -> DataFrame:
    """(by, *more, start, end) with overlapping and touching spans as one."""
    keys = [by, *more]
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    told = spans.withColumn("__new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    island = told.withColumn("__i", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    score = [F.max("score").alias("score")] if "score" in spans.columns else []
    return island.groupBy(*keys, "__i").agg(F.min("start").alias("start"), F.max("end").alias("end"), *score).drop("__i")


def resolve_conflicts(spans: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, entity, start, end, score): spans that can be applied one after another.

    Overlaps of one entity merge (touching ones stay apart); of equal spans the higher score stays, then the entity first by
    name; contained spans go; where two overlap in part, the earlier ends where the later starts."""
    w = Window.partitionBy(by, "entity").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    told = spans.withColumn("__new", F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0))
    island = told.withColumn("__i", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = island.groupBy(by, "entity", "__i").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score")).drop("__i")
    order = Window.partitionBy(by).orderBy("start", F.desc("end"), F.desc("score"), "entity")
    outer = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    alone = merged.withColumn("__o", outer).where(F.col("__o").isNull() | (F.col("end") > F.col("__o"))).drop("__o")
    after = F.lead("start").over(Window.partitionBy(by).orderBy("start"))
    return alone.withColumn("end", F.least("end", F.coalesce(after, F.col("end"))))


def merge_across_space(parts: Column, spans: Column) -> Column:
    """The end of E7, inside a row: of disjoint spans in order, array<struct<start, end, entity, ...>>, neighbours of one entity with
    nothing but white space between them become one, with the first one's other fields. ``parts``: the text's chunks."""

    def of(s: Column) -> Column:
        def joins(i: Column) -> Column:
            a, z = F.get(s, i - 1), F.get(s, i)
            return (i > 0) & (a["entity"] == z["entity"]) & (z["start"] > a["end"]) & F.rlike(cut(parts, a["end"], z["start"]), F.lit(r"(?U)^\s+$"))

        heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: ~F.coalesce(joins(i), F.lit(False)))
        return let(heads, lambda h: F.transform(h, lambda i, j: F.get(s, i).withField("end", F.get(s, F.coalesce(F.get(h, j + 1), F.size(s)) - 1)["end"])))

    return let(spans, lambda s: F.when(F.size(s) > 1, of(s)).otherwise(s))


def resolve_by_class(spans: DataFrame, classes: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, entity, start, end, score): no overlap is left, and who stays is decided by class (1 first), then score, then
    length, then start, end and entity.

    In rounds: of spans that hang together the first in that order outranks all it meets, so it stays, what it meets goes, and what is
    left falls apart into smaller groups. A round is windows over the spans that are still open, without text; most spans meet
    none and stay in the first one. Groups fall apart by halves, about, unless the order follows their places."""
    folder = run_folder(spans.sparkSession)
    own = spans.select(by, "entity", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("score").cast("double").alias("score"))
    ranks = classes.groupBy("entity").agg(F.min(F.col("class").cast("int")).alias("__class"))
    ranked = own.join(ranks, "entity", "left").select(*own.columns, F.coalesce("__class", F.lit(99)).alias("__class"))
    order = Window.partitionBy(by).orderBy("__class", F.desc("score"), F.col("start") - F.col("end"), "start", "end", "entity")
    left = written(ranked.withColumn("__place", F.row_number().over(order)).drop("__class"), folder)
    taken = []
    while True:
        w = Window.partitionBy(by).orderBy("start", "end", "__place")
        reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
        told = left.withColumn("__new", F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0))
        told = told.withColumn("__group", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        told = told.withColumn("__best", F.min(F.struct("__place", "start", "end")).over(Window.partitionBy(by, "__group")))
        told = told.withColumn("__stays", F.col("__place") == F.col("__best.__place")).where(F.col("__stays") | (F.col("end") <= F.col("__best.start")) | (F.col("start") >= F.col("__best.end")))
        told = written(told.select(*own.columns, "__place", "__stays"), folder)
        taken.append(told.where("__stays").select(*own.columns))
        left = told.where("not __stays").drop("__stays")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, taken)


def ordered(spans: DataFrame, by: str = "doc_id") -> DataFrame:
    """With ``pos``, the place of each span in its document by start, longer first, then entity."""
    return spans.withColumn("pos", F.row_number().over(Window.partitionBy(by).orderBy("start", F.desc("end"), "entity")))


def above_threshold(spans: DataFrame, least: float) -> DataFrame:
    """E9."""
    return spans.where(F.col("score") >= least)
