"""Operator 6: mixing sources to target weights by temperature.

A source's share p of all words is raised to an exponent between 0 (all sources alike) and 1 (as
they are) and normalised to its weight. The exponent is bisected until the weights' entropy
reaches its target, or until no source repeats more often than the limit: repetition falls and entropy
falls as the exponent grows, so it is the largest exponent that reaches the entropy, raised if need be
to the smallest that respects the limit. Each pass bisects
five times at once: 31 exponents between the bounds are put against all sources in one grouping by
exponent, and the two next to the target are the new bounds.

A source of w words and weight q has a quota of q * budget words. It is filled in blocks, each a permutation
of all the source's texts in an order of its own (MD5 of seed, block, doc_id, text hash), as many whole
blocks as fit and the front of one more, up to the text that reaches the quota. Without a budget, the
smallest at which no source is cut is taken. Every row of the mixture has its block and its place in it, so
that reading sources block by block, by place, gives the mixture in its order.

Places, and word sums for the front of the last block, come in two steps: by ranges of the permutation's
key, of about RANGE texts each, and then inside a range; so a source with a third of all texts is spread
over as many tasks as it has ranges. All of it is DataFrame work.

A null source is a source of its own. A text has at least one word's weight, null and empty ones
included. Repeated rows are texts of their own, each with its own place; where doc_id and text hash are equal, too, their
order is that in which the rows were read. One source has weight 1. An empty table gives an empty result; extra
columns are kept by ``mixture``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder, table, written

#: Entropy to reach, as a part of the largest possible; repetitions of a source at most.
ENTROPY, REPEATS = 0.985, 4.0
SEED = "1"
#: Texts in one range of a permutation, about.
RANGE = 1024
PASSES = 8


def _words(text: Column) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.greatest(F.lit(1), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")


def temperature(shares: DataFrame, target: float = ENTROPY, limit: float = REPEATS, budget: float | None = None) -> tuple[float, float]:
    """(exponent, budget) for (source, words), one row for each source; see the module."""
    totals = shares.agg(F.count("*").alias("n"), F.sum("words").alias("words")).first()
    if not totals["n"]:
        return 1.0, 0.0
    p = F.log(F.col("words") / F.lit(float(totals["words"])))

    def tried(low: float, high: float) -> list:
        power = F.exp(F.col("x") * F.col("p"))
        found = shares.select(p.alias("p")).withColumn("x", F.explode(F.array(*(F.lit(low + (high - low) * k / 32) for k in range(33)))))
        # entropy = log z - x * sum(p * power) / z; repetition = budget * power / (z * words)
        return found.groupBy("x").agg(F.sum(power).alias("z"), F.sum(F.col("p") * power).alias("pz"), F.max((F.col("x") - 1) * F.col("p")).alias("most"), F.min((F.col("x") - 1) * F.col("p")).alias("least")).orderBy("x").collect()

    def search(enough, rising: bool) -> float:
        """Bounds of the change of ``enough`` between 0 and 1; the side where it holds."""
        low, high = 0.0, 1.0
        for _ in range(PASSES):
            rows = tried(low, high)
            held = [r["x"] for r in rows if enough(r)]
            if rising:  # it holds from some exponent on
                if not held:
                    return 1.0
                high = held[0]
                low = max((r["x"] for r in rows if r["x"] < high), default=low)
            else:
                if not held:
                    return 0.0
                low = held[-1]
                high = min((r["x"] for r in rows if r["x"] > low), default=high)
            if low >= high:
                break
        return high if rising else low

    from math import exp, log

    def entropy(r) -> float:
        return log(r["z"]) - r["x"] * r["pz"] / r["z"]

    def repeats(r) -> float:
        size = budget / totals["words"] if budget else r["z"] / exp(r["least"])
        return size * exp(r["most"]) / r["z"]

    exponent = search(lambda r: entropy(r) >= target * log(totals["n"]) - 1e-12, False) if totals["n"] > 1 else 1.0
    if limit:
        bound = search(lambda r: repeats(r) <= limit + 1e-12, True)
        exponent = max(exponent, bound)
    if not budget:
        shape = shares.select(p.alias("p")).agg(F.sum(F.exp(exponent * F.col("p"))).alias("z"), F.min((exponent - 1) * F.col("p")).alias("least")).first()
        budget = totals["words"] * shape["z"] / exp(shape["least"])
    return exponent, float(budget)


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    """(row, doc_id, source, n_words, th), ``row`` unlike for all rows, and other columns."""
    doc, source = F.col("doc_id").cast("long"), F.col("source").cast("string")
    own = {"__row": F.monotonically_increasing_id(), "__doc": doc, "__source": source, "__words": _words(F.col("text")), "__th": F.xxhash64(F.col("text").cast("string"))}
    return docs.withColumns(own).select(*own, *more)


def _placed(own: DataFrame, folder: str, budget: float | None, target: float, limit: float, seed: str) -> DataFrame:
    """(__row, __doc, __source, __words, __weight, __block, __place) for each row of the mixture."""
    shares = written(own.groupBy(F.col("__source").alias("source")).agg(F.sum("__words").alias("words"), F.count("*").alias("texts")), folder, "shares")
    exponent, budget = temperature(shares, target, limit, budget)
    total = shares.agg(F.sum("words")).first()[0] or 1
    power = F.exp(F.lit(exponent) * F.log(F.col("words") / F.lit(float(total))))
    z = shares.agg(F.sum(power)).first()[0] or 1.0
    quota = shares.select("source", (power / F.lit(z)).alias("__weight"), "words", F.ceil(F.col("texts") / RANGE).alias("__ranges"))
    # a quota a rounding error away from whole blocks is whole blocks
    wanted = F.col("__weight") * F.lit(budget)
    quota = quota.withColumn("__full", F.floor(wanted / F.col("words") + 1e-9)).withColumn("__rest", F.round(F.greatest(F.lit(0.0), wanted - F.col("__full") * F.col("words")))).drop("words")
    met = own.join(written(quota, folder, "quota"), own["__source"].eqNullSafe(F.col("source"))).drop("source")
    last = F.col("__full") - F.when(F.col("__rest") > 0, 0).otherwise(1)
    many = met.where(last >= 0).withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("__block"), F.coalesce(F.col("__doc").cast("string"), F.lit("")), F.col("__th")))
    many = many.withColumn("__key", key).withColumn("__range", F.floor(F.conv(F.substring("__key", 1, 8), 16, 10).cast("long") * F.col("__ranges") / F.lit(1 << 32)))
    group = ["__source", "__block"]
    ahead = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = many.groupBy(*group, "__range").agg(F.sum("__words").alias("w"), F.count("*").alias("n"))
    none = F.lit(0).cast("long")
    sums = sums.select(F.col("__source").alias("s"), F.col("__block").alias("b"), F.col("__range").alias("r"), F.coalesce(F.sum("w").over(ahead), none).alias("w"), F.coalesce(F.sum("n").over(ahead), none).alias("n"))
    inside = Window.partitionBy(*group, "__range").orderBy("__key", "__row").rowsBetween(Window.unboundedPreceding, -1)
    ranked = many.withColumns({"__before": F.coalesce(F.sum("__words").over(inside), none), "__nth": F.count("*").over(inside)})
    found = ranked.join(sums, ranked["__source"].eqNullSafe(sums["s"]) & (F.col("__block") == F.col("b")) & (F.col("__range") == F.col("r")))
    taken = found.where((F.col("__block") < F.col("__full")) | (F.col("w") + F.col("__before") < F.col("__rest")))
    return taken.select("__row", "__doc", "__source", "__words", F.round("__weight", 9).alias("__weight"), "__block", (F.col("n") + F.col("__nth")).alias("__place"))


def placements(docs: DataFrame, budget: float | None = None, target: float = ENTROPY, limit: float = REPEATS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, n_words, weight, block, place) for each row of the mixture, blocks and places from 0."""
    folder = shared_folder(docs.sparkSession)
    found = _placed(written(_keyed(docs), folder, "rows"), folder, budget, target, limit, seed)
    return found.select(F.col("__doc").alias("doc_id"), F.col("__source").alias("source"), F.col("__words").alias("n_words"), F.col("__weight").alias("weight"), F.col("__block").alias("block"), F.col("__place").alias("place"))


def mixture(docs: DataFrame, budget: float | None = None, target: float = ENTROPY, limit: float = REPEATS, seed: str = SEED) -> DataFrame:
    """The rows of the mixture with all columns of ``docs``, and block and place as ``mix_block`` and ``mix_place``."""
    folder = shared_folder(docs.sparkSession)
    rows = written(_keyed(docs, *docs.columns), folder, "rows")
    found = _placed(rows.select("__row", "__doc", "__source", "__words", "__th"), folder, budget, target, limit, seed)
    places = found.select("__row", F.col("__block").alias("mix_block"), F.col("__place").alias("mix_place"))
    return rows.join(places, "__row").select(*docs.columns, "mix_block", "mix_place")


def mixed(docs: DataFrame, budget: float | None = None) -> DataFrame:
    """``mixture`` with the columns of ``docs`` only."""
    return mixture(docs, budget).select(*docs.columns)


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return placements(table(spark, sf_dir, "documents"))
