"""Operator 7: quality rules by weak supervision.

Each rule looks at one measure of a text and votes good, votes bad or abstains. How far a rule can be
trusted isn't set by hand: expectation-maximisation over the votes of all documents estimates, for the
hidden classes good and bad, how often each rule votes what in each, and a text is kept when the
posterior probability of good is at least KEEP. No rule alone rejects a text, except for the two base
limits (``base_failed``).

A vote pattern is one of at most 3 ** RULES; documents are counted by pattern before any shuffle,
the algorithm works on that table, and each pattern's verdict joins back by broadcast of
at most that many rows. Everything runs on built-in functions; the measures are
computed once and written, as narrow rows, to the shared folder.

Words are runs of characters other than space and U+0009 to U+000D. A null text has no words, and so fails
the base limits, as does an empty one. Ties of the posterior keep. Repeated rows, null ids and
extra columns pass through; without documents nothing is estimated and nothing returned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, table, written

KEEP = 0.5
ROUNDS = 60
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measures(text: Column) -> dict[str, Column]:
    """Columns for use after one another: each may name the ones before."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "words": F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""),
        "lines": lines,
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "windows": F.when(F.col("n_words") >= 8, F.transform(F.sequence(F.lit(1), F.col("n_words").cast("int") - 7), lambda i: F.xxhash64(F.slice("words", i, 8)))).otherwise(F.array().cast("array<bigint>")),
        # sorted by hash, only where a hash stands twice; a column of its own, so that it is computed once
        "places": F.when(F.size("windows") != F.size(F.array_distinct("windows")), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
        "n_repeat_words": F.when(F.col("places").isNull(), F.lit(0).cast("long")).otherwise(_covered(F.col("places"))),
    }


def _covered(places: Column) -> Column:
    """Words in the windows whose hash stands twice: of the places sorted by hash, those next to an
    equal one, and the union of their runs of eight."""
    twice = F.filter(
        F.transform(places, lambda p, k: F.struct(p["i"].alias("i"), ((k > 0) & (F.get(places, k - 1)["h"] == p["h"]) | F.coalesce(F.get(places, k + 1)["h"] == p["h"], F.lit(False))).alias("again"))),
        lambda p: p["again"],
    )
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda acc, p: F.struct((p["i"] + 8).alias("end"), (acc["n"] + p["i"] + 8 - F.greatest(acc["end"], p["i"])).alias("n"))
    return F.aggregate(F.array_sort(twice), start, step)["n"].cast("long")


def with_measures(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and the measures of the text, one projection for each so that none is computed twice."""
    cols = measures(F.col("text"))
    out = docs
    for name in ("words", "lines", "n_words", "windows", "places"):
        out = out.withColumn(name, cols[name])
    return out.select(*keep, *(cols[m].alias(m) if m != "n_words" else F.col(m) for m in MEASURES))


#: Votes: good from the first test on, bad from the second on, else an abstention.
def votes() -> list[Column]:
    n, chars = F.col("n_words"), F.col("word_chars")

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, 2).when(good, 1).otherwise(0)

    return [
        vote(n >= 50, n < 20),
        vote(100 * F.col("n_symbols") <= chars, 20 * F.col("n_symbols") > chars),
        vote(50 * F.col("n_symbols") <= n, 4 * F.col("n_symbols") > n),
        vote(F.col("n_dup_lines") == 0, F.col("n_dup_lines") >= 3),
        vote(F.col("n_repeat_words") == 0, 100 * F.col("n_repeat_words") > 20 * n),
        vote((chars >= 3 * n) & (chars <= 9 * n), (2 * chars < 7 * n) | (chars > 12 * n)),
    ]


RULES = 6


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """The posterior probability of good for each vote pattern, by expectation-maximisation over the
    counts. It starts from rules that are right four times in five."""
    total = sum(patterns.values())
    if not total:
        return {}
    share = 0.8
    chance = [[[0.2, 0.64, 0.16], [0.2, 0.16, 0.64]] for _ in range(RULES)]  # rule, class, vote
    good: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for p in patterns:
            odds = math.log(share / (1 - share)) + sum(math.log(chance[r][0][v] / chance[r][1][v]) for r, v in enumerate(p))
            good[p] = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
        mass = [math.fsum(good[p] * n for p, n in sorted(patterns.items())), math.fsum((1 - good[p]) * n for p, n in sorted(patterns.items()))]
        share = (mass[0] + 4) / (total + 5)
        for r in range(RULES):
            for c in (0, 1):
                for v in (0, 1, 2):
                    prior = 10 * (0.2, 0.64, 0.16)[v] if c == 0 else 10 * (0.2, 0.16, 0.64)[v]
                    seen = math.fsum((good[p] if c == 0 else 1 - good[p]) * n for p, n in sorted(patterns.items()) if p[r] == v)
                    chance[r][c][v] = (seen + prior) / (mass[c] + 10)
    return good


def _pattern() -> Column:
    return F.array_join(F.array(*votes()), "").alias("pattern")


def _kept() -> Column:
    return ~F.col("base_failed") & (F.col("posterior") >= KEEP)


def with_posterior(voted: DataFrame) -> DataFrame:
    """``voted``, with a column ``pattern``, with the posterior in its place. Reads it twice."""
    rows = voted.groupBy("pattern").count().collect()  # at most 3 ** RULES
    good = estimate({tuple(map(int, r["pattern"])): r["count"] for r in rows})
    verdicts = voted.sparkSession.createDataFrame([("".join(map(str, p)), g) for p, g in good.items()], "pattern string, posterior double")
    return voted.join(F.broadcast(verdicts), "pattern", "left").drop("pattern")


def with_verdict(measured: DataFrame) -> DataFrame:
    """``measured`` with base_failed, posterior and kept."""
    told = with_posterior(measured.withColumns({"pattern": _pattern(), "base_failed": base_failed()}))
    return told.withColumn("kept", _kept())


def quality(docs: DataFrame) -> DataFrame:
    """(doc_id, the measures, base_failed, kept, posterior) for every row of ``docs``."""
    measured = written(with_measures(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id"), shared_folder(docs.sparkSession), "measures")
    return with_verdict(measured).select("doc_id", *MEASURES, "base_failed", "kept", "posterior")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep. Rows are measured once and written with their vote pattern, so the
    verdict is told inside the row and no text is shuffled."""
    own = docs.select("text", F.struct(*docs.columns).alias("__row"))
    measured = with_measures(own, "__row").select("__row", _pattern(), base_failed().alias("base_failed"))
    told = with_posterior(written(measured, shared_folder(docs.sparkSession), "measured"))
    return told.where(_kept()).select("__row.*")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).withColumn("posterior", F.round("posterior", 6))


_PRIOR = {"good": (0.2, 0.64, 0.16), "bad": (0.2, 0.16, 0.64)}
_ODDS = "ln(share / (1 - share)) + " + " + ".join(f"ln(good[{3 * r + 1} + v[{r + 1}]] / bad[{3 * r + 1} + v[{r + 1}]])" for r in range(RULES))


def _step(part: str, mass: str, kind: str) -> str:
    """The chances of each vote of each rule in a class, as a list of 3 * RULES numbers."""
    each = [f"(sum({part} * n) FILTER (v[{r + 1}] = {x}) + {10 * _PRIOR[kind][x]}) / ({mass} + 10)" for r in range(RULES) for x in range(3)]
    return "[" + ", ".join(e.replace("(sum(", "(coalesce(sum(", 1).replace(") + ", "), 0) + ", 1) for e in each) + "]"


#: The votes and the algorithm over vote patterns, a round for each row of ``em``.
ORACLE_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
), x AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)
), c AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS k FROM x) WHERE k > 1) GROUP BY doc_id
), m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM w LEFT JOIN c USING (doc_id)
), o AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, [
    CASE WHEN n_words < 20 THEN 2 WHEN n_words >= 50 THEN 1 ELSE 0 END,
    CASE WHEN 20 * n_symbols > word_chars THEN 2 WHEN 100 * n_symbols <= word_chars THEN 1 ELSE 0 END,
    CASE WHEN 4 * n_symbols > n_words THEN 2 WHEN 50 * n_symbols <= n_words THEN 1 ELSE 0 END,
    CASE WHEN n_dup_lines >= 3 THEN 2 WHEN n_dup_lines = 0 THEN 1 ELSE 0 END,
    CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 WHEN n_repeat_words = 0 THEN 1 ELSE 0 END,
    CASE WHEN 2 * word_chars < 7 * n_words OR word_chars > 12 * n_words THEN 2 WHEN word_chars >= 3 * n_words AND word_chars <= 9 * n_words THEN 1 ELSE 0 END] AS v
  FROM m
), p AS (
  SELECT v, CAST(count(*) AS DOUBLE) AS n FROM o GROUP BY v
), em AS (
  SELECT 1 AS k, CAST(0.8 AS DOUBLE) AS share, {[float(x) for _ in range(RULES) for x in _PRIOR["good"]]}::DOUBLE[] AS good, {[float(x) for _ in range(RULES) for x in _PRIOR["bad"]]}::DOUBLE[] AS bad
  UNION ALL
  SELECT k + 1, (sum(g * n) + 4) / (sum(n) + 5), {_step("g", "sum(g * n)", "good")}, {_step("(1 - g)", "sum((1 - g) * n)", "bad")}
  FROM (SELECT k, v, n, 1 / (1 + exp(-({_ODDS}))) AS g FROM em, p WHERE k < {ROUNDS}) GROUP BY k
), f AS (
  SELECT v, 1 / (1 + exp(-({_ODDS}))) AS g FROM em, p WHERE k = {ROUNDS}
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  base_failed, NOT base_failed AND g >= {KEEP} AS kept, round(g, 6) AS posterior
FROM o JOIN f USING (v)
"""
