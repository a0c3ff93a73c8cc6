"""Comparison of two runs: (id, output, entities array<struct<entity, text>>)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .spans import CHUNK, chunks


def as_multiset(entities: Column) -> Column:
    """Entities in an order of their own, by text and entity; duplicates stay."""
    return F.array_sort(F.transform(entities, lambda e: F.struct(e["text"].alias("text"), e["entity"].alias("entity"))))


def compare_runs(snapshot: DataFrame, current: DataFrame) -> DataFrame:
    """G1: (id, status) for each id of either run. Texts and entities are compared by digest, so the
    join moves no text."""
    form = lambda df, p: df.select(
        F.col("id"), F.lit(True).alias(f"{p}_in"), F.sha2(tx.normalize_newlines(F.col("output")), 256).alias(f"{p}_out"), F.sha2(F.to_json(as_multiset(F.col("entities"))), 256).alias(f"{p}_ent")
    )
    met = form(snapshot, "a").join(form(current, "b"), "id", "full_outer")
    status = (
        F.when(F.col("b_in").isNull(), "missing_in_current")
        .when(F.col("a_in").isNull(), "missing_in_snapshot")
        .when(F.col("a_out") != F.col("b_out"), "output_mismatch")
        .when(~F.col("a_ent").eqNullSafe(F.col("b_ent")), "entity_mismatch")
        .otherwise("ok")
    )
    return met.select("id", status.alias("status"))


def entity_differences(snapshot: DataFrame, current: DataFrame) -> DataFrame:
    """G2 as a difference: (id, entity, text, missing, extra): how many times more the snapshot, or the current run, has an entity. Counts
    with signs are summed up, so only entities that differ are left. An id that one run lacks has no entities there."""
    signed = lambda df, n: df.select("id", F.explode("entities").alias("e")).select("id", "e.entity", "e.text", F.lit(n).alias("n"))
    summed = signed(snapshot, 1).unionByName(signed(current, -1)).groupBy("id", "entity", "text").agg(F.sum("n").alias("n")).where("n <> 0")
    return summed.select("id", "entity", "text", F.greatest("n", F.lit(0)).cast("long").alias("missing"), F.greatest(-F.col("n"), F.lit(0)).cast("long").alias("extra"))


def first_differences(snapshot: DataFrame, current: DataFrame) -> DataFrame:
    """(id, at, before, after): for each id of both runs whose texts differ, the first code point that does, from 0, and the two signs there, empty
    beyond a text's end. Line ends count as in G1; a null text is empty.

    The runs meet by digests of the texts' chunks; only the first chunk that differs is fetched, and halved until the sign is found."""
    form = lambda df: df.select("id", chunks(tx.normalize_newlines(F.col("output"))).alias("parts"))
    digests = lambda df, c: form(df).select("id", F.transform("parts", lambda x: F.xxhash64(x)).alias(c))
    met = digests(snapshot, "a").join(digests(current, "b"), "id")
    other = F.filter(F.sequence(F.lit(0), F.greatest(F.size("a"), F.size("b"))), lambda i: ~F.get("a", i).eqNullSafe(F.get("b", i)))
    part = met.select("id", F.get(other, F.lit(0)).alias("part")).where("part is not null")
    fetched = lambda df, c: form(df).join(part, "id").select("id", "part", F.coalesce(F.get("parts", F.col("part")), F.lit("")).alias(c))
    both = fetched(snapshot, "a").join(fetched(current, "b").drop("part"), "id")

    def halved(x: Column, _: Column) -> Column:
        same = lambda m: F.substring(F.col("a"), F.lit(1), m) == F.substring(F.col("b"), F.lit(1), m)
        half = lambda m: F.when(same(m), F.struct(m.alias("low"), x["high"].alias("high"))).otherwise(F.struct(x["low"].alias("low"), (m - 1).alias("high")))
        return F.when(x["low"] >= x["high"], x).otherwise(tx.let(F.shiftright(x["low"] + x["high"] + 1, 1), half))

    alike = F.aggregate(F.sequence(F.lit(0), F.lit(CHUNK.bit_length())), F.struct(F.lit(0).alias("low"), F.greatest(F.length("a"), F.length("b")).alias("high")), halved)["low"]
    at = both.withColumn("alike", alike)
    return at.select("id", (F.col("part") * CHUNK + F.col("alike")).cast("long").alias("at"), F.substring("a", F.col("alike") + 1, F.lit(1)).alias("before"), F.substring("b", F.col("alike") + 1, F.lit(1)).alias("after"))


def failure_summary(compared: DataFrame) -> DataFrame:
    """G3."""
    return compared.groupBy("status").agg(F.count("*").alias("n"))
