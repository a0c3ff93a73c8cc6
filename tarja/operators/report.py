"""Reports over the entity table (doc_id, entidade, texto_detectado, inicio, fim, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# In all of them ``by`` tells documents apart: the id, or the flows' row_id where ids may be null or repeated.


def totals(entities: DataFrame, by: str = "doc_id") -> DataFrame:
    """R1."""
    return entities.groupBy(by).agg(F.count("*").alias("total"), F.countDistinct("entidade").alias("tipos"))


def top_types(entities: DataFrame, k: int = 3, by: str = "doc_id") -> DataFrame:
    """R2: each document's k commonest types, ties by name."""
    n = entities.groupBy(by, "entidade").agg(F.count("*").alias("n"))
    return n.withColumn("pos", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "entidade"))).where(F.col("pos") <= k)


# The wording of the summary line.
SUMMARY = "**Resumo ({}):** "
SOME = "%d entidades detectadas em %d tipos. Principais ocorrencias: %s."
NONE = "nenhuma entidade detectada."
METADATA_FOUND = " Metadados (nomes PF): identificado (%d nome(s)); ocorrencias forcadas: %d."
METADATA_NOT_FOUND = " Metadados (nomes PF): nao identificado."
TIME = " Tempo total: {:.2f}s."
# End of the fixed values.


def summary_lines(docs: DataFrame, entities: DataFrame, origin: str, metrics: DataFrame | None = None, seconds: float | None = None, by: str = "doc_id") -> DataFrame:
    """(by, resumo) for each of ``docs``. ``metrics``: N3's columns, for PDF."""
    item = F.struct("pos", F.concat("entidade", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("t"))
    top = top_types(entities, by=by).groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["t"]), ", ").alias("top"))
    met = docs.select(by).join(totals(entities, by), by, "left").join(top, by, "left")
    about = F.lit("")
    if origin.upper() == "PDF":
        about = F.lit(METADATA_NOT_FOUND)
        if metrics is not None:
            met = met.join(metrics.select(by, "metadado_nome_identificado", "metadado_nomes_pf_total", "metadado_ocorrencias_forcadas"), by, "left")
            found = F.format_string(METADATA_FOUND, F.col("metadado_nomes_pf_total"), F.col("metadado_ocorrencias_forcadas"))
            about = F.when(F.coalesce("metadado_nome_identificado", F.lit(False)), found).otherwise(about)
    took = F.lit("" if seconds is None else TIME.format(seconds))
    body = F.when(F.col("total").isNull(), NONE).otherwise(F.format_string(SOME, F.col("total"), F.col("tipos"), F.col("top")))
    return met.select(by, F.concat(F.lit(SUMMARY.format(origin)), body, about, took).alias("resumo"))


def nested_entities(docs: DataFrame, entities: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, entidades): each document's entities by place; without any, an empty array."""
    item = F.struct("inicio", (-F.col("fim")).alias("k"), "entidade", "texto_detectado", "fim", "score")
    own = entities.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: F.struct(s["entidade"].alias("entidade"), s["texto_detectado"].alias("texto_detectado"), s["inicio"].alias("inicio"), s["fim"].alias("fim"), s["score"].alias("score"))).alias("entidades"))
    kind = own.schema["entidades"].dataType
    return docs.select(by).join(own, by, "left").withColumn("entidades", F.coalesce("entidades", F.array().cast(kind)))


def by_entity(entities: DataFrame) -> DataFrame:
    """Detections and documents for each entity."""
    return entities.groupBy("entidade").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def by_source_and_entity(entities: DataFrame) -> DataFrame:
    """R5 with subtotals by source."""
    return entities.rollup("source", "entidade").agg(F.count("*").alias("n"))


def acceptance(spans: DataFrame) -> DataFrame:
    """Raw and kept spans for each entity."""
    return spans.groupBy("entity").agg(F.count("*").alias("raw"), F.sum(F.col("kept").cast("long")).alias("kept"))


def audit_sample(spans: DataFrame, k: int = 3) -> DataFrame:
    """For each entity and decision, k spans in the order of a hash, without text. Only k rows for
    each entity and doc-hash bucket go on to the ranking, so a very common entity is cut before it."""
    key = F.md5(F.concat_ws(":", "doc_id", "entity", "start", "end"))
    own = spans.select("doc_id", "entity", "start", "end", "score", "kept", key.alias("hash"))
    coarse = Window.partitionBy("entity", "kept", F.substring("hash", 1, 2)).orderBy("hash", "score")
    fine = Window.partitionBy("entity", "kept").orderBy("hash", "score")
    few = own.withColumn("pos", F.row_number().over(coarse)).where(F.col("pos") <= k)
    return few.withColumn("pos", F.row_number().over(fine)).where(F.col("pos") <= k)


def rules_digest(rules: DataFrame) -> DataFrame:
    """One SHA-256 over the rule table, which is small."""
    line = F.concat_ws("|", "entity", "rule", "regex", F.col("score").cast("string"))
    return rules.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"), F.count("*").alias("rules"))


def rules_used(spans: DataFrame, by: str = "doc_id") -> DataFrame:
    """R7 for results: for each document a digest of the rules that found something in it, and their number, so that two runs
    show where other rules decided. A document has as many distinct rules as the rule table at most."""
    line = F.concat_ws("|", "entity", "rule", F.format_string("%.3f", F.col("score")))
    own = spans.select(by, line.alias("l")).distinct().groupBy(by)
    return own.agg(F.md5(F.array_join(F.array_sort(F.collect_list("l")), "\n")).alias("digest"), F.count("*").alias("rules"))


def _size_bucket() -> Column:
    return F.when(F.col("chars") < 500, "<500").when(F.col("chars") < 2000, "<2000").when(F.col("chars") < 8000, "<8000").otherwise("8000+")


def density_by_size(docs: DataFrame, entities: DataFrame, text: str = "text") -> DataFrame:
    """Documents, median and 95th percentile of length, and entities per 1,000 characters, by size."""
    n = entities.groupBy("doc_id").agg(F.count("*").alias("n"))
    size = docs.select("doc_id", F.length(text).alias("chars")).join(n, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return size.groupBy(_size_bucket().alias("bucket")).agg(
        F.count("*").alias("docs"), F.percentile("chars", 0.5).alias("p50"), F.percentile("chars", 0.95).alias("p95"), F.round(1000 * F.sum("n") / F.sum("chars"), 6).alias("density")
    )


# --- R5 and R8 over many runs: each run leaves sketches, which are folded without reading its results again. Distinct documents come within 5 %
# (three standard errors of 4,096 registers), quantiles within 3 % of the rank.
REGISTERS, BUCKETS = 12, 400


def entity_sketches(entities: DataFrame, by: str = "doc_id") -> DataFrame:
    """A run's part of R5: (entidade, n, docs_sketch)."""
    return entities.groupBy("entidade").agg(F.count("*").alias("n"), F.hll_sketch_agg(F.col(by).cast("string"), F.lit(REGISTERS)).alias("docs_sketch"))


def folded_entities(sketches: DataFrame) -> DataFrame:
    """R5 over all runs whose sketches these are: (entidade, n, docs): n exact, documents that several runs have count once."""
    return sketches.groupBy("entidade").agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("docs_sketch")).alias("docs"))


def size_sketches(docs: DataFrame, text: str = "text") -> DataFrame:
    """A run's part of R8: (bucket, docs, chars, chars_sketch)."""
    size = docs.select(F.length(text).cast("long").alias("chars")).where("chars is not null")
    return size.groupBy(_size_bucket().alias("bucket")).agg(F.count("*").alias("docs"), F.sum("chars").alias("chars"), F.kll_sketch_agg_bigint("chars", F.lit(BUCKETS)).alias("chars_sketch"))


def folded_sizes(sketches: DataFrame) -> DataFrame:
    """R8's sizes over all runs: (bucket, docs, chars, p50, p95)."""
    own = sketches.groupBy("bucket").agg(F.sum("docs").alias("docs"), F.sum("chars").alias("chars"), F.kll_merge_agg_bigint("chars_sketch").alias("s"))
    return own.select("bucket", "docs", "chars", *(F.kll_sketch_get_quantile_bigint("s", F.lit(q)).alias(f"p{round(100 * q)}") for q in (0.5, 0.95)))
