"""Whole flows: a table of documents in; anonymized documents, spans and metrics out."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import terms
from ..functions import text as tx
from ..operators import names as nm
from ..operators.detect import Rule, reduced_array, rules_for, span_array, with_context_array
from ..operators.policy import PROTECTED, analysed_entities, applied, apply_spans, default_policy, entity_table, small_policy
from ..operators.spans import chunks, clean_marks, cut, splice_array, step, tables, traced
from ..sources.documents import admit_pdfs, join_pages, with_status
from ..sources.shared import delete_folder, run_folder, written

#: The flow's own key: each row of the input has one, whatever its doc_id.
ROW = "row_id"
METRICS = ["metadado_nome_identificado", "metadado_nomes_pf_total", "metadado_ocorrencias_forcadas"]


@dataclass
class Anonymized:
    """``documents``: the input's columns with the text anonymized, row_id, and N3's metrics. ``spans``: raw spans with ``kept``,
    what kind of rule found them (``source``) and their place in the original text. ``entities``: the entity table. ``stretches``: what was
    replaced, names included. All have row_id and doc_id, and join on row_id; a doc_id may be null or stand
    at several rows. The input's columns stay: where one is called row_id, or as a metric, the new one has an
    underscore behind its name; ``row`` is the key's name. ``metrics`` were counted while the results were written: rows, signs of the
    original texts (``chars``), and for each entity found (``raw ENTITY``) and accepted spans (``kept ENTITY``).

    They read one intermediate table that holds personal data; ``release`` deletes it once the results are written."""

    documents: DataFrame
    spans: DataFrame
    entities: DataFrame
    stretches: DataFrame
    folder: str
    row: str
    metrics: dict[str, int]
    #: Of a PDF corpus also the admission, with the names of the metadata.
    admission: str = ""

    def release(self) -> None:
        for folder in filter(None, (self.folder, self.admission)):
            delete_folder(self.documents.sparkSession, folder)


#: The step that makes letters and their marks one sign. It masks nothing.
COMPOSED = "composed"


def mask_named_persons(docs: DataFrame, steps: str = "__steps", compose: bool = False) -> DataFrame:
    """S1 to S3 on ``docs`` (text, names, ...): metadata names, target parties, contextual names, with the ``steps`` that were taken.
    All inside the row. ``compose``: letters with marks of their own are made one sign first, in texts and names."""
    own = docs.withColumn("text", clean_marks(F.coalesce("text", F.lit(""))))
    if compose:
        own = own.withColumn("__pairs", nm.composed_spans(F.col("text")))
        own = own.withColumn("text", F.when(F.size("__pairs") > 0, tx.let(F.struct("text", "__pairs"), lambda o: splice_array(o["text"], o["__pairs"]))).otherwise(F.col("text")))
        own = own.withColumn("names", F.transform("names", lambda n: splice_array(n, nm.composed_spans(n))))
    own = own.withColumn("__original", F.col("text"))
    out = nm.mask_metadata_names(own, steps=steps)
    if compose:
        out = out.withColumn(steps, F.concat(step(COMPOSED, F.col("__pairs")), steps)).drop("__pairs")

    def masked(df: DataFrame, names: Column, placeholder: str, source: str) -> DataFrame:
        df = df.withColumn("__names", names)
        df = df.withColumn("__done", tx.let(F.struct("text", "__names"), lambda o: nm.mask_names_in_steps(o["text"], o["__names"], placeholder, source)))
        return df.withColumns({"text": F.col("__done.text"), steps: F.concat(steps, "__done.steps")}).drop("__names", "__done")

    out = masked(out, tx.party_names(F.col("__original")), terms.PARTY_PLACEHOLDER_INNER, "party")
    return masked(out, tx.contextual_names(F.col("text")), terms.NAME_PLACEHOLDER, "context").drop("__original")


STRETCH = "array<struct<source:string,entity:string,start:int,end:int,put:string>>"


def _stretches(steps: Column, before: Column, put: Column) -> Column:
    """STRETCH: what each step and then the policy replaced, in places of the original text. ``before``: the steps' tables."""
    of = lambda source, entity, x, t: tx.let(traced(x["start"], x["end"], t), lambda p: F.struct(source.alias("source"), entity.alias("entity"), p["start"].alias("start"), p["end"].alias("end"), x["put"].alias("put")))
    none = F.lit(None).cast("string")
    names = F.flatten(F.transform(steps, lambda s, k: F.transform(F.when(s["source"] != COMPOSED, s["spans"]).otherwise(F.array().cast("array<struct<start:int,end:int,put:string>>")), lambda x: of(s["source"], none, x, F.slice(before, F.lit(1), k)))))
    found = F.transform(put, lambda x: of(F.lit("policy"), x["entity"], x, before))
    return F.concat(names.cast(STRETCH), found.cast(STRETCH))


def _unused(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def anonymize(docs: DataFrame, index: DataFrame | list[str] | None = None, policy: DataFrame | None = None, rules: list[Rule] | None = None, titles: list[str] | None = None, common: list[str] | None = None, compose: bool = False) -> Anonymized:
    """P5: the flow S1 to S7 on ``docs`` (doc_id, text, and names, an array, if there are any), with the
    user's titles and common terms unless ``rules`` are given.

    By default a letter and a mark that stands for itself are two signs, and a name written so is cut at its marks. With ``compose`` they
    are made one sign first, so such names are found whole; places still refer to the text as it came.

    All of it happens inside the row, in one stage: the name list and the policy, unless they are too long for the plan, are part of it, and no text is
    shuffled. Each row is anonymized for itself: null and repeated doc_ids, repeated rows, null and empty texts (which give an
    empty text) and other columns pass through. An empty table gives empty results."""
    spark = docs.sparkSession
    folder = run_folder(spark)
    policy = default_policy(spark) if policy is None else policy
    if rules is None:
        wanted = analysed_entities(policy, spark.createDataFrame([(e,) for e in PROTECTED], "entity string"))
        rules = rules_for((r["entity"] for r in wanted.collect()), titles, common)  # one for each entity
    found, replaced, original = (_unused(c, docs.columns) for c in ("__spans", "__stretches", "__original"))
    row, named = _unused(ROW, docs.columns), {m: _unused(m, docs.columns) for m in METRICS}
    names = F.col("names") if "names" in docs.columns else F.array().cast("array<string>")
    own = docs.select(F.struct(*docs.columns).alias("__user"), "text", names.alias("names"), F.monotonically_increasing_id().alias("__row"))

    out = mask_named_persons(own, compose=compose)
    listed = nm.small_list(index) if isinstance(index, DataFrame) else index
    if listed is not None:  # S4
        out = nm.mask_common_names(out, listed, steps="__steps")
    elif index is not None:
        out = nm.mask_common_names(written(out, folder, "named"), index, steps="__steps")
    lists = [r.name for r in rules if r.source == "list"]
    out = out.withColumn("__raw", span_array(F.col("text"), rules)).withColumn("__spans", with_context_array(reduced_array(F.col("__raw")))).withColumn("__before", tables(F.col("__steps")))

    def told(s: Column, before: Column) -> Column:
        place = lambda p: s.withField("source", F.when(s["rule"].isin(lists), "list").otherwise("regex")).withField("original_start", p["start"]).withField("original_end", p["end"])
        return tx.let(traced(s["start"], s["end"], before), place)

    out = out.withColumn("__spans", tx.let(F.struct("__spans", "__before"), lambda o: F.transform(o["__spans"], lambda s: told(s, o["__before"]))))
    ops = small_policy(policy)
    put = F.array().cast("array<struct<start:int,end:int,put:string,entity:string>>") if ops is None else applied(F.col("text"), F.filter("__spans", lambda s: s["kept"]), ops)
    out = out.withColumn("__put", put)
    out = out.withColumn("__stretches", F.when((F.size("__steps") > 0) | (F.size("__put") > 0), tx.let(F.struct("__steps", "__before", "__put"), lambda o: _stretches(o["__steps"], o["__before"], o["__put"]))).otherwise(F.array().cast(STRETCH)))
    cut_out = tx.let(F.struct(chunks(clean_marks(F.coalesce("__user.text", F.lit("")))).alias("parts"), F.col("__stretches").alias("s")), lambda o: F.transform(o["s"], lambda s: s.withField("found", cut(o["parts"], s["start"], s["end"]))))
    spliced = tx.let(F.struct("text", "__put"), lambda o: splice_array(o["text"], F.transform(o["__put"], lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["put"].alias("put")))))
    # a policy that is joined is applied afterwards, to the text that the spans' places refer to
    text = F.col("text") if ops is None else tx.public_placeholder(F.when(F.size("__put") > 0, spliced).otherwise(F.col("text")))
    done = out.select(
        *(F.col(f"__user.{c}").alias(c) if c != "text" else text.alias("text") for c in docs.columns),
        F.col("__row").alias(row), *(F.col(m).alias(n) for m, n in named.items()), F.col("__spans").alias(found), F.when(F.size("__stretches") > 0, cut_out).alias(replaced), F.col("__user.text").alias(original),
    )
    entities = sorted({r.entity for r in rules})
    of = lambda e, kept: F.sum(F.size(F.filter(F.col(found), lambda s: (s["entity"] == e) & (s["kept"] | F.lit(not kept)))))
    counts = [of(e, kept).alias(f"{'kept' if kept else 'raw'} {e}") for e in entities for kept in (False, True)]
    seen = Observation()
    chars = F.sum(F.length(F.coalesce(F.col(original), F.lit(""))).cast("long")).alias("chars")
    done = written(done.observe(seen, F.count(F.lit(1)).alias("rows"), chars, *counts).drop(original), folder, "done")
    metrics = {m: n or 0 for m, n in seen.get.items()}
    spans = done.select(row, "doc_id", F.explode(found).alias("__s")).select(row, "doc_id", "__s.*")
    documents = done.drop(found, replaced)
    if ops is None:
        documents = apply_spans(documents, spans.where("kept"), policy, by=row)
    stretches = done.select(row, "doc_id", F.explode(replaced).alias("__s")).select(row, "doc_id", "__s.*")
    return Anonymized(documents, spans, entity_table(spans.where("kept"), row), stretches, folder, row, metrics)


def anonymize_pdf_corpus(pdf_docs: DataFrame, pages: DataFrame, index: DataFrame | None = None, titles: list[str] | None = None, common: list[str] | None = None) -> tuple[DataFrame, Anonymized]:
    """(admission with names, result): gate, pages joined, names from the metadata, the flow. Pages belong to a
    document by doc_id, so here it is unique and not null. The admission is written once; ``release`` deletes it, too."""
    folder = run_folder(pdf_docs.sparkSession)
    # read three times, and each time it would ask all pages and find the names anew
    admitted = written(admit_pdfs(pdf_docs, pages).withColumn("names", tx.metadata_names(F.col("metadata"))), folder, "admitted")
    good = admitted.where(F.col("status") == "ok").select("doc_id", "names")
    texts = join_pages(pages.join(good, "doc_id", "left_semi"))
    done = anonymize(with_status(texts.join(good, "doc_id")).where(F.col("status") == "ok").drop("status"), index, titles=titles, common=common)
    return admitted, replace(done, admission=folder)
