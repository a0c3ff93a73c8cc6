"""Sources and sinks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms

REQUEST = "doc_id long, texto string, nomes_metadados array<string>"
SNAPSHOT = "id string, input string, output string, entities array<struct<entity:string,text:string>>"


def read_documents(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """A1: (doc_id, text, names); absent names are an empty array."""
    df = spark.read.schema(REQUEST).format(form).load(path)
    return df.select("doc_id", F.col("texto").alias("text"), F.coalesce("nomes_metadados", F.array().cast("array<string>")).alias("names"))


def spread(docs: DataFrame) -> DataFrame:
    """``docs``, dealt evenly over all cores if its scan has fewer partitions than there are cores: work on texts is bound by
    CPU, and a file of one row group is one task's. Larger tables stay as they are, without a shuffle."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def with_status(docs: DataFrame) -> DataFrame:
    """A2: ``status`` is blank for a null or blank text, else ok."""
    return docs.withColumn("status", F.when(F.coalesce("text", F.lit("")).rlike(r"(?U)\S"), "ok").otherwise("blank"))


def admit_pdfs(pdf_docs: DataFrame, pages: DataFrame) -> DataFrame:
    """A3: pdf_docs with ``status``: too_large, too_many_pages, no_text or ok, in this order of tests."""
    text = pages.groupBy("doc_id").agg(F.max(F.coalesce("text", F.lit("")).rlike(r"(?U)\S")).alias("__some"))
    met = pdf_docs.join(text, "doc_id", "left")
    status = F.when(F.col("size_bytes") > terms.MAX_PDF_MB * 1024 * 1024, "too_large").when(F.col("page_count") > terms.MAX_PDF_PAGES, "too_many_pages").when(~F.coalesce("__some", F.lit(False)), "no_text").otherwise("ok")
    return met.withColumn("status", status).drop("__some")


def pdf_files(spark: SparkSession, path: str, modified_after: str | None = None, glob: str = "*.pdf") -> DataFrame:
    """A3 at the source: (path, size_bytes, modified, status) of the files below ``path``; ``status`` is too_large or ok. Sizes come from the
    listing, so no file is opened. ``modified_after``, as ``2026-01-31T00:00:00``: only files that are newer."""
    files = _binary(spark, path, modified_after, glob)
    status = F.when(F.col("length") > terms.MAX_PDF_MB * 1024 * 1024, "too_large").otherwise("ok")
    return files.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), status.alias("status"))


def _binary(spark: SparkSession, path: str, modified_after: str | None, glob: str) -> DataFrame:
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    return (reader.option("modifiedAfter", modified_after) if modified_after else reader).load(path)


def pdf_pages(spark: SparkSession, path: str, pages_of: Callable[[bytes], list[str]], modified_after: str | None = None, glob: str = "*.pdf") -> DataFrame:
    """(path, page_no, text): the pages of the files that aren't too large, which alone are opened, one at a time in a task. ``pages_of``, the
    user's, gives a file's pages; a file that it fails on, or that has too many pages, gives one row without page_no or text, and its ``problem``."""

    def read(frames):
        for f in frames:
            for name, content in zip(f["path"], f["content"], strict=True):
                try:
                    found = pages_of(bytes(content))
                    problem = "too_many_pages" if len(found) > terms.MAX_PDF_PAGES else None
                except Exception as e:  # whatever a file makes the user's function raise is that file's problem
                    problem = f"unreadable: {type(e).__name__}"
                if problem:
                    yield pd.DataFrame({"path": [name], "page_no": pd.array([None], "Int32"), "text": [None], "problem": [problem]})
                else:
                    yield pd.DataFrame({"path": name, "page_no": pd.array(range(1, len(found) + 1), "Int32"), "text": pd.Series(found, dtype=object), "problem": None})

    small = _binary(spark, path, modified_after, glob).where(F.col("length") <= terms.MAX_PDF_MB * 1024 * 1024)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", terms.MAX_PDF_MB * 1024 * 1024)
    return small.select("path", "content").mapInPandas(read, "path string, page_no int, text string, problem string")


def join_pages(pages: DataFrame) -> DataFrame:
    """A4: (doc_id, text): a document's pages in order, with nothing between. Run it on admitted
    documents, whose pages are at most MAX_PDF_PAGES."""
    own = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text")))).alias("p"))
    return own.select("doc_id", F.array_join(F.transform("p", lambda s: s["text"]), "").alias("text"))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """A5: (line, value): the lines of a term list, stripped, without blank ones. A missing file is an
    empty list. ``line`` grows along a file."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "line long, value string")
    stripped = F.regexp_replace("value", r"(?U)^[\s\x{FEFF}]+|\s+$", "")
    return lines.select(F.monotonically_increasing_id().alias("line"), stripped.alias("value")).where(F.col("value") != "")


def term_list(df: DataFrame) -> list[str]:
    """A rule list's values in order, for the rule table. Such a list becomes one pattern, so it is small by nature."""
    return [r["value"] for r in df.orderBy("line").select("value").collect()]


def write_results(docs: DataFrame, entities: DataFrame, path: str, form: str = "parquet", by: str = "doc_id") -> None:
    """One row for each document: id, text and nested entities. ``by`` tells rows apart (row_id for results of the flow)."""
    from ..operators.report import nested_entities

    out = docs.select(*{by: 0, "doc_id": 0}, F.col("text").alias("texto_anonimizado")).join(nested_entities(docs, entities, by), by)
    out.write.mode("overwrite").format(form).save(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Files of one JSON array each, with or without a byte order mark, or of one object in each line. The first sign in the
    first file with any says which."""
    head = spark.read.text(path).select(F.regexp_extract("value", r"(?U)^[\s\x{FEFF}]*(\S)", 1).alias("c")).where("c <> ''").first()
    return spark.read.schema(SNAPSHOT).option("multiLine", head is not None and head["c"] == "[").json(path)


#: What the tasks that write a snapshot take at a time, so that their memory doesn't follow a partition's rows.
SNAPSHOT_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 500, "spark.sql.execution.arrow.maxBytesPerBatch": 4 * 1024 * 1024}


def _arrays(batches):
    yield pa.RecordBatch.from_pydict({"value": ["["]})
    first = True
    for b in batches:
        lines = b.column("value")
        if len(lines):
            head = pa.array(["" if first else ","] + [","] * (len(lines) - 1), lines.type)
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(head, lines, pa.scalar("", lines.type))], ["value"])
            first = False
    yield pa.RecordBatch.from_pydict({"value": ["]"]})


def write_snapshot(run: DataFrame, path: str, files: int | None = None) -> None:
    """Each partition's rows as a file with one JSON array; ``files``: so many, by ranges of id, rows in its order."""
    if files:
        run = run.repartitionByRange(files, "id").sortWithinPartitions("id")
    conf = run.sparkSession.conf
    before = {k: conf.get(k) for k in SNAPSHOT_BATCH}
    try:
        for k, most in SNAPSHOT_BATCH.items():
            conf.set(k, most)
        run.select(F.to_json(F.struct("id", "input", "output", "entities")).alias("value")).mapInArrow(_arrays, "value string").write.mode("overwrite").text(path)
    finally:
        for k, v in before.items():
            conf.set(k, v)
