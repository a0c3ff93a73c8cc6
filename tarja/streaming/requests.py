"""Requests as a stream: each is handled alone, and a micro-batch runs the batch flow."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.report import nested_entities
from ..plans.anonymize import Anonymized, anonymize
from ..sources.documents import REQUEST
from ..sources.shared import delete_folder, exists, folders_in, put_file


def read_requests(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """Requests (doc_id, text, names) that arrive as files in ``path``, as a stream."""
    requests = spark.readStream.schema(REQUEST).format(form).load(path)
    return requests.select("doc_id", F.col("texto").alias("text"), F.coalesce("nomes_metadados", F.array().cast("array<string>")).alias("names"))


def answers(done: Anonymized) -> DataFrame:
    """(doc_id, texto_anonimizado, entidades): one for each request, whatever its doc_id."""
    row = done.row
    texts = done.documents.select(row, "doc_id", F.col("text").alias("texto_anonimizado"))
    return texts.join(nested_entities(done.documents, done.entities, row), row).drop(row)


DATA, BATCHES = "data", "batches"
BATCH = "batch long, folder string, requests long, chars long, metrics map<string,long>"


def read_batches(spark: SparkSession, sink: str) -> DataFrame:
    """What has been answered: a row for each batch, with its folder and the counts that were made while it was written."""
    if not exists(spark, f"{sink}/{BATCHES}"):
        return spark.createDataFrame([], BATCH)
    return spark.read.schema(BATCH).option("pathGlobFilter", "*.json").json(f"{sink}/{BATCHES}")


def read_answers(spark: SparkSession, sink: str) -> DataFrame:
    """The answers of all batches that are complete; a batch that is being written isn't seen."""
    folders = [r["folder"] for r in read_batches(spark, sink).select("folder").collect()]  # a name for each batch
    return spark.read.schema(ANSWER).parquet(*(f"{sink}/{DATA}/{f}" for f in folders)) if folders else spark.createDataFrame([], ANSWER)


ANSWER = "doc_id long, texto_anonimizado string, entidades array<struct<entidade:string,texto_detectado:string,inicio:int,fim:int,score:string>>"


def answer_batch(batch: DataFrame, number: int, sink: str, index: DataFrame | list[str] | None = None, titles: list[str] | None = None, common: list[str] | None = None) -> None:
    """A micro-batch's answers: written to a folder of their own, and then told by one small file for the batch, which comes into being at once. A
    batch that is told already was answered before a failure, and isn't answered again."""
    spark = batch.sparkSession
    told = f"{sink}/{BATCHES}/{number}.json"
    if exists(spark, told):
        return
    done = anonymize(batch, index, titles=titles, common=common)
    try:
        folder = f"{number}-{uuid.uuid4().hex}"
        answers(done).write.parquet(f"{sink}/{DATA}/{folder}")
        counts = {k: n for k, n in done.metrics.items() if k not in ("rows", "chars")}
        put_file(spark, told, json.dumps({"batch": number, "folder": folder, "requests": done.metrics["rows"], "chars": done.metrics["chars"], "metrics": counts}))
    finally:
        done.release()


def clear_attempts(spark: SparkSession, sink: str) -> None:
    """Deletes folders that attempts have left that didn't come to their end. Not while a stream writes to ``sink``."""
    known = {r["folder"] for r in read_batches(spark, sink).select("folder").collect()}
    for folder in folders_in(spark, f"{sink}/{DATA}"):
        if folder not in known:
            delete_folder(spark, f"{sink}/{DATA}/{folder}")


def anonymize_stream(requests: DataFrame, sink: str, checkpoint: str, index: DataFrame | list[str] | None = None, titles: list[str] | None = None, common: list[str] | None = None, **trigger) -> StreamingQuery:
    """A stream of requests (doc_id, text, names), from any source; ``read_answers`` reads the answers in ``sink``, one for each request at any
    time, also while a batch is written or repeated after a failure. ``trigger`` as ``DataStreamWriter.trigger`` takes
    it (``processingTime="5 seconds"``, ``availableNow=True``); without one batches follow each other for as long as the query
    lives. Intermediate tables of a batch are deleted with its answers written."""
    clear_attempts(requests.sparkSession, sink)
    stream = requests.writeStream.foreachBatch(lambda batch, number: answer_batch(batch, number, sink, index, titles, common)).option("checkpointLocation", checkpoint)
    return (stream.trigger(**trigger) if trigger else stream).start()
