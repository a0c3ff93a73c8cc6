"""From raw documents to encoded training rows, one operator after another.

Every stage reads all that the one before it kept. ``run`` writes each stage's rows to the
shared folder before the next one reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarja.llm import jaccard, lines, mixing, pieces, quality
from tarja.llm.common import shared_folder, written

#: Words that sources share isn't expressible in SQL together with the estimated rules and the encoding.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the quality rules keep. Null, empty and very short texts go; equal texts share a verdict; an
    empty table gives an empty one."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines of three-line windows that stood earlier; ``n_chars`` follows the text. A null
    text stays null; rows alike in doc_id and text are one text."""
    return lines.dedup_lines(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates one row, that of the smallest doc_id. Rows are compared, not ids:
    unlike texts under one doc_id, or under none, are rows of their own. Texts without words all stay."""
    return jaccard.keep_one(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mixture takes it. A null source is one of its own; repeated rows count each."""
    return mixing.mixed(docs)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids, decoded_sha256, round_trip) for each row, whole texts; a null text is an empty one."""
    return pieces.encode_pieces(docs, pieces.model_path())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("mixing sources to target weights", mixing_sources),
    ("SentencePiece encoding", sentencepiece_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), folder, f"stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
