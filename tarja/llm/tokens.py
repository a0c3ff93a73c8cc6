"""Operator 1: token counts with a digest cache.

The cache is a table of (content, tokenizer, n_tokens): the SHA-256 of the normalised content, the
SHA-256 of the tokenizer's file, and the count. A text's normalised content is its UTF-8 bytes, a
null being empty; nothing that could change a count is folded. Counting joins the documents'
digests to the cache, encodes each missing content once, wherever copies of it stand, and
appends the new counts to the cache, from which the answer is then read.

Copies meet before the shuffle (a sorted partial aggregation keeps one text for each digest), so a
text that a third of the documents share reaches its task once for each input partition. Two
runs that append the same content at once leave equal rows; reading drops the repetition. Repeated
rows and doc_ids, null ids and extra columns pass through as rows of their own; an empty text
has 0 tokens; an empty table gives an empty result. A tokenizer file must be at the same path on
every executor, as installed packages are.
"""

from __future__ import annotations

import hashlib
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import exists
from .common import limit_batches, shared_folder, table, written

LIMIT = 4096
SCHEMA = "content binary, tokenizer string, n_tokens long"


@cache
def _counter(path: str):
    """A function from a list of texts to their numbers of tokens."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _encoded(path: str, version: str):
    def run(frames):
        count = _counter(path)
        for f in frames:
            for a in range(0, len(f), 64):
                part = f.iloc[a : a + 64]
                yield pd.DataFrame({"content": part["content"], "tokenizer": version, "n_tokens": count(part["text"].tolist())})

    return run


def read_cache(spark, path: str) -> DataFrame:
    """What has been counted; empty if nothing has been written there yet. A cache that can't be read is an error."""
    return spark.read.schema(SCHEMA).parquet(path) if exists(spark, path) else spark.createDataFrame([], SCHEMA)


def count_tokens(docs: DataFrame, tokenizer: str, cache_path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``; see the module."""
    spark = docs.sparkSession
    limit_batches(spark)
    version = file_digest(tokenizer)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("content", F.unhex(F.sha2("text", 256)))
    known = read_cache(spark, cache_path).where(F.col("tokenizer") == version).select("content", "n_tokens")
    misses = own.groupBy("content").agg(F.first("text").alias("text")).join(known, "content", "left_anti")
    misses.mapInPandas(_encoded(tokenizer, version), SCHEMA).write.mode("append").parquet(cache_path)
    counts = read_cache(spark, cache_path).where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    # written, so that both sides of the join are plain shuffles, and a content with very many copies can be split
    counts = written(counts, shared_folder(spark), "counts")
    sizes = own.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content")
    return sizes.join(counts, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    """With a cache of its own, so that each run counts every text."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), f"{shared_folder(spark)}/token-counts")
