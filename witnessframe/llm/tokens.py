"""Token counts through a digest cache: only distinct texts that no earlier run counted are encoded."""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable, shared_folder
from . import words

LIMIT = 4096
CACHE = "content binary, n_tokens long, tokenizer string"


@functools.lru_cache(2)
def _tokenizer(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.lru_cache(2)
def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and the library that reads it."""
    import sentencepiece

    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + sentencepiece.__version__.encode()).hexdigest()


def normalised(text: Column) -> Column:
    """Texts that count alike by rule get one form: null is empty, and the visible space mark is a space."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("▁"), F.lit(" "))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def count_tokens(docs: DataFrame, path: str, cache: str, *, limit: int = LIMIT) -> DataFrame:
    """Tokens of every whole text of ``docs(doc_id, text, ...)`` as the tokenizer file at ``path`` gives them.

    -> ``doc_id, n_bytes, n_tokens, over_limit``. ``cache`` is a folder of Parquet, partitioned
    by tokenizer version, that need not exist: digests of normalised texts are joined to the
    counts stored there, each distinct text that is missing is encoded once and appended.
    Digests, not texts, meet in the last join. ``path`` must name the file on every executor.

    No begin, end or other special tokens, no truncation; strings of special tokens inside a
    text are plain text, as is the library's default. A null text is empty and has 0 tokens;
    repeated rows give equal rows; extra columns are ignored. Two runs may append the
    same text at once: equal digests carry equal counts, and one is read.
    """
    spark = words.small_batches(docs).sparkSession
    version = tokenizer_version(path)
    spark.createDataFrame([], CACHE).write.mode("append").partitionBy("tokenizer").parquet(cache)

    def stored() -> DataFrame:
        rows = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version)
        return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            for row, stop, _, _ in words.slices(batch.column(1)):
                texts = batch.column(1).slice(row, stop - row).to_pylist()
                counts = [len(ids) for ids in tokenizer.encode(texts, num_threads=1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, stop - row), pa.array(counts, pa.int64())], ["content", "n_tokens"])

    text = normalised(F.col("text"))
    keyed = durable(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), digest(text).alias("content")))
    texts = docs.select(digest(text).alias("content"), text.alias("text"))
    missing = texts.join(stored().select("content"), "content", "left_anti").dropDuplicates(["content"])
    counted = missing.mapInArrow(encode, "content binary, n_tokens long").withColumn("tokenizer", F.lit(version))
    counted.write.mode("append").partitionBy("tokenizer").parquet(cache)
    return keyed.join(stored(), "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def fresh_cache(spark) -> str:
    """A cache folder of its own in the shared folder."""
    return f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}"
