"""Quality by importance resampling: how much likelier a text is under the target than under the raw corpus.

Two bag models over hashed words and pairs are compared: one of documents
labelled good, one of all documents. A row's log ratio plus Gumbel noise is
its key; keeping the rows with the k greatest keys samples k rows without
replacement in proportion to the ratio.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, labelled_sample, table, texts_of
from .hashing import batch_words, pair_hashes

#: Buckets of the hashed n-grams.
BUCKETS = 1 << 14
#: At most so many labelled documents make the target model.
SAMPLE_ROWS = 20_000
#: Pseudo-count of each bucket.
ALPHA = 1.0
SEED = 7
#: Bits of the key that one selection pass settles, and the key's bits in all.
DIGIT, KEY_BITS = 16, 48


def buckets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words and pairs of a batch of texts, the text that each is of, and how many words each text has."""
    words, n = batch_words(column)
    row = np.repeat(np.arange(len(column)), n)
    inside = row[1:] == row[:-1]
    both = np.concatenate((words, pair_hashes(words)[inside]))
    return (both >> np.uint64(40)).astype(np.int64) % BUCKETS, np.concatenate((row, row[1:][inside])), n


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Counts of the BUCKETS n-gram buckets over all rows of ``texts`` (column text).

    Each task adds up its own and sends one row for each bucket; the driver gets BUCKETS sums.
    """
    bounded_batches(texts.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            total += np.bincount(buckets_of(b.column(0))[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    sums = texts.select("text").mapInArrow(each, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS)
    for bucket, n in sums.collect():
        out[bucket] = n
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + ALPHA) / (target.sum() + ALPHA * BUCKETS)) - np.log((raw + ALPHA) / (raw.sum() + ALPHA * BUCKETS))


def weighted(documents: DataFrame, ratios: np.ndarray) -> DataFrame:
    """(doc_id, n_words, log_weight): the log of target over raw probability of each text; 0 for one without words."""
    bounded_batches(documents.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bucket, row, n = buckets_of(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(np.bincount(row, ratios[bucket], b.num_rows), pa.float64())], names=["doc_id", "n_words", "log_weight"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(each, "doc_id bigint, n_words bigint, log_weight double")


def gumbel(seed: int) -> Column:
    """Standard Gumbel noise, a function of doc_id and seed alone."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_greatest(keys: DataFrame, k: int) -> int | None:
    """The exact k-th greatest of a column ``key`` of KEY_BITS-bit integers, by counting its digits from the top.

    Each pass counts one digit of the keys that share the digits found so
    far: at most 2**DIGIT counts reach the driver, however many rows there are.
    """
    if k <= 0:
        return None
    prefix, left = 0, k
    for shift in range(KEY_BITS - DIGIT, -1, -DIGIT):
        own = keys.where(F.shiftright("key", shift + DIGIT) == prefix).groupBy(F.shiftright("key", shift).alias("p")).count().collect()
        for p, n in sorted(((r[0], r[1]) for r in own), reverse=True):
            if n >= left:
                prefix = p
                break
            left -= n
        else:
            return None
    return prefix


def resampled(documents: DataFrame, labels: DataFrame, share: float | None = None, bound: int = SAMPLE_ROWS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, log_weight, gumbel_key, kept) for every row.

    ``share`` of the rows is kept, by default the share of good ones among
    those labelled. A null text counts as empty and weighs 0; rows with one
    doc_id get equal noise, and rows whose key equals the k-th are all kept.
    Without labels every row is kept.
    """
    scratch = Scratch(documents.sparkSession)
    good = labelled_sample(documents.sparkSession, labels, F.col("quality") == 1, bound, [])
    if share is None:
        share = labels.where("quality is not null").agg(F.avg(F.col("quality").cast("double"))).first()[0]
    share = 1.0 if share is None else share
    ratios = log_ratios(bucket_counts(texts_of(documents, good)), bucket_counts(documents))
    scored = weighted(documents, ratios).withColumn("gumbel_key", F.col("log_weight") + gumbel(seed))
    limit = float(1 << (KEY_BITS - 2))
    key = F.least(F.greatest(F.round(F.col("gumbel_key") * 1e5), F.lit(-limit)), F.lit(limit)).cast("bigint") + (1 << (KEY_BITS - 1))
    held = scratch.put(scored.withColumn("key", key))
    least = kth_greatest(held.select("key"), round(share * held.count()))
    return held.withColumn("kept", F.lit(False) if least is None else F.col("key") >= least).drop("key")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
