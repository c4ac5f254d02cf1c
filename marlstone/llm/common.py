"""What the operators of this subpackage share: tables, shared storage, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, shared_dir  # noqa: F401

#: White space of the word rule ``[^\x20\x09-\x0D]+``; ``bytes.split()`` uses the same set.
SPACE_CLASS = r"[\x20\x09-\x0D]"

#: Rows and bytes of an Arrow batch handed to a Python worker, whichever comes first; they bound a worker's memory when texts are many or long.
ARROW_ROWS, ARROW_BYTES = 512, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Hand texts to Python workers in small batches; smaller ones that the session sets hold.

    The plans that follow are made lazily, so the settings stay.
    """
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        held = int(str(spark.conf.get(key)).rstrip("b"))
        if not 0 < held <= most:
            spark.conf.set(key, str(most))


def words(text: Column) -> Column:
    """Array of the words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+"), "")


def text_key(text: Column) -> list[Column]:
    """96 bits that stand for a text where rows have no usable id."""
    return [F.xxhash64(text).alias("_k1"), F.hash(text).alias("_k2")]


def labelled_sample(spark: SparkSession, labels: DataFrame, where: Column, bound: int, columns: list[str]) -> DataFrame:
    """At most ``bound`` labelled rows, the same at every run: those with the least hash of doc_id.

    The bound makes the result small enough to broadcast. A doc_id labelled
    more than once counts once, with its least label values.
    """
    kept = labels.where(where & F.col("doc_id").isNotNull()).select("doc_id", *columns)
    once = kept.groupBy("doc_id").agg(*[F.min(c).alias(c) for c in columns]) if columns else kept.distinct()
    return once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def texts_of(documents: DataFrame, sample: DataFrame) -> DataFrame:
    """Texts of the bounded sample's documents, without a shuffle of the texts."""
    own = documents.select(F.col("doc_id").alias("_id"), F.col("text").alias("text"))
    return own.join(F.broadcast(sample), F.col("_id") == F.col("doc_id")).drop("_id")
