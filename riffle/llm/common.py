"""What the operators of this subpackage share: shared storage, bounded Arrow batches, hashes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riffle.storage import discard, materialize, recorded, run_folder, shared_folder  # noqa: F401  the operators take them from here

#: Rows and bytes that one Arrow batch to Python may hold (a longer text is a batch of its own).
ROWS_PER_BATCH, BYTES_PER_BATCH = 256, 32 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of an Arrow batch, as it has to fit a Python worker.

    Spark has these limits for a session, not for a plan. They are lowered where they are higher, never raised; other queries
    of the session get smaller batches then, and the same results.
    """
    for key, most in (("maxRecordsPerBatch", ROWS_PER_BATCH), ("maxBytesPerBatch", BYTES_PER_BATCH)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key, None)
        digits = (now or "").removesuffix("b")
        if not digits.isdigit() or not 0 < int(digits) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, with underscores added until no column of df has that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a string column; null reads as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def fold_of(doc_id: object, folds: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_fold: int, per_class: int, most_bytes: int) -> list[tuple[bytes, int]]:
    """Whole texts of at most per_class documents of either label, as (utf-8, label), in a fixed order.

    Training rows are those whose fold is not held_fold. Ids are chosen by a hash over the labels alone; repeated or
    contradicting labels of one id count once (the larger label). Of documents that share an id the one with the smallest hash
    counts. In the order of the hash, texts of any length are taken as long as those of a label have most_bytes in all.
    What comes to the driver is at most 2 * per_class texts and 2 * most_bytes bytes, whatever the tables hold.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .select("doc_id", F.col(label).cast("int").alias("__y"))
        .where(id_fold(F.col("doc_id"), folds) != held_fold)
        .groupBy("doc_id")
        .agg(F.max("__y").alias("__y"))
    )
    order = F.xxhash64(F.lit(17), F.col("doc_id"))
    picked = None
    for y in (0, 1):
        some = known.where(F.col("__y") == y).orderBy(order, "doc_id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", text.alias("__t")).join(F.broadcast(picked), "doc_id")  # at most 2 * per_class rows of two numbers
    one = found.groupBy("doc_id", "__y").agg(F.min(F.struct(F.xxhash64("__t").alias("h"), "__t")).alias("__m"))  # at most 2 * per_class rows
    so_far = F.sum(F.octet_length("__m.__t")).over(Window.partitionBy("__y").orderBy("__o", "doc_id"))
    rows = one.withColumn("__o", order).withColumn("__sum", so_far).where(F.col("__sum") <= most_bytes).select("__o", F.col("__m.__t").alias("__t"), "__y").collect()
    return [(r["__t"].encode(), r["__y"]) for r in sorted(rows, key=lambda r: (r["__o"], r["__t"]))]


def slabs(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about `most` bytes in all; a longer text gets a range of its own."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > most:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)
