"""Best-fit decreasing packing of whole documents into sequences of a fixed number of tokens.

Best-fit decreasing takes pieces by length, longest first, and puts each into the open sequence with the tightest
remaining capacity that holds it; a segment tree over remaining capacities finds that one in logarithmic time. Pieces of
one length are interchangeable, so that the algorithm runs over the histogram of lengths (at most `capacity` counts,
whatever the number of documents) and places runs of equal pieces into runs of equal sequences. Its result is the
same as piece by piece. Each piece then finds its place by its rank among pieces of its length, a number that is made
in parallel: rank within (length, bucket of ids) plus the sizes of the buckets before.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riffle.llm.common import materialize, slabs, small_batches, texts_of
from riffle.llm.token_ids import cache_for

#: Pieces that one (length, bucket) should hold if all had the same length.
PIECES_PER_BUCKET = 1_000_000
#: Pieces of documents that stand together in a file are ranked together, so many rows of it at a time.
ROWS_TOGETHER = 1 << 10
#: Bits of a row's number within its file; the file's number is above them.
ROW_BITS = 40
#: Bytes of text encoded at a time.
SLAB = 1 << 20


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity; each leaf has the runs of sequences with that much left."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << (capacity + 1 - 1).bit_length()
        self.open = [0] * (2 * self.size)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _count(self, r: int, by: int) -> None:
        i = r + self.size
        while i:
            self.open[i] += by
            i //= 2

    def put(self, r: int, run: tuple[int, int]) -> None:
        self.runs[r].append(run)
        self._count(r, 1)

    def take(self, r: int) -> tuple[int, int]:
        self._count(r, -1)
        return self.runs[r].pop()

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least `length` that a sequence has."""
        i = length + self.size
        if self.open[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def pack_histogram(counts: Mapping[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, pieces, pieces a sequence, first sequence, offset), and the number of sequences."""
    tree, placed, sequences = CapacityTree(capacity), [], 0
    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left, rank = counts[length], 0
        while left:
            r = tree.tightest(length)
            if r is None:
                r, opened = capacity, -(-left // (capacity // length))
                tree.put(r, (sequences, opened))
                sequences += opened
            start, n = tree.take(r)
            fit = r // length
            full = min(n, left // fit)
            if full:
                placed.append((length, rank, full * fit, fit, start, capacity - r))
                tree.put(r - fit * length, (start, full))
                rank, left, start, n = rank + full * fit, left - full * fit, start + full, n - full
            if left and n:  # fewer than fit are left
                placed.append((length, rank, left, left, start, capacity - r))
                tree.put(r - left * length, (start, 1))
                rank, left, start, n = rank + left, 0, start + 1, n - 1
            if n:
                tree.put(r, (start, n))
    return np.array(sorted(placed), dtype=np.int64).reshape(-1, 6), sequences


def file_place() -> Column:
    """Place of a row in a table that Spark has written as Parquet: by the number of its file, then by its row there."""
    number = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long")
    return F.shiftleft(number, ROW_BITS) + F.col("_metadata.row_index")


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, text: str = "text", place: Column | None = None) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece; null texts count as empty (the end id alone).

    With place (a long), __place too, after doc_id.
    """
    small_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id"), *([] if place is None else [place.alias("__place")]), F.col(text).alias("__text"))
    keep = src.columns[:-1]
    schema = src.select(*keep, F.lit(0).alias("piece"), *(F.lit(0).cast("long").alias(c) for c in ("start", "length", "ids_crc32"))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, end = cache_for(tokenizer), end_id.to_bytes(4, "little")
        for b in batches:
            texts, rows = texts_of(b, "__text"), []
            for lo, hi in slabs(texts, SLAB):
                for row, ids in enumerate(cache.ids(texts[lo:hi]), lo):
                    whole = memoryview(ids + end)
                    for k, at in enumerate(range(0, len(whole), 4 * capacity)):
                        part = whole[at : at + 4 * capacity]
                        rows.append((row, k, at // 4, len(part) // 4, zlib.crc32(part)))
            row, *rest = zip(*rows, strict=True) if rows else ([], [], [], [], [])
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(row, pa.int64())) for i in range(len(keep))), *(pa.array(x, t) for x, t in zip(rest, kinds, strict=True))], names=schema.names)

    return src.mapInArrow(run, schema)


def pack(parts: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...), which must be cheap to read twice.

    Equal rows get different places. Memory on the driver: the histogram and its runs, which depend on `capacity` alone.
    With a column __place, pieces of one length are taken in its order.
    """
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # at most `capacity` rows
    runs, _ = pack_histogram(counts, capacity)
    buckets = max(64, -(-sum(counts.values()) // PIECES_PER_BUCKET))
    order = [c for c in parts.columns if c != "length"]
    bucket = F.pmod(F.xxhash64(*parts.columns), F.lit(buckets))
    if "__place" in parts.columns:
        order, bucket = ["__place", "piece"], F.floor(F.col("__place") / ROWS_TOGETHER)
    keyed = parts.withColumn("__b", bucket)
    before = Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy("length", "__b").count().select("length", "__b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    ranked = keyed.withColumn("__n", F.row_number().over(Window.partitionBy("length", "__b").orderBy(*order)))
    ranked = ranked.join(offsets, ["length", "__b"]).select(*parts.columns, (F.col("__before") + F.col("__n") - 1).alias("__rank"))
    out = parts.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    shared = parts.sparkSession.sparkContext.broadcast(runs)
    n, at = len(parts.columns), parts.columns.index("length")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        keys = (rows[:, 0] << 48) + rows[:, 1]
        for b in batches:
            length, rank = b.column(at).to_numpy(), b.column(n).to_numpy()
            hit = rows[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
            k = rank - hit[:, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), pa.array(hit[:, 4] + k // hit[:, 3]), pa.array(hit[:, 5] + k % hit[:, 3] * length)], names=out.names)

    return ranked.mapInArrow(place, out)


def by_first_place(packed: DataFrame) -> DataFrame:
    """packed (with __place), its sequences numbered anew by the earliest piece that each holds.

    A sequence's number is its rank among those that begin in its run of ROWS_TOGETHER rows, plus those of the runs before in
    its file and of the files before: most sequences begin in the first files, whose rows are no single task's therefore.
    """
    first = packed.groupBy("sequence_id").agg(F.min(F.struct("__place", "piece")).alias("__first"))
    first = first.withColumns({"__file": F.shiftright("__first.__place", ROW_BITS), "__run": F.floor(F.col("__first.__place") / ROWS_TOGETHER)})
    runs = first.groupBy("__file", "__run").count()
    so_far = lambda w: F.coalesce(F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = runs.groupBy("__file").agg(F.sum("count").alias("count")).select("__file", so_far(Window.orderBy("__file")).alias("__files"))  # a row for each file
    runs = runs.withColumn("__runs", so_far(Window.partitionBy("__file").orderBy("__run"))).join(files, "__file").select("__run", (F.col("__runs") + F.col("__files")).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__run").orderBy("__first"))
    numbers = first.withColumn("__n", rank).join(runs, "__run").select("sequence_id", (F.col("__before") + F.col("__n") - 1).alias("__new"))
    out = [F.col("__new").alias(c) if c == "sequence_id" else F.col(c) for c in packed.columns]
    return packed.join(numbers, "sequence_id").select(*out)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, text: str = "text", place: Column | None = None) -> DataFrame:
    """Tokenize, cut and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Empty input gives no rows; repeated rows are packed one by one; null ids are kept. With place (see file_place), pieces
    of one length are taken in its order, and sequences are numbered by the earliest place that they hold.
    """
    parts, _ = materialize(pieces(docs, tokenizer, capacity, end_id, text, place), "pieces")
    packed = pack(parts, capacity)
    if place is None:
        return packed
    packed, _ = materialize(packed, "packed")
    return by_first_place(packed).drop("__place")
