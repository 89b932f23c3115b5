"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Each stream (a source with a weight, or the rest) is put into a fixed pseudo-random order and cut into blocks. With integer
weights w of sum W, the j-th block of a stream (from 0) is released at slot floor(j W / w) and due before slot
ceil((j + 1) W / w); in every slot the released block with the earliest deadline goes (ties: the first stream). That
keeps each stream less than one block from its share of every prefix, and repeats after W slots, so that one cycle is
scheduled and expanded by arithmetic. A cycle's weights are what its streams still have, at most w blocks: each document
goes out exactly once, and when a stream has run out, the others go on in proportion. There are at most two shapes of
cycle for each stream; the schedule of all shapes has at most (2 streams + 1) W rows, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REST = "rest"
#: Rows that one bucket of the order key holds on average, at most.
ROWS_PER_BUCKET = 50_000
ADDED = ("__stream", "__block", "__slot", "__place", "__s", "__o", "__h", "__k", "__r", "__n", "__before", "__cycle", "__j", "__at", "__shapes")


def _streams(weights: Mapping[str, int], rest: int) -> list[tuple[str, int]]:
    """Streams in order, the rest last; weights are positive integers."""
    if rest < 1 or any(int(w) != w or w < 1 for w in weights.values()):
        raise ValueError("weights must be positive integers")
    return [*((s, int(w)) for s, w in weights.items()), (REST, rest)]


def order_key(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).cast("binary"))


def cycle_schedule(shapes: DataFrame) -> DataFrame:
    """From `first` and `ks` (blocks of each stream in a cycle): first, stream, j, slot_in_cycle, by EDF over Pfair windows."""
    # ks: weights of this shape; one step picks the released block with the earliest deadline
    step = """
    aggregate(
      sequence(0, total - 1),
      named_struct('done', transform(ks, k -> 0L), 'picked', cast(array() as array<int>)),
      (s, t) -> element_at(transform(
        array(array_min(transform(
          filter(sequence(0, size(ks) - 1), i -> s.done[i] < ks[i] and (s.done[i] * total) div ks[i] <= t),
          i -> named_struct('due', ((s.done[i] + 1) * total + ks[i] - 1) div ks[i], 'i', i))).i),
        p -> named_struct('done', transform(s.done, (d, i) -> if(i = p, d + 1, d)), 'picked', array_append(s.picked, p))), 1),
      s -> s.picked)
    """
    sized = shapes.withColumn("total", F.expr("aggregate(ks, 0L, (a, k) -> a + k)")).where("total > 0")
    slots = sized.select("first", F.posexplode(F.expr(step)).alias("slot_in_cycle", "stream"))
    nth = F.row_number().over(Window.partitionBy("first", "stream").orderBy("slot_in_cycle")) - 1
    return slots.select("first", "stream", nth.cast("long").alias("j"), F.col("slot_in_cycle").cast("long").alias("slot_in_cycle"))


def mix(docs: DataFrame, weights: Mapping[str, int], rest: int = 1, block: int = 16, seed: int = 7, source: str = "source", ids: tuple[str, ...] = ("doc_id",), digits: int | None = None) -> DataFrame:
    """docs with __stream (name), __block (within its stream), __slot (of the block in the mixture) and __place (in the block).

    Null sources and those without a weight are the rest. Rows that tie in `ids` are ordered by a hash of the whole row; equal
    rows are interchangeable. An empty input gives no rows. Ranks are made within (stream, bucket of the order key) and the
    sizes of earlier buckets added, so that a stream with most rows costs no single task; there are 16 ** digits buckets,
    by default as many as keep ROWS_PER_BUCKET rows if all are of one stream. Columns of
    docs that are named like those in ADDED are an error.
    """
    streams = _streams(weights, rest)
    if clash := [c for c in docs.columns if c in ADDED]:
        raise ValueError(f"columns of docs that mix() adds itself: {clash}")
    if digits is None:
        n = docs.count()
        digits = next(d for d in range(3, 9) if d == 8 or n <= ROWS_PER_BUCKET * 16**d)
    number = F.create_map(*[F.lit(x) for i, (s, _) in enumerate(streams[:-1]) for x in (s, i)]) if weights else F.create_map(F.lit(""), F.lit(0))
    of = F.coalesce(number[F.col(source)], F.lit(len(streams) - 1))
    keyed = docs.withColumns({"__s": of, "__o": order_key(seed, *ids), "__h": F.xxhash64(*docs.columns)}).withColumn("__k", F.substring("__o", 1, digits))
    sizes = keyed.groupBy("__s", "__k").agg(F.count("*").alias("n"))
    before = Window.partitionBy("__s").orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__s", "__k", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))

    # one row: the blocks of every stream, by number
    per = sizes.groupBy("__s").agg(F.ceil(F.sum("n") / F.lit(block)).alias("m")).agg(F.map_from_entries(F.collect_list(F.struct("__s", "m"))).alias("m"))
    ws = F.array(*[F.lit(w).cast("long") for _, w in streams])
    have = per.select(F.transform(ws, lambda _, i: F.coalesce(F.col("m")[i], F.lit(0).cast("long"))).alias("ms"))
    # cycles from 0 at which the shape changes: when a stream's last whole cycle, or its rest, is over
    ends = F.flatten(F.zip_with("ms", ws, lambda m, w: F.array(F.floor(m / w), F.ceil(m / w))))
    have = have.withColumn("firsts", F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), ends))))
    in_cycle = lambda c: F.zip_with("ms", ws, lambda m, w: F.greatest(F.lit(0).cast("long"), F.least(w, m - c * w)))
    shapes = have.select("ms", F.explode("firsts").alias("first")).select("first", in_cycle(F.col("first")).alias("ks"), F.expr(f"aggregate(zip_with(ms, array({', '.join(f'{w}L' for _, w in streams)}), (m, w) -> least(m, first * w)), 0L, (a, x) -> a + x)").alias("base"))
    bases = shapes.select("first", "base", F.expr("aggregate(ks, 0L, (a, k) -> a + k)").alias("per_cycle"))
    schedule = cycle_schedule(shapes.select("first", "ks")).join(F.broadcast(bases), "first")  # at most (2 streams + 1) rows

    rank = F.row_number().over(Window.partitionBy("__s", "__k").orderBy("__o", *ids, "__h"))
    ranked = keyed.withColumn("__r", rank).join(starts, ["__s", "__k"]).withColumn("__n", F.col("__before") + F.col("__r") - 1)
    w = F.element_at(ws, F.col("__s") + 1)
    placed = ranked.withColumns({"__block": F.expr(f"__n div {block}"), "__place": F.col("__n") % block}).withColumns({"__cycle": F.floor(F.col("__block") / w), "__j": F.col("__block") % w})
    # the shape that a cycle has: the last that begins at it or before; firsts is one row of at most 2 streams + 1 numbers
    firsts = schedule.select("first", "stream", "j", "base", "per_cycle", "slot_in_cycle")
    spans = have.select(F.explode(F.expr("transform(firsts, (f, i) -> named_struct('first', f, 'next', get(firsts, i + 1)))")).alias("x")).select("x.*")
    # the rows' cycles of one stream and j: expanded by shape, of which each cycle has one
    table = firsts.join(F.broadcast(spans), "first").groupBy("stream", "j").agg(F.collect_list(F.struct("first", "next", "base", "per_cycle", "slot_in_cycle")).alias("__shapes"))
    found = placed.join(F.broadcast(table), (F.col("__s") == F.col("stream")) & (F.col("__j") == F.col("j")))  # at most W rows of 2 streams + 1 entries
    at = F.expr("filter(__shapes, x -> x.first <= __cycle and (x.next is null or __cycle < x.next))[0]")
    slot = F.expr("__at.base + (__cycle - __at.first) * __at.per_cycle + __at.slot_in_cycle")
    names = F.array(*[F.lit(s) for s, _ in streams])
    return found.withColumn("__at", at).select(*docs.columns, F.element_at(names, F.col("__s") + 1).alias("__stream"), "__block", slot.alias("__slot"), "__place")


def in_order(docs: DataFrame, weights: Mapping[str, int], rest: int = 1, block: int = 16, per_partition: int = 6_000, bytes_per_partition: int = 128 << 20, **options: object) -> DataFrame:
    """All rows of docs in the mixture's order: partitions are consecutive ranges of slots, sorted within.

    A partition has per_partition rows or bytes_per_partition bytes of text on average, whichever is less. Columns may have any
    names.
    """
    names = docs.columns
    used = {"text", options.get("source", "source"), *options.get("ids", ("doc_id",))}
    docs = docs.toDF(*(c if c in used else f"c{i}" for i, c in enumerate(names)))
    mixed = mix(docs, weights, rest, block, **options)
    size = F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) if "text" in names else F.lit(0)
    total, volume = docs.agg(F.count("*"), size).first()
    partitions = max(1, min(200_000, max(-(-total // per_partition), -(-volume // bytes_per_partition))))
    blocks = max(1, -(-total // block) + len(weights) + 1)  # at most one block of each stream is not full
    at = F.least(F.lit(partitions - 1), F.floor(F.col("__slot") * partitions / blocks)).cast("int")
    return mixed.repartitionById(partitions, at).sortWithinPartitions("__slot", "__place").select(*docs.columns).toDF(*names)
