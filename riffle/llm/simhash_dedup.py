"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within `radius` bits share a variant within half the radius (rounded up) of each. Every distinct
fingerprint therefore has all its variants (2081 for 64 bits and radius 4) looked at, grouped by variant. What is shuffled is keyed
by a prefix of the variant: a fingerprint goes once to each prefix that any of its variants has (1 + b + b(b-1)/2 keys
for b bits), and the variants under that prefix are generated where they meet. That moves some dozens of 8-byte
values for each fingerprint instead of thousands of pairs. A prefix under which too many variants would meet, as in a
dense cluster of fingerprints, is split by further bits, as often as needed. Fingerprints that share a variant are linked as
a star, verified by their Hamming distance, and reduced to a spanning forest in place; components are then joined across
prefixes by alternating star contractions. No group is expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riffle.llm.common import discard, materialize, small_batches, texts_of

BITS = 64
#: Variants that one task holds in memory at a time (8 bytes each, about five arrays).
VARIANTS_AT_ONCE = 3_000_000
#: Variants that one prefix should have on average, which sets how many prefix bits are used; and most of one prefix before it is split.
VARIANTS_PER_PREFIX, MOST_PER_PREFIX = 2_000_000, 16_000_000
#: Bits by which a prefix is split.
SPLIT_BITS = 8
#: Shingle hashes whose bits are counted at a time.
HASHES_AT_ONCE = 1 << 16


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the A-Z lower-cased text's word shingles; 0 without words."""
    words = text.lower().split()  # ASCII letters and ASCII white space only, as both are bytes methods
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, HASHES_AT_ONCE):
        span = range(at, min(n, at + HASHES_AT_ONCE))
        h = np.fromiter((digest(joined[starts[i] : stops[i]], seed) for i in span), dtype="<u8", count=len(span))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "__fp", keep: list[str] | None = None, shingle: int = 4, seed: int = 42) -> DataFrame:
    """The columns `keep` of docs and the fingerprint as a signed long; null texts count as empty."""
    small_batches(docs.sparkSession)
    keep = keep or []
    src, said = (docs.select(*keep), text) if text in keep else (docs.select(*keep, F.col(text).alias("__text")), "__text")
    schema = src.select(*keep, F.lit(0).cast("long").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, shingle, seed) for t in texts_of(b, said)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(fps.view(np.int64))], names=[*keep, out])

    return src.mapInArrow(run, schema)


def _masks(bits: list[int], most: int) -> list[list[int]]:
    """By number of set bits from 0 to `most`: all masks over `bits`."""
    return [[sum(1 << b for b in c) for c in combinations(bits, k)] for k in range(most + 1)]


def _forest(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node position that each of `nodes` reaches over the links a-b (positions)."""
    label = np.arange(len(nodes))
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        if np.array_equal(before, label):
            break
    return label


def link_prefix(fps: np.ndarray, prefix: int, prefix_bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among distinct fingerprints that share a variant with this prefix (its lowest bits), as a spanning forest.

    Variants are made in slices by further bits, so that memory stays bounded however many fingerprints meet here.
    """
    fps = np.unique(fps)
    half = -(-radius // 2)
    low = np.uint64((1 << prefix_bits) - 1)
    used = np.bitwise_count((fps ^ np.uint64(prefix)) & low)
    base = (fps & ~low) | np.uint64(prefix)
    free = list(range(prefix_bits, BITS))
    by_size = _masks(free, half)
    total = sum(int((used == u).sum()) * sum(len(m) for m in by_size[: half - u + 1]) for u in range(half + 1))
    slice_bits = min(len(free), max(0, int(np.ceil(np.log2(max(1, total) / VARIANTS_AT_ONCE)))))
    within = np.uint64(((1 << slice_bits) - 1) << prefix_bits)
    everything = {u: np.array([m for ms in by_size[: half - u + 1] for m in ms], dtype=np.uint64) for u in range(half + 1)}
    owners = {u: np.flatnonzero(used == u) for u in range(half + 1)}
    found_a, found_b = [], []
    for s in range(1 << slice_bits):
        want = np.uint64(s << prefix_bits)
        vs, who = [], []
        for u, own in owners.items():
            if not len(own):
                continue
            masks = everything[u]
            if not slice_bits:
                vs.append((base[own][:, None] ^ masks[None, :]).ravel())
                who.append(np.repeat(own.astype(np.int32), len(masks)))
                continue
            # masks grouped by what they do to the slice's bits: each fingerprint takes the one group that leads here
            need = (base[own] ^ want) & within
            part = masks & within
            for flip in np.unique(need):
                if flip in part:
                    o, m = own[need == flip], masks[part == flip]
                    vs.append((base[o][:, None] ^ m[None, :]).ravel())
                    who.append(np.repeat(o.astype(np.int32), len(m)))
        if not vs:
            continue
        v, w = np.concatenate(vs), np.concatenate(who)
        del vs, who
        ordered = np.sort(v)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        del ordered
        if not len(twice):
            continue
        # a small table of hashes of the shared variants finds the few incidences that matter
        mix = np.uint64(0x9E3779B97F4A7C15)
        seen = np.zeros(1 << 20, dtype=bool)
        seen[(twice * mix) >> np.uint64(44)] = True
        near = seen[(v * mix) >> np.uint64(44)]
        v, w = v[near], w[near]
        order = np.lexsort((w, v))
        v, w = v[order], w[order]
        first = np.concatenate(([True], v[1:] != v[:-1]))
        head = w[np.flatnonzero(first)[np.cumsum(first) - 1]]
        pairs = np.unique((head[~first].astype(np.uint64) << np.uint64(32)) | w[~first].astype(np.uint64))
        found_a.append((pairs >> np.uint64(32)).astype(np.int64))
        found_b.append((pairs & np.uint64(0xFFFFFFFF)).astype(np.int64))
    if not found_a:
        none = np.array([], dtype=np.uint64)
        return none, none
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    near = np.bitwise_count(fps[a] ^ fps[b]) <= radius
    label = _forest(fps, a[near], b[near])
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def _spread(rows: DataFrame, bits: int, more: int, half: int) -> DataFrame:
    """rows (fp, prefix, used) by `more` further bits of the prefix, after the first `bits`: each with every change that its ball allows."""
    flips = [(m, k) for k, ms in enumerate(_masks(list(range(bits, bits + more)), half)) for m in ms]
    some = F.array(*[F.struct(F.lit(m - (m >> 63 << 64)).cast("long").alias("m"), F.lit(k).alias("k")) for m, k in flips])
    if bits:  # at the beginning nothing is used up yet
        some = F.filter(some, lambda f: f["k"] + F.col("used") <= half)
    window = ((1 << more) - 1) << bits
    here = F.col("fp").bitwiseAND(F.lit(window - (window >> 63 << 64)).cast("long"))
    each = rows.select("fp", "prefix", "used", F.explode(some).alias("f"))
    return each.select("fp", F.col("prefix").bitwiseOR(here.bitwiseXOR(F.col("f.m"))).alias("prefix"), (F.col("used") + F.col("f.k")).alias("used"))


def prefix_bits(n: int, radius: int) -> int:
    """Bits of the prefix for n fingerprints, so that the variants under one are VARIANTS_PER_PREFIX on average."""
    per_fp = sum(len(m) for m in _masks(list(range(BITS)), -(-radius // 2)))
    return int(min(40, max(6, np.ceil(np.log2(max(1, n) * per_fp / VARIANTS_PER_PREFIX)))))


def ball_links(fps: DataFrame, n: int, radius: int = 4) -> DataFrame:
    """Links (a, b) between the n distinct fingerprints of column fp that connect all within `radius` bits."""
    half, bits = -(-radius // 2), prefix_bits(n, radius)
    rows = _spread(fps.select("fp", F.lit(0).cast("long").alias("prefix"), F.lit(0).alias("used")), 0, bits, half)
    links = None
    while True:
        # variants that a fingerprint has under a prefix, by the bits of it that have been changed
        weight = F.array(*[F.lit(sum(len(m) for m in _masks(list(range(bits, BITS)), half - u))) for u in range(half + 1)])
        loads = rows.groupBy("prefix").agg(F.sum(F.get(weight, F.col("used"))).alias("n"))
        hot, _ = materialize(loads.where(F.col("n") > MOST_PER_PREFIX).select("prefix"), "hot-prefixes")
        last = bits == BITS or hot.isEmpty()
        found = _meet(rows if last else rows.join(hot, "prefix", "left_anti"), bits, radius)
        links = found if links is None else links.unionByName(found)
        if last:
            return links.distinct()
        more = min(SPLIT_BITS, BITS - bits)
        rows, _ = materialize(_spread(rows.join(hot, "prefix", "left_semi"), bits, more, half), "split-prefixes")
        bits += more


def _meet(rows: DataFrame, bits: int, radius: int) -> DataFrame:
    """Links among the fingerprints of each prefix of so many bits."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        got = group.column("fp").to_numpy().view(np.uint64)
        a, b = link_prefix(got, key[0].as_py() % (1 << BITS), bits, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return rows.select("fp", "prefix").groupBy("prefix").applyInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node reachable (as signed longs).

    Alternates large-star and small-star contractions until nothing changes; each round is cut off by a table in the
    shared folder. Minima are partially aggregated before they are shuffled, so that a hub costs no single task.
    """
    spark = links.sparkSession
    edges, path = materialize(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    n = edges.count()
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "k")
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(low, F.col("u") == F.col("k")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        after, at = materialize(small, "links")
        m = after.count()
        # both are sets of edges: they are the same if there are as many, and none is new
        same = m == n and after.join(edges, ["u", "v"], "left_anti").isEmpty()
        discard(spark, path)
        edges, path, n = after, at, m
        if same:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, keys: list[str] | None = None, text: str = "text", radius: int = 4, shingle: int = 4) -> DataFrame:
    """`keys` of every row, its fingerprint (`__fp`, signed) and component (smallest non-null first key reachable).

    Null texts count as empty, empty texts have fingerprint 0 and link like any other; rows with equal fingerprints
    share a component; rows whose whole component has a null first key get a null component; an empty input gives no rows;
    other columns are left alone.
    """
    keys = keys or ["doc_id"]
    marked, _ = materialize(with_fingerprint(docs, text, "__fp", keys, shingle), "fingerprints")
    fps, _ = materialize(marked.groupBy(F.col("__fp").alias("fp")).agg(F.min(keys[0]).alias("least")), "fingerprint-firsts")
    links, _ = materialize(ball_links(fps.select("fp"), fps.count(), radius), "ball-links")
    roots = components(links)
    # only fingerprints with links need their group's minimum; its table stands by itself, so that a join with a large group can be split
    members = roots.union(roots.select("root", "root").distinct()).join(fps, F.col("node") == F.col("fp")).select("fp", "root", "least")
    least, _ = materialize(members.groupBy("root").agg(F.min("least").alias("best")), "components")
    grouped = members.select("fp", "root").join(least, "root").select(F.col("fp").alias("__f"), "best")
    named = fps.join(grouped, F.col("fp") == F.col("__f"), "left").select("fp", F.coalesce("best", "least").alias("__component"))
    return marked.join(named, F.col("__fp") == F.col("fp"), "left").drop("fp")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, text: str = "text", radius: int = 4, shingle: int = 4) -> DataFrame:
    """One row of every near-duplicate group: that with the smallest doc_id (nulls last; ties: any one), all columns kept.

    Columns may have any names. Rows are numbered as they are written once with their fingerprints; then groups are
    decided on numbers alone, and texts move again only if the rows to drop are too many to be sent to every task.
    """
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    numbered = plain.withColumn("row", F.monotonically_increasing_id())
    written, _ = materialize(with_fingerprint(numbered, f"c{names.index(text)}", "fp", numbered.columns, shingle), "fingerprints")
    ids = F.col(f"c{names.index('doc_id')}")
    key = F.struct(ids.isNull().alias("late"), ids.alias("id"), "row")
    firsts, _ = materialize(written.groupBy("fp").agg(F.min(key).alias("first")), "fingerprint-firsts")
    links, _ = materialize(ball_links(firsts.select("fp"), firsts.count(), radius), "ball-links")
    roots = components(links)
    members = roots.union(roots.select("root", "root").distinct()).join(firsts, F.col("node") == F.col("fp")).select("fp", "root", "first")
    best = members.groupBy("root").agg(F.min("first").alias("best")).select("root", F.col("best.row").alias("row"))
    kept = firsts.join(members.select("fp"), "fp", "left_anti").select(F.col("first.row").alias("row")).union(best.select("row"))
    dropped, _ = materialize(written.select("row").join(kept, "row", "left_anti"), "dropped-rows")
    return written.join(dropped, "row", "left_anti").drop("row", "fp").toDF(*names)
