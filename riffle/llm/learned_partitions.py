"""Approximate nearest neighbours by learned partitions.

On a bounded sample: the nearest-neighbour graph is cut into balanced partitions (median bisections along principal
directions of the neighbourhood means, refined by label moves under a capacity), and a small classifier learns, for each
vector, how its neighbours spread over the partitions. Every vector is then indexed in its most probable partition, and a
query searches the several most probable ones; how many is set on sample vectors kept from the training, to
reach a target recall. Where more partitions are needed than one classifier tells apart, each is partitioned again by a
router of its own, which is learned on a sample of that partition by one task, so that partitions keep their size
however many vectors there are. Equal vectors are indexed once, with their smallest ids. Queries are searched in blocks
that follow their first partitions, so that those of a block share most of what they probe: a block meets all that it
needs in shards of bounded size, and each shard gives a query's best over all its partitions at once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riffle.llm.common import materialize

#: Rows of a partition aimed at; partitions of one router if it is the only one, and the most of each of two levels.
PER_PARTITION, ONE_LEVEL, MOST_PARTITIONS = 1024, 256, 1024
#: Vectors that a router learns from: so many for each of its partitions, within these limits.
SAMPLE_EACH, SAMPLE_LEAST, SAMPLE_MOST = 64, 8192, 65_536
#: Rows that one task routes on the second level.
ROUTED_TOGETHER = 65_536
#: Queries of a block, and bytes of candidates (as doubles) that one task compares them with.
QUERY_BLOCK, SHARD_BYTES = 8192, 64 << 20
#: Pairs that a task holds before it cuts them down to each query's best.
PAIRS_AT_ONCE = 2_000_000


@dataclass
class Router:
    """A classifier with one hidden layer over partitions, and how many partitions a query searches."""

    mean: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int
    sample_recall: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def best(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n most probable partitions of each row, the most probable first."""
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :n]


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest inner products of each row with other rows."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), dtype=np.int64)
    for at in range(0, len(x), 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out[at : at + len(s)] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, axis=1), axis=1), axis=1)
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.15, rounds: int = 12) -> np.ndarray:
    """Labels 0..parts-1 (a power of two) with few graph edges cut and at most slack * n / parts rows each."""
    smooth = x + x[graph].mean(axis=1)
    label = np.zeros(len(x), dtype=np.int64)
    for _ in range(int(np.log2(parts))):
        nxt = np.empty_like(label)
        for p in np.unique(label):
            own = np.flatnonzero(label == p)
            centred = smooth[own] - smooth[own].mean(axis=0)
            direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            order = own[np.argsort(centred @ direction, kind="stable")]
            nxt[order[: len(order) // 2]], nxt[order[len(order) // 2 :]] = 2 * p, 2 * p + 1
        label = nxt
    src, dst = np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()
    most = int(np.ceil(slack * len(x) / parts))
    for _ in range(rounds):
        votes = np.bincount(src * parts + label[dst], minlength=len(x) * parts) + np.bincount(dst * parts + label[src], minlength=len(x) * parts)
        votes = votes.reshape(len(x), parts)
        to = votes.argmax(axis=1)
        gain = votes[np.arange(len(x)), to] - votes[np.arange(len(x)), label]
        sizes, moved = np.bincount(label, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[to[i]] < most:
                sizes[label[i]] -= 1
                sizes[to[i]] += 1
                label[i], moved = to[i], moved + 1
        if moved < len(x) // 200:
            break
    return label


def levels(n: int, per_partition: int = PER_PARTITION, one_level: int = ONE_LEVEL) -> tuple[int, int]:
    """Partitions of the first level, and of each of those on the second (1: there is none), for n vectors; powers of two."""
    wanted = int(np.round(np.log2(max(1, n) / per_partition)))
    wanted = max(wanted, 0 if n < 256 else 3 if n < 1024 else 4)
    if 1 << wanted <= one_level:
        return 1 << wanted, 1
    most = int(np.log2(MOST_PARTITIONS))
    first = min(most, (wanted + 1) // 2)
    return 1 << first, 1 << min(most, wanted - first)


def sample_size(parts: int) -> int:
    return min(SAMPLE_MOST, max(SAMPLE_LEAST, SAMPLE_EACH * parts))


def fit_router(x: np.ndarray, parts: int, k: int = 20, target: float = 0.95, seed: int = 11, hidden: int = 96, epochs: int = 30) -> Router:
    """Learn partitions for vectors of which x is a sample; with under four vectors for each there is one partition."""
    rng = np.random.default_rng(seed)
    x = x[rng.permutation(len(x))].astype(np.float64)
    mean, dim = x.mean(axis=0), x.shape[1]
    if parts == 1 or len(x) < 4 * parts:
        return Router(mean, np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1, 1.0)
    kept = min(1024, len(x) // 8)
    train, probe = x[kept:], x[:kept]
    graph = neighbour_graph(train, 10)
    label = balanced_partition(train, graph, parts)
    target_of = np.zeros((len(train), parts))
    np.add.at(target_of, (np.repeat(np.arange(len(train)), graph.shape[1]), label[graph].ravel()), 1.0)
    target_of[np.arange(len(train)), label] += 2
    target_of /= target_of.sum(axis=1, keepdims=True)
    w = [rng.standard_normal((dim, hidden)) * np.sqrt(2 / dim) / max(1e-9, (train - mean).std()), np.zeros(hidden), rng.standard_normal((hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts)]
    m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for epoch in range(epochs):
        order = rng.permutation(len(train))
        for at in range(0, len(order), 256):
            i = order[at : at + 256]
            xb = train[i] - mean
            h = np.maximum(xb @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            d = (p / p.sum(axis=1, keepdims=True) - target_of[i]) / len(i)
            dh = (d @ w[2].T) * (h > 0)
            step += 1
            for j, g in enumerate((xb.T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0))):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                w[j] -= 0.004 * (1 - epoch / epochs) * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-9)
    router = Router(mean, *w, parts, 1.0)
    # the fewest probes that find enough of the true neighbours of vectors that were not trained on
    home = router.best(train, 1)[:, 0]
    near = np.argsort(-(probe @ train.T), axis=1)[:, :k]
    place = np.argsort(router.best(probe, parts), axis=1)
    needed = np.take_along_axis(place, home[near], axis=1)
    recall = np.array([(needed < p).mean() for p in range(1, parts + 1)])
    router.probes = int(np.argmax(recall >= target)) + 1
    router.sample_recall = float(recall[router.probes - 1])
    return router


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def top_pairs(q: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of c, inner product) of the k best rows of c for each row of q, ties to the smaller id."""
    out = []
    for at in range(0, len(q), 128):
        some = q[at : at + 128]
        s = some @ c.T
        if len(c) > k:
            cut = -np.partition(-s, k - 1, axis=1)[:, k - 1]
            slack = 1e-9 * (1 + np.abs(s).max(axis=1))
            qi, ci = np.nonzero(s >= (cut - slack)[:, None])
        else:
            qi, ci = (x.ravel() for x in np.indices(s.shape))
        exact = np.concatenate([(some[qi[j : j + 50_000]] * c[ci[j : j + 50_000]]).sum(axis=1) for j in range(0, len(qi), 50_000)] or [np.zeros(0)])
        order = np.lexsort((ids[ci], -exact, qi))
        qi, ci, exact = qi[order], ci[order], exact[order]
        first = np.searchsorted(qi, qi, side="left")
        keep = np.arange(len(qi)) - first < k
        out.append((qi[keep] + at, ci[keep], exact[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def usable(vector: Column) -> Column:
    """Not null, of finite components, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _vectors(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    column = rows.column("v")
    return _matrix(column if isinstance(rows, pa.RecordBatch) else column.combine_chunks())


def _at_home(router: Router, rows: pa.Table | pa.RecordBatch, base: int = 0) -> pa.Table:
    """Rows (k, least, v) with p, the most probable partition."""
    best = router.best(_vectors(rows), 1)[:, 0]
    return pa.table([pa.array(base + best.astype(np.int64)), *(rows.column(c) for c in ("k", "least", "v"))], names=["p", "k", "least", "v"])


def _probing(router: Router, rows: pa.Table | pa.RecordBatch, sizes: np.ndarray, need: int, base: int = 0) -> pa.Table:
    """Rows (k, least, v) with ps: as many of the most probable partitions as the router probes, and more until they hold `need` vectors."""
    best = router.best(_vectors(rows), router.b2.size)
    number = np.minimum(best.shape[1], np.maximum(router.probes, 1 + (np.cumsum(sizes[best], axis=1) < need).sum(axis=1)))
    row, rank = np.nonzero(np.arange(best.shape[1]) < number[:, None])
    ps = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(number))).astype(np.int32)), pa.array(base + best[row, rank].astype(np.int64)))
    return pa.table([ps, *(rows.column(c) for c in ("k", "least", "v"))], names=["ps", "k", "least", "v"])


def _second_level(homes: DataFrame, asks: DataFrame, parts: int, k: int, target: float) -> tuple[DataFrame, DataFrame]:
    """homes (p, k, least, v) and asks (ps, k, least, v) routed on within their partitions, each by a router that one task learns there."""
    size = sample_size(parts)
    first = F.row_number().over(Window.partitionBy("p").orderBy(F.xxhash64("k"), "k"))
    some = homes.withColumn("r", first).where(F.col("r") <= size).select("p", "v")  # cut before the shuffle

    def learn(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        router = fit_router(_vectors(group), parts, k, target)
        return pa.table({"p": pa.array([key[0].as_py()], pa.int64()), "router": [pickle.dumps(router)]})

    routers, _ = materialize(some.groupBy("p").applyInArrow(learn, "p long, router binary"), "routers")

    def further(rows: DataFrame, known: DataFrame, schema: str) -> DataFrame:
        every = "sizes" in known.columns

        def route(_: tuple[pa.Scalar, ...], some: pa.Table, one: pa.Table) -> pa.Table:
            if not one.num_rows:
                raise ValueError("a partition has no router")
            router, base = pickle.loads(one.column("router")[0].as_py()), one.column("p")[0].as_py() * parts  # noqa: S301  written by this run
            if not every:
                return _at_home(router, some, base)
            sizes = np.zeros(router.b2.size, dtype=np.int64)
            for p, n in one.column("sizes")[0].as_py():
                sizes[p - base] = n
            return _probing(router, some, sizes, k + 1, base)

        salts = rows.groupBy("p").agg(F.ceil(F.count("*") / ROUTED_TOGETHER).cast("int").alias("salts"))
        left = rows.join(salts, "p").select("p", "k", "least", "v", F.pmod(F.xxhash64("k"), F.col("salts")).cast("int").alias("salt"))
        others = salts.select(F.col("p").alias("p"), F.col("salts").alias("n"))
        right = known.join(others, "p").select(*known.columns, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("salt"))
        # salts are dealt by hash, so that one of them can be without rows
        full = right.join(left.select("p", "salt").distinct(), ["p", "salt"], "left_semi")
        return left.groupBy("p", "salt").cogroup(full.groupBy("p", "salt")).applyInArrow(route, schema)

    kind = f"k string, least long, v {dict(homes.dtypes)['v']}"
    inner = further(homes, routers, f"p long, {kind}")
    sizes = inner.groupBy("p").count().groupBy(F.floor(F.col("p") / parts).alias("p")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("p"), F.col("count")))).alias("sizes"))
    each = asks.select(F.explode("ps").alias("p"), "k", "least", "v")
    live = each.join(sizes.select("p"), "p", "left_semi")  # first-level partitions without vectors have no router
    return inner, further(live, routers.join(sizes, "p"), f"ps array<long>, {kind}")


def _searched(homes: DataFrame, asks: DataFrame, k: int, width: int) -> DataFrame:
    """query, k, least, score: in each shard of what its block needs, the k best for each row of asks over its partitions."""
    # queries by the first partition that they probe: places in its range of all queries, dealt by hash, make blocks
    firsts = asks.groupBy(F.get("ps", F.lit(0)).alias("p0")).agg(F.count("*").alias("n"))
    starts = firsts.select("p0", "n", F.coalesce(F.sum("n").over(Window.orderBy("p0").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))  # a row for each partition
    block = F.floor((F.col("start") + F.pmod(F.xxhash64("k"), F.col("n"))) / QUERY_BLOCK)
    dealt = asks.join(starts, F.get("ps", F.lit(0)) == F.col("p0")).select(block.alias("block"), "k", "v", "ps")
    rows = max(1, SHARD_BYTES // (8 * width))
    needs = dealt.select("block", F.explode("ps").alias("p")).distinct()
    counted = needs.join(homes.groupBy("p").agg(F.count("*").alias("n")), "p")
    shards = counted.groupBy("block").agg(F.ceil(F.sum("n") / rows).cast("int").alias("shards"))
    met, _ = materialize(needs.join(shards, "block"), "partition-blocks")
    left = homes.join(met, "p").select("block", F.pmod(F.xxhash64("k"), F.col("shards")).cast("int").alias("shard"), "p", "k", "least", "v")
    of_block = met.groupBy("block").agg(F.max("shards").alias("of_block"))
    right = dealt.join(of_block, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("of_block") - 1)).alias("shard"), "k", "v", "ps")

    def compare(_: tuple[pa.Scalar, ...], c: pa.Table, q: pa.Table) -> pa.Table:
        if not c.num_rows or not q.num_rows:
            return pa.table([pa.array([], t) for t in (pa.string(), pa.string(), pa.int64(), pa.float64())], names=["query", "k", "least", "score"])
        x, y, ids = _vectors(c), _vectors(q), c.column("least").to_numpy()
        ps = q.column("ps").combine_chunks()
        asked, of = ps.flatten().to_numpy(), np.repeat(np.arange(q.num_rows), np.diff(ps.offsets.to_numpy()))
        by_p = np.argsort(asked, kind="stable")
        asked, of = asked[by_p], of[by_p]
        home = c.column("p").to_numpy()
        order = np.argsort(home, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], home[order][1:] != home[order][:-1], [True])))
        held, pairs = [], 0
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = order[lo:hi]
            who = of[np.searchsorted(asked, home[own[0]], "left") : np.searchsorted(asked, home[own[0]], "right")]
            if len(who):
                qi, ci, score = top_pairs(y[who], x[own], ids[own], k)
                held.append((who[qi], own[ci], score))
                pairs += len(qi)
                if pairs > PAIRS_AT_ONCE:
                    held = [_best(held, ids, k)]
                    pairs = len(held[0][0])
        qi, ci, score = _best(held, ids, k)
        return pa.table([q.column("k").take(pa.array(qi)), c.column("k").take(pa.array(ci)), pa.array(ids[ci]), pa.array(score)], names=["query", "k", "least", "score"])

    return left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(compare, "query string, k string, least long, score double")


def _best(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best pairs (query, candidate, score) of each query, ties to the smaller id."""
    qi, ci, score = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    order = np.lexsort((ids[ci], -score, qi))
    qi, ci, score = qi[order], ci[order], score[order]
    keep = np.arange(len(qi)) - np.searchsorted(qi, qi, side="left") < k
    return qi[keep], ci[keep], score[keep]


def nearest(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", target: float = 0.95, per_partition: int = PER_PARTITION, one_level: int = ONE_LEVEL) -> DataFrame:
    """query_id, rank (from 1), the found id (as id_col) and score (inner product) of each query's k nearest rows but itself.

    Rows with a null id or an unusable vector take no part; a vector that is shorter than the longest counts as filled up
    with zeros; equal rows count once; of different vectors under one id, the one with the smaller hash counts. Ties go to the
    smaller id. Fewer than k candidates give fewer rows; an empty table gives none; other columns are left out. What comes
    to the driver is the first level's sample, of sample_size() vectors.
    """
    spark = rows.sparkSession
    good = rows.where(F.col(id_col).isNotNull() & usable(F.col(vector)))
    width = good.agg(F.max(F.size(vector))).first()[0]
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double").withColumnRenamed("vec_id", id_col)
    zero = F.lit(0).cast(good.schema[vector].dataType.elementType)
    filled = F.when(F.size(vector) == width, F.col(vector)).otherwise(F.concat(vector, F.array_repeat(zero, F.lit(width) - F.size(vector))))
    base = good.select(F.col(id_col).cast("long").alias("id"), filled.alias("v"), is_query.alias("q"))
    base = base.withColumn("k", F.concat(F.hex(F.xxhash64("v")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "v"))))
    one, _ = materialize(base.select("id", "k", "q").groupBy("id").agg(F.min("k").alias("k"), F.max("q").alias("q")), "vector-ids")
    # of each distinct vector: its k + 1 smallest ids (a query may be among them), cut before the shuffle
    smallest = F.row_number().over(Window.partitionBy("k").orderBy("id"))
    ids = one.select("k", "id").withColumn("r", smallest).where(F.col("r") <= k + 1).groupBy("k").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    of_k = one.groupBy("k").agg(F.max("q").alias("q"), F.min("id").alias("least"))
    vectors, _ = materialize(base.groupBy("k").agg(F.first("v").alias("v")).join(of_k, "k").select("k", "v", "q", "least"), "vectors")
    n = vectors.count()
    parts, further = levels(n, per_partition, one_level)
    some = vectors.orderBy(F.xxhash64("k"), "k").limit(sample_size(parts)).select("v").collect()  # bounded
    router = fit_router(np.array([r["v"] for r in some], dtype=np.float64), parts, k, target)
    shared = spark.sparkContext.broadcast(router)

    def route(sizes: np.ndarray | None):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from (_at_home(shared.value, b) if sizes is None else _probing(shared.value, b, sizes, k + 1)).to_batches()

        return run

    kind = f"k string, least long, v {dict(base.dtypes)['v']}"
    homes = vectors.select("k", "least", "v").mapInArrow(route(None), f"p long, {kind}")
    sizes = np.zeros(router.b2.size, dtype=np.int64)
    for r in homes.groupBy("p").count().collect():  # at most MOST_PARTITIONS rows
        sizes[r["p"]] = r["count"]
    asks = vectors.where("q").select("k", "least", "v").mapInArrow(route(sizes), f"ps array<long>, {kind}")
    if further > 1:
        homes, asks = _second_level(homes, asks, further, k, target)
    found = _searched(homes, asks, k + 1, width)
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "least"))
    top = found.withColumn("r", best).where(F.col("r") <= k + 1).join(ids, "k")
    pairs = F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("i")))))
    lists = top.groupBy("query").agg(F.slice(F.array_sort(pairs), 1, k + 1).alias("near"))  # at most (k + 1) ** 2 before the cut
    queries = one.where("q").select("k", "id")
    ranked = queries.join(lists, F.col("k") == F.col("query")).select(F.col("id").alias("query_id"), F.slice(F.filter("near", lambda x: x["i"] != F.col("id")), 1, k).alias("near"))
    out = ranked.select("query_id", F.posexplode("near").alias("r", "x"))
    return out.select("query_id", (F.col("r") + 1).alias("rank"), F.col("x.i").alias(id_col), (-F.col("x.s")).alias("score"))
