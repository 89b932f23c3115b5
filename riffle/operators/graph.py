"""Graphs as node and edge tables: bounded breadth-first search, reachability, taint pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riffle.storage import discard, materialize

#: Tables of reached nodes that are read side by side before they are merged into one.
MOST_TABLES = 8


def bounded_bfs(edges: DataFrame, starts: DataFrame, most: int = 4, routes: bool = False) -> DataFrame:
    """start, node, distance (0..most) of everything within `most` hops of each start (column node) over edges (src, dst).

    Each step joins the frontier with the edges and drops what has been reached; nothing is collected, and each frontier is
    written, so that the plan does not grow with the hops. With routes, the path of each node too: the shortest, ties by
    the smallest sequence of nodes.
    """
    step, _ = materialize(edges.select("src", "dst").distinct(), "edges")
    path = [F.array("node").alias("path")] if routes else []
    frontier, _ = materialize(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("distance"), *path).dropDuplicates(["start", "node"]), "frontier")
    reached = frontier
    for d in range(1, most + 1):
        longer = [F.concat("path", F.array("dst")).alias("path")] if routes else []
        further = frontier.join(step, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), F.lit(d).alias("distance"), *longer)
        further = further.groupBy("start", "node", "distance").agg(F.min("path").alias("path")) if routes else further.distinct()
        frontier, _ = materialize(further.join(reached.select("start", "node"), ["start", "node"], "left_anti").select(*reached.columns), "frontier")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """node of everything that any start (column node) reaches, itself included; loops until nothing is new.

    Rounds are written; when MOST_TABLES of them have come together they become one table, so that neither the plan nor the
    number of tables grows with the diameter of the graph.
    """
    spark = edges.sparkSession
    step, _ = materialize(edges.select("src", "dst").distinct(), "edges")
    frontier, at = materialize(starts.select("node").distinct(), "reached")
    tables = [(frontier, at)]
    while True:
        reached = tables[0][0]
        for t, _ in tables[1:]:
            reached = reached.union(t)
        new = frontier.join(step, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(reached, "node", "left_anti")
        frontier, at = materialize(new, "reached")
        if frontier.isEmpty():
            return reached
        tables.append((frontier, at))
        if len(tables) > MOST_TABLES:
            whole = materialize(reached.union(frontier), "reached")
            for _, old in tables[:-1]:
                discard(spark, old)
            tables = [whole]


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, neighbour, direction over one hop."""
    out = nodes.join(edges, F.col("node") == F.col("src")).select("node", F.col("dst").alias("neighbour"), F.lit("out").alias("direction"))
    into = nodes.join(edges, F.col("node") == F.col("dst")).select("node", F.col("src").alias("neighbour"), F.lit("in").alias("direction"))
    return out.union(into).distinct()


def taint_pairs(sources: DataFrame, sinks: DataFrame, sanitizers: DataFrame, calls: DataFrame, most: int = 4) -> DataFrame:
    """source, sink, sink_kind, path of symbols and sanitized_by for each source and each sink that its symbol reaches within `most` calls.

    sources and sinks: id, symbol, pattern, kind; sanitizers: symbol, name, kind; calls: src, dst. A pair of one non-empty
    pattern is none. Sanitizers of the sink's kind count if the first or last symbol of the path holds them.
    """
    routes = bounded_bfs(calls, sources.select(F.col("symbol").alias("node")).distinct(), most, routes=True)
    s = sources.select(F.col("id").alias("source"), F.col("symbol").alias("start"), F.col("pattern").alias("__p1"))
    t = sinks.select(F.col("id").alias("sink"), F.col("symbol").alias("node"), F.col("pattern").alias("__p2"), F.col("kind").alias("sink_kind"))
    pairs = s.join(routes, "start").join(t, "node").where("not (coalesce(__p1, '') != '' and __p1 <=> __p2)")
    by = sanitizers.groupBy(F.col("symbol").alias("__sym"), F.col("kind").alias("sink_kind")).agg(F.collect_set("name").alias("names"))
    at = lambda end, out: by.select(F.col("__sym").alias(end), "sink_kind", F.col("names").alias(out))
    full = pairs.join(at("start", "__a"), ["start", "sink_kind"], "left").join(at("node", "__b"), ["node", "sink_kind"], "left")
    none = F.array().cast("array<string>")
    known = F.array_distinct(F.concat(F.coalesce("__a", none), F.coalesce("__b", none)))
    return full.select("source", "sink", "sink_kind", "path", F.array_sort(known).alias("sanitized_by")).distinct()
