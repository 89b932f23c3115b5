"""Set and map algebra: map differences, coverage, splices and drift decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, kind (added, removed, changed), old and new; equal entries give no row."""
    b = before.select(*keys, F.col(value).alias("old"), F.lit(True).alias("__b"))
    a = after.select(*keys, F.col(value).alias("new"), F.lit(True).alias("__a"))
    return changes(b.join(a, list(keys), "full"), keys)


def changes(both: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As map_diff, of one row for each key with old and new; __b and __a are null where there is no such side."""
    kind = F.when(F.col("__b").isNull(), "added").when(F.col("__a").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.select(*keys, kind.alias("kind"), "old", "new").where("kind is not null")


def uncovered(expected: DataFrame, covered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected keys that are not covered."""
    return expected.select(*keys).distinct().join(covered.select(*keys), list(keys), "left_anti")


def splice(old: DataFrame, fresh: DataFrame, evicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old without the rows of evicted keys, and the fresh rows."""
    return old.join(evicted.select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh)


def prune_orphans(nodes: DataFrame, edges: DataFrame, fileless: Column) -> DataFrame:
    """nodes but file-less ones that no edge refers to any longer."""
    used = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst"))).distinct().withColumn("__used", F.lit(True))
    return nodes.join(used, "id", "left").where(~fileless | F.col("__used").isNotNull()).drop("__used")


def drift_decision(stats: DataFrame, file_limit: float = 0.25, edge_limit: float = 0.15) -> DataFrame:
    """stats with decision: cold, warm, rebuild or incremental, and the reason of a rebuild.

    Needs has_profile, same_sha, anchor_changed, new_language (booleans), files, files_changed, edges and edges_changed. A repository
    without files has churn 1; limits are strict.
    """
    churn = lambda part, whole: F.when(F.col(whole) == 0, F.lit(1.0)).otherwise(F.col(part) / F.col(whole))
    file_churn, edge_churn = churn("files_changed", "files"), F.coalesce(F.try_divide("edges_changed", "edges"), F.lit(0.0))
    reason = F.when(F.col("anchor_changed"), "anchor").when(F.col("new_language"), "language").when(file_churn > file_limit, "file_churn").when(edge_churn > edge_limit, "edge_churn")
    decision = F.when(~F.col("has_profile"), "cold").when(F.col("same_sha"), "warm").when(reason.isNotNull(), "rebuild").otherwise("incremental")
    return stats.withColumns({"file_churn": file_churn, "edge_churn": edge_churn, "decision": decision, "reason": F.when(decision == "rebuild", reason)})
