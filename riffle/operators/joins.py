"""Joins that findings need: intervals, containers, ordered fallbacks, precedence, best matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlapping(left: DataFrame, right: DataFrame, key: str, how: str = "left_semi", bin_size: int | None = None) -> DataFrame:
    """Rows of left (key, start, end) whose closed interval meets one of right's with the same key; or, left_anti, meets none.

    Intervals are cut into bins and meet by (key, bin), so that one key with very many intervals on both sides is many small
    groups. Without bin_size, bins are twice as long as the intervals are on average, and such that none has more than 64.
    An interval with a null, or that ends before it starts, meets none.
    """
    if how not in ("left_semi", "left_anti"):
        raise ValueError("for semi and anti joins only")
    r = right.select(F.col(key).alias("__k"), F.col("start").alias("__s"), F.col("end").alias("__e")).where("__s <= __e")
    if bin_size is None:
        size = left.where("start <= end").select((F.col("end") - F.col("start")).alias("n")).union(r.select(F.col("__e") - F.col("__s")))
        mean, most = size.agg(F.avg("n"), F.max("n")).first()
        bin_size = max(1, int(2 * (mean or 0)), -(-int(most or 0) // 63))
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bin_size), F.floor(F.col(e) / bin_size)))
    ids = [key, "start", "end"]
    spans = left.select(*ids).where("start <= end").distinct().withColumn("__b", bins("start", "end"))
    rb = r.withColumn("__rb", bins("__s", "__e"))
    hit = spans.join(rb, (F.col(key) == F.col("__k")) & (F.col("__b") == F.col("__rb")) & (F.col("__s") <= F.col("end")) & (F.col("start") <= F.col("__e")), "left_semi").select(*ids).distinct()
    return left.join(hit, ids, how)


def smallest_container(points: DataFrame, spans: DataFrame, key: str, at: str, order: str, keep: Sequence[str]) -> DataFrame:
    """points with the columns `keep` of the shortest span (start, end) of the same key that holds `at`; ties: lowest `order`; nulls if none.

    Points are told apart by all their columns; equal points share a result. A span of up to 2 ** level places lies in one or
    two bins of that size, so that a point meets only spans near it, by (key, level, bin), and not all spans of a
    popular key. Levels that occur (64 at most) are collected.
    """
    size = F.col("end") - F.col("start")
    level = F.when(size <= 0, 0).otherwise(F.ceil(F.log2(size + 1))).cast("int")
    s = spans.where("start <= end").select(F.col(key).alias("__k"), "start", "end", level.alias("__l"), F.struct(size.alias("size"), F.col(order).alias("o"), *keep).alias("__c"))
    levels = sorted(r[0] for r in s.select("__l").distinct().collect())
    bin_of = lambda c, lv: F.expr(f"cast(floor({c} / shiftleft(1L, {lv})) as bigint)")
    near = s.withColumn("__b", F.explode(F.sequence(bin_of("start", "__l"), bin_of("end", "__l"))))
    asked = points.withColumn("__pl", F.explode(F.array(*[F.lit(x) for x in levels] or [F.lit(None).cast("int")]))).withColumn("__pb", bin_of(f"`{at}`", "__pl"))
    on = (F.col(key) == F.col("__k")) & (F.col("__pl") == F.col("__l")) & (F.col("__pb") == F.col("__b")) & F.col(at).between(F.col("start"), F.col("end"))
    best = asked.join(near, on, "left").groupBy(*points.columns).agg(F.min("__c").alias("__c"))
    return best.select(*points.columns, *(F.col(f"__c.{c}").alias(c) for c in keep))


def first_container(points: DataFrame, spans: DataFrame, key: str, at: str, order: str, keep: Sequence[str]) -> DataFrame:
    """points with the columns `keep` of the first span (by `order`) of the same key that holds `at`, whatever its size; nulls if none.

    Places are whole numbers; equal points share a result. A span is cut into aligned blocks of 2 ** level places, two of a level
    at most, and a block keeps its first span; a point lies in one block of each level. So a point meets one row for each
    level, however many spans of a popular key hold it. The length of the longest span is collected.
    """
    whole = ("tinyint", "smallint", "int", "bigint")
    if any(dict(df.dtypes)[c] not in whole for df, c in ((points, at), (spans, "start"), (spans, "end"))):
        raise ValueError("places have to be whole numbers")
    s = spans.where("start <= end").select(F.col(key).alias("__k"), F.col("start").cast("long").alias("__s"), F.col("end").cast("long").alias("__e"), F.struct(F.col(order).alias("o"), *keep).alias("__c"))
    levels = range(int(s.agg(F.max(F.col("__e") - F.col("__s") + 1)).first()[0] or 1).bit_length())

    def blocks(level: int) -> list[Column]:
        """Of the whole blocks of this level in the span: the first if it is a right half, the last if it is a left half; else the next level has them."""
        rest = F.lit((1 << level) - 1).cast("long")
        first = F.shiftright("__s", level) + F.when(F.col("__s").bitwiseAND(rest) == 0, 0).otherwise(1)
        last = F.shiftright("__e", level) - F.when(F.col("__e").bitwiseAND(rest) == rest, 0).otherwise(1)
        return [F.when((first <= last) & (b.bitwiseAND(F.lit(1)) == odd), F.struct(F.lit(level).alias("l"), b.alias("b"))) for b, odd in ((first, 1), (last, 0))]

    cut = s.select("__k", "__c", F.explode(F.array_compact(F.array(*[b for level in levels for b in blocks(level)]))).alias("__b"))
    firsts = cut.groupBy("__k", "__b").agg(F.min("__c").alias("__c"))
    held = F.array(*[F.struct(F.lit(level).alias("l"), F.shiftright(F.col("__at").cast("long"), level).alias("b")) for level in levels])
    asked = points.select(F.col(key).alias("__k"), F.col(at).alias("__at")).distinct().withColumn("__b", F.explode(held))
    best = asked.join(firsts, ["__k", "__b"]).groupBy("__k", "__at").agg(F.min("__c").alias("__c"))
    out = points.distinct().join(best, (F.col(key) == F.col("__k")) & (F.col(at) == F.col("__at")), "left")
    return out.select(*points.columns, *(F.col(f"__c.{c}").alias(c) for c in keep))


def meeting(ranges: DataFrame, spans: DataFrame, key: str, name: str) -> DataFrame:
    """ranges (key, start, end, …) with `name`: sorted distinct values of that column of the spans of the same key that overlap."""
    s = spans.select(F.col(key).alias("__k"), F.col("start").alias("__s"), F.col("end").alias("__e"), F.col(name).alias("__v"))
    hit = ranges.join(s, (F.col(key) == F.col("__k")) & (F.col("__s") <= F.col("end")) & (F.col("start") <= F.col("__e")), "left")
    return hit.groupBy(*ranges.columns).agg(F.array_sort(F.collect_set("__v")).alias(name))


def back_references(rows: DataFrame, keys: Sequence[str], content: str, order: str, out: str = "same_as") -> DataFrame:
    """rows with `out`: the `order` of the first row of the group with the same content, null for that row itself."""
    first = F.min(order).over(Window.partitionBy(*keys, F.sha2(F.col(content).cast("binary"), 256)))
    return rows.withColumn(out, F.when(first != F.col(order), first))


def excluded(rows: DataFrame, exclusions: DataFrame) -> DataFrame:
    """rows (id, repo, sha) without those that an exclusion (column key) names: by id, or as repo@sha with the whole hash or its first 12 digits."""
    e = exclusions.select(F.col("key").alias("__x")).where("__x is not null").distinct()
    keys = F.array("id", F.concat("repo", F.lit("@"), "sha"), F.concat("repo", F.lit("@"), F.substring("sha", 1, 12)))
    named = rows.select("id", "repo", "sha", F.explode(keys).alias("__x")).join(e, "__x", "left_semi").select(F.col("id").alias("__i"), F.col("repo").alias("__r"), F.col("sha").alias("__s")).distinct()
    same = F.col("id").eqNullSafe(F.col("__i")) & F.col("repo").eqNullSafe(F.col("__r")) & F.col("sha").eqNullSafe(F.col("__s"))
    return rows.join(named, same, "left_anti")


def ordered_fallback(subject: Column, exact: Sequence[tuple[str, str]], patterns: Sequence[tuple[str, str]], fallback: Column | None, unmapped: str) -> Column:
    """(target, origin): an exact entry, else the first pattern that fits, else the fallback, else unmapped.

    Rule tables are constants of the plan: one CASE in generated code, in the order of the table.
    """
    out = F
    for key, target in exact:
        out = out.when(subject == key, F.struct(F.lit(target).alias("target"), F.lit("exact").alias("origin")))
    for pattern, target in patterns:
        out = out.when(subject.rlike(pattern), F.struct(F.lit(target).alias("target"), F.lit("heuristic").alias("origin")))
    if fallback is not None:
        out = out.when(fallback.isNotNull(), F.struct(fallback.alias("target"), F.lit("fallback").alias("origin")))
    return out.otherwise(F.struct(F.lit(unmapped).alias("target"), F.lit("unmapped").alias("origin")))


def best_match(facts: DataFrame, truths: DataFrame, on: Column, rank: Column, fact_keys: Sequence[str], truth_order: Sequence[str]) -> DataFrame:
    """Each fact with its truth of the highest positive rank (ties: first by truth_order), or with nulls."""
    joined = facts.join(truths, on, "left").withColumn("__rank", F.coalesce(rank, F.lit(0)))
    w = Window.partitionBy(*fact_keys).orderBy(F.desc("__rank"), *truth_order)
    return joined.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n").withColumnRenamed("__rank", "match_rank")


def first_precedence(cases: Sequence[tuple[Column, object]], otherwise: object) -> Column:
    """The value of the first case that holds; null conditions do not."""
    out = F
    for condition, value in cases:
        out = out.when(F.coalesce(condition, F.lit(False)), value)
    return out.otherwise(otherwise)


def unique_or_null(column: str) -> Column:
    """As an aggregate: the only distinct value, or null if there are several."""
    return F.when(F.min(column) == F.max(column), F.max(column))
