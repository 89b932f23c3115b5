"""The regression gate over two scored runs: comparability first, then invariants and integer ratchets; and measures of arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riffle.operators.evaluate import case_set_difference
from riffle.operators.metrics import rate

#: Measures of which more is worse, with what they may grow by (None: the caller's allowance), and of which less is worse.
MAY_NOT_GROW = {"gate_relevant_false_positives": 0, "false_positives": None}
MAY_NOT_SHRINK = ("true_positives", "in_scope_true_positives", "discriminated_pairs")
ALLOWED_NEW = 1


def incomparable(base: DataFrame, current: DataFrame, base_cases: DataFrame, current_cases: DataFrame) -> DataFrame:
    """problem: why two runs can't be compared; no row if they can.

    base and current: one row of corpus, cold_profiles, dump_version; cases: case_id of what was scored. A run without scored
    cases compares equal to anything, so that it is a problem of its own.
    """
    b = base.select(*(F.col(c).alias(f"b_{c}") for c in ("corpus", "cold_profiles", "dump_version")))
    c = current.select(*(F.col(c).alias(f"c_{c}") for c in ("corpus", "cold_profiles", "dump_version")))
    differ = lambda name: F.when(~F.col(f"b_{name}").eqNullSafe(F.col(f"c_{name}")), F.lit(name))
    runs = b.join(c, F.lit(True)).select(F.explode(F.array(*[differ(x) for x in ("corpus", "cold_profiles", "dump_version")])).alias("problem")).where("problem is not null")  # a row on either side
    empty = lambda cases, name: cases.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(f"{name} has no scored cases").alias("problem"))
    sets = case_set_difference(base_cases, current_cases).select(F.concat("side", F.lit(" case "), "case_id").alias("problem"))
    return runs.unionByName(empty(base_cases, "baseline")).unionByName(empty(current_cases, "current")).unionByName(sets)


def snapshot(cases: DataFrame, detectors: DataFrame, scores: DataFrame, dropped: DataFrame) -> DataFrame:
    """name, n: the counts that a gate reads.

    cases: case_id, labelled, pair_id, side, error, false_positives, gate_relevant, true_positives, in_scope_true_positives;
    detectors: detector, status; scores is cases that were scored; dropped: true files that the filter dropped.
    """
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("long")
    labelled = F.col("labelled")
    one = scores.agg(total("false_positives", ~labelled).alias("false_positives"), total("gate_relevant", ~labelled).alias("gate_relevant_false_positives"), total("true_positives", labelled).alias("true_positives"), total("in_scope_true_positives", labelled).alias("in_scope_true_positives"))
    rows = one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, one.columns)), F.array(*one.columns))).alias("name", "n"))
    errors = cases.agg(F.count(F.when(F.col("error").isNotNull(), 1)).alias("n")).select(F.lit("case_errors").alias("name"), "n")
    ran = detectors.groupBy("detector").agg(F.count(F.when(F.col("status") == "ran", 1)).alias("n")).select(F.concat(F.lit("ran:"), "detector").alias("name"), "n")
    lost = dropped.agg(F.count("*").alias("n")).select(F.lit("dropped_truth").alias("name"), "n")
    found = discriminated(scores).select(F.lit("discriminated_pairs").alias("name"), F.col("num").alias("n"))
    return rows.unionByName(errors).unionByName(ran).unionByName(lost).unionByName(found)


def checks(before: DataFrame, after: DataFrame, allowed: int = ALLOWED_NEW) -> DataFrame:
    """name, kind (invariant or ratchet), before, after, passed over two snapshots; a count that a side lacks is 0.

    Invariants: no more case errors, no detector that runs less often, no more true files dropped. Ratchets: noise may not grow
    (beyond `allowed` false positives), signal may not shrink.
    """
    b, a = before.select("name", F.col("n").alias("before")), after.select("name", F.col("n").alias("after"))
    j = b.join(a, "name", "full").na.fill(0, ["before", "after"])
    invariant = F.col("name").isin("case_errors", "dropped_truth") | F.startswith("name", F.lit("ran:"))
    grow = F.when(F.col("name").isin("case_errors", "dropped_truth"), 0)
    for name, n in MAY_NOT_GROW.items():
        grow = grow.when(F.col("name") == name, allowed if n is None else n)
    shrinks = F.startswith("name", F.lit("ran:")) | F.col("name").isin(*MAY_NOT_SHRINK)
    passed = F.when(shrinks, F.col("after") >= F.col("before")).otherwise(F.col("after") <= F.col("before") + grow)
    return j.select("name", F.when(invariant, "invariant").otherwise("ratchet").alias("kind"), "before", "after", F.coalesce(passed, F.lit(True)).alias("passed"))


def gate_verdict(found: DataFrame, problems: DataFrame) -> DataFrame:
    """One row: verdict (refused, failed or passed), failed (sorted names of checks), problems (sorted)."""
    f = found.agg(F.array_sort(F.collect_set(F.when(~F.col("passed"), F.col("name")))).alias("failed"))
    p = problems.agg(F.array_sort(F.collect_set("problem")).alias("problems"))
    return f.join(p, F.lit(True)).select(F.when(F.size("problems") > 0, "refused").when(F.size("failed") > 0, "failed").otherwise("passed").alias("verdict"), "failed", "problems")  # a row on either side


# -- measures of pairs and arms ----------------------------------------------------------------------------------------


def _aggregate(num: Column, den: Column) -> list[Column]:
    return [c.alias(k) for k, c in rate(num, den).items()]


def discriminated(scores: DataFrame) -> DataFrame:
    """num, den, value over complete pairs (pair_id, side vuln or control): a true positive on the one side, no false one on the other."""
    hit = F.max(F.when(F.col("side") == "vuln", F.col("true_positives") > 0))
    clean = F.max(F.when(F.col("side") == "control", F.col("false_positives") == 0))
    pairs = scores.where("pair_id is not null").groupBy("pair_id").agg(hit.alias("hit"), clean.alias("clean")).where("hit is not null and clean is not null")
    return pairs.agg(*_aggregate(F.count(F.when(F.col("hit") & F.col("clean"), 1)), F.count("*")))


def in_scope_recall(rows: DataFrame, in_scope: DataFrame) -> DataFrame:
    """num, den, value: matched rows among those that some detector could name (rows: case_id, gt_ordinal, matched; in_scope: the keys)."""
    scope = rows.join(in_scope.select("case_id", "gt_ordinal").distinct(), ["case_id", "gt_ordinal"], "left_semi")
    return scope.agg(*_aggregate(F.count(F.when(F.col("matched"), 1)), F.count("*")))


def arm_suppression(scores: DataFrame) -> DataFrame:
    """arm, num, den, value over a whole run: dropped as pre-existing of all raw findings. Null for arms of a model alone: they have no baseline pass, which is not 0.

    scores: arm, scored_findings, skipped. The suppression of one stratum is evaluate.negative_measures' instead.
    """
    raw = F.sum(F.col("scored_findings") + F.col("skipped"))
    return scores.groupBy("arm").agg(*_aggregate(F.sum("skipped"), raw)).withColumn("value", F.when(~F.startswith("arm", F.lit("llm")), F.col("value")))


def recall_ceiling(arms: DataFrame) -> DataFrame:
    """num, den, value: rows in scope of all true rows, of the first arm (by ordinal) that has labels."""
    first = arms.where("rows > 0").agg(F.min(F.struct("ordinal", "in_scope", "rows")).alias("a"))
    return first.select(*(c.alias(k) for k, c in rate(F.col("a.in_scope"), F.col("a.rows")).items()))


def status_pivot(status: DataFrame, kinds: tuple[str, ...] = ("ran", "not_applicable", "missing_tool", "disabled", "error")) -> DataFrame:
    """A row for each detector with the number of runs by status (detect.detector_status); statuses are given, so that no pass looks for them."""
    return status.groupBy("detector").pivot("status", list(kinds)).agg(F.count(F.lit(1))).na.fill(0)


def detector_reach(*tables: DataFrame) -> DataFrame:
    """internal: every id that some detector's table can emit."""
    out = tables[0].select("internal")
    for t in tables[1:]:
        out = out.union(t.select("internal"))
    return out.where("internal is not null").distinct()
