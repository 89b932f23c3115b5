"""Scorecards with denominators: rates, scoring of findings, pairs, spread over passes, and the regression gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riffle.functions import tables as T
from riffle.functions import text as X
from riffle.operators.joins import best_match


def rate(num: Column, den: Column) -> dict[str, Column]:
    """num, den and value; the value of a rate without denominator is null, never 0."""
    return {"num": num.cast("long"), "den": den.cast("long"), "value": F.when(den != 0, num / den)}


def f1(precision: Column, recall: Column) -> Column:
    """Null where either is null or 0."""
    return F.when((precision != 0) & (recall != 0), 2 * precision * recall / (precision + recall))


def cwe_relation(cwes: Column, truth: Column) -> Column:
    """exact_cwe, related_cwe or null for a finding's CWE array against a true one."""
    ours = F.filter(F.transform(cwes, X.normalized_cwe), lambda c: c != "")
    gt = X.normalized_cwe(truth)
    group = T.cwe_group(gt)
    return F.when(F.array_contains(ours, gt) & (gt != ""), "exact_cwe").when(group.isNotNull() & F.exists(ours, lambda c: F.coalesce(T.cwe_group(c) == group, F.lit(False))), "related_cwe")


def score(findings: DataFrame, truths: DataFrame) -> DataFrame:
    """Each introduced finding of a case with label tp, near_miss or fp, its kind of match and the true row's ordinal.

    A true row in the same file with a related CWE ranks 2 (exact CWE: 2, related: 1) times 2 if a span overlaps, else 1; among
    equal ranks the first row wins. Overlap makes a tp, the file alone a near miss. truths: case_id, gt_ordinal, cwe,
    gt_file, spans (array of start, end).
    """
    overlap = F.exists("spans", lambda s: (s["start"] <= F.col("end_line")) & (F.col("start_line") <= s["end"]))
    kind = cwe_relation(F.col("cwe_ids"), F.col("cwe"))
    rank = F.when(kind == "exact_cwe", 2).when(kind == "related_cwe", 1) * F.when(overlap, 2).otherwise(1)
    t = truths.withColumnRenamed("case_id", "__case")
    on = (F.col("case_id") == F.col("__case")) & (F.col("file") == F.col("gt_file"))
    hit = best_match(findings.where("introduced_by_pr"), t, on, rank, ["case_id", "ordinal"], ["gt_ordinal"])
    matched = F.col("match_rank") > 0
    return hit.select(
        *findings.columns,
        F.when(matched & overlap, "tp").when(matched, "near_miss").otherwise("fp").alias("label"),
        F.when(matched, kind).alias("match_kind"),
        F.when(matched, F.col("gt_ordinal")).alias("gt_ordinal"),
    )


def truth_rows(findings: DataFrame, truths: DataFrame) -> DataFrame:
    """Each true row with matched (a finding overlaps with a related CWE) and located (overlaps, whatever the CWE)."""
    f = findings.where("introduced_by_pr").select(F.col("case_id").alias("__case"), "file", "start_line", "end_line", "cwe_ids")
    overlap = F.exists("spans", lambda s: (s["start"] <= F.col("end_line")) & (F.col("start_line") <= s["end"]))
    joined = truths.join(f, (F.col("case_id") == F.col("__case")) & (F.col("gt_file") == F.col("file")), "left")
    located = F.coalesce(overlap, F.lit(False))
    matched = located & cwe_relation(F.col("cwe_ids"), F.col("cwe")).isNotNull()
    return joined.groupBy("case_id", "gt_ordinal").agg(F.max(F.coalesce(matched, F.lit(False))).alias("matched"), F.max(located).alias("located"))


def attribution(truths: DataFrame, matched: DataFrame, pre_existing: DataFrame) -> DataFrame:
    """How the baseline explains each missed true row: overlap, file_only or none."""
    overlap = F.exists("spans", lambda s: (s["start"] <= F.col("end_line")) & (F.col("start_line") <= s["end"]))
    p = pre_existing.select(F.col("case_id").alias("__case"), "file", "start_line", "end_line", "cwe_ids")
    missed = truths.join(matched.where("matched").select("case_id", "gt_ordinal"), ["case_id", "gt_ordinal"], "left_anti")
    joined = missed.join(p, (F.col("case_id") == F.col("__case")) & (F.col("gt_file") == F.col("file")), "left")
    fits = cwe_relation(F.col("cwe_ids"), F.col("cwe")).isNotNull()
    priority = F.max(F.when(fits & overlap, 2).when(fits, 1).otherwise(0))
    return joined.groupBy("case_id", "gt_ordinal").agg(priority.alias("__p")).select("case_id", "gt_ordinal", F.when(F.col("__p") == 2, "overlap").when(F.col("__p") == 1, "file_only").otherwise("none").alias("by_baseline"))


def labelled_measures(verdicts: DataFrame, rows: DataFrame, controls: DataFrame) -> DataFrame:
    """measure, num, den, value: precision (scorecard and pooled), recall, recall ignoring CWE, localization, relation share."""
    n = lambda c: F.count(F.when(c, 1))
    v = verdicts.agg(n(F.col("label") == "tp").alias("tp"), n(F.col("label") == "fp").alias("fp"), n(F.col("label") == "near_miss").alias("near"), n((F.col("label") == "tp") & (F.col("match_kind") == "related_cwe")).alias("related"))
    r = rows.agg(n(F.col("matched")).alias("matched"), n(F.col("located")).alias("located"), F.count("*").alias("rows"))
    c = controls.agg(F.count("*").alias("control"))
    one = v.join(F.broadcast(r), F.lit(True)).join(F.broadcast(c), F.lit(True))  # three tables of one row
    entry = lambda name, a, b: F.struct(F.lit(name).alias("measure"), F.expr(a).cast("long").alias("num"), F.expr(b).cast("long").alias("den"))
    table = F.array(entry("precision", "tp", "tp + fp"), entry("precision_pooled", "tp", "tp + fp + control"), entry("recall", "matched", "rows"), entry("recall_ignoring_cwe", "located", "rows"), entry("localization", "tp", "tp + near"), entry("relation_share", "related", "tp"))
    return one.select(F.explode(table).alias("m")).select("m.*").withColumn("value", F.try_divide("num", "den"))


def pair_outcomes(sides: DataFrame) -> DataFrame:
    """Each pair (pair_id, side vuln or control, hits) as missed, clean, also_flagged or unpaired; the last side by ordinal counts."""
    last = sides.groupBy("pair_id").agg(F.max_by(F.when(F.col("side") == "vuln", F.col("hits")), F.when(F.col("side") == "vuln", F.col("ordinal"))).alias("vuln"), F.max_by(F.when(F.col("side") == "control", F.col("hits")), F.when(F.col("side") == "control", F.col("ordinal"))).alias("control"))
    outcome = F.when(F.col("vuln").isNull() | F.col("control").isNull(), "unpaired").when(F.col("vuln") == 0, "missed").when(F.col("control") == 0, "clean").otherwise("also_flagged")
    return last.withColumn("outcome", outcome)


def spread(rates: DataFrame, key: str, value: str = "value") -> DataFrame:
    """key, passes and max - min of the non-null rates, where there are two or more."""
    return rates.groupBy(key).agg(F.count(value).alias("passes"), (F.max(value) - F.min(value)).alias("spread")).where("passes >= 2")


def ratchet(before: DataFrame, after: DataFrame, allowed: int = 1) -> DataFrame:
    """name, before, after and PASS or FAIL: a count may grow by `allowed`; a measure on one side only fails."""
    b, a = before.select("name", F.col("n").alias("before")), after.select("name", F.col("n").alias("after"))
    return b.join(a, "name", "full").withColumn("status", F.when(F.col("before").isNull() | F.col("after").isNull(), "FAIL").when(F.col("after") - F.col("before") > allowed, "FAIL").otherwise("PASS"))


def cost(calls: DataFrame, floors: dict[str, int], default_floor: int) -> DataFrame:
    """arm, cost, cost_per_case, own_tokens: tokens beyond the harness' cached floor of each call, never below 0.

    calls: arm, completed (cases), usd, tokens, cached, n_calls, build.
    """
    floor = T.lookup(F.col("build"), floors, default_floor)
    own = F.greatest(F.lit(0), F.col("tokens") - F.least(F.col("cached"), F.col("n_calls") * floor))
    return calls.withColumn("__own", own).groupBy("arm").agg(F.sum("usd").alias("cost"), F.try_divide(F.sum("usd"), F.sum("completed")).alias("cost_per_case"), F.sum("__own").alias("own_tokens"))
