"""Findings: deduplication with merge, scoping against a baseline, validation, gate, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riffle.functions import tables as T
from riffle.operators.joins import first_precedence


def dedup(findings: DataFrame, keys: tuple[str, ...] = ("run_id", "fingerprint")) -> DataFrame:
    """One finding for each key: the richest, with the evidence, flow, entry and sources of the others.

    Richest: severity, confidence, number of evidence and of flow nodes, snippet characters; ties: the earliest `ordinal`.
    Evidence is distinct by (file, lines) in order of richness; the first flow and entry that exist are taken; other
    detectors are listed sorted, the winner's not among them. Needs columns severity_rank, confidence, evidence
    (array of file, lines, snippet, why), data_flow (array), entry, detector, ordinal. Evidence is first reduced to one for
    each place and detector, so that work grows with the findings and a popular key is reduced before it meets in one task.
    """
    chars = F.aggregate("evidence", F.lit(0), lambda n, e: n + F.coalesce(F.length(e["snippet"]), F.lit(0)))
    order = {"__a": -F.col("severity_rank"), "__b": -F.col("confidence"), "__c": -F.size("evidence"), "__d": -F.size("data_flow"), "__f": -chars, "__ordinal": F.col("ordinal"), "__detector": F.col("detector")}
    rest = [c for c in findings.columns if c not in keys]
    once = [c for c in rest if c not in ("evidence", "ordinal", "detector")]
    each = findings.select(*keys, *once, *(v.alias(k) for k, v in order.items()), F.posexplode_outer("evidence").alias("__i", "__e"))
    # a finding's own columns stay with its first evidence; structs are made in the aggregates, so that rows are narrow where they are sorted
    first, there = F.coalesce("__i", F.lit(0)) == 0, F.col("__i").isNotNull()
    each = each.select(*keys, *order, "__i", "__e", there.alias("__there"), F.col("__e.file").alias("__file"), F.col("__e.lines").alias("__lines"), *(F.when(first, F.col(c)).alias(c) for c in once))
    least = lambda when, *values: F.min(F.when(when, F.struct(*order, *values)))
    places = each.groupBy(*keys, "__there", "__file", "__lines", "__detector").agg(
        least(first, *once).alias("__best"), least(there, "__i", "__e").alias("__proof"), least(first & (F.size("data_flow") > 0), "data_flow").alias("__flow"), least(first & F.col("entry").isNotNull(), "entry").alias("__entry"), F.count(F.when(first, 1)).alias("__n")
    )
    proofs = F.collect_list(F.when(F.col("__there"), F.struct("__file", "__lines", "__proof")))
    group = places.groupBy(*keys).agg(*(F.min(c).alias(c) for c in ("__best", "__flow", "__entry")), F.sort_array(proofs).alias("__proofs"), F.sum("__n").alias("__n"), F.collect_set(F.struct("__detector")).alias("__detectors"))
    # a place that several detectors name is there once for each, side by side
    before = lambda i: F.get("__proofs", i - 1)
    new = lambda x, i: (i == 0) | ~(x["__file"].eqNullSafe(before(i)["__file"]) & x["__lines"].eqNullSafe(before(i)["__lines"]))
    evidence = F.transform(F.sort_array(F.transform(F.filter("__proofs", new), lambda x: x["__proof"])), lambda x: x["__e"])
    best = F.col("__best")
    others = F.array_sort(F.array_except(F.col("__detectors")["__detector"], F.array(best["__detector"])))
    own = {"evidence": evidence, "data_flow": F.coalesce(F.col("__flow")["data_flow"], best["data_flow"]), "entry": F.col("__entry")["entry"], "ordinal": best["__ordinal"], "detector": best["__detector"]}
    return group.select(*keys, *((own[c] if c in own else best[c]).alias(c) for c in rest), others.alias("also_detected_by"), (F.col("__n") - 1).cast("int").alias("merged"))


def scope(findings: DataFrame, baseline: DataFrame, covered: DataFrame, spans: DataFrame, known: DataFrame, synthetic: tuple[str, ...] = ("pr:title", "pr:body")) -> DataFrame:
    """findings with introduced and scope_reason, by the first that applies.

    Synthetic surface: introduced. Fingerprint in the baseline: pre-existing. Path covered by the baseline: introduced. Path with
    touched spans: introduced if one overlaps [start_line, end_line]. Path known to the change without spans: introduced.
    Anything else: pre-existing. baseline: fingerprint; covered and known: path; spans: path, start, end. Each of these
    has a run_id too and counts for that run alone, or it has none and counts for all runs (one baseline of one tree).
    """
    out = findings

    def by(side: DataFrame, key: str, column: str, name: str, *more: Column) -> DataFrame:
        """out joined with one row for each (run and) key of side."""
        keys = ["run_id", key] if "run_id" in side.columns else [key]
        one = side.groupBy(*(F.col(k).alias(f"__{name}_{k}") for k in keys)).agg(*(more or (F.lit(True).alias(f"__{name}"),)))
        on = F.col(column) == F.col(f"__{name}_{key}")
        if len(keys) == 2:
            on = on & F.col("run_id").eqNullSafe(F.col(f"__{name}_run_id"))
        return out.join(one, on, "left")

    out = by(baseline, "fingerprint", "fingerprint", "hit")
    out = by(covered, "path", "file", "cov")
    out = by(spans, "path", "file", "spans", F.collect_list(F.struct("start", "end")).alias("__spans"))  # few spans in a file
    out = by(known, "path", "file", "kno")
    overlap = F.exists("__spans", lambda s: (s["start"] <= F.col("end_line")) & (F.col("start_line") <= s["end"]))
    reason = first_precedence(
        [(F.col("file").isin(*synthetic), "synthetic"), (F.col("__hit"), "baseline"), (F.col("__cov"), "new_in_covered"), (overlap, "in_hunk"), (F.col("__spans").isNotNull(), "outside_hunks"), (F.col("__kno"), "known_path")],
        "untouched",
    )
    return out.withColumn("scope_reason", reason).withColumn("introduced_by_pr", F.col("scope_reason").isin("synthetic", "new_in_covered", "in_hunk", "known_path")).select(*findings.columns, *(c for c in ("scope_reason", "introduced_by_pr") if c not in findings.columns))


def problem(lines: Column) -> Column:
    """The first reason why a finding is invalid, or null; `lines` is its file's number of lines, null if unknown."""
    return (
        F.when(F.coalesce(F.col("file"), F.lit("")) == "", "no file")
        .when(F.col("start_line") < 1, "line below 1")
        .when(F.col("end_line") < F.col("start_line"), "ends before it starts")
        .when(lines.isNotNull() & (F.col("start_line") > lines), "beyond the file")
        .when(F.size("evidence") == 0, "no evidence")
    )


def gate_triggers(findings: DataFrame, floor: str = T.GATE_FLOOR, confidence: int = T.GATE_CONFIDENCE) -> DataFrame:
    """Findings that flag a change: introduced, validated, at the severity floor and the confidence floor or above."""
    return findings.where(F.col("introduced_by_pr") & (F.col("status") == "validated") & (T.severity_rank(F.col("severity")) >= T.SEVERITIES.index(floor)) & (F.col("confidence") >= confidence))


def verdicts(runs: DataFrame, findings: DataFrame, **floors: object) -> DataFrame:
    """run_id, triggers, verdict of every run, those without findings included."""
    n = gate_triggers(findings, **floors).groupBy("run_id").agg(F.count("*").alias("triggers"))
    return runs.select("run_id").distinct().join(n, "run_id", "left").select("run_id", F.coalesce("triggers", F.lit(0)).alias("triggers"), F.when(F.col("triggers") > 0, "flagged").otherwise("approved").alias("verdict"))


def multi_counts(findings: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """dimension, value, n: one-dimensional counts and the total, in one pass with grouping sets."""
    sets = [F.col(d).cast("string").alias(d) for d in dimensions]
    total = findings.select(*sets).groupingSets([[], *[[F.col(d)] for d in dimensions]], *[F.col(d) for d in dimensions]).agg(F.count("*").alias("n"), F.grouping_id().alias("__g"))
    k = len(dimensions)
    name, value = F.lit("total"), F.lit(None).cast("string")
    for i, d in enumerate(dimensions):
        here = F.col("__g") == (1 << k) - 1 - (1 << (k - 1 - i))
        name, value = F.when(here, d).otherwise(name), F.when(here, F.col(d)).otherwise(value)
    return total.select(name.alias("dimension"), value.alias("value"), "n")


def penalized(findings: DataFrame, flagged: DataFrame, run_flagged: Column, detector: str = "agent") -> DataFrame:
    """Agent findings of flagged files (all, if the run itself is flagged) lose TRUST_PENALTY confidence, to 0 at least."""
    f = flagged.select(F.col("path").alias("__fp")).distinct()
    hit = (F.col("detector") == detector) & (F.col("__fp").isNotNull() | run_flagged)
    lower = F.greatest(F.lit(0), F.col("confidence") - T.TRUST_PENALTY)
    return findings.join(f, F.col("file") == F.col("__fp"), "left").withColumn("confidence", F.when(hit, lower).otherwise(F.col("confidence"))).drop("__fp")


def report_order() -> list[Column]:
    return [F.desc("severity_rank"), F.desc("confidence"), F.asc("file"), F.asc("start_line"), F.asc("ordinal")]


def numbered(findings: DataFrame) -> DataFrame:
    """Position of each finding in its run's report."""
    return findings.withColumn("position", F.row_number().over(Window.partitionBy("run_id").orderBy(*report_order())))
