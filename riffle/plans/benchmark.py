"""Benchmark runs: all cases of a corpus as one plan, stored as versioned dumps, and scored again from the dump alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle.operators import evaluate, gate, metrics
from riffle.plans.review import review
from riffle.storage import materialize

DUMP_VERSION = 2
FINDING = "case_id string, ordinal long, file string, start_line int, end_line int, cwe_ids array<string>, severity string, internal string, introduced_by_pr boolean"
TABLES = ("run", "cases", "findings", "truths", "detectors", "dropped")


def limited(cases: DataFrame, n: int | None) -> DataFrame:
    """The first n cases by id (all, without n): for a trial, never to be compared with a whole run."""
    return cases if n is None else cases.orderBy("case_id").limit(n)


def run_corpus(cases: DataFrame, cwe_of: DataFrame, **sides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings (FINDING) of all cases (case_id, diff) in one plan, and (case_id, error) of those that can't be read.

    A case is a run of the review, so that cases don't see each other's baselines or spans (sides: as in review(), with
    run_id). A case without a diff has an error row and no findings; the others are not held up by it. cwe_of: internal, cwe_ids.
    """
    errors = cases.where("diff is null or trim(diff) = ''").select("case_id", F.lit("no diff").alias("error"))
    good = cases.join(errors, "case_id", "left_anti").select(F.col("case_id").alias("run_id"), F.col("diff").alias("text"))
    found = review(good, **sides).findings
    rows = found.join(cwe_of, "internal", "left").select(F.col("run_id").alias("case_id"), "ordinal", "file", "start_line", "end_line", F.coalesce("cwe_ids", F.array().cast("array<string>")).alias("cwe_ids"), "severity", "internal", "introduced_by_pr")
    return rows, errors


def save_run(tables: dict[str, DataFrame], path: str) -> None:
    """A dump: its tables (TABLES) below a folder, of which none may be there yet; `run` gets the version."""
    if missing := set(TABLES) - set(tables):
        raise ValueError(f"a dump lacks {sorted(missing)}")
    for name in TABLES:
        df = tables[name].withColumn("dump_version", F.lit(DUMP_VERSION)) if name == "run" else tables[name]
        df.write.mode("errorifexists").parquet(f"{path}/{name}")


def load_run(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a dump; one of another version is refused, as its fields would be compared as if they were missing."""
    out = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
    versions = {r[0] for r in out["run"].select("dump_version").collect()}  # one row
    if versions != {DUMP_VERSION}:
        raise ValueError(f"a dump of version {sorted(versions, key=str)}, not {DUMP_VERSION}: run it again")
    return out


def rescore(tables: dict[str, DataFrame], emittable: DataFrame) -> dict[str, DataFrame]:
    """Scores of a stored run, made from its tables alone: verdicts, rows, in_scope, scores (by case), snapshot.

    cases: case_id, labelled, pair_id, side, error, skipped; truths: case_id, gt_ordinal, cwe, gt_file, spans; emittable: cwe.
    """
    cases, findings, truths = tables["cases"], tables["findings"], tables["truths"]
    ok = cases.where("error is null")
    live = findings.join(ok.select("case_id"), "case_id", "left_semi")
    # each is read by several measures, and written once
    verdicts, _ = materialize(metrics.score(live, truths.join(ok.select("case_id"), "case_id", "left_semi")), "verdicts")
    rows, _ = materialize(metrics.truth_rows(live, truths.join(ok.select("case_id"), "case_id", "left_semi")), "truth-rows")
    scope = evaluate.in_scope(truths, emittable).select("case_id", "gt_ordinal")
    mine = verdicts.join(scope.withColumn("__in", F.lit(True)), ["case_id", "gt_ordinal"], "left")
    n = lambda c: F.count(F.when(c, 1))
    hit = F.col("label") == "tp"
    per = mine.groupBy("case_id").agg(n(hit).alias("true_positives"), n(hit & F.col("__in")).alias("in_scope_true_positives"), n(F.col("label") == "fp").alias("__fp"), F.count("*").alias("scored_findings"), n(F.col("severity").isin("high", "critical")).alias("gate_relevant"))
    counts = ["true_positives", "in_scope_true_positives", "__fp", "scored_findings", "gate_relevant"]
    scores = ok.join(per, "case_id", "left").na.fill(0, counts)
    # without labels every introduced finding is a false positive
    scores = scores.withColumn("false_positives", F.when(F.col("labelled"), F.col("__fp")).otherwise(F.col("scored_findings"))).drop("__fp")
    scores, _ = materialize(scores, "scores")
    snap = gate.snapshot(cases, tables["detectors"], scores, tables["dropped"])
    return {"verdicts": verdicts, "rows": rows, "in_scope": scope, "scores": scores, "snapshot": snap}


def load_corpus(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Cases that sinks.scorecards.pin_corpus wrote, without the criteria; a corpus that has none is refused."""
    cases = spark.read.schema(f"{schema}, criteria map<string,string>").json(path)
    if cases.where("criteria is null or size(criteria) = 0").limit(1).count():
        raise ValueError("a corpus without the criteria of its selection")
    return cases.drop("criteria")


CAPTURE_VERSION = 1


def capture(bundles: DataFrame, path: str) -> None:
    """Context bundles (run_id, group_id, …) as they were, so that a model can be asked again about the same context."""
    bundles.withColumn("capture_version", F.lit(CAPTURE_VERSION)).write.mode("errorifexists").parquet(path)


def replay(spark: SparkSession, path: str, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captured bundles of the given cases (case_id), and the cases that have none; a capture of another version is refused."""
    kept = spark.read.parquet(path)
    if kept.where(F.col("capture_version") != CAPTURE_VERSION).limit(1).count():
        raise ValueError("a capture of another version")
    wanted = cases.select(F.col("case_id").alias("run_id")).distinct()
    found = kept.drop("capture_version").join(wanted, "run_id", "left_semi")
    return found, wanted.join(found.select("run_id"), "run_id", "left_anti").select(F.col("run_id").alias("case_id"))


def measures(scored: dict[str, DataFrame]) -> DataFrame:
    """measure, num, den, value of a rescored run: labelled, in scope, pairs, and unlabelled cases."""
    scores, verdicts = scored["scores"], scored["verdicts"]
    live = scores.where("labelled").select("case_id")
    controls = verdicts.join(scores.where("not labelled").select("case_id"), "case_id", "left_semi")
    own = metrics.labelled_measures(verdicts.join(live, "case_id", "left_semi"), scored["rows"], controls)
    named = lambda df, name: df.select(F.lit(name).alias("measure"), "num", "den", "value")
    one = scores.where("not labelled").agg(F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("false_positives", "gate_relevant")), F.count(F.when(F.col("false_positives") == 0, 1)).alias("clean"))
    each = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(c).cast("long").alias("num"), F.col("n").alias("den")) for m, c in (("fp_per_case", "false_positives"), ("gate_relevant_per_case", "gate_relevant"), ("clean_rate", "clean"))])
    rest = one.select(F.explode(each).alias("m")).select("m.*").withColumn("value", F.try_divide("num", "den"))
    return own.unionByName(named(gate.in_scope_recall(scored["rows"], scored["in_scope"]), "in_scope_recall")).unionByName(named(gate.discriminated(scores), "pair_discrimination")).unionByName(rest)


def compare(before: dict[str, DataFrame], after: dict[str, DataFrame], emittable: DataFrame, allowed: int = gate.ALLOWED_NEW) -> tuple[DataFrame, DataFrame]:
    """Checks and the verdict of the gate between two stored runs."""
    old, new = rescore(before, emittable), rescore(after, emittable)
    found = gate.checks(old["snapshot"], new["snapshot"], allowed)
    return found, gate.gate_verdict(found, gate.incomparable(before["run"], after["run"], old["scores"], new["scores"]))
