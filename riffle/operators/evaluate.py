"""Evaluation corpora: ground truth from fixes, negative measures, ablation, ceilings, comparability, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riffle.functions import tables as T
from riffle.functions import text as X
from riffle.operators.metrics import rate
from riffle.operators.windows import islands

# Paths whose fixes are no ground truth, and lines that only support a fix.
EXCLUDED = r"(?i)(^|/)(tests?|testing|docs?|examples?|benchmarks?)/|(^|/)(test_[^/]+|[^/]+_test|conftest|setup|noxfile|changelog|changes)\.py$"
SUPPORTING = r"(?i)^\s*((import|from)\s+\S.*|_*version(_info)?_*\s*[:=].*|#.*)?$"


def ground_truth(files: DataFrame, hunks: DataFrame, lines: DataFrame) -> DataFrame:
    """case_id, file, spans: where a fix took lines out of Python sources, in the old file.

    Runs of removed lines count unless all of a run only supports the fix. A file with additions alone gives the old ranges of
    its hunks, but for hunks that only add supporting lines. Added and binary files are skipped; a renamed one goes by its old path.
    """
    use = files.where(~F.col("binary") & (F.col("change") != "added")).select(F.col("run_id").alias("case_id"), "file_no", F.coalesce("previous_path", "path").alias("file"))
    use = use.where(F.endswith("file", F.lit(".py")) & ~F.col("file").rlike(EXCLUDED))
    body = lines.withColumnRenamed("run_id", "case_id").join(use, ["case_id", "file_no"])
    removed = body.where("tag = '-'")
    runs = islands(removed, ["case_id", "file"], "old_ln")
    real = removed.where(~F.col("text").rlike(SUPPORTING)).select(F.col("case_id").alias("__c"), F.col("file").alias("__f"), F.col("old_ln").alias("__at"))
    kept = runs.join(real, (F.col("case_id") == F.col("__c")) & (F.col("file") == F.col("__f")) & F.col("__at").between(F.col("start"), F.col("end")), "left_semi")
    adds = body.where(F.col("tag") == "+").groupBy("case_id", "file_no", "hunk_no").agg(F.max(~F.col("text").rlike(SUPPORTING)).alias("real")).where("real")
    places = hunks.withColumnRenamed("run_id", "case_id").where("old_len > 0").join(use, ["case_id", "file_no"]).join(removed.select("case_id", "file").distinct(), ["case_id", "file"], "left_anti")
    inserted = places.join(adds, ["case_id", "file_no", "hunk_no"], "left_semi").select("case_id", "file", F.col("old_start").alias("start"), (F.col("old_start") + F.col("old_len") - 1).alias("end"))
    spans = kept.select("case_id", "file", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")).unionByName(inserted)
    return spans.groupBy("case_id", "file").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def negative_measures(cases: DataFrame, findings: DataFrame) -> DataFrame:
    """measure, num, den, value over unlabelled cases (case_id, endpoints, skipped): every introduced finding is a false positive."""
    per = findings.where("introduced_by_pr").groupBy("case_id").agg(F.count("*").alias("fp"), F.count(F.when(F.col("severity").isin("high", "critical"), 1)).alias("gate"), F.count(F.when(F.col("internal") == "BAC-MISSING-AUTHZ", 1)).alias("authz"))
    c = cases.join(per, "case_id", "left").na.fill(0, ["fp", "gate", "authz", "endpoints", "skipped"])
    n = lambda cond: F.count(F.when(cond, 1))
    one = c.agg(F.count("*").alias("cases"), *(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("fp", "gate", "authz", "endpoints", "skipped")), n(F.col("fp") == 0).alias("clean"), n(F.col("endpoints") > 0).alias("ep_cases"), F.coalesce(F.sum(F.when(F.col("endpoints") > 0, F.col("fp"))), F.lit(0)).alias("ep_fp"))
    entry = lambda name, a, b: F.struct(F.lit(name).alias("measure"), F.expr(a).cast("long").alias("num"), F.expr(b).cast("long").alias("den"))
    table = F.array(
        entry("fp_per_pr", "fp", "cases"), entry("gate_relevant_per_pr", "gate", "cases"), entry("clean_rate", "clean", "cases"), entry("suppression", "skipped", "fp + skipped"),
        entry("fp_per_pr_unscoped", "fp + skipped", "cases"), entry("fp_per_endpoint_pr", "ep_fp", "ep_cases"), entry("missing_authz_per_endpoint", "authz", "endpoints"),
    )
    return one.select(F.explode(table).alias("m")).select("m.*").withColumn("value", F.try_divide("num", "den"))


def reached_the_right_file(tp: Column, near: Column, overlap: Column, file_only: Column, fn: Column) -> dict[str, Column]:
    """Mixed by design: findings and missed rows that the baseline explains, over findings and missed rows."""
    return rate(tp + near + overlap + file_only, tp + near + fn)


def ablation(dropped: DataFrame, truths: DataFrame) -> DataFrame:
    """gt_files, dropped_gt, recall_after_filter: true files that the filter dropped."""
    gt = truths.select("case_id", F.col("gt_file").alias("path")).distinct()
    lost = gt.join(dropped.select("case_id", "path").distinct().withColumn("__d", F.lit(True)), ["case_id", "path"], "left")
    one = lost.agg(F.count("*").alias("gt_files"), F.count("__d").alias("dropped_gt"))
    return one.withColumn("recall_after_filter", F.try_divide(F.col("gt_files") - F.col("dropped_gt"), F.col("gt_files")))


def in_scope(truths: DataFrame, emittable: DataFrame) -> DataFrame:
    """True rows whose CWE, or one of its group, some detector emits (column cwe)."""
    e = emittable.select(X.normalized_cwe(F.col("cwe")).alias("e")).distinct().withColumn("g", T.cwe_group(F.col("e")))
    t = truths.withColumn("__c", X.normalized_cwe(F.col("cwe"))).withColumn("__g", T.cwe_group(F.col("__c")))
    exact = t.join(e.select("e"), F.col("__c") == F.col("e"), "left_semi")
    related = t.join(e.select("e"), F.col("__c") == F.col("e"), "left_anti").join(e.where("g is not null").select("g").distinct(), F.col("__g") == F.col("g"), "left_semi")
    return exact.unionByName(related).drop("__c", "__g")


def cwe_index(taxonomy: DataFrame) -> DataFrame:
    """cwe, internal: the id that lists a CWE in the foremost place, ties by the table's order. taxonomy: ordinal, internal, cwe (array)."""
    each = taxonomy.select("ordinal", "internal", F.posexplode("cwe").alias("pos", "c"))
    return each.groupBy(X.normalized_cwe(F.col("c")).alias("cwe")).agg(F.min_by("internal", F.struct("pos", "ordinal")).alias("internal"))


def case_set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """case_id, side: cases of one run alone; empty if two runs can be compared."""
    left, right = a.select("case_id").distinct(), b.select("case_id").distinct()
    return left.subtract(right).withColumn("side", F.lit("missing")).union(right.subtract(left).withColumn("side", F.lit("added")))


def dump_slice(findings: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a stored run keeps: all findings of labelled cases, introduced ones of others; and the number of pre-existing ones."""
    f = findings.join(cases.select("case_id", "labelled"), "case_id")
    return f.where("labelled or introduced_by_pr").drop("labelled"), f.where("not introduced_by_pr").groupBy("case_id").agg(F.count("*").alias("pre_existing"))


def capped_per_key(rows: DataFrame, key: str, order: str, accepted: Column, distinct: str, cap: int) -> DataFrame:
    """The first `cap` accepted rows of each key by order, with distinct values of one column: acceptance is decided first, so that rejects use up nothing."""
    ok = rows.where(accepted)
    first = ok.withColumn("__n", F.row_number().over(Window.partitionBy(key, distinct).orderBy(order))).where("__n = 1").drop("__n")
    return first.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("__k") <= cap).drop("__k")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """what, name, n: nodes by kind and edges by relation."""
    a = nodes.groupBy(F.col("kind").alias("name")).agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "name", "n")
    return a.union(edges.groupBy(F.col("relation").alias("name")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "name", "n"))


def splice_violations(nodes: DataFrame, edges: DataFrame, evicted: DataFrame) -> DataFrame:
    """Edges that still lead to or from nodes of evicted paths after a splice; there must be none."""
    gone = nodes.join(evicted.select(F.col("path").alias("file")).distinct(), "file", "left_semi").select("id")
    end = lambda c: edges.join(gone.withColumnRenamed("id", c), c, "left_semi").select(*edges.columns)
    return end("src").union(end("dst")).distinct()


def permission_checks(guards: DataFrame) -> DataFrame:
    """name, its first file, line and kind, and all that it grants."""
    return guards.groupBy("name").agg(F.min_by(F.struct("file", "line", "kind"), "ordinal").alias("f"), F.array_sort(F.collect_set("grants")).alias("grants")).select("name", "f.*", "grants")


def overlay(matrix: DataFrame, lifted: DataFrame) -> DataFrame:
    """matrix with the judgement columns of lifted rows of the same controller and file; enforcement outside its values is ignored."""
    allowed = F.when(F.col("__e").isin("enforced", "declared_not_enforced", "none"), F.col("__e"))
    right = lifted.select("controller", "file", F.col("enforcement").alias("__e"), F.col("auth_pattern").alias("__a"))
    return matrix.join(right, ["controller", "file"], "left").withColumns({"enforcement": F.coalesce(allowed, F.col("enforcement")), "auth_pattern": F.coalesce("__a", "auth_pattern")}).drop("__e", "__a")
