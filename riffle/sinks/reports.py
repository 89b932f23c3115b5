"""Findings as SARIF and Markdown, and run artifacts as partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riffle.functions import text as X
from riffle.functions.tables import lookup

# Report levels by severity.
LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
FENCE = "```"


def sarif(findings: DataFrame) -> DataFrame:
    """run_id and sarif: one document for each run, its rules in order of first use."""
    result = F.struct(
        F.col("internal").alias("ruleId"),
        lookup(F.col("severity"), LEVELS).alias("level"),
        F.struct(F.concat("title", F.coalesce(F.concat(F.lit(": "), F.get("evidence", F.lit(0))["why"]), F.lit(""))).alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine")).alias("region")).alias("physicalLocation"))).alias("locations"),
        F.struct(F.col("fingerprint").alias("fingerprint/v1")).alias("partialFingerprints"),
        F.struct("severity", "confidence", "status", F.col("introduced_by_pr").alias("introducedByPr"), "detector").alias("properties"),
    )
    run = findings.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", result.alias("r")))).alias("all"))
    rules = F.transform(F.array_distinct(F.transform("all", lambda x: x["r"]["ruleId"])), lambda i: F.struct(i.alias("id")))
    driver = F.struct(F.lit("riffle").alias("name"), rules.alias("rules"))
    doc = F.struct(F.lit("2.1.0").alias("version"), F.array(F.struct(F.struct(driver.alias("driver")).alias("tool"), F.transform("all", lambda x: x["r"]).alias("results"))).alias("runs"))
    return run.select("run_id", F.to_json(doc).alias("sarif"))


def safe_code(text: Column) -> Column:
    """For a fenced block: fences inside are broken by a zero-width space."""
    return F.replace(text, F.lit(FENCE), F.lit("`​``"))


def markdown(findings: DataFrame) -> DataFrame:
    """run_id and markdown: introduced findings and pre-existing ones in sections of their own."""
    snippet = safe_code(F.coalesce(F.get("evidence", F.lit(0))["snippet"], F.lit("")))
    block = F.concat(F.lit("### ["), F.upper("severity"), F.lit("] "), F.col("title"), F.lit("\n\n`"), F.col("file"), F.lit(":"), F.col("start_line").cast("string"), F.lit(f"`\n\n{FENCE}\n"), snippet, F.lit(f"\n{FENCE}\n"))
    order = F.struct((-F.col("severity_rank")).alias("a"), (-F.col("confidence")).alias("b"), "file", "start_line", "ordinal", block.alias("block"))
    part = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, order))), lambda x: x["block"]), "\n")
    out = findings.groupBy("run_id").agg(part(F.col("introduced_by_pr")).alias("new"), part(~F.col("introduced_by_pr")).alias("old"), F.count("*").alias("n"))
    return out.select("run_id", F.concat(F.lit("# Review\n\n## Introduced\n\n"), "new", F.lit("\n## Pre-existing\n\n"), "old").alias("markdown"))


def comparison_rows(measures: DataFrame) -> DataFrame:
    """arm, html: a table row for each arm with its measures as value (num/den), all text escaped."""
    cell = F.concat(F.lit("<td>"), X.html_escaped(F.concat_ws(" ", F.when(F.col("value").isNotNull(), F.format_string("%.3f", "value")).otherwise("n/a"), F.format_string("(%d/%d)", "num", "den"))), F.lit("</td>"))
    cells = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("measure", cell.alias("c")))), lambda x: x["c"]), "")
    return measures.groupBy("arm").agg(cells.alias("cells")).select("arm", F.concat(F.lit("<tr><th>"), X.html_escaped(F.col("arm")), F.lit("</th>"), "cells", F.lit("</tr>")).alias("html"))


def write_artifact(df: DataFrame, root: str, name: str, overwrite: bool = False) -> None:
    """A run artifact, partitioned by run_id; refuses to replace one unless told to."""
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("run_id").parquet(f"{root}/{name}")


#: Artifacts of a run, each a table partitioned by run_id.
ARTIFACTS = ("manifest", "dep_deltas", "changeset", "groups", "bundles", "findings", "detectors", "rejected")


def write_run(result: object, root: str, telemetry: DataFrame | None = None, profile_ref: DataFrame | None = None) -> None:
    """All artifacts of a review below a folder, with SARIF and Markdown, telemetry and the profile (run_id, repo, version) that it used."""
    for name in ARTIFACTS:
        write_artifact(getattr(result, name), root, name)
    write_artifact(sarif(result.findings), root, "sarif")
    write_artifact(markdown(result.findings), root, "markdown")
    for name, table in (("telemetry", telemetry), ("profile_ref", profile_ref)):
        if table is not None:
            write_artifact(table, root, name)
