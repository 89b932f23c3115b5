"""Scorecards, the comparison page and corpus pins: texts made of rows, written only where nothing stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riffle.functions import text as X


def counts_table(rows: DataFrame, key: str, n: str = "n") -> DataFrame:
    """key, n, share: counts with their share of the total, most first."""
    whole = F.sum(n).over(Window.partitionBy())  # a row for each value of key
    return rows.select(key, n, F.try_divide(F.col(n), whole).alias("share")).orderBy(F.desc(n), key)


def rendered(measures: DataFrame) -> DataFrame:
    """measures (…, num, den, value) with text: value (num/den), or n/a (num/den); a ratio is never shown without its denominator."""
    value = F.when(F.col("value").isNotNull(), F.format_string("%.3f", "value")).otherwise("n/a")  # a null would be written as text
    return measures.withColumn("text", F.concat(value, F.lit(" ("), F.col("num").cast("string"), F.lit("/"), F.col("den").cast("string"), F.lit(")")))


def scorecard(measures: DataFrame, notes: DataFrame) -> DataFrame:
    """run_id, markdown: a section for each, in order, with its measures as a table and its note before it.

    measures: run_id, section_no, section, measure_no, measure, num, den, value; notes: run_id, section, note. Pipes and line
    ends inside cells are made harmless.
    """
    safe = lambda c: F.regexp_replace(F.replace(c, F.lit("|"), F.lit("\\|")), "[\r\n]+", " ")
    row = F.concat(F.lit("| "), safe(F.col("measure")), F.lit(" | "), F.col("text"), F.lit(" |"))
    lines = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["t"]), "\n")
    parts = rendered(measures).groupBy("run_id", "section_no", "section").agg(lines(F.struct("measure_no", row.alias("t"))).alias("rows"))
    parts = parts.join(notes.select("run_id", "section", "note"), ["run_id", "section"], "left")
    part = F.concat(F.lit("## "), "section", F.lit("\n\n"), F.coalesce(F.concat("note", F.lit("\n\n")), F.lit("")), F.lit("| measure | value |\n|-|-|\n"), "rows", F.lit("\n"))
    whole = parts.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_no", part.alias("t")))), lambda x: x["t"]), "\n").alias("body"))
    return whole.select("run_id", F.concat(F.lit("# Scorecard "), "run_id", F.lit("\n\n"), "body").alias("markdown"))


def scope_note(arm: str) -> str:
    """What an arm's numbers are about."""
    if arm.startswith("llm"):
        return "Findings of a model that read the diff; there is no baseline pass, and nothing is suppressed."
    return "Findings of the pipeline, scoped against a baseline of the tree before the change."


def comparison_page(sections: DataFrame, title: str) -> DataFrame:
    """html: one page with a table for each section (section_no, section, arm, measure_no, measure, text); all text is escaped."""
    e = lambda c: X.html_escaped(F.col(c))
    cell = F.concat(F.lit("<td>"), e("text"), F.lit("</td>"))
    joined = lambda s, sep="": F.array_join(F.transform(F.array_sort(F.collect_list(s)), lambda x: x["t"]), sep)
    arms = sections.groupBy("section_no", "section", "arm").agg(joined(F.struct("measure_no", cell.alias("t"))).alias("cells"), joined(F.struct("measure_no", F.concat(F.lit("<th>"), e("measure"), F.lit("</th>")).alias("t"))).alias("heads"))
    row = F.concat(F.lit("<tr><th>"), e("arm"), F.lit("</th>"), "cells", F.lit("</tr>"))
    tables = arms.groupBy("section_no", "section").agg(joined(F.struct("arm", row.alias("t"))).alias("rows"), F.max("heads").alias("heads"))
    part = F.concat(F.lit("<h2>"), e("section"), F.lit("</h2><table><tr><th></th>"), "heads", F.lit("</tr>"), "rows", F.lit("</table>"))
    head = F.concat(F.lit("<!doctype html><html><head><meta charset='utf-8'><title>"), X.html_escaped(F.lit(title)), F.lit("</title></head><body><h1>"), X.html_escaped(F.lit(title)), F.lit("</h1>"))
    return tables.agg(joined(F.struct("section_no", part.alias("t"))).alias("body")).select(F.concat(head, "body", F.lit("</body></html>")).alias("html"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def collisions(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths where something stands: asked before a long run, so that it doesn't fail at its end."""
    return [p for p in paths if _exists(spark, p)]


def write_scorecard(card: DataFrame, dump: DataFrame, path: str) -> None:
    """Markdown as text and the dump it was made from as JSON, below a folder; neither replaces what stands there."""
    if found := collisions(card.sparkSession, [f"{path}/scorecard", f"{path}/dump"]):
        raise FileExistsError(f"there already: {found}")
    card.select("markdown").coalesce(1).write.mode("errorifexists").text(f"{path}/scorecard")  # one text
    dump.write.mode("errorifexists").json(f"{path}/dump")


def pin_corpus(cases: DataFrame, criteria: dict[str, str], path: str) -> None:
    """Write the cases of a corpus with the criteria that they were chosen by; a corpus without criteria is refused."""
    if not criteria or not all(v.strip() for v in criteria.values()):
        raise ValueError("a corpus needs the criteria of its selection")
    said = F.create_map(*[F.lit(x) for kv in sorted(criteria.items()) for x in kv])
    cases.withColumn("criteria", said).write.mode("errorifexists").json(path)


def curation_log(decisions: DataFrame) -> DataFrame:
    """line: what became of each candidate (id, kept, reason), those kept first, by id."""
    verb = F.when(F.col("kept"), "kept").otherwise("left out")
    return decisions.orderBy(F.desc("kept"), "id").select(F.concat_ws(" ", "id", verb, F.concat(F.lit("("), F.coalesce("reason", F.lit("no reason")), F.lit(")"))).alias("line"))
