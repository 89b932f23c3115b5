"""Limits and permissions: payload ceilings and the audit of tools, which fails closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: characters of a payload beyond which a case is refused, with a note.
MOST_PAYLOAD = 600_000


def refusal(payload: Column) -> Column:
    """The note of a payload that is too large, else null."""
    return F.when(F.length(payload) > MOST_PAYLOAD, F.concat(F.lit("payload of "), F.length(payload).cast("string"), F.lit(f" characters exceeds {MOST_PAYLOAD}")))


def audit_tools(personas: DataFrame, classes: DataFrame, forbidden: DataFrame) -> DataFrame:
    """persona, tool, class, permitted. A tool without a class counts as one that changes sources; forbidden: persona, class."""
    known = personas.join(classes.select("tool", "class"), "tool", "left").withColumn("class", F.coalesce("class", F.lit("source")))
    no = forbidden.select("persona", "class").distinct().withColumn("__no", F.lit(True))
    return known.join(no, ["persona", "class"], "left").select("persona", "tool", "class", F.col("__no").isNull().alias("permitted"))


def permitted_tools(audit: DataFrame) -> DataFrame:
    """persona and its permitted tools, sorted."""
    return audit.groupBy("persona").agg(F.array_sort(F.collect_set(F.when(F.col("permitted"), F.col("tool")))).alias("tools"))
