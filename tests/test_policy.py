from pyspark.sql import functions as F
from riffle.operators import policy


def test_unknown_tools_fail_closed(spark):
    personas = spark.createDataFrame([("reader", "grep"), ("reader", "odd"), ("fixer", "odd")], "persona string, tool string")
    classes = spark.createDataFrame([("grep", "read")], "tool string, class string")
    forbidden = spark.createDataFrame([("reader", "source")], "persona string, class string")
    audit = policy.audit_tools(personas, classes, forbidden)
    assert {(r.persona, r.tool): r.permitted for r in audit.collect()} == {("reader", "grep"): True, ("reader", "odd"): False, ("fixer", "odd"): True}
    assert {r.persona: r.tools for r in policy.permitted_tools(audit).collect()} == {"reader": ["grep"], "fixer": ["odd"]}


def test_large_payloads_are_refused(spark):
    row = spark.range(1).select(policy.refusal(F.lit("x")).alias("a"), policy.refusal(F.expr("repeat('x', 600001)")).alias("b")).first()
    assert row.a is None and "600001" in row.b
