from pyspark.sql import functions as F
from riffle.operators import evaluate as ev
from riffle.sources import diff

FIX = """diff --git a/app/a.py b/app/a.py
--- a/app/a.py
+++ b/app/a.py
@@ -1,6 +1,4 @@
-import os
 x = 1
-bad(1)
-bad(2)
+good()
 y = 2
diff --git a/app/b.py b/app/b.py
--- a/app/b.py
+++ b/app/b.py
@@ -10,2 +10,3 @@
 def f():
+    check()
     run()
diff --git a/tests/test_a.py b/tests/test_a.py
--- a/tests/test_a.py
+++ b/tests/test_a.py
@@ -1 +1 @@
-old()
+new()
"""


def test_ground_truth(spark):
    d = diff.read_diffs(spark.createDataFrame([("c", FIX)], "run_id string, text string"))
    got = {r.file: [tuple(s) for s in r.spans] for r in ev.ground_truth(d.files, d.hunks, d.lines).collect()}
    assert got == {"app/a.py": [(3, 4)], "app/b.py": [(10, 11)]}


def test_negative_measures_and_ablation(spark):
    cases = spark.createDataFrame([("a", 2, 3), ("b", 0, 1), ("c", 0, 0)], "case_id string, endpoints int, skipped int")
    f = spark.createDataFrame([("a", "high", "BAC-MISSING-AUTHZ", True), ("a", "low", "X", True), ("b", "low", "X", False)], "case_id string, severity string, internal string, introduced_by_pr boolean")
    m = {r.measure: (r.num, r.den, r.value) for r in ev.negative_measures(cases, f).collect()}
    assert m["fp_per_pr"][:2] == (2, 3) and m["clean_rate"][:2] == (2, 3) and m["suppression"][:2] == (4, 6) and m["missing_authz_per_endpoint"][:2] == (1, 2) and m["fp_per_endpoint_pr"][:2] == (2, 1)
    assert all(r.value is None for r in ev.negative_measures(cases.limit(0), f.limit(0)).collect())
    truths = spark.createDataFrame([("a", "x.py"), ("a", "y.py")], "case_id string, gt_file string")
    row = ev.ablation(spark.createDataFrame([("a", "x.py"), ("b", "y.py")], "case_id string, path string"), truths).first()
    assert (row.gt_files, row.dropped_gt, row.recall_after_filter) == (2, 1, 0.5)


def test_scope_index_and_caps(spark):
    truths = spark.createDataFrame([(1, "78"), (2, "CWE-77"), (3, "CWE-22"), (4, "CWE-9999")], "i int, cwe string")
    assert {r.i for r in ev.in_scope(truths, spark.createDataFrame([("CWE-78",), ("9999",)], "cwe string")).collect()} == {1, 2, 4}
    tax = spark.createDataFrame([(0, "A", ["CWE-1", "CWE-2"]), (1, "B", ["CWE-2"])], "ordinal int, internal string, cwe array<string>")
    assert {r.cwe: r.internal for r in ev.cwe_index(tax).collect()} == {"CWE-1": "A", "CWE-2": "B"}
    rows = spark.createDataFrame([("r", i, f"c{i // 2}", i % 3 > 0) for i in range(10)], "repo string, o int, commit string, ok boolean")
    got = ev.capped_per_key(rows, "repo", "o", F.col("ok"), "commit", 3).orderBy("o").collect()
    assert [r.o for r in got] == [1, 2, 4]
    a, b = (spark.createDataFrame([(x,) for x in s], "case_id string") for s in ("ab", "bc"))
    assert {(r.case_id, r.side) for r in ev.case_set_difference(a, b).collect()} == {("a", "missing"), ("c", "added")}
