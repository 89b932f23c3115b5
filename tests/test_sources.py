import json

from riffle.sources import deps, diff, reports

DIFF = """diff --git a/app/main.py b/app/main.py
index 1..2 100644
--- a/app/main.py
+++ b/app/main.py
@@ -1,3 +1,4 @@ def main():
 import os
-x = 1
+x = 2
+y = 3
 z = 4
\\ No newline at end of file
@@ -10 +11 @@
-old
+new
diff --git a/old.txt b/new.txt
similarity index 90%
rename from old.txt
rename to new.txt
diff --git a/gone.py b/gone.py
deleted file mode 100644
--- a/gone.py
+++ /dev/null
@@ -1,2 +0,0 @@
-a
-b
diff --git a/poetry.lock b/poetry.lock
--- a/poetry.lock
+++ b/poetry.lock
@@ -1,6 +1,6 @@
 name = "Flask_X"
-version = "1.0"
+version = "1.1"
 [[package]]
 name = "kept"
 version = "2"
@@ -20,2 +20,4 @@
+name = "fresh"
+version = "0.1"
+version = "9.9"
 version = "dangling"
diff --git a/bad.c b/bad.c
@@ broken
+ignored
@@ -1 +1 @@
+ignored too
"""


def parsed(spark):
    return diff.read_diffs(spark.createDataFrame([("r", DIFF), ("none", None), ("empty", "")], "run_id string, text string"))


def test_files_and_hunks(spark):
    d = parsed(spark)
    files = {r.path: (r.change, r.previous_path) for r in d.files.collect()}
    assert files == {"app/main.py": ("modified", None), "new.txt": ("renamed", "old.txt"), "gone.py": ("deleted", None), "poetry.lock": ("modified", None), "bad.c": ("modified", None)}
    hunks = sorted((r.path, r.hunk_no, r.old_start, r.old_len, r.new_start, r.new_len, r.header) for r in d.hunks.collect())
    assert hunks[0] == ("app/main.py", 1, 1, 3, 1, 4, "def main():") and hunks[1] == ("app/main.py", 2, 10, 1, 11, 1, "")
    assert not [h for h in hunks if h[0] == "bad.c"]


def test_line_numbers_and_sides(spark):
    d = parsed(spark)
    main = sorted((r.hunk_no, r.seq, r.tag, r.old_ln, r.new_ln, r.text) for r in d.lines.where("path = 'app/main.py'").collect())
    assert [x[2:] for x in main] == [(" ", 1, 1, "import os"), ("-", 2, None, "x = 1"), ("+", None, 2, "x = 2"), ("+", None, 3, "y = 3"), (" ", 3, 4, "z = 4"), ("-", 10, None, "old"), ("+", None, 11, "new")]
    old = [r.text for r in diff.side(d.lines.where("path = 'app/main.py' and hunk_no = 1"), "old").orderBy("seq").collect()]
    assert old == ["import os", "x = 1", "z = 4"]
    assert {(r.path, r.start, r.end) for r in diff.touched_spans(d).collect()} == {("app/main.py", 1, 4), ("app/main.py", 11, 11), ("poetry.lock", 1, 6), ("poetry.lock", 20, 23)}


def test_manifest_flags_and_totals(spark):
    d = parsed(spark)
    rows = {r.path: r for r in diff.manifest(d).collect()}
    assert rows["app/main.py"].lang == "python" and rows["poetry.lock"].is_lockfile and not rows["app/main.py"].is_test
    assert (rows["app/main.py"].additions, rows["app/main.py"].deletions) == (3, 2)
    total = diff.totals(diff.manifest(d), d).first()
    assert (total.files, total.hunks, total.oversize) == (5, 5, False)


def test_dependency_deltas(spark):
    got = {(r.name, r.kind, r.old, r.new) for r in deps.dep_deltas(parsed(spark).lines).collect()}
    assert got == {("flask-x", "changed", "1.0", "1.1"), ("fresh", "added", None, "0.1")}


def _added(spark, path, lines):
    body = "".join(f"+{x}\n" for x in lines)
    text = f"diff --git a/{path} b/{path}\n--- a/{path}\n+++ b/{path}\n@@ -0,0 +1,{len(lines)} @@\n{body}"
    d = diff.read_diffs(spark.createDataFrame([("r", text)], "run_id string, text string"))
    return {r["name"]: r["new"] for r in deps.dep_deltas(d.lines).collect()}


def test_dependency_formats(spark):
    cases = {
        "requirements.txt": (["Flask==2.0 # web", "-r other.txt", "uvicorn[std]>=0.1; x", "plain"], {"flask": "2.0", "uvicorn": "0.1", "plain": ""}),
        "pyproject.toml": (["[project]", 'name = "x"', "dependencies = [", '  "flask>=2.0",', "[tool.poetry.dependencies]", 'python = "^3"', 'requests = "^2.1"'], {"flask": "2.0", "requests": "^2.1"}),
        "package.json": (['"name": "app",', '"left-pad": "^1.3.0",', '"build": "tsc"', '"local": "file:../x"'], {"left-pad": "^1.3.0", "local": "file:../x"}),
        "go.mod": (["require github.com/a/b v1.2.3 // indirect", "go 1.20"], {"github.com/a/b": "v1.2.3"}),
        "go.sum": (["github.com/a/b v1.2.3/go.mod h1:x"], {"github.com/a/b": "v1.2.3"}),
        "Cargo.lock": (["version = 3", 'name = "serde"', 'version = "1.0"'], {"serde": "1.0"}),
        "Pipfile.lock": (['"flask": {', '"version": "==2.0.1"'], {"flask": "2.0.1"}),
        "package-lock.json": (['"packages": {', '"node_modules/a/node_modules/b": {', '"version": "3.1"'], {"b": "3.1"}),
        "yarn.lock": (['"@babel/core@^7.0.0":', '  version "7.1.0"', "x@1, x@2:", '  version "2.0"'], {"@babel/core": "7.1.0", "x": "2.0"}),
        "composer.lock": (['"name": "monolog/monolog",', '"version": "1.25.0",', '"name": "Jordi Boggiano"'], {"monolog/monolog": "1.25.0"}),
        "Gemfile.lock": (["    actionpack (5.2.0)", "      activesupport (= 5.2.0)", "  rack (~> 2)"], {"actionpack": "5.2.0"}),
    }
    for path, (lines, want) in cases.items():
        assert _added(spark, path, lines) == want, path


def test_sarif(spark):
    doc = {"runs": [{"tool": {"driver": {"rules": [{"id": "r1", "defaultConfiguration": {"level": "error"}, "properties": {"security-severity": "9.1", "k": "rule"}}]}}, "results": [
        {"ruleId": "r1", "message": {"text": " hi "}, "properties": {"k": "own"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "file:///w/src/a.py"}, "region": {"startLine": 3, "snippet": {"text": "x"}}}}]},
        {"ruleIndex": 0, "level": "note"}, {"ruleIndex": 7}]}]}
    text = "banner\n" + json.dumps(doc)
    got = reports.read_sarif(spark.createDataFrame([("r", text), ("bad", "no json")], "run_id string, text string"), root="/w").orderBy("result_no").collect()
    assert [(r.rule_id, r.level, r.security_severity, r.path, r.start_line, r.end_line) for r in got] == [("r1", "error", 9.1, "src/a.py", 3, 3), ("r1", "note", 9.1, "", 0, 0), ("", "warning", None, "", 0, 0)]
    assert got[0].properties["k"] == "own" and got[0].message == "hi"


def test_osv(spark):
    doc = {"results": [{"source": {"path": "/w/requirements.txt"}, "packages": [
        {"package": {"name": "PyYAML", "version": "5.3"}, "groups": [{"max_severity": "9.8"}], "vulnerabilities": [
            {"id": "A", "aliases": ["CVE-2", "X"], "severity": [{"score": "CVSS:3"}], "database_specific": {"severity": "LOW"}, "affected": [{"package": {"name": "pyyaml"}, "ranges": [{"events": [{"fixed": "5.4"}, {"fixed": "5.10"}]}]}, {"package": {"name": "other"}, "ranges": [{"events": [{"fixed": "9"}]}]}]},
            {"id": "B", "aliases": ["CVE-1"], "details": "bad"}]},
        {"package": {"name": "fine", "version": "1"}, "vulnerabilities": []},
        {"package": {"name": "mine", "version": "1"}, "vulnerabilities": [{"id": "C"}]}]}]}
    packages = reports.read_osv(spark.createDataFrame([("r", json.dumps(doc))], "run_id string, text string"), root="/w")
    rows = {r["name"]: r for r in packages.collect()}
    p = rows["PyYAML"]
    assert (p.path, p.ids, p.cves, p.severity, p.vector, p.fixed, p.headline) == ("requirements.txt", ["A", "B"], ["CVE-1", "CVE-2"], "critical", "CVSS:3", "5.10", "bad")
    assert rows["mine"].severity == "medium" and "fine" not in rows
    deltas = spark.createDataFrame([("r", "pyyaml", "added")], "run_id string, name string, kind string")
    own = spark.createDataFrame([("r", "requirements.txt", "Mine")], "run_id string, path string, name string")
    assert {r["name"]: r.status for r in reports.changed_packages_only(packages, deltas, own).collect()} == {"PyYAML": "reported", "mine": "first_party"}


def test_replies(spark):
    text = 'Here:\n```json\n{"findings": [{"file": "a.py", "start_line": 2, "cwe": "89", "severity": "HIGH"}, {"file": "", "start_line": 1}]}\n```'
    rows = reports.read_replies(spark.createDataFrame([("c", text), ("d", "nothing")], "case_id string, text string")).orderBy("case_id", "ordinal").collect()
    assert [(r.note, r.cwe) for r in rows[:2]] == [(None, "CWE-89"), ("no file", "")]
    assert rows[2].note == "no findings"


def test_lines_of_a_diff_are_numbered_without_a_join(spark):
    d = parsed(spark)
    assert all("Join" not in x._jdf.queryExecution().optimizedPlan().toString() for x in (d.lines, d.hunks))
    two = "diff --git a/x b/x\nrename from x\n@@ -5 +7 @@\n-a\n\\ no newline\n+b\n@@ -20 +30 @@\n c\ndiff --git a/q b/q\n@@ -1 +1 @@\n+e\n"
    got = [(r.path, r.hunk_no, r.tag, r.old_ln, r.new_ln, r.text) for r in diff.read_diffs(spark.createDataFrame([("r", two)], "run_id string, text string")).lines.orderBy("seq").collect()]
    assert got == [("x", 1, "-", 5, None, "a"), ("x", 1, "+", None, 7, "b"), ("x", 2, " ", 20, 30, "c"), ("q", 1, "+", None, 1, "e")]


def test_a_diff_is_read_with_one_sort_and_both_sides_in_one_pass(spark):
    d = parsed(spark)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(d.lines).count(" Sort [") == 1
    deltas = plan(deps.dep_deltas(d.lines))
    assert "Join" not in deltas and deltas.count(" Sort [") <= 2 and deltas.count("Generate posexplode") == 1


def test_a_block_waits_on_its_side_of_its_hunk_only(spark):
    body = ['-name = "a"', '+name = "b"', ' version = "1"', '+version = "2"', ' name = "c"', "@@ -9 +9 @@", '+version = "3"', ' name = "d"', '-version = "4"', '+version = "5"']
    text = "\n".join(["diff --git a/uv.lock b/uv.lock", "@@ -1 +1 @@", *body, "diff --git a/x/uv.lock b/x/uv.lock", "@@ -1 +1 @@", '+version = "6"'])
    got = {(r.path, r["name"], r.kind, r.old, r.new) for r in deps.dep_deltas(diff.read_diffs(spark.createDataFrame([("r", text)], "run_id string, text string")).lines).collect()}
    assert got == {("uv.lock", "a", "removed", "1", None), ("uv.lock", "b", "added", None, "1"), ("uv.lock", "d", "changed", "4", "5")}


def test_partitions_follow_a_table_s_size(spark, tmp_path):
    from riffle.plans import catalog

    spark.range(1 << 20).selectExpr("id", "hash(id) a", "xxhash64(id) b").write.parquet(str(tmp_path / "t.parquet"))
    table = catalog.t(spark, str(tmp_path), "t")
    size = sum(p.stat().st_size for p in (tmp_path / "t.parquet").glob("*.parquet"))
    parts = catalog.dealt(table.select("id"), table, "id").rdd.getNumPartitions()
    assert size >> 21 == parts > 4
