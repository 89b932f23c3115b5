"""Stored runs, the gate, scorecards, pins, configuration, telemetry, triage and the command line."""

import pytest
from pyspark.sql import functions as F
from riffle import cli, config
from riffle.functions import text as X
from riffle.operators import change, detect, gate
from riffle.plans import benchmark
from riffle.sinks import scorecards
from riffle.telemetry import Telemetry

CASE = "case_id string, labelled boolean, pair_id string, side string, error string, skipped int"
TRUTH = "case_id string, gt_ordinal int, cwe string, gt_file string, spans array<struct<start:int,end:int>>"


def stored(spark, path, noisy=0, lost=False, corpus="c", cases=("a:vuln", "a:control", "b:vuln", "b:control")):
    rows = [(c, c.endswith("vuln"), c[0], c.split(":")[1], None, 2) for c in cases]
    found = [] if lost else [("a:vuln", 1, "x.py", 5, 6, ["CWE-78"], "high", "INJ-CMD", True)]
    found += [("b:vuln", 2, "x.py", 5, 6, ["CWE-89"], "low", "INJ-SQLI", True), ("a:vuln", 3, "x.py", 5, 5, ["CWE-78"], "high", "INJ-CMD", False)]
    found += [("b:control", 10 + i, "y.py", 1, 1, [], "high", "X", True) for i in range(1 + noisy)]
    tables = {
        "run": spark.createDataFrame([(corpus, True, "pipeline")], "corpus string, cold_profiles boolean, arm string"),
        "cases": spark.createDataFrame(rows, CASE),
        "findings": spark.createDataFrame(found, benchmark.FINDING),
        "truths": spark.createDataFrame([("a:vuln", 1, "CWE-77", "x.py", [(4, 5)]), ("b:vuln", 1, "CWE-22", "z.py", [(1, 2)])], TRUTH),
        "detectors": spark.createDataFrame([("r", "secrets", "ran"), ("r", "sca", "missing_tool")], "run_id string, detector string, status string"),
        "dropped": spark.createDataFrame([], "case_id string, path string"),
    }
    benchmark.save_run(tables, path)
    return benchmark.load_run(spark, path)


def test_rescore_and_gate(spark, tmp_path):
    at = lambda n: f"file://{tmp_path}/{n}"
    emits = spark.createDataFrame([("CWE-78",)], "cwe string")
    base, same = stored(spark, at("base")), stored(spark, at("same"))
    scored = benchmark.rescore(base, emits)
    snap = {r.name: r.n for r in scored["snapshot"].collect()}
    assert snap == {"false_positives": 1, "gate_relevant_false_positives": 1, "true_positives": 1, "in_scope_true_positives": 1, "case_errors": 0, "ran:secrets": 1, "ran:sca": 0, "dropped_truth": 0, "discriminated_pairs": 1}
    m = {r.measure: (r.num, r.den) for r in benchmark.measures(scored).collect()}
    assert m["precision"] == (1, 2) and m["recall"] == (1, 2) and m["in_scope_recall"] == (1, 1) and m["pair_discrimination"] == (1, 2) and m["fp_per_case"] == (1, 2) and m["precision_pooled"] == (1, 3)
    verdict = lambda other, **kw: benchmark.compare(base, other, emits, **kw)[1].first()
    assert verdict(same).verdict == "passed"
    worse = verdict(stored(spark, at("worse"), noisy=2, lost=True))
    assert (worse.verdict, worse.failed) == ("failed", ["discriminated_pairs", "false_positives", "gate_relevant_false_positives", "in_scope_true_positives", "true_positives"])
    other = verdict(stored(spark, at("other"), corpus="d", cases=("a:vuln", "a:control")))
    assert other.verdict == "refused" and other.problems == ["corpus", "missing case b:control", "missing case b:vuln"]
    empty = {**same, "cases": same["cases"].limit(0)}
    assert "current has no scored cases" in verdict(empty).problems
    with pytest.raises(ValueError, match="lacks"):
        benchmark.save_run({"run": base["run"]}, at("half"))
    base["run"].withColumn("dump_version", F.lit(1)).write.parquet(at("old/run"))
    for name in benchmark.TABLES[1:]:
        base[name].write.parquet(at(f"old/{name}"))
    with pytest.raises(ValueError, match="version"):
        benchmark.load_run(spark, at("old"))


def test_command_line_of_stored_runs(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr("riffle.session.local_session", lambda *a, **b: spark)
    base, worse = f"file://{tmp_path}/base", f"file://{tmp_path}/worse"
    stored(spark, base)
    stored(spark, worse, noisy=3)
    assert cli.main(["gate", base, base, "--emits", "CWE-78"]) == 0
    assert cli.main(["gate", base, worse]) == 1
    assert cli.main(["gate", base, f"file://{tmp_path}/none"]) == 2
    assert cli.main(["rescore", base]) == 0 and "precision\t0.500 (1/2)" in capsys.readouterr().out
    assert cli.main(["compare", base, worse]) == 0 and capsys.readouterr().out.count("<tr><th>") == 3  # heads and two arms
    (tmp_path / "tree" / "a").mkdir(parents=True)
    (tmp_path / "tree" / "a" / "app.py").write_text("from flask import Flask\n@app.route('/x')\ndef f(): pass\n")
    assert cli.main(["profile", f"file://{tmp_path}/tree", "--out", f"file://{tmp_path}/profile"]) == 0
    assert "node\tendpoint\t1" in capsys.readouterr().out
    assert [r.file for r in spark.read.parquet(f"file://{tmp_path}/profile/access_matrix").collect()] == ["a/app.py"]
    (tmp_path / "calm.diff").write_text("diff --git a/x.py b/x.py\n@@ -1 +1 @@\n-a\n+b\n")
    (tmp_path / "bad.diff").write_text('diff --git a/x.py b/x.py\n@@ -1 +1 @@\n+DB_PASSWORD = "correct-horse"\n')
    assert cli.main(["review", f"file://{tmp_path}/calm.diff"]) == 0
    assert cli.main(["review", f"file://{tmp_path}/bad.diff", "--out", f"file://{tmp_path}/out"]) == 1
    assert spark.read.parquet(f"file://{tmp_path}/out/findings").count() == 1 and spark.read.parquet(f"file://{tmp_path}/out/telemetry").count() == 1
    assert cli.main(["review", f"file://{tmp_path}/bad.diff", "--out", f"file://{tmp_path}/out"]) == 2  # artifacts are not replaced
    assert cli.main(["version"]) == 0


def test_arms(spark):
    s = spark.createDataFrame([("pipeline", 3, 7), ("pipeline", 0, 0), ("llm-low", 5, 0)], "arm string, scored_findings int, skipped int")
    assert {r.arm: (r.num, r.den, r.value) for r in gate.arm_suppression(s).collect()} == {"pipeline": (7, 10, 0.7), "llm-low": (0, 5, None)}
    arms = spark.createDataFrame([(1, 0, 0), (2, 9, 36), (3, 30, 30)], "ordinal int, in_scope int, rows int")
    assert gate.recall_ceiling(arms).first().value == 0.25 and gate.recall_ceiling(arms.limit(0)).first().value is None
    a, b = (spark.createDataFrame([(x,) for x in v], "internal string") for v in (["A", "B"], ["B", None]))
    assert {r.internal for r in gate.detector_reach(a, b).collect()} == {"A", "B"}


def test_scorecards_and_pins(spark, tmp_path):
    m = spark.createDataFrame([("r", 1, "One", 1, "a|b", 1, 4, 0.25), ("r", 1, "One", 2, "none", 0, 0, None), ("r", 2, "Two", 1, "c", 2, 2, 1.0)], "run_id string, section_no int, section string, measure_no int, measure string, num long, den long, value double")
    notes = spark.createDataFrame([("r", "One", scorecards.scope_note("pipeline"))], "run_id string, section string, note string")
    text = scorecards.scorecard(m, notes).first().markdown
    assert "| a\\|b | 0.250 (1/4) |\n| none | n/a (0/0) |" in text and text.index("## One") < text.index("## Two") and "baseline" in text
    page = scorecards.comparison_page(scorecards.rendered(m).withColumn("arm", F.lit("<x>")), "A & B").first().html
    assert "&lt;x&gt;" in page and "A &amp; B" in page and "<x>" not in page
    card = scorecards.scorecard(m, notes)
    scorecards.write_scorecard(card, m, f"file://{tmp_path}/card")
    with pytest.raises(FileExistsError):
        scorecards.write_scorecard(card, m, f"file://{tmp_path}/card")
    cases = spark.createDataFrame([("a",)], "case_id string")
    with pytest.raises(ValueError):
        scorecards.pin_corpus(cases, {"language": " "}, f"file://{tmp_path}/pin")
    scorecards.pin_corpus(cases, {"language": "python"}, f"file://{tmp_path}/pin")
    assert benchmark.load_corpus(spark, f"file://{tmp_path}/pin", "case_id string").collect() == cases.collect()
    log = spark.createDataFrame([("b", False, "too old"), ("a", True, None)], "id string, kept boolean, reason string")
    assert [r.line for r in scorecards.curation_log(log).collect()] == ["a kept (no reason)", "b left out (too old)"]
    assert [r.share for r in scorecards.counts_table(spark.createDataFrame([("x", 3), ("y", 1)], "k string, n int"), "k").collect()] == [0.75, 0.25]


def test_capture_and_corpus_runs(spark, tmp_path):
    bundles = spark.createDataFrame([("a", "g", 1), ("c", "g", 1)], "run_id string, group_id string, n_slices int")
    benchmark.capture(bundles, f"file://{tmp_path}/capture")
    cases = spark.createDataFrame([("a",), ("b",)], "case_id string")
    found, missing = benchmark.replay(spark, f"file://{tmp_path}/capture", cases)
    assert [r.run_id for r in found.collect()] == ["a"] and [r.case_id for r in missing.collect()] == ["b"]
    diffs = spark.createDataFrame([("a", 'diff --git a/x.py b/x.py\n@@ -1 +1 @@\n+DB_PASSWORD = "correct-horse"\n'), ("b", None), ("c", " ")], "case_id string, diff string")
    rows, errors = benchmark.run_corpus(diffs, spark.createDataFrame([("SEC-PASSWORD", ["CWE-798"])], "internal string, cwe_ids array<string>"))
    assert [(r.case_id, r.cwe_ids) for r in rows.collect()] == [("a", ["CWE-798"])] and {r.case_id for r in errors.collect()} == {"b", "c"}
    assert [r.case_id for r in benchmark.limited(diffs, 2).collect()] == ["a", "b"]


def test_a_detector_that_fails_takes_nothing_from_the_others(spark):
    runs = spark.createDataFrame([("r",), ("s",)], "run_id string")
    bad = lambda: runs.select("run_id", F.raise_error(F.lit("no")).cast("int").alias("n"))
    rows, status = detect.run_all(runs, {"good": lambda: runs.select("run_id", F.lit(1).alias("n")), "bad": bad, "worse": lambda: 1 / 0}, "run_id string, n int")
    assert rows.count() == 2 and {(r.run_id, r.detector, r.status) for r in status.collect()} == {(r, x, "error") for r in "rs" for x in ("bad", "worse")}


def test_triage_and_rationale(spark):
    hunks = spark.createDataFrame([("r", f"h{i}", i, "x" * 2000) for i in range(70)], "run_id string, hunk_id string, ordinal int, text string")
    payload = change.triage_payload(hunks).collect()
    assert len(payload) == 60 and max(len(p.text) for p in payload) == 1200
    replies = spark.createDataFrame([("r", 'Sure:\n```json\n{"h1": "NO", "h2": "maybe", "h3": "dunno", "zz": "no"}\n```')], "run_id string, text string")
    labels = change.triage_labels(replies, hunks)
    assert {r.hunk_id: r.label for r in labels.collect()} == {"h1": "no", "h2": "maybe"}
    assert change.apply_triage(hunks, labels).count() == 69
    row = spark.range(1).select(change.rationale(F.array(F.lit("sink"), F.lit("auth")), F.lit("os.system"), F.array(F.lit("guard_removed:x")), F.lit(True), F.lit(False), F.array(F.lit("a"))).alias("r"), change.rationale(F.array().cast("array<string>"), F.lit(None).cast("string"), F.array().cast("array<string>"), F.lit(False), F.lit(False), F.array().cast("array<string>")).alias("q")).first()
    assert row.r == "touches auth, sink (os.system). guard_removed:x. a taint path passes through the changed lines. significant: a" and row.q == "no security surface is known for this file"


def test_configuration_and_telemetry(spark):
    assert config.load('{"gate_confidence": 8}').gate_confidence == 8
    for bad in ('{"x": 1}', '{"triage": true, "triage": false}', '{"gate_floor": "awful"}', '{"gate_confidence": 11}', '{"detectors": ["nope"]}'):
        with pytest.raises(ValueError):
            config.load(bad)
    clock = Telemetry()
    with clock.phase("a"), clock.phase("b"):
        seen = clock.observed(spark.range(7), "seen")
        assert len(seen.collect()) == 7
    assert clock.rows("seen") == 7 and {r.phase for r in clock.frame(spark, "r").collect()} == {"a", "b"}


def test_dates(spark):
    rows = spark.createDataFrame([("2024-02-29",), ("2024-03-01T00:30:00+02:00",), ("2024-03-01T23:30:00Z",), ("2024-13-01",), ("soon",), (None,)], "d string")
    assert [str(r[0]) for r in rows.select(X.iso_date(F.col("d"))).collect()] == ["2024-02-29", "2024-02-29", "2024-03-01", "None", "None", "None"]
