"""The review of a change: diff, manifest, scans, structure, packages, scoping, deduplication, gate, groups and bundles. One plan for any number of changes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riffle.config import Config
from riffle.functions import tables as T
from riffle.operators import change, detect, findings, graph, profile, scan
from riffle.sources import deps, diff, python_code
from riffle.sources import reports as scanner_reports
from riffle.storage import materialize

#: Between run and path where one graph holds the files of many runs; it occurs in neither.
RUN = "\x1f"


@dataclass
class Review:
    manifest: DataFrame
    dep_deltas: DataFrame
    changeset: DataFrame
    findings: DataFrame
    verdicts: DataFrame
    groups: DataFrame
    bundles: DataFrame
    detectors: DataFrame
    rejected: DataFrame
    stages: dict[str, DataFrame] = field(default_factory=dict)


def _raw(hits: DataFrame, tool: str) -> DataFrame:
    return hits.select("run_id", F.xxhash64("path", "line_no", "rule").alias("ordinal"), "internal", F.concat(F.lit(f"{tool}: "), "rule").alias("title"), "severity", "confidence", "status", F.lit(tool).alias("detector"), F.lit(tool).alias("tool"), F.col("rule").alias("rule_id"), "path", F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"), "snippet", F.lit(f"found by {tool}").alias("why"), F.lit(None).cast("string").alias("symbol"), "is_test")


def _one(df: DataFrame, tool: str, title: Column, rule: Column, path: Column, line: Column, snippet: Column, why: Column, symbol: Column, *keys: str) -> DataFrame:
    """Raw findings of detectors that work on structure, from rows with run_id, internal, severity and confidence."""
    return df.select("run_id", F.xxhash64(F.lit(tool), *keys).alias("ordinal"), "internal", title.alias("title"), "severity", "confidence", F.lit("candidate").alias("status"), F.lit(tool).alias("detector"), F.lit(tool).alias("tool"), rule.alias("rule_id"), path.alias("path"), F.greatest(F.lit(1), line).cast("int").alias("start_line"), F.greatest(F.lit(1), line).cast("int").alias("end_line"), snippet.alias("snippet"), why.alias("why"), symbol.alias("symbol"))


def _of_run(facts: DataFrame) -> DataFrame:
    """facts whose paths hold their run, with the run in a column of its own."""
    return facts.withColumn("run_id", F.substring_index("path", RUN, 1))


def _path(c: str) -> Column:
    return F.element_at(F.split(c, RUN), -1)


def scan_runs(sources: DataFrame) -> DataFrame:
    """FACTS of (run_id, path, text), each path with its run before it, so that files of one name in two runs stay apart."""
    return python_code.scan_sources(sources.where(F.endswith("path", F.lit(".py"))).select(F.concat("run_id", F.lit(RUN), "path").alias("path"), "text"))


def structural(head: DataFrame, base: DataFrame, changed: DataFrame, hops: int = T.MOST_HOPS) -> tuple[DataFrame, profile.Graph, DataFrame]:
    """Raw taint and access findings, the graph and the endpoints of head sources (run_id, path, text) against base sources.

    changed: run_id, path. A taint path is reachable if an endpoint calls on to one of its symbols.
    """
    facts, _ = materialize(scan_runs(head), "facts")
    g, (ep, _) = profile.build_graph(facts, most_hops=hops), materialize(_of_run(profile.endpoints(facts)), "head-endpoints")
    entry = F.concat_ws(" ", F.array_join("methods", ","), F.coalesce(F.nullif("route", F.lit("")), "name"))
    starts = ep.select("run_id", F.explode(F.concat(F.array("symbol"), F.transform("methods", lambda m: F.concat("symbol", F.lit("."), F.lower(m))))).alias("start"), entry.alias("entry"), "guarded")
    reach = starts.join(graph.bounded_bfs(python_code.call_edges(facts), starts.select(F.col("start").alias("node")).distinct(), hops), "start").select("run_id", F.col("node").alias("symbol"), "entry", "guarded").distinct()
    paths = g.taint.withColumn("run_id", F.substring_index("sink_file", RUN, 1)).withColumn("sink_file", _path("sink_file"))
    live = detect.taint_findings(paths, changed, reach)
    sinks = g.nodes.where("kind = 'sink'").select(F.col("id").alias("sink"), F.col("line").alias("at"), F.col("name").alias("sink_name")).distinct()
    live = live.join(sinks, "sink")
    taint = _one(live, "structure", F.concat(F.lit("unsanitized flow into "), "sink_name"), F.concat(F.lit("taint-"), "sink_kind"), F.col("sink_file"), F.col("at"), F.col("sink_name"), F.concat_ws(" -> ", F.transform("path", lambda s: F.element_at(F.split(s, ":"), -1))), F.element_at(F.split(F.element_at("path", -1), ":"), -1), "source", "sink")
    sides = [x.select("run_id", F.concat_ws(":", _path("path"), "name").alias("id"), _path("path").alias("file"), "name", "line", "guarded", "opens_access") for x in (ep, _of_run(profile.endpoints(materialize(scan_runs(base), "base-facts")[0])))]
    open_ = detect.access_findings(sides[0], sides[1], changed)
    access = _one(open_, "structure", F.concat(F.lit("endpoint without a guard: "), "name"), F.col("rule_id"), F.col("file"), F.col("line"), F.col("name"), F.col("rule_id"), F.col("name"), "id", "rule_id")
    return materialize(taint.unionByName(access), "structural")[0], g, ep


def _packages(osv: DataFrame, deltas: DataFrame, head_lines: DataFrame) -> DataFrame:
    """Raw findings of vulnerable packages that the change adds or changes; on the first line of the file that names the package, else line 1."""
    known = scanner_reports.changed_packages_only(osv, deltas, osv.sparkSession.createDataFrame([], "run_id string, path string, name string")).where("status = 'reported'")
    at = head_lines.select("run_id", "path", F.col("new_ln").alias("ln"), F.lower("text").alias("t"))
    named = known.join(at, ["run_id", "path"], "left").where(F.col("t").isNull() | F.contains("t", F.lower("name")))
    first = named.groupBy("run_id", "path", "name").agg(F.min("ln").alias("ln"))
    rows = known.join(first, ["run_id", "path", "name"], "left").withColumns({"internal": F.lit("SC-VULN-DEP"), "confidence": F.lit(8)})
    title = F.concat("name", F.lit(" "), "version", F.lit(": "), F.coalesce("headline", F.lit("known vulnerability")))
    return _one(rows, "packages", title, F.array_join("ids", ","), F.col("path"), F.coalesce("ln", F.lit(1)), F.concat("name", F.lit("=="), "version"), F.concat(F.lit("fixed in "), F.coalesce("fixed", F.lit("no release"))), F.lit(None).cast("string"), "path", "name", "version")


def review(
    diffs: DataFrame, baseline: DataFrame | None = None, covered: DataFrame | None = None, reports: DataFrame | None = None, head: DataFrame | None = None, base: DataFrame | None = None,
    osv: DataFrame | None = None, labels: DataFrame | None = None, skipped: DataFrame | None = None, config: Config = Config(),  # noqa: B008  frozen
) -> Review:
    """diffs: run_id, text. baseline: fingerprint; covered: path (both with run_id, or for all runs); reports: raw findings
    (detect.from_sarif) with run_id; head and base: run_id, path, text of the trees; osv: rows of read_osv; labels: run_id,
    hunk_id, label of a triage; skipped: run_id, detector, status of what could not run.

    Order of the stages: validate, scope, deduplicate, gate. Without a baseline scoping goes by hunks. What an input is missing
    for is a detector with a status of its own, never one that found nothing.
    """
    spark = diffs.sparkSession
    none = lambda schema: spark.createDataFrame([], schema)
    # what many stages read is written once: plans stay small, and nothing is parsed twice
    kept_as = lambda df, name: materialize(df, name)[0]
    d = diff.read_diffs(diffs)
    d = diff.Diff(*(kept_as(x, n) for x, n in ((d.files, "files"), (d.hunks, "hunks"), (d.lines, "diff-lines"))))
    manifest = kept_as(diff.manifest(d), "manifest")
    flags = manifest.select("run_id", "path", "is_test", "is_generated")
    added = d.lines.where("tag = '+'").join(flags, ["run_id", "path"]).select("run_id", "path", "is_test", "is_generated", F.col("new_ln").alias("line_no"), F.col("text").alias("line"))
    secrets = scan.secret_scan(added.where("not is_generated"), is_test="is_test")
    secrets, sentinel = kept_as(secrets, "secrets"), kept_as(scan.sentinel_scan(added), "sentinel")
    on = set(config.detectors)
    raw = _raw(secrets, "secrets").unionByName(_raw(sentinel.withColumnRenamed("text", "snippet"), "sentinel")).where(F.col("detector").isin(*sorted(on)))
    made = detect.make_findings(raw)
    # a secret's fingerprint is over the secret, not over its redacted line
    made = made.join(secrets.select("run_id", F.xxhash64("path", "line_no", "rule").alias("ordinal"), F.col("fingerprint").alias("__fp")), ["run_id", "ordinal"], "left").withColumn("fingerprint", F.coalesce("__fp", "fingerprint")).drop("__fp")
    tested = lambda rows: rows.join(flags.select("run_id", "path", "is_test"), ["run_id", "path"], "left")
    if reports is not None and "reports" in on:
        made = made.unionByName(detect.make_findings(tested(reports)))
    deltas = kept_as(deps.dep_deltas(d.lines), "dep-deltas")
    if osv is not None and "packages" in on:
        made = made.unionByName(detect.make_findings(tested(_packages(osv, deltas, d.lines.where("tag <> '-'")))))
    changed = manifest.where("not is_binary and change <> 'deleted'").select("run_id", "path")
    signals, tainted, opened = change.path_signals(manifest), none("run_id string, path string, line int"), none("run_id string, path string, line int")
    formatting = none("run_id string, path string")
    base_tree = base if base is not None else none("run_id string, path string, text string")
    if head is not None:
        texts = manifest.select("run_id", "path").join(head.select("run_id", "path", F.col("text").alias("after")), ["run_id", "path"], "left").join(base_tree.select("run_id", "path", F.col("text").alias("before")), ["run_id", "path"], "left")
        formatting = python_code.equal_structure(texts.where(F.endswith("path", F.lit(".py")) & F.col("before").isNotNull() & F.col("after").isNotNull())).where("equal").select("run_id", "path")
    if head is not None and "structure" in on:
        rows, g, ep = structural(head, base_tree, changed, config.most_hops)
        made = made.unionByName(detect.make_findings(tested(rows)))
        own = _of_run(profile.signals(g, profile.access_matrix(ep))).withColumn("path", _path("path"))
        signals = signals.unionByName(own.select(*signals.columns))
        facts = _of_run(profile.file_facts(g, ep)).withColumn("path", _path("path"))
        tainted = facts.select("run_id", "path", F.explode("taint_lines").alias("line"))
        opened = facts.select("run_id", "path", F.explode("unguarded_lines").alias("line"))
    lengths = None if head is None else head.select("run_id", F.col("path").alias("file"), F.size(F.split("text", "\n", -1)).alias("__lines"))
    counted = made.withColumn("__lines", F.lit(None).cast("int")) if lengths is None else made.join(lengths, ["run_id", "file"], "left")
    judged = counted.withColumn("problem", findings.problem(F.col("__lines"))).drop("__lines")
    rejected, valid = judged.where("problem is not null"), judged.where("problem is null").drop("problem").select(*made.columns)
    valid = findings.penalized(valid, sentinel.select("run_id", "path"), F.lit(False)).select(*made.columns)
    empty_base = baseline if baseline is not None and config.baseline else none("fingerprint string")
    scoped = findings.scope(valid, empty_base, covered if covered is not None and config.baseline else none("path string"), diff.touched_spans(d), manifest.select("run_id", "path"))
    unique = kept_as(findings.dedup(scoped), "findings")
    verdicts = findings.verdicts(diffs.select("run_id"), unique, floor=config.gate_floor, confidence=config.gate_confidence)
    weakened = kept_as(change.weakened_tests(manifest, d.lines), "weakened")
    captured = deltas.select("run_id", "path").distinct()
    signals = kept_as(signals, "signals")
    kept = kept_as(change.filter_changes(manifest, captured, formatting, change.security_relevant(signals), sentinel.select("run_id", "path"), weakened), "changeset")
    groups, slices = _groups(d, kept, signals, tainted, opened, weakened, labels)
    missing = [x for x, there in (("reports", reports), ("packages", osv), ("structure", head)) if there is None and x in on]
    off = sorted({"secrets", "sentinel", "reports", "packages", "structure"} - on)
    status = none("run_id string, detector string, status string") if skipped is None else skipped.select("run_id", "detector", "status")
    said = F.array(*[F.struct(F.lit(x).alias("detector"), F.lit("no_input").alias("status")) for x in missing], *[F.struct(F.lit(x).alias("detector"), F.lit("disabled").alias("status")) for x in off]) if missing or off else None
    if said is not None:
        auto = diffs.select("run_id").distinct().select("run_id", F.explode(said).alias("s")).select("run_id", "s.*")
        status = status.unionByName(auto.join(status.select("run_id", "detector"), ["run_id", "detector"], "left_anti"))
    detectors = detect.detector_status(diffs, ["secrets", "sentinel", "reports", "packages", "structure"], unique.withColumn("detector", F.when(F.col("detector") == "sast", "reports").otherwise(F.col("detector"))), status)
    return Review(manifest, deltas, kept, unique, verdicts, groups, change.bundles(slices, config.most_slice_lines), detectors, rejected)


def _groups(d: diff.Diff, kept: DataFrame, signals: DataFrame, tainted: DataFrame, opened: DataFrame, weakened: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Groups of the kept hunks, and the slices of code that their bundles hold."""
    live = kept.where("decision = 'kept'").select("run_id", "path", "file_id", "is_test", "is_iac")
    hunks = d.hunks.join(live, ["run_id", "path"]).withColumn("hunk_id", F.concat("file_id", F.lit(":h"), (F.col("hunk_no") - 1).cast("string")))
    if labels is not None:
        hunks = change.apply_triage(hunks, labels)
    spans = hunks.select("run_id", "path", "hunk_id", F.col("new_start").alias("start"), (F.col("new_start") + F.greatest(F.col("new_len"), F.lit(1)) - 1).alias("end"))
    touched = change.signals_in(spans, signals).select("run_id", "hunk_id", "touches", "signal_confidence")
    guards = sorted({n for _, n in profile.C.framework_rows(profile.C.PYTHON, "guards")})
    openers = sorted({n for _, n in profile.C.framework_rows(profile.C.PYTHON, "openers")})
    at = F.coalesce("new_ln", "old_ln")
    edits = scan.guard_edits(d.lines.withColumn("line", at), guards, openers, ["run_id", "path", "line"])
    near = change.edits_near(spans, edits).select("run_id", "hunk_id", "edits")
    inside = lambda marks, name: spans.join(marks.select(F.col("run_id").alias("__r"), F.col("path").alias("__p"), F.col("line").alias("__l")), (F.col("run_id") == F.col("__r")) & (F.col("path") == F.col("__p")) & F.col("__l").between(F.col("start"), F.col("end")), "left_semi").select("run_id", "hunk_id").distinct().withColumn(name, F.lit(True))
    weak = weakened.select("run_id", "path").distinct().withColumn("weakened", F.lit(True))
    said = labels.select("run_id", "hunk_id", "label") if labels is not None else hunks.select("run_id", "hunk_id", F.lit(None).cast("string").alias("label")).limit(0)
    full = hunks.join(touched, ["run_id", "hunk_id"], "left").join(near, ["run_id", "hunk_id"], "left").join(inside(tainted, "tainted"), ["run_id", "hunk_id"], "left").join(inside(opened, "unguarded"), ["run_id", "hunk_id"], "left").join(weak, ["run_id", "path"], "left").join(said, ["run_id", "hunk_id"], "left")
    none = F.array().cast("array<string>")
    full = full.withColumns({"touches": F.coalesce("touches", none), "edits": F.coalesce("edits", none), "sinks": none}).na.fill(False, ["tainted", "unguarded", "weakened"])
    grouped, _ = materialize(change.groups(full), "groups")
    lines = d.lines.where("tag <> '-'").groupBy("run_id", "path", "file_no", "hunk_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n").alias("text"))
    texts = hunks.join(lines, ["run_id", "path", "file_no", "hunk_no"]).select("run_id", "hunk_id", "path", F.col("new_start").alias("start"), (F.col("new_start") + F.col("new_len") - 1).alias("end"), "text")
    slices = grouped.select("run_id", F.col("id").alias("group_id"), F.posexplode("hunk_ids").alias("ordinal", "hunk_id")).join(texts, ["run_id", "hunk_id"]).select("run_id", "group_id", "ordinal", "path", "start", "end", "text")
    return grouped, slices
