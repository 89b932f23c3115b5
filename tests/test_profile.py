"""Endpoints, graph, taint, profile tables, patching; and the review over source trees."""

import pytest
from pyspark.sql import functions as F
from riffle.functions import catalog
from riffle.operators import detect, findings, joins
from riffle.operators import profile as P
from riffle.plans.review import review
from riffle.sources import python_code, reports

APP = '''from flask import Flask, request
app = Flask(__name__)
@app.route("/run", methods=["POST", "PUT"])
def run_it():
    cmd = request.args.get("c")
    return helper(cmd)
def helper(c):
    password = "x"
    subprocess.run(c)
@app.route("/safe")
@login_required
def safe():
    x = shlex.quote(request.form["a"])
    os.system(x)
@app.route("/open")
@login_required
@login_exempt
def opened():
    pass
@mock.patch("a.b")
def test():
    pass
'''
API = '''from fastapi import APIRouter, Depends
router = APIRouter(dependencies=[Depends(verify)])
other = APIRouter()
@router.get("/a")
def a(): pass
@other.post("/b", dependencies=[Depends(check)])
def b(u=Depends(current_user)): pass
@other.delete("/c")
def c(): pass
'''
VIEWS = '''from rest_framework.views import APIView
class V(LoginRequiredMixin, APIView):
    permission_classes = [IsAuthenticated]
    def get(self, r): return r.user
    def post(self, r): return open(r.GET)
class W(APIView):
    permission_classes = [AllowAny]
    def delete(self, r): pass
class N: pass
'''
FILES = [("x/app.py", APP), ("y/app.py", API), ("v.py", VIEWS), ("plain.py", "@app.get('/z')\ndef z(): pass\n")]


@pytest.fixture(scope="module")
def facts(spark):
    return python_code.scan_sources(spark.createDataFrame(FILES, "path string, text string")).cache()


def test_endpoints_of_functions_and_views(facts):
    got = {r.symbol: (r.framework, r.route, r.methods, r.guards, r.guard_kind, r.guarded, r.opens_access) for r in P.endpoints(facts).collect()}
    assert got == {
        "x/app.py:run_it": ("flask", "/run", ["POST", "PUT"], [], None, False, False),
        "x/app.py:safe": ("flask", "/safe", ["GET"], ["login_required"], "decorator", True, False),
        "x/app.py:opened": ("flask", "/open", ["GET"], ["login_required"], "decorator", False, True),
        "y/app.py:a": ("fastapi", "/a", ["GET"], ["verify"], "router_dependency", True, False),
        "y/app.py:b": ("fastapi", "/b", ["POST"], ["current_user", "check"], "route_dependency", True, False),
        "y/app.py:c": ("fastapi", "/c", ["DELETE"], [], None, False, False),
        "v.py:V": ("django", "", ["GET", "POST"], ["LoginRequiredMixin", "IsAuthenticated"], "permission_classes", True, False),
        "v.py:W": ("django", "", ["DELETE"], [], None, False, True),
    }


def test_graph_layers_and_taint(spark, facts, tmp_path):
    g = P.build_graph(facts)
    edges = {(r.src, r.dst, r.relation) for r in g.edges.collect()}
    assert ("sym:x/app.py:run_it", "sym:x/app.py:helper", "calls") in edges and ("endpoint:v.py:V", "sym:v.py:V.post", "implements") in edges
    assert ("permission:verify", "endpoint:y/app.py:a", "guards") in edges and ("sym:v.py:V.post", "sink:v.py:5:open", "contains") in edges
    # one pattern that is source and sink is no flow to itself; files of one name stay apart
    assert {(r.source, r.sink, tuple(r.path), tuple(r.sanitized_by)) for r in g.taint.collect()} == {
        ("source:x/app.py:5:request.args", "sink:x/app.py:9:subprocess.run", ("x/app.py:run_it", "x/app.py:helper"), ()),
        ("source:x/app.py:13:request.form", "sink:x/app.py:14:os.system", ("x/app.py:safe",), ("shlex.quote",)),
    }
    assert ("source:x/app.py:13:request.form", "sink:x/app.py:14:os.system", "sanitizes") in edges
    assert {r.name for r in P.unguarded_endpoints(g).collect()} == {"run_it", "opened", "c", "W"}
    assert [r.data_flow[1].name for r in P.flow(P.paths_to(g, "command")).where(F.size("sanitized_by") > 0).collect()] == ["shlex.quote"]
    assert {r.name for r in P.nodes_of_kind(g, "sensitive_field").collect()} == {"password"} and P.edges_of(g, "guards").count() == 7
    P.save_graph(g, f"file://{tmp_path}/g")
    again = P.load_graph(spark, f"file://{tmp_path}/g")
    assert {(r.src, r.dst, r.relation) for r in again.edges.collect()} == edges
    facts_of = {r.path: r for r in P.file_facts(g, P.endpoints(facts)).collect()}
    assert facts_of["x/app.py"].taint_lines == [5, 9, 13, 14] and facts_of["x/app.py"].unguarded_lines == [4, 18] and [tuple(s) for s in facts_of["v.py"].sinks] == [(5, "path")]


def test_profile_tables(facts):
    ep = P.endpoints(facts)
    m = {r.controller: (r.endpoint, r.http_method, r.auth_pattern, r.enforcement) for r in P.access_matrix(ep).collect()}
    assert m["run_it"] == ("/run", "POST,PUT", "none", "none") and m["V"] == ("(unresolved:V)", "GET,POST", "permission_classes:LoginRequiredMixin", "enforced")
    c = {r.name: (r.authenticated, r.description) for r in P.io_channels(ep).collect()}
    assert c["/run"] == (False, "POST/PUT handled by run_it (flask)")


def test_patching_equals_a_whole_build(spark, facts):
    files = dict(FILES)
    changed = files | {"x/app.py": APP.replace("    subprocess.run(c)\n", "    pass\n"), "new.py": API}
    del changed["v.py"]
    old = P.build_graph(facts)
    changes = spark.createDataFrame([("x/app.py", None, "modified", False), ("v.py", None, "deleted", False), ("new.py", None, "added", False)], "path string, previous_path string, change string, is_binary boolean")
    sizes = lambda x: spark.createDataFrame([(p, len(t)) for p, t in x.items()], "path string, size int")
    affected = P.affected_paths(changes, sizes(files), sizes(changed))
    assert {(r.path, r.touched, r.evicted) for r in affected.collect()} == {("x/app.py", True, False), ("v.py", True, True), ("new.py", True, False)}
    tree = spark.createDataFrame(list(changed.items()), "path string, text string")
    fresh, problems = python_code.scan_paths(tree, affected.where("touched"))
    assert {(r.path, r.problem) for r in problems.collect()} == {("v.py", "missing")}
    patched, whole = P.patch_graph(old, P.build_graph(fresh), affected), P.build_graph(python_code.scan_sources(tree))
    for name in ("nodes", "edges", "taint"):
        assert sorted(map(str, getattr(patched, name).collect())) == sorted(map(str, getattr(whole, name).collect())), name
    judged = spark.createDataFrame([("x/app.py", "safe"), ("v.py", "V"), ("y/app.py", "a")], "file string, controller string")
    assert [(r.file, r.controller) for r in P.relifted(judged, P.access_matrix(P.endpoints(fresh)), affected).collect()] == [("x/app.py", "safe")]


def test_totals_and_actions(spark, facts):
    sizes = spark.createDataFrame([("x/app.py", 10), ("y/app.py", 20), ("z.txt", 5)], "path string, size long")
    f = {r.path: r for r in P.fingerprint_files(sizes, facts).collect()}
    assert f["x/app.py"].edges > 0 and f["y/app.py"].edges == 0 and f["x/app.py"].symbols == 5  # the first file of a stem takes its edges
    assert P.fingerprint_totals(P.fingerprint_files(sizes, facts)).first().total_size == 35
    d = spark.createDataFrame([("warm", True), ("incremental", True), ("rebuild", True), ("cold", False)], "decision string, has_profile boolean")
    act = lambda checkout, build: {r.decision: r.action for r in P.action(d, F.lit(checkout), F.lit(build)).collect()}
    assert act(True, True) == {"warm": "reuse", "incremental": "patch", "rebuild": "build", "cold": "build"}
    assert act(False, True) == {"warm": "reuse", "incremental": "stale_reuse", "rebuild": "stale_reuse", "cold": "skipped"}
    assert act(True, False)["rebuild"] == "stale_reuse" and act(True, False)["incremental"] == "patch"


def test_catalog_refuses_ambiguity():
    with pytest.raises(ValueError, match="both modes"):
        catalog.call_patterns({"sinks": {"a": {"calls": ["x"]}, "b": {"exact_calls": ["x"]}}})
    with pytest.raises(ValueError, match="twice"):
        catalog.load('{"sinks": {"a": {"calls": ["x"], "calls": ["y"]}}}')


def test_deep_sources_are_rows_not_failures(spark):
    deep = "x = " + " + ".join(["1"] * 3000)
    nested = "(" * 100_000
    facts = python_code.scan_sources(spark.createDataFrame([("deep.py", deep), ("nested.py", nested)], "path string, text string")).collect()
    assert {(r.path, r.kind) for r in facts} == {("deep.py", "assignment"), ("nested.py", "error")} and max(len(r.text) for r in facts) == len(deep)
    pairs = spark.createDataFrame([(1, deep, deep + "  # same"), (2, deep, deep + " + 1"), (3, nested, nested)], "i int, before string, after string")
    assert {r.i: r.equal for r in python_code.equal_structure(pairs).collect()} == {1: True, 2: False, 3: False}


def test_scope_keeps_runs_apart(spark):
    rows = [("r1", 1, "f1", "app.py", 10, 10), ("r2", 2, "f1", "app.py", 10, 10), ("r2", 3, "f2", "b.py", 1, 1), ("r1", 4, "f2", "b.py", 1, 1)]
    f = spark.createDataFrame(rows, "run_id string, ordinal long, fingerprint string, file string, start_line int, end_line int")
    spans = spark.createDataFrame([("r1", "app.py", 8, 12), ("r2", "app.py", 90, 95)], "run_id string, path string, start int, end int")
    base = spark.createDataFrame([("r1", "f2")], "run_id string, fingerprint string")
    known = spark.createDataFrame([("r2", "b.py")], "run_id string, path string")
    none = spark.createDataFrame([], "run_id string, path string")
    got = {r.ordinal: r.scope_reason for r in findings.scope(f, base, none, spans, known).collect()}
    assert got == {1: "in_hunk", 2: "outside_hunks", 3: "known_path", 4: "baseline"}
    for_all = findings.scope(f, base.select("fingerprint"), none, spans, known)
    assert {r.ordinal for r in for_all.where("scope_reason = 'baseline'").collect()} == {3, 4}


DIFF = """diff --git a/x/app.py b/x/app.py
--- a/x/app.py
+++ b/x/app.py
@@ -4,3 +4,3 @@
     cmd = request.args.get("c")
-    return cmd
+    return helper(cmd)
 def helper(c):
@@ -16,2 +16,1 @@
-@login_required
 def opened():
diff --git a/poetry.lock b/poetry.lock
--- a/poetry.lock
+++ b/poetry.lock
@@ -1,2 +1,2 @@
 name = "flask"
-version = "1.0"
+version = "2.0"
"""


def test_review_over_trees(spark):
    runs = ["one", "two"]
    diffs = spark.createDataFrame([(r, DIFF) for r in runs], "run_id string, text string")
    after = APP.replace("@login_exempt\n", "").replace('@app.route("/open")\n@login_required\n', '@app.route("/open")\n')
    tree = lambda pairs: spark.createDataFrame(pairs, "run_id string, path string, text string")
    head = tree([("one", "x/app.py", after), ("two", "x/app.py", "x = 1\n")])
    base = tree([("one", "x/app.py", APP.replace("@login_exempt\n", "").replace("return helper(cmd)", "return cmd"))])
    osv = reports.read_osv(spark.createDataFrame([("one", '{"results": [{"source": {"path": "poetry.lock"}, "packages": [{"package": {"name": "flask", "version": "2.0"}, "vulnerabilities": [{"id": "G-1", "summary": "bad"}]}]}]}')], "run_id string, text string"))
    r = review(diffs, head=head, base=base, osv=osv)
    got = {(f.run_id, f.internal, f.rule_id, f.file, f.severity, f.scope_reason) for f in r.findings.collect()}
    assert ("one", "INJ-CMD", "taint-command", "x/app.py", "critical", "outside_hunks") in got
    assert ("one", "BAC-MISSING-AUTHZ", "guard-removed", "x/app.py", "high", "in_hunk") in got
    assert ("one", "SC-VULN-DEP", "G-1", "poetry.lock", "medium", "in_hunk") in got
    assert not any(g[0] == "two" for g in got)
    status = {(d.run_id, d.detector): (d.status, d.findings) for d in r.detectors.collect()}
    assert status["one", "structure"] == ("ran", 3) and status["one", "reports"] == ("no_input", None) and status["two", "packages"][0] == "ran"
    groups = r.groups.where("run_id = 'one'").collect()
    assert {("x/app.py", "high")} <= {(g.path, g.projected_severity) for g in groups} and r.bundles.where("run_id = 'one'").count() == len(groups)
    assert {c.path: c.reason for c in r.changeset.where("run_id = 'two'").collect()} == {"x/app.py": "kept", "poetry.lock": "lockfile_captured"}


def _most_joined(df) -> int:
    """The most rows that a join of df's plan made."""
    def joins_of(p):
        name = p.nodeName()
        kids = [p.executedPlan()] if name == "AdaptiveSparkPlan" else [p.plan()] if "QueryStage" in name else [p.children().apply(i) for i in range(p.children().size())]
        own = [p.metrics().apply("numOutputRows").value()] if "Join" in name and p.metrics().contains("numOutputRows") else []
        return own + [n for k in kids for n in joins_of(k)]

    plan = df._jdf.queryExecution()
    plan.executedPlan().executeCollect()
    return max(joins_of(plan.executedPlan()), default=0)


def test_container_variants(spark):
    spans = spark.createDataFrame([("k", 1, 100, 1, "big"), ("k", 10, 20, 2, "small"), ("k", 10, 20, 3, "same"), ("q", 5, 5, 4, "one")], "key string, start int, end int, o int, name string")
    points = spark.createDataFrame([("k", 15), ("k", 15), ("k", 50), ("k", 200), ("q", 5), ("n", 1)], "key string, at int")
    assert {(r.key, r["at"]): r.name for r in joins.smallest_container(points, spans, "key", "at", "o", ["name"]).collect()} == {("k", 15): "small", ("k", 50): "big", ("k", 200): None, ("q", 5): "one", ("n", 1): None}
    assert {(r.key, r["at"]): r.name for r in joins.first_container(points, spans, "key", "at", "o", ["name"]).collect()}["k", 15] == "big"
    ranges = spark.createDataFrame([("k", 18, 30)], "key string, start int, end int")
    assert joins.meeting(ranges, spans, "key", "name").first().name == ["big", "same", "small"]


def test_first_container_meets_a_row_for_each_level(spark):
    rows = [("k", (i * 37) % 90 - 45, (i * 37) % 90 - 45 + (i * i) % 41 - 1, i, f"s{i}") for i in range(300)] + [("k", None, 3, -1, "none"), ("big", -(1 << 40), 1 << 40, 1, "long"), (None, 0, 9, -2, "no key")]
    spans = spark.createDataFrame(rows, "key string, start long, end long, o int, name string")
    points = [(k, p) for k in ("k", "big", None) for p in [*range(-60, 90), None]]
    got = {(r.key, r["at"]): r.name for r in joins.first_container(spark.createDataFrame(points, "key string, at int"), spans, "key", "at", "o", ["name"]).collect()}
    plain = {(k, p): min(((o, n) for key, a, b, o, n in rows if None not in (k, p, a) and key == k and a <= p <= b), default=(0, None))[1] for k, p in points}
    assert got == plain
    # many spans that hold many points: the join makes no row for each pair
    many = spark.range(3000).select(F.lit("k").alias("key"), (F.col("id") % 50).alias("start"), (F.col("id") % 50 + F.col("id") % 30).alias("end"), F.col("id").alias("o"), F.col("id").alias("name"))
    asked = spark.range(3000).select("id", F.lit("k").alias("key"), (F.col("id") % 9 * 4).alias("at"))
    out = joins.first_container(asked, many, "key", "at", "o", ["name"])
    assert out.count() == 3000
    assert _most_joined(out) <= 3000


def test_back_references_and_exclusions(spark):
    rows = spark.createDataFrame([("r", 1, "a"), ("r", 2, "b"), ("r", 3, "a"), ("s", 1, "a")], "run string, n int, body string")
    assert {(r.run, r.n): r.same_as for r in joins.back_references(rows, ["run"], "body", "n").collect()} == {("r", 1): None, ("r", 2): None, ("r", 3): 1, ("s", 1): None}
    sha = "0123456789abcdef"
    adv = spark.createDataFrame([("A", "o/r", sha), ("B", "o/r", "f" * 16), ("C", "o/q", sha), ("D", None, None)], "id string, repo string, sha string")
    out = joins.excluded(adv, spark.createDataFrame([("C",), (f"o/r@{sha[:12]}",), (None,)], "key string"))
    assert {r.id for r in out.collect()} == {"B", "D"}


def test_mapping_report(spark):
    raw = spark.createDataFrame([("checkov", "CKV_DOCKER_3"), ("checkov", "CKV_NEW"), ("semgrep", "x.sql-injection"), ("semgrep", "x.sql-injection"), ("semgrep", "odd")], "tool string, rule_id string")
    got = {r.origin: (r.n, r.rule_ids) for r in detect.mapping_report(raw).collect()}
    assert got == {"exact": (1, []), "fallback": (1, []), "heuristic": (2, ["x.sql-injection"]), "unmapped": (1, ["odd"])}


def test_graph_parses_sources_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    files = spark.createDataFrame([("app.py", "import os\ndef f(c):\n    os.system(c)\n")], "path string, text string").mapInArrow(counted, "path string, text string")
    g = P.build_graph(python_code.scan_sources(files))
    assert {(n.kind, n.name) for n in g.nodes.collect()} >= {("file", "app.py"), ("sink", "os.system")}
    assert read.value == 1
