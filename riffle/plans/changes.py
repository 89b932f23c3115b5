"""Change analysis, profile joins, evaluation corpora and sinks on rows made of the driver's tables, and their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle.functions import tables as T
from riffle.operators import change, detect, evaluate, findings, graph, joins, policy
from riffle.plans.applied import by_remainder
from riffle.plans.catalog import query, t
from riffle.sinks import reports as sinks
from riffle.sources import python_code, reports


def _strings(c: str):  # noqa: ANN202
    return F.array_join(c, ",")


@query("""select case when l_partkey % 11 = 0 then 'no file' when l_linenumber - l_orderkey % 3 < 1 then 'line below 1' when l_linenumber + l_quantity::int % 5 - 2 < l_linenumber - l_orderkey % 3 then 'ends before it starts'
    when l_suppkey % 4 <> 0 and l_linenumber - l_orderkey % 3 > l_suppkey % 6 then 'beyond the file' when l_partkey % 7 = 0 then 'no evidence' end problem, count(*) n from lineitem group by 1""")
def finding_problems(s: SparkSession, d: str) -> DataFrame:
    k = F.col("l_partkey")
    f = t(s, d, "lineitem").select(F.when(k % 11 == 0, by_remainder(k, "", F.lit(None).cast("string"))).otherwise("a.py").alias("file"), (F.col("l_linenumber") - F.col("l_orderkey") % 3).alias("start_line"), (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 5 - 2).alias("end_line"), F.when(k % 7 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1))).alias("evidence"), "l_suppkey")
    return f.select(findings.problem(F.when(F.col("l_suppkey") % 4 != 0, F.col("l_suppkey") % 6)).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


@query("""select l_suppkey, l_orderkey, l_linenumber, l_partkey, row_number() over (partition by l_suppkey order by l_linenumber % 5 desc, l_quantity::int % 11 desc, 'f' || l_partkey % 7, l_linenumber, l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey) "position" from lineitem""")
def report_positions(s: SparkSession, d: str) -> DataFrame:
    f = t(s, d, "lineitem").select(F.col("l_suppkey").alias("run_id"), "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_linenumber") % 5).alias("severity_rank"), (F.col("l_quantity").cast("int") % 11).alias("confidence"), F.concat(F.lit("f"), F.col("l_partkey") % 7).alias("file"), F.col("l_linenumber").alias("start_line"), F.expr("l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey").alias("ordinal"))
    return findings.numbered(f).select(F.col("run_id").alias("l_suppkey"), "l_orderkey", "l_linenumber", "l_partkey", F.col("position").cast("long").alias("position"))


_SIGNALS = "select user_id % 60 p, case event_type when 'click' then 'endpoint' when 'error' then 'sink' when 'purchase' then 'source' when 'signup' then 'sanitizer' else 'config' end kind, case when event_id % 5 = 0 then 0 else event_id % 300 end ln, event_id % 10 c from events where event_id % 41 = 0"
_HUNKS = "select distinct user_id % 60 p, case when event_id % 4 <> 0 then event_id % 290 end a, case when event_id % 4 <> 0 then event_id % 290 + 9 end b from events where event_id % 37 = 0"


def _signals(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n, e = F.col("event_id"), t(s, d, "events")
    kind = T.lookup(F.col("event_type"), {"click": "endpoint", "error": "sink", "purchase": "source", "signup": "sanitizer"}, "config")
    path = (F.col("user_id") % 60).cast("string").alias("path")
    signals = e.where(n % 41 == 0).select(F.lit("r").alias("run_id"), path, kind.alias("kind"), F.when(n % 5 == 0, 0).otherwise(n % 300).alias("line"), (n % 10).alias("confidence"))
    at = lambda x: F.when(n % 4 != 0, n % 290 + x)
    spans = e.where(n % 37 == 0).select(F.lit("r").alias("run_id"), path, at(0).alias("start"), at(9).alias("end")).distinct()
    return signals, spans.withColumn("hunk_id", F.concat_ws(":", "path", F.coalesce(F.col("start").cast("string"), F.lit("-"))))


@query(f"""with sg as ({_SIGNALS}), h as ({_HUNKS}) select h.p || ':' || coalesce(h.a::varchar, '-') hunk, coalesce(string_agg(distinct kind, ',' order by kind) filter (where kind <> 'sanitizer'), '') touches, max(c) confidence
    from h left join sg on sg.p = h.p and (ln = 0 or a is null or ln between a and b) group by h.p, a, b""")
def signals_by_hunk(s: SparkSession, d: str) -> DataFrame:
    signals, spans = _signals(s, d)
    return change.signals_in(spans, signals).select(F.col("hunk_id").alias("hunk"), _strings("touches").alias("touches"), F.col("signal_confidence").alias("confidence"))


@query(f"""with sg as ({_SIGNALS}), h as ({_HUNKS}), x as (select h.p, a, coalesce(string_agg(distinct kind, ',' order by kind) filter (where kind <> 'sanitizer'), '') touches, max(c) c, coalesce(a, 0) % 7 = 3 opened, coalesce(a, 0) % 5 = 2 tainted from h left join sg on sg.p = h.p and (ln = 0 or a is null or ln between a and b) group by h.p, a, b),
    y as (select *, case when opened then array_to_string(list_sort(list_distinct(list_concat(list_filter(string_split(touches, ','), lambda v: v <> ''), ['authz']))), ',') else touches end ts from x),
    g as (select p, ts, count(*) hunks, max(c) c, bool_or(opened) opened, bool_or(tainted) tainted from y group by p, ts)
    select p::varchar path, ts touches, hunks, case when tainted or opened then 'high' when ts <> '' then 'medium' else 'low' end severity, case when opened then greatest(case when ts <> '' then coalesce(c, 5) else 5 end, 7) else case when ts <> '' then coalesce(c, 5) else 5 end end confidence,
    case when regexp_matches(ts, 'endpoint|auth|authz|source|sink|sensitive_field') then 'security' when regexp_matches(ts, 'config|dependency') then 'architecture' else 'convention' end kind from g""")
def hunk_groups(s: SparkSession, d: str) -> DataFrame:
    """Hunks grouped by file and touches; some open access, some are tainted."""
    signals, spans = _signals(s, d)
    n = F.coalesce("start", F.lit(0))
    none = F.array().cast("array<string>")
    h = change.signals_in(spans, signals).withColumns({"file_id": F.concat(F.lit("id"), "path"), "edits": F.when(n % 7 == 3, F.array(F.lit("access_opened"))).otherwise(none), "sinks": none, "tainted": n % 5 == 2, "unguarded": F.lit(False), "weakened": F.lit(False), "is_test": F.lit(False), "is_iac": F.lit(False), "label": F.lit(None).cast("string")})
    g = change.groups(h)
    return g.select("path", _strings("touches").alias("touches"), F.size("hunk_ids").cast("long").alias("hunks"), F.col("projected_severity").alias("severity"), "confidence", "kind")


@query("select doc_id, doc_id % 5 in (0, 1, 2) equal from documents")
def equal_structures(s: SparkSession, d: str) -> DataFrame:
    """Modules before and after: comments, layout and docstrings only; a changed name; one that does not parse."""
    n = F.col("doc_id")
    before = F.concat(F.lit('def f(a):\n    """Doc."""\n    return a + '), n.cast("string"), F.lit("\n"))
    after = by_remainder(n, before, F.concat(F.lit("# note\n"), before), F.concat(F.lit("def f( a ):\n    return (a\n        + "), n.cast("string"), F.lit(")\n")), F.replace(before, F.lit("(a)"), F.lit("(b)")), F.lit("def f(:\n"))
    return python_code.equal_structure(t(s, d, "documents").select("doc_id", before.alias("before"), after.alias("after"))).select("doc_id", "equal")


@query("""select 'e' || o_orderkey id, case when exists (select 1 from orders b where b.o_orderkey = o.o_orderkey and b.o_orderkey % 3 = 0) then 'guard-removed' else 'missing-authz' end rule_id, case when o_orderkey % 3 = 0 then 7 else 5 end confidence from orders o
    where o_orderstatus <> 'F' and o_orderkey % 5 <> 0 and o_custkey % 20 < 9""")
def access_changes(s: SparkSession, d: str) -> DataFrame:
    """Orders as endpoints of the head and the base: unguarded ones of changed files, by whether they had a guard."""
    n = F.col("o_orderkey")
    o = t(s, d, "orders").select(F.lit("r").alias("run_id"), F.concat(F.lit("e"), n).alias("id"), F.concat(F.lit("f"), F.col("o_custkey") % 20).alias("file"), "o_orderstatus", n.alias("n"))
    head = o.withColumns({"guarded": F.col("o_orderstatus") == "F", "opens_access": F.col("n") % 5 == 0}).drop("o_orderstatus", "n")
    base = o.withColumns({"guarded": F.col("n") % 3 == 0, "opens_access": F.lit(False)}).drop("o_orderstatus", "n")
    changed = s.createDataFrame([("r", f"f{i}") for i in range(9)], "run_id string, path string")
    return detect.access_findings(head, base, changed).select("id", "rule_id", "confidence")


@query("""with x as (select l_orderkey * 100 + l_linenumber o, l_partkey % 6 k, l_suppkey % 10 sup, l_orderkey % 30 a, (l_orderkey + 1) % 30 b from (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem)),
    y as (select *, case k when 0 then 'INJ-SQLI' when 1 then 'INJ-CMD' when 2 then 'BAC-PATH-TRAVERSAL' when 3 then 'BAC-SSRF' end internal, k in (0, 1) high, (a < 12 or b < 12) reached, (a < 12 and a % 2 = 0) or (b < 12 and b % 2 = 0) open from x where sup < 7 and k < 4 and o % 7 <> 0)
    select internal, case when high and open then 'critical' when high then 'high' else 'medium' end severity, case when reached then 7 else 6 end confidence, count(distinct o || '/' || k || '/' || sup) n from y group by 1, 2, 3""")
def taint_changes(s: SparkSession, d: str) -> DataFrame:
    """Items as paths into sinks: sanitized ones, responses and unchanged files are left out; an open entry raises what is high."""
    n = F.col("l_orderkey")
    li = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    o = n * 100 + F.col("l_linenumber")
    sym = lambda x: F.concat(F.lit("s"), x % 30)
    paths = li.select(F.lit("r").alias("run_id"), F.concat(F.lit("f"), F.col("l_suppkey") % 10).alias("sink_file"), by_remainder(F.col("l_partkey"), "sql", "command", "path", "http_outbound", "response", "log").alias("sink_kind"), F.array(sym(n), sym(n + 1)).alias("path"), F.when(o % 7 == 0, F.array(F.lit("clean"))).otherwise(F.array().cast("array<string>")).alias("sanitized_by"), F.concat_ws("/", o, F.col("l_partkey") % 6, F.col("l_suppkey") % 10).alias("o")).distinct()
    changed = s.createDataFrame([("r", f"f{i}") for i in range(7)], "run_id string, path string")
    reach = s.createDataFrame([("r", f"s{i}", f"GET /{i}", i % 2 == 1) for i in range(12)], "run_id string, symbol string, entry string, guarded boolean")
    return detect.taint_findings(paths, changed, reach).groupBy("internal", "severity", "confidence").agg(F.count("*").alias("n"))


@query("""select c_custkey, case when c_custkey % 4 = 0 then 'enforced' else 'none' end enforcement, case when c_custkey % 4 in (0, 1) then 'lifted' else 'own' end auth_pattern from customer""")
def judged_overlay(s: SparkSession, d: str) -> DataFrame:
    k, c = F.col("c_custkey"), t(s, d, "customer")
    rows = c.select("c_custkey", F.concat(F.lit("c"), k).alias("controller"), F.col("c_mktsegment").alias("file"), F.lit("none").alias("enforcement"), F.lit("own").alias("auth_pattern"))
    lifted = c.where(k % 4 < 2).select(F.concat(F.lit("c"), k).alias("controller"), F.col("c_mktsegment").alias("file"), by_remainder(k, "enforced", "made up", "", "").alias("enforcement"), F.lit("lifted").alias("auth_pattern"))
    wrong = c.where(k % 4 == 2).select(F.concat(F.lit("c"), k).alias("controller"), F.lit("other").alias("file"), F.lit("enforced").alias("enforcement"), F.lit("lifted").alias("auth_pattern"))
    return evaluate.overlay(rows, lifted.unionByName(wrong)).select("c_custkey", "enforcement", "auth_pattern")


@query("""select p_partkey, case when p_partkey % 5 = 0 then 'first_party' when p_partkey % 3 in (0, 1) then 'reported' else 'out_of_delta' end status from part""")
def changed_packages(s: SparkSession, d: str) -> DataFrame:
    k, p = F.col("p_partkey"), t(s, d, "part")
    name = F.concat(F.lit("Pkg"), k)
    rows = p.select("p_partkey", F.lit("r").alias("run_id"), F.lit("a.lock").alias("path"), name.alias("name"))
    deltas = p.select(F.lit("r").alias("run_id"), F.lower(name).alias("name"), by_remainder(k, "added", "changed", "removed").alias("kind"))
    own = p.where(k % 5 == 0).select(F.lit("r").alias("run_id"), F.lit("a.lock").alias("path"), F.upper(name).alias("name"))
    return reports.changed_packages_only(rows, deltas, own).select("p_partkey", "status")


@query("""with x as (select p_partkey o, 'I' || p_partkey i, unnest([p_size, p_size + 1, p_size + p_partkey % 3]) c, unnest([0, 1, 2]) pos from part) select 'CWE-' || c cwe, arg_min(i, (pos, o)) internal from x group by c""")
def cwe_index(s: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size")
    spelt = lambda x, how: F.concat(F.lit(how), x.cast("string"))
    tax = t(s, d, "part").select(F.col("p_partkey").alias("ordinal"), F.concat(F.lit("I"), "p_partkey").alias("internal"), F.array(spelt(n, ""), spelt(n + 1, "cwe-"), spelt(n + F.col("p_partkey") % 3, "CWE_")).alias("cwe"))
    return evaluate.cwe_index(tax)


@query("""select o_orderpriority "name", arg_min('f' || o_custkey, o_orderkey) file, string_agg(distinct o_orderstatus, ',' order by o_orderstatus) grants from orders group by 1""")
def permission_checks(s: SparkSession, d: str) -> DataFrame:
    g = t(s, d, "orders").select(F.col("o_orderpriority").alias("name"), F.concat(F.lit("f"), "o_custkey").alias("file"), F.lit(1).alias("line"), F.lit("decorator").alias("kind"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderstatus").alias("grants"))
    return evaluate.permission_checks(g).select("name", "file", _strings("grants").alias("grants"))


@query("""with e as (select distinct o_custkey src, (o_custkey * 7 + o_orderkey) % 1000 dst from orders) select src node, dst neighbour, 'out' direction from e where src % 50 = 0 union select dst, src, 'in' from e where dst % 50 = 0 and dst in (select c_custkey from customer)""")
def graph_neighbours(s: SparkSession, d: str) -> DataFrame:
    e = t(s, d, "orders").select(F.col("o_custkey").alias("src"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % 1000).alias("dst"))
    nodes = t(s, d, "customer").where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("node"))
    return graph.neighbours(e, nodes)


@query("""with e as (select distinct o_custkey src, o_orderkey % 700 dst, o_orderstatus relation from orders), g as (select c_custkey id from customer where c_nationkey < 5) select src, dst, relation from e where src in (select id from g) or dst in (select id from g)""")
def splice_violations(s: SparkSession, d: str) -> DataFrame:
    nodes = t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("file"))
    e = t(s, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 700).alias("dst"), F.col("o_orderstatus").alias("relation")).distinct()
    return evaluate.splice_violations(nodes, e, s.createDataFrame([(str(i),) for i in range(5)], "path string"))


@query("""select case_id, n from (select 'r' || user_id case_id, count(*) filter (where event_type <> 'error') n from events group by user_id) where n > 0""")
def pre_existing_counts(s: SparkSession, d: str) -> DataFrame:
    f = t(s, d, "events").select(F.concat(F.lit("r"), "user_id").alias("case_id"), (F.col("event_type") == "error").alias("introduced_by_pr"))
    cases = f.select("case_id").distinct().withColumn("labelled", F.lit(False))
    return evaluate.dump_slice(f, cases)[1].select("case_id", F.col("pre_existing").alias("n"))


@query("""with a as (select distinct user_id from events where event_id % 301 = 0 and value < 40), b as (select distinct user_id from events where event_id % 199 = 0 and value < 60)
    select 'r' || user_id case_id, 'missing' side from a where user_id not in (select user_id from b) union all select 'r' || user_id, 'added' from b where user_id not in (select user_id from a)""")
def comparable_cases(s: SparkSession, d: str) -> DataFrame:
    side = lambda k, v: t(s, d, "events").where((F.col("event_id") % k == 0) & (F.col("value") < v)).select(F.concat(F.lit("r"), "user_id").alias("case_id"))
    return evaluate.case_set_difference(side(301, 40), side(199, 60))


@query("""with p as (select distinct o_custkey % 200 c, o_orderkey % 9 f from orders where o_orderstatus = 'P'), x as (select distinct o_custkey % 200 c, o_orderkey % 9 f from orders where o_orderstatus = 'F' and o_totalprice > 300000)
    select count(*) gt_files, count(x.c) dropped_gt, (count(*) - count(x.c)) / count(*) recall_after_filter from p left join x using (c, f)""")
def filter_ablation(s: SparkSession, d: str) -> DataFrame:
    o = t(s, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey") % 200).alias("case_id"), F.concat(F.lit("f"), F.col("o_orderkey") % 9).alias("path"), "o_orderstatus", "o_totalprice")
    return evaluate.ablation(o.where("o_orderstatus = 'F' and o_totalprice > 300000"), o.where("o_orderstatus = 'P'").withColumnRenamed("path", "gt_file"))


@query("""select l_partkey % 2 = 0 multi, l_suppkey % 3 = 0 guarded, l_linenumber % 2 = 1 flow, case when l_partkey % 2 = 0 then 'multi_hop' when l_suppkey % 3 = 0 or l_linenumber % 2 = 1 then 'full_file' else 'none' end level, count(*) n from lineitem group by all""")
def escalation_levels(s: SparkSession, d: str) -> DataFrame:
    x = t(s, d, "lineitem").select((F.col("l_partkey") % 2 == 0).alias("multi"), (F.col("l_suppkey") % 3 == 0).alias("guarded"), (F.col("l_linenumber") % 2 == 1).alias("flow"))
    return x.withColumn("level", change.escalation(F.col("multi"), F.col("guarded"), F.col("flow"))).groupBy("multi", "guarded", "flow", "level").agg(F.count("*").alias("n"))


@query("""with p as (select distinct 'p' || s_nationkey persona, 't' || s_suppkey % 20 tool from supplier), x as (select persona, tool, case when substr(tool, 2)::int < 15 then 'class' || substr(tool, 2)::int % 4 else 'source' end class from p)
    select persona, tool, class, not ((class = 'source' and substr(persona, 2)::int % 2 = 0) or (class = 'class1' and substr(persona, 2)::int % 3 = 0)) permitted from x""")
def tool_audit(s: SparkSession, d: str) -> DataFrame:
    """Suppliers as tools of personas; tools without a class count as changing sources."""
    personas = t(s, d, "supplier").select(F.concat(F.lit("p"), "s_nationkey").alias("persona"), F.concat(F.lit("t"), F.col("s_suppkey") % 20).alias("tool")).distinct()
    classes = s.createDataFrame([(f"t{i}", f"class{i % 4}") for i in range(15)], "tool string, class string")
    forbidden = s.createDataFrame([(f"p{i}", "source") for i in range(0, 25, 2)] + [(f"p{i}", "class1") for i in range(0, 25, 3)], "persona string, class string")
    return policy.audit_tools(personas, classes, forbidden)


@query("""select user_id run_id, 'R-' || event_type rule_id, event_id::int start_line, case when event_type in ('error', 'purchase') then 'error' when event_type = 'view' then 'warning' else 'note' end "level" from events""")
def sarif_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Findings written as SARIF and read back."""
    e = t(s, d, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("ordinal"), F.concat(F.lit("R-"), "event_type").alias("internal"), T.lookup(F.col("event_type"), {"error": "critical", "purchase": "high", "view": "medium", "click": "low"}, "info").alias("severity"), F.lit("title").alias("title"),
        F.array(F.struct(F.lit("why").alias("why"))).alias("evidence"), F.lit("a b/ü.py").alias("file"), F.col("event_id").cast("int").alias("start_line"), F.col("event_id").cast("int").alias("end_line"), F.lit("f").alias("fingerprint"), F.lit(5).alias("confidence"), F.lit("candidate").alias("status"), F.lit(True).alias("introduced_by_pr"), F.lit("x").alias("detector"),
    )
    return reports.read_sarif(sinks.sarif(e), text="sarif").select("run_id", "rule_id", "start_line", "level")


@query("""with x as (select conv_id, turn, case when turn % 2 = 0 then chr(10) || 'b' else '' end extra from conversations where text is not null) select conv_id group_id, count(*) n_slices, sum(case when turn % 2 = 0 then 3 else 1 end)::bigint slice_chars from x group by 1""")
def bundle_sizes(s: SparkSession, d: str) -> DataFrame:
    """Turns as slices of one or two lines and, for even turns, one line too many."""
    c = t(s, d, "conversations").where("text is not null").select(F.lit("r").alias("run_id"), F.col("conv_id").alias("group_id"), F.col("turn").alias("ordinal"), F.lit("p").alias("path"), F.lit(1).alias("start"), F.lit(2).alias("end"), F.when(F.col("turn") % 2 == 0, "a\nb\nc").otherwise("a").alias("text"))
    return change.bundles(c, 2).select("group_id", F.col("n_slices").cast("long").alias("n_slices"), F.col("slice_chars").cast("long").alias("slice_chars"))


@query("""select case conv_id % 5 when 0 then 'Broken Access Control' when 1 then 'Authentication Failures' end families, count(*) n from (select distinct conv_id from conversations) where conv_id % 5 < 2 and conv_id % 3 = 0 group by 1""")
def weakened_tests(s: SparkSession, d: str) -> DataFrame:
    """Test files (a third of the conversations) from which assertions on permissions, on logins, or on nothing of the kind were removed."""
    k = F.col("conv_id")
    path = F.concat(F.lit("tests/t"), k, F.lit(".py"))
    c = t(s, d, "conversations").select("conv_id").distinct()
    said = by_remainder(k, "    assert r.status_code == 403", "    assertTrue(LOGGED_IN)", "    permission = 1", "    assert x == 1", "    pass")
    lines = c.select(F.lit("r").alias("run_id"), path.alias("path"), F.lit("-").alias("tag"), said.alias("text"))
    files = c.select(F.lit("r").alias("run_id"), path.alias("path"), (k % 3 == 0).alias("is_test"))
    return change.weakened_tests(files, lines).groupBy(_strings("families").alias("families")).agg(F.count("*").alias("n"))


@query("""with x as (select p_partkey, p_size % 9 * 4 a, 'k' || p_brand k from part), s as (select distinct 'k' || p_brand k, p_size a, p_size + p_partkey % 30 b, p_partkey o from part) select p_partkey, arg_min(s.o, s.o) first_part from x left join s on s.k = x.k and x.a between s.a and s.b group by 1""")
def first_containers(s: SparkSession, d: str) -> DataFrame:
    p = t(s, d, "part")
    points = p.select("p_partkey", F.concat(F.lit("k"), "p_brand").alias("k"), (F.col("p_size") % 9 * 4).alias("at"))
    spans = p.select(F.concat(F.lit("k"), "p_brand").alias("k"), F.col("p_size").alias("start"), (F.col("p_size") + F.col("p_partkey") % 30).alias("end"), F.col("p_partkey").alias("o"), F.col("p_partkey").alias("first_part"))
    return joins.first_container(points, spans, "k", "at", "o", ["first_part"]).select("p_partkey", "first_part")
