"""Domain operators on the driver's tables: readers over texts built from rows, findings built from rows, and their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle.functions import tables as T
from riffle.functions import text as X
from riffle.operators import change, evaluate, findings, metrics
from riffle.plans.catalog import _LINES, dealt, query, t
from riffle.sinks.cache import ledger_drift as drift
from riffle.sources import deps, diff, reports


@query(f"""with {_LINES}, g as (select doc_id, line_no, line, case line_no % 3 when 1 then ' ' when 2 then '-' else '+' end tag from lines)
    select doc_id, line_no::bigint line_no, tag, case when tag <> '+' then 1 + coalesce(count(*) filter (where tag <> '+') over w, 0) end old_ln,
    case when tag <> '-' then 1 + coalesce(count(*) filter (where tag <> '-') over w, 0) end new_ln from g
    window w as (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding)""")
def diff_line_numbers(s: SparkSession, d: str) -> DataFrame:
    """Every document as the hunk of a diff, its lines context, removed and added in turn."""
    tag = lambda i: F.when(i % 3 == 0, " ").when(i % 3 == 1, "-").otherwise("+")
    body = F.array_join(F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(tag(i), x)), "\n")
    texts = t(s, d, "documents").select(F.col("doc_id").alias("run_id"), F.concat(F.lit("diff --git a/f b/f\n@@ -1 +1 @@\n"), body).alias("text"))
    lines = diff.read_diffs(texts).lines
    return lines.select(F.col("run_id").alias("doc_id"), (F.col("seq") - 1).cast("long").alias("line_no"), "tag", F.col("old_ln").cast("long").alias("old_ln"), F.col("new_ln").cast("long").alias("new_ln"))


@query("""with x as (select l_suppkey, l_partkey % 40 p, case when l_returnflag = 'R' then 'old' else 'new' end side, l_quantity::int q, l_orderkey, l_linenumber, l_partkey from lineitem where l_returnflag <> 'A'),
    v as (select l_suppkey, p, side, arg_min(q, (l_orderkey, l_linenumber, l_partkey, q)) q from x group by 1, 2, 3), o as (select * from v where side = 'old'), n as (select * from v where side = 'new')
    select coalesce(o.l_suppkey, n.l_suppkey) l_suppkey, 'pkg-' || coalesce(o.p, n.p) "name", case when o.p is null then 'added' when n.p is null then 'removed' else 'changed' end kind, o.q::varchar "old", n.q::varchar "new"
    from o full join n on o.l_suppkey = n.l_suppkey and o.p = n.p where o.q is distinct from n.q""")
def lockfile_deltas(s: SparkSession, d: str) -> DataFrame:
    """Each supplier's items as a lock file's diff, returned ones on the old side."""
    items = t(s, d, "lineitem").where("l_returnflag <> 'A'").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q"), F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("sign"))
    rows = dealt(items, t(s, d, "lineitem"), "l_suppkey").groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", "q", "sign"))).alias("all"))
    block = lambda x: F.concat(x["sign"], F.lit('name = "Pkg_'), (x["l_partkey"] % 40).cast("string"), F.lit('"\n'), x["sign"], F.lit('version = "'), x["q"].cast("string"), F.lit('"'))
    text = F.concat(F.lit("diff --git a/poetry.lock b/poetry.lock\n@@ -1 +1 @@\n"), F.array_join(F.transform("all", block), "\n"))
    lines = diff.read_diffs(rows.select(F.col("l_suppkey").alias("run_id"), text.alias("text"))).lines
    return deps.dep_deltas(lines).select(F.col("run_id").alias("l_suppkey"), "name", "kind", "old", "new")


@query("""select user_id, event_type rule_id, event_id::int start_line, case when event_type = 'view' then case when value >= 90 then 'critical' when value >= 70 then 'high' when value >= 40 then 'medium' when value > 0 then 'low' else 'info' end
    when event_type = 'error' then 'high' when event_type = 'click' then 'low' else 'medium' end severity from events""")
def sarif_results(s: SparkSession, d: str) -> DataFrame:
    """Each user's events as a SARIF report with a banner, read back."""
    place = F.array(F.struct(F.struct(F.struct(F.col("event_id").alias("startLine")).alias("region")).alias("physicalLocation")))
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "note")
    result = F.struct(F.col("event_type").alias("ruleId"), level.alias("level"), F.when(F.col("event_type") == "view", F.create_map(F.lit("security-severity"), (F.col("value") / 10).cast("string"))).alias("properties"), place.alias("locations"))
    doc = F.to_json(F.struct(F.array(F.struct(F.collect_list(result).alias("results"))).alias("runs")))
    texts = t(s, d, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.concat(F.lit("banner\n"), doc).alias("text"))
    out = reports.read_sarif(texts)
    return out.select(F.col("run_id").alias("user_id"), "rule_id", "start_line", T.severity_of_score(F.col("security_severity"), F.col("level")).alias("severity"))


@query("select p_partkey, 'CWE-' || p_size cwe from part")
def cwe_spellings(s: SparkSession, d: str) -> DataFrame:
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    spelt = F.when(k == 0, n).when(k == 1, F.concat(F.lit("cwe-"), n)).when(k == 2, F.concat(F.lit(" CWE_"), n)).otherwise(F.concat(F.lit("Cwe"), n))
    return t(s, d, "part").select("p_partkey", X.normalized_cwe(spelt).alias("cwe"))


@query("select page_id, url like '%/en/%' crosses, regexp_matches(url, '^https?://[^/]*/[^/]*/[^/]*$') stays from pages")
def glob_dialects(s: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    stays = u.rlike(X.glob_regex("http://*/*/*", False)) | u.rlike(X.glob_regex("https://*/*/*", False))
    return t(s, d, "pages").select("page_id", u.rlike(X.glob_regex("*/en/*", True)).alias("crosses"), stays.alias("stays"))


@query("""with m as (select * from (values ('signup', 'Authentication Failures'), ('purchase', 'Injection'), ('error', 'Security Misconfiguration'), ('view', 'Privacy / PII'), ('click', 'Broken Access Control')) v(e, f)),
    x as (select user_id, strftime(ts, '%Y-%m-%d') d, f from events join m on e = event_type union select a.user_id, strftime(a.ts, '%Y-%m-%d'), 'Logging & Alerting' from events a join events b on a.user_id = b.user_id and strftime(a.ts, '%Y-%m-%d') = strftime(b.ts, '%Y-%m-%d')
    where a.event_type = 'view' and b.event_type = 'purchase') select user_id, d "day", string_agg(distinct f, ',' order by f) families from x group by 1, 2""")
def family_routes(s: SparkSession, d: str) -> DataFrame:
    kind = T.lookup(F.col("event_type"), {"signup": "auth", "purchase": "sink", "error": "config", "view": "sensitive_field", "click": "endpoint"})
    e = t(s, d, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.collect_set(kind).alias("touches"))
    return e.select("user_id", "day", F.array_join(change.route_families(F.col("touches"), F.array().cast("array<string>"), F.lit(False)), ",").alias("families"))


_ORD = "(l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey)"


@query(f"""with f as (select l_suppkey, l_partkey % 50 fp, l_linenumber % 5 sev, l_quantity::int % 11 conf, l_returnflag det, l_linestatus ls, {_ORD} o from lineitem),
    w as (select l_suppkey, fp, arg_min(det, (-sev, -conf, o)) det, arg_min(o, (-sev, -conf, o)) winner, count(*) - 1 merged, count(distinct det || ls) evidence from f group by 1, 2)
    select w.l_suppkey, w.fp, winner, merged, evidence, coalesce(string_agg(distinct f.det, ',' order by f.det) filter (where f.det <> w.det), '') others from w join f on f.l_suppkey = w.l_suppkey and f.fp = w.fp group by all""")
def argmax_merge(s: SparkSession, d: str) -> DataFrame:
    """Items as findings of their supplier: the richest wins, evidence and detectors of the others are merged."""
    rows = t(s, d, "lineitem").select(
        F.col("l_suppkey").alias("run_id"), (F.col("l_partkey") % 50).alias("fingerprint"), (F.col("l_linenumber") % 5).alias("severity_rank"), (F.col("l_quantity").cast("int") % 11).alias("confidence"),
        F.array(F.struct(F.col("l_returnflag").alias("file"), F.col("l_linestatus").alias("lines"), F.lit("s").alias("snippet"), F.lit("w").alias("why"))).alias("evidence"), F.array().cast("array<string>").alias("data_flow"),
        F.lit(None).cast("string").alias("entry"), F.col("l_returnflag").alias("detector"), F.expr(_ORD).alias("ordinal"),
    )
    out = findings.dedup(rows)
    return out.select(F.col("run_id").alias("l_suppkey"), F.col("fingerprint").alias("fp"), F.col("ordinal").alias("winner"), F.col("merged").cast("long").alias("merged"), F.size("evidence").cast("long").alias("evidence"), F.array_join("also_detected_by", ",").alias("others"))


@query("""select reason, count(*) n, count(*) filter (where reason in ('synthetic', 'new_in_covered', 'in_hunk', 'known_path')) introduced from (select case when s_suppkey % 50 = 7 then 'synthetic' when p_size < 5 then 'baseline' when s_acctbal < 0 then 'new_in_covered'
    when s_acctbal < 5000 and l_linenumber <= 2 then 'in_hunk' when s_acctbal < 5000 then 'outside_hunks' when s_acctbal < 8000 then 'known_path' else 'untouched' end reason
    from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey) group by reason""")
def scope_reasons(s: SparkSession, d: str) -> DataFrame:
    """Items as findings: baseline by part, files by supplier, spans by line number."""
    sup = t(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), "s_acctbal", "s_suppkey")
    file = F.when(F.col("l_suppkey") % 50 == 7, "pr:body").otherwise(F.col("l_suppkey").cast("string"))
    rows = t(s, d, "lineitem").select(F.col("l_partkey").cast("string").alias("fingerprint"), file.alias("file"), F.col("l_linenumber").alias("start_line"), F.col("l_linenumber").alias("end_line"))
    base = t(s, d, "part").where("p_size < 5").select(F.col("p_partkey").cast("string").alias("fingerprint"))
    spans = sup.where("s_acctbal >= 0 and s_acctbal < 5000").select("path", F.lit(1).alias("start"), F.lit(2).alias("end"))
    out = findings.scope(rows, base, sup.where("s_acctbal < 0").select("path"), spans, sup.where("s_acctbal < 8000").select("path"))
    return out.groupBy(F.col("scope_reason").alias("reason")).agg(F.count("*").alias("n"), F.count(F.when(F.col("introduced_by_pr"), 1)).alias("introduced"))


@query("""with c as (select user_id, count(*) filter (where event_type = 'signup') ep, count(*) filter (where event_type = 'view') sk, count(*) filter (where event_type = 'error') fp, count(*) filter (where event_type = 'error' and value > 80) g from events group by 1),
    o as (select count(*) n, sum(fp) fp, sum(g) g, sum(sk) sk, count(*) filter (where fp = 0) cl, count(*) filter (where ep > 0) ec, coalesce(sum(fp) filter (where ep > 0), 0) ef, sum(ep) ep from c)
    select measure, num::bigint num, den::bigint den, num / nullif(den, 0) as "value" from (select unnest(['fp_per_pr', 'gate_relevant_per_pr', 'clean_rate', 'suppression', 'fp_per_pr_unscoped', 'fp_per_endpoint_pr', 'missing_authz_per_endpoint']) measure,
    unnest([fp, g, cl, sk, fp + sk, ef, 0]) num, unnest([n, n, n, fp + sk, n, ec, ep]) den from o)""")
def negative_scorecard(s: SparkSession, d: str) -> DataFrame:
    e = t(s, d, "events").withColumnRenamed("user_id", "case_id")
    n = lambda k: F.count(F.when(F.col("event_type") == k, 1))
    cases = e.groupBy("case_id").agg(n("signup").alias("endpoints"), n("view").alias("skipped"))
    found = e.where("event_type = 'error'").select("case_id", F.when(F.col("value") > 80, "high").otherwise("low").alias("severity"), F.lit("X").alias("internal"), F.lit(True).alias("introduced_by_pr"))
    return evaluate.negative_measures(cases, found)


@query("""select event_type arm, round(sum(value) / 100, 4) "cost", round(sum(value) / 100 / nullif(count(*) filter (where value > 50), 0), 6) cost_per_case,
    sum(greatest(0, event_id % 1000 - least(event_id % 700, (event_id % 3) * case when user_id % 2 = 0 then 100 else 73 end)))::bigint own_tokens from events group by 1""")
def cost_accounting(s: SparkSession, d: str) -> DataFrame:
    build = F.when(F.col("user_id") % 2 == 0, "a").otherwise("b")
    calls = t(s, d, "events").select(F.col("event_type").alias("arm"), (F.col("value") > 50).cast("int").alias("completed"), (F.col("value") / 100).alias("usd"), (F.col("event_id") % 1000).alias("tokens"), (F.col("event_id") % 700).alias("cached"), (F.col("event_id") % 3).alias("n_calls"), build.alias("build"))
    return metrics.cost(calls, {"a": 100}, 73).withColumns({"cost": F.round("cost", 4), "cost_per_case": F.round("cost_per_case", 6)})


@query("""select page_id::varchar "output", case when page_id % 10 = 0 then 'missing' else 'changed' end status from pages where page_id % 10 = 0 or (page_id % 2 = 1 and url <> regexp_replace(url, '[?#].*$', ''))""")
def ledger_drift(s: SparkSession, d: str) -> DataFrame:
    """Pages' addresses as recorded, against addresses of which some are gone and some have lost their query."""
    p = t(s, d, "pages").select("page_id", F.col("page_id").cast("string").alias("output"), F.col("url").alias("content"))
    now = p.where("page_id % 10 <> 0").withColumn("content", F.when(F.col("page_id") % 2 == 1, F.regexp_replace("content", "[?#].*$", "")).otherwise(F.col("content")))
    return drift(p, now)


@query("""with f as (select *, row_number() over (partition by o_custkey, o_orderpriority order by o_orderkey) r from orders where o_orderstatus <> 'P'), k as (select *, row_number() over (partition by o_custkey order by o_orderkey) n from f where r = 1)
    select o_custkey, o_orderkey from k where n <= 2""")
def capped_first_rows(s: SparkSession, d: str) -> DataFrame:
    return evaluate.capped_per_key(t(s, d, "orders"), "o_custkey", "o_orderkey", F.col("o_orderstatus") != "P", "o_orderpriority", 2).select("o_custkey", "o_orderkey")


@query("""with u as (select distinct user_id from events where event_type = 'signup'), x as (select event_id, case when e.user_id in (select user_id from u) and event_type = 'error' then greatest(0, (value / 10)::int - 2) else (value / 10)::int end c from events e)
    select c confidence, count(*) n from x group by c""")
def trust_penalty(s: SparkSession, d: str) -> DataFrame:
    e = t(s, d, "events")
    f = e.select(F.rint(F.col("value") / 10).cast("int").alias("confidence"), F.when(F.col("event_type") == "error", "agent").otherwise("tool").alias("detector"), F.col("user_id").alias("file"))
    flagged = e.where("event_type = 'signup'").select(F.col("user_id").alias("path"))
    return findings.penalized(f, flagged, F.lit(False)).groupBy("confidence").agg(F.count("*").alias("n"))
