"""The kernels on the driver's tables: queries by name, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riffle.functions import tables as T
from riffle.functions import text as X
from riffle.operators import findings as fi
from riffle.operators import graph, joins, maps, metrics, scan, windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(c: str | object):  # noqa: ANN201
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# Rules for invented prose: phrases that occur there.
DOC_RULES = (
    scan.LineRule("credential", "SEC-PASSWORD", "high", 8, "validated", r"(?i)(password|token|secret|api[_-]?key)\s*[:=]", gating=True),
    scan.LineRule("license", "SC-LICENSE", "low", 5, "candidate", r"(?i)(licen[sc]e|copyright|all rights reserved)"),
    scan.LineRule("address", "PII-EMAIL", "medium", 6, "candidate", r"[\w.]+@[\w.]+\.[a-z]+"),
    scan.LineRule("number", "PII-NUMBER", "info", 3, "candidate", r"\d{3}", generic=True),
)
_RULE_ROWS = ", ".join(f"({i}, '{r.rule}', '{r.internal}', '{r.severity}', {r.confidence}, '{r.status}', '{r.pattern}', {r.gating}, {r.generic})" for i, r in enumerate(DOC_RULES))
_LINES = "lines as (select doc_id, source, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) line_no from documents)"
_RULES = f"rules as (select * from (values {_RULE_ROWS}) v(o, rule, internal, severity, confidence, status, pattern, gating, generic))"
_HITS = f"{_LINES}, {_RULES}, hits as (select * from lines join rules on regexp_matches(line, pattern))"


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores if a small file gives fewer (one row group is one task); larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() <= cores else df


def dealt(df: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """df, made of a table's rows, dealt out by keys: a partition for each 2 MiB of the table's files, so that a task's rows don't grow with the table."""
    n = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >> 21
    return df.repartition(max(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    return scan.lines_of(spread(t(spark, d, "documents").select("doc_id", "source", "text")), "text", "doc_id", "source")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Rule hits over lines, fingerprinted, deduplicated and gated by source."""
    hits = scan.rule_scan(doc_lines(spark, d), DOC_RULES)
    found = hits.select(
        F.col("source").alias("run_id"), X.fingerprint(F.col("source"), F.col("internal"), F.lit(""), X.collapsed(F.col("line"))).alias("fingerprint"), "severity", T.severity_rank(F.col("severity")).alias("severity_rank"), "confidence", "status",
        F.lit(True).alias("introduced_by_pr"), F.array(F.struct(F.col("doc_id").cast("string").alias("file"), F.col("line_no").cast("string").alias("lines"), F.col("line").alias("snippet"), F.col("rule").alias("why"))).alias("evidence"),
        F.array().cast("array<struct<role:string,file:string,line:int,note:string>>").alias("data_flow"), F.lit(None).cast("string").alias("entry"), F.col("rule").alias("detector"), (F.col("doc_id") * 100000 + F.col("line_no")).alias("ordinal"),
    )
    return fi.verdicts(t(spark, d, "documents").select(F.col("source").alias("run_id")), fi.dedup(found))


@query(f"""with {_HITS} select doc_id, line_no::bigint line_no, rule, severity from hits where not generic or not exists
    (select 1 from hits g where g.doc_id = hits.doc_id and g.line_no = hits.line_no and g.gating and g.o < hits.o)""")
def line_rule_scan(s: SparkSession, d: str) -> DataFrame:
    return scan.rule_scan(doc_lines(s, d), DOC_RULES).select("doc_id", long("line_no").alias("line_no"), "rule", "severity")


@query(f"""with {_HITS} select rule, count(*) n, count(distinct doc_id) docs from hits where not generic or not exists
    (select 1 from hits g where g.doc_id = hits.doc_id and g.line_no = hits.line_no and g.gating and g.o < hits.o) group by rule""")
def specific_suppresses_generic(s: SparkSession, d: str) -> DataFrame:
    return scan.rule_scan(doc_lines(s, d), DOC_RULES).groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(f"""with {_HITS}, kept as (select * from hits where not generic or not exists
    (select 1 from hits g where g.doc_id = hits.doc_id and g.line_no = hits.line_no and g.gating and g.o < hits.o)),
    fp as (select distinct source, substr(sha1(source || '|' || internal || '||' || lower(trim(regexp_replace(line, '\\s+', ' ', 'g')))), 1, 16) f, severity, confidence, status from kept)
    select s.source run_id, count(*) filter (where severity in ('high', 'critical') and confidence >= 6 and status = 'validated') triggers,
    case when count(*) filter (where severity in ('high', 'critical') and confidence >= 6 and status = 'validated') > 0 then 'flagged' else 'approved' end verdict
    from (select distinct source from documents) s left join fp on fp.source = s.source group by s.source""")
def rule_gate(s: SparkSession, d: str) -> DataFrame:
    return flagship(s, d)


_FP = "substr(sha1(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))), 1, 16)"


@query(f"""select fingerprint, count(*) copies, arg_min(doc_id, (-n_chars, doc_id)) doc_id, string_agg(distinct source, ',' order by source) sources
    from (select *, {_FP} fingerprint from documents) group by fingerprint""")
def fingerprint_dedup(s: SparkSession, d: str) -> DataFrame:
    docs = t(s, d, "documents").select("doc_id", "n_chars", "source", F.substring(F.sha1(X.collapsed(F.col("text")).cast("binary")), 1, 16).alias("fingerprint"))
    return docs.groupBy("fingerprint").agg(F.count("*").alias("copies"), F.min_by("doc_id", F.struct(-F.col("n_chars"), "doc_id")).alias("doc_id"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query(f"select copies, count(*) n from (select {_FP} f, count(*) copies from documents group by f) where copies > 1 group by copies")
def exact_copy_groups(s: SparkSession, d: str) -> DataFrame:
    return fingerprint_dedup(s, d).where("copies > 1").groupBy("copies").agg(F.count("*").alias("n"))


def _fingerprints(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents").select("doc_id", "source", F.substring(F.sha1(X.collapsed(F.col("text")).cast("binary")), 1, 16).alias("fingerprint"))


_SPANS = "epoch(ts)::bigint"


def _second() -> Column:
    """The nearest second of ts, halves to the even one, as the SQL's cast has it."""
    return F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")


@query(f"""with e as (select event_id, user_id, event_type, {_SPANS} a, {_SPANS} + 3600 b from events)
    select event_id, user_id from e where event_type = 'view' and exists (select 1 from e p where p.event_type = 'purchase' and p.user_id = e.user_id and p.a <= e.b and e.a <= p.b)""")
def interval_overlap(s: SparkSession, d: str) -> DataFrame:
    start = _second()
    e = t(s, d, "events").select("event_id", "user_id", "event_type", start.alias("start"), (start + 3600).alias("end"))
    return joins.overlapping(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "user_id").select("event_id", "user_id")


@query(f"""with e as (select event_id, user_id, event_type, {_SPANS} a, {_SPANS} + 3600 b from events)
    select event_id, user_id from e where event_type = 'click' and not exists (select 1 from e p where p.event_type = 'error' and p.user_id = e.user_id and p.a <= e.b and e.a <= p.b)""")
def interval_anti_binned(s: SparkSession, d: str) -> DataFrame:
    start = _second()
    e = t(s, d, "events").select("event_id", "user_id", "event_type", start.alias("start"), (start + 3600).alias("end"))
    return joins.overlapping(e.where("event_type = 'click'"), e.where("event_type = 'error'"), "user_id", "left_anti", bin_size=86400).select("event_id", "user_id")


@query("""with p as (select distinct l_orderkey, l_linenumber from lineitem), sp as (select l_orderkey k, l_linenumber - l_quantity::int % 4 a, l_linenumber + l_partkey % 4 b, l_partkey, l_suppkey,
    l_partkey * 100000 + l_suppkey o from lineitem)
    select p.l_orderkey, p.l_linenumber, arg_min(sp.l_partkey, (b - a, o)) partkey from p left join sp on sp.k = p.l_orderkey and p.l_linenumber between a and b group by 1, 2""")
def smallest_container(s: SparkSession, d: str) -> DataFrame:
    li = t(s, d, "lineitem")
    spans = li.select("l_orderkey", (F.col("l_linenumber") - F.col("l_quantity").cast("int") % 4).alias("start"), (F.col("l_linenumber") + F.col("l_partkey") % 4).alias("end"), F.col("l_partkey").alias("partkey"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("o"))
    return joins.smallest_container(li.select("l_orderkey", "l_linenumber").distinct(), spans, "l_orderkey", "l_linenumber", "o", ["partkey"])


_MAP_EXACT = (("PROMO", "PROMOTED"), ("ECONOMY", "CHEAP"))
_MAP_TOKENS = ((r"(?i)^st", "STANDARD"), (r"(?i)med|small", "SIZED"))
_MAPPED = """select p_partkey, case when p_type = 'PROMO' then 'PROMOTED' when p_type = 'ECONOMY' then 'CHEAP' when regexp_matches(p_type, '(?i)^st') then 'STANDARD' when regexp_matches(p_type, '(?i)med|small') then 'SIZED'
    when p_brand < 'Brand#3' then 'BRANDED' else 'UNMAPPED' end target, case when p_type in ('PROMO', 'ECONOMY') then 'exact' when regexp_matches(p_type, '(?i)^st') or regexp_matches(p_type, '(?i)med|small') then 'heuristic'
    when p_brand < 'Brand#3' then 'fallback' else 'unmapped' end origin from part"""


@query(_MAPPED)
def rule_mapping_fallback(s: SparkSession, d: str) -> DataFrame:
    to = joins.ordered_fallback(F.col("p_type"), _MAP_EXACT, _MAP_TOKENS, F.when(F.col("p_brand") < "Brand#3", "BRANDED"), "UNMAPPED")
    return t(s, d, "part").select("p_partkey", to.alias("m")).select("p_partkey", "m.target", "m.origin")


@query("""with e as (select event_type, case when event_type in ('view', 'click') then null else value / 10 end sc from events) select severity, count(*) n from (select
    case when sc >= 9 then 'critical' when sc >= 7 then 'high' when sc >= 4 then 'medium' when sc > 0 then 'low' when sc is not null then 'info' when event_type = 'click' then 'low' else 'medium' end severity from e) group by severity""")
def severity_bands(s: SparkSession, d: str) -> DataFrame:
    e = t(s, d, "events").select(F.when(F.col("event_type").isin("view", "click"), None).otherwise(F.col("value") / 10).alias("sc"), F.when(F.col("event_type") == "click", "note").otherwise(F.col("event_type")).alias("level"))
    return e.select(T.severity_of_score(F.col("sc"), F.col("level")).alias("severity")).groupBy("severity").agg(F.count("*").alias("n"))


_SIDE = "select l_suppkey, l_partkey % 50 bucket, sum(l_quantity)::bigint q from lineitem where l_returnflag = '{}' group by 1, 2"


@query(f"""select coalesce(b.l_suppkey, a.l_suppkey) l_suppkey, coalesce(b.bucket, a.bucket) bucket, case when b.q is null then 'added' when a.q is null then 'removed' else 'changed' end kind, b.q "old", a.q "new"
    from ({_SIDE.format("R")}) b full join ({_SIDE.format("N")}) a on a.l_suppkey = b.l_suppkey and a.bucket = b.bucket where b.q is distinct from a.q""")
def map_diff(s: SparkSession, d: str) -> DataFrame:
    side = lambda f: t(s, d, "lineitem").where(F.col("l_returnflag") == f).groupBy("l_suppkey", (F.col("l_partkey") % 50).alias("bucket")).agg(F.sum("l_quantity").cast("long").alias("q"))
    return maps.map_diff(side("R"), side("N"), ["l_suppkey", "bucket"], "q")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 150000)")
def coverage_gap(s: SparkSession, d: str) -> DataFrame:
    return maps.uncovered(t(s, d, "customer"), t(s, d, "orders").where("o_totalprice > 150000").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])


@query("""with d as (select distinct user_id, (epoch_us(ts) // 86400000000)::bigint dno from events), i as (select *, dno - row_number() over (partition by user_id order by dno) g from d)
    select user_id, min(dno) "start", max(dno) "end" from i group by user_id, g""")
def gaps_islands(s: SparkSession, d: str) -> DataFrame:
    days = t(s, d, "events").select("user_id", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400).alias("day"))
    return windows.islands(days, ["user_id"], "day")


@query("""with c as (select *, count(*) filter (where role = 'user') over (partition by conv_id order by turn) island from conversations),
    n as (select *, max(case when role = 'user' then turn end) over (partition by conv_id order by turn) opened, count(*) filter (where role = 'assistant') over (partition by conv_id, island order by turn) nth from c)
    select conv_id, turn, opened from n where role = 'assistant' and nth = 1 and island > 0""")
def carry_forward_consume(s: SparkSession, d: str) -> DataFrame:
    c = t(s, d, "conversations")
    return windows.carry_forward(c, ["conv_id"], "turn", F.col("role") == "user", F.col("role") == "assistant", F.col("turn"), "opened").select("conv_id", "turn", "opened")


@query("select l_orderkey, arg_min(l_partkey, (l_quantity, l_linenumber, l_partkey, l_suppkey)) partkey, min(l_quantity) quantity from lineitem group by l_orderkey")
def first_wins(s: SparkSession, d: str) -> DataFrame:
    li = t(s, d, "lineitem").select("*", F.col("l_partkey").alias("partkey"), F.col("l_quantity").alias("quantity"))
    return windows.first_wins(li, ["l_orderkey"], ["l_quantity", "l_linenumber", "l_partkey", "l_suppkey"], ["partkey", "quantity"])


@query("""select conv_id, turn, count(*) filter (where role <> 'assistant') over w old_no, count(*) filter (where role <> 'user') over w new_no from conversations window w as (partition by conv_id order by turn)""")
def running_line_numbers(s: SparkSession, d: str) -> DataFrame:
    return windows.running_counts(t(s, d, "conversations"), ["conv_id"], ["turn"], old_no=F.col("role") != "assistant", new_no=F.col("role") != "user").select("conv_id", "turn", "old_no", "new_no")


@query("""select 'total' dimension, null::varchar as "value", count(*) n from events union all select 'event_type', event_type, count(*) from events group by 2
    union all select 'day', strftime(ts, '%Y-%m-%d'), count(*) from events group by 2""")
def multi_counts(s: SparkSession, d: str) -> DataFrame:
    return fi.multi_counts(t(s, d, "events").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")), ("event_type", "day"))


@query("""select o_orderpriority, count(*) filter (where o_orderstatus = 'F') num, count(*) filter (where o_totalprice > 150000) den,
    case when count(*) filter (where o_totalprice > 150000) > 0 then count(*) filter (where o_orderstatus = 'F') / count(*) filter (where o_totalprice > 150000) end as "value" from orders group by 1""")
def rates_with_denominator(s: SparkSession, d: str) -> DataFrame:
    r = metrics.rate(F.count(F.when(F.col("o_orderstatus") == "F", 1)), F.count(F.when(F.col("o_totalprice") > 150000, 1)))
    return t(s, d, "orders").groupBy("o_orderpriority").agg(*(c.alias(k) for k, c in r.items()))


@query("""with f as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, p_brand, p_size from lineitem join part on p_partkey = l_partkey where l_returnflag = 'R'),
    g as (select l_orderkey gk, l_partkey gp, l_suppkey gs, l_linenumber gl, p_brand gb, p_size gz from lineitem join part on p_partkey = l_partkey where l_returnflag <> 'R'),
    j as (select f.*, gp, case when gb = p_brand then 2 when substr(gb, 1, 7) = substr(p_brand, 1, 7) then 1 else 0 end * case when abs(gz - p_size) <= 10 then 2 else 1 end rk, gl, gs from f left join g on gk = l_orderkey),
    r as (select *, row_number() over (partition by l_orderkey, l_linenumber, l_partkey, l_suppkey order by coalesce(rk, 0) desc, gl, gp, gs) n from j)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(rk, 0)::int match_rank, case when coalesce(rk, 0) = 0 then 'fp' when rk in (4, 2) then 'tp' else 'near_miss' end label from r where n = 1""")
def best_match_label(s: SparkSession, d: str) -> DataFrame:
    li = t(s, d, "lineitem").join(t(s, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "p_brand", "p_size")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    truths = li.where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("gk"), F.col("l_partkey").alias("gp"), F.col("l_suppkey").alias("gs"), F.col("l_linenumber").alias("gl"), F.col("p_brand").alias("gb"), F.col("p_size").alias("gz"))
    same = F.when(F.col("gb") == F.col("p_brand"), 2).when(F.substring("gb", 1, 7) == F.substring("p_brand", 1, 7), 1).otherwise(0)
    best = joins.best_match(li.where("l_returnflag = 'R'"), truths, F.col("gk") == F.col("l_orderkey"), F.when(F.col("gk").isNotNull(), same * F.when(F.abs(F.col("gz") - F.col("p_size")) <= 10, 2).otherwise(1)), keys, ["gl", "gp", "gs"])
    return best.select(*keys, "match_rank", F.when(F.col("match_rank") == 0, "fp").when(F.col("match_rank").isin(4, 2), "tp").otherwise("near_miss").alias("label"))


@query("""with x as (select conv_id, arg_max(length(text) % 3, turn) filter (where role = 'user') v, arg_max(length(text) % 2, turn) filter (where role = 'assistant') c from conversations group by conv_id)
    select case when v is null or c is null then 'unpaired' when v = 0 then 'missed' when c = 0 then 'clean' else 'also_flagged' end outcome, count(*) n from x group by 1""")
def pair_outcomes(s: SparkSession, d: str) -> DataFrame:
    c = t(s, d, "conversations").where("role in ('user', 'assistant')")
    sides = c.select(F.col("conv_id").alias("pair_id"), F.when(F.col("role") == "user", "vuln").otherwise("control").alias("side"), F.when(F.col("role") == "user", F.length("text") % 3).otherwise(F.length("text") % 2).alias("hits"), F.col("turn").alias("ordinal"))
    every = t(s, d, "conversations").select(F.col("conv_id").alias("pair_id")).distinct().join(metrics.pair_outcomes(sides), "pair_id", "left")
    return every.groupBy(F.coalesce("outcome", F.lit("unpaired")).alias("outcome")).agg(F.count("*").alias("n"))


@query("""with r as (select event_type, strftime(ts, '%Y-%m-%d') d, count(*) filter (where value > 50) / nullif(count(*), 0) v from events group by 1, 2)
    select event_type, count(v) passes, max(v) - min(v) spread from r group by 1 having count(v) >= 2""")
def variance_spread(s: SparkSession, d: str) -> DataFrame:
    r = t(s, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("d")).agg(F.try_divide(F.count(F.when(F.col("value") > 50, 1)), F.count("*")).alias("value"))
    return metrics.spread(r, "event_type")


@query("""with a as (select event_type, count(*) n from events where ts < timestamp '2024-01-16' group by 1), b as (select event_type, count(*) n from events where ts >= timestamp '2024-01-16' group by 1)
    select coalesce(a.event_type, b.event_type) "name", a.n "before", b.n "after", case when a.n is null or b.n is null or b.n - a.n > 1 then 'FAIL' else 'PASS' end status from a full join b on a.event_type = b.event_type""")
def ratchet_gate(s: SparkSession, d: str) -> DataFrame:
    e, cut = t(s, d, "events").withColumnRenamed("event_type", "name"), F.to_timestamp_ntz(F.lit("2024-01-16 00:00:00"))
    side = lambda c: e.where(c).groupBy("name").agg(F.count("*").alias("n"))
    return metrics.ratchet(side(F.col("ts") < cut), side(F.col("ts") >= cut))


@query("""with v as (select p_brand, p_size, p_partkey % 13 m, p_partkey from part) select p_brand, arg_max(p_size || '.' || m || case when p_partkey % 3 = 0 then '.rc' else '.1' end,
    (p_size, m, case when p_partkey % 3 = 0 then 0 else 1 end)) best from v group by p_brand""")
def version_max(s: SparkSession, d: str) -> DataFrame:
    version = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 13).cast("string"), F.when(F.col("p_partkey") % 3 == 0, "rc").otherwise("1"))
    return t(s, d, "part").select("p_brand", version.alias("v")).groupBy("p_brand").agg(F.max_by("v", X.version_key(F.col("v"))).alias("best"))


_HOST = "regexp_extract(url, '://([^/?#]+)', 1)"


@query(f"select page_id, {_HOST} = 'example.net' or ends_with({_HOST}, '.example.net') hit from pages")
def suffix_match(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "pages").select("page_id", X.suffix_match(F.regexp_extract("url", "://([^/?#]+)", 1), F.lit("example.net")).alias("hit"))


@query("select p_partkey, contains('_' || lower(replace(p_name, ' ', '_')) || '_', '_' || (select lower(split_part(min(p_name), ' ', 1)) from part) || '_') hit from part")
def segment_match(s: SparkSession, d: str) -> DataFrame:
    p = t(s, d, "part")
    term = p.agg(F.lower(F.split(F.min("p_name"), " ")[0]).alias("term"))
    return p.join(F.broadcast(term), F.lit(True)).select("p_partkey", X.segment_match(F.replace("p_name", F.lit(" "), F.lit("_")), F.col("term")).alias("hit"))


_EDGES = "select distinct n_nationkey::bigint src, (n_nationkey * 7 + k) % 25 dst from nation, (values (1), (3)) v(k)"


@query(f"""with recursive e as ({_EDGES}), r as (select n_nationkey::bigint "start", n_nationkey::bigint node, 0 distance from nation
    union all select "start", dst, distance + 1 from r join e on e.src = r.node where distance < 4) select "start", node, min(distance)::int distance from r group by 1, 2""")
def bounded_bfs(s: SparkSession, d: str) -> DataFrame:
    n = t(s, d, "nation").select(long("n_nationkey").alias("n"))
    edges = n.select(F.col("n").alias("src"), F.explode(F.array((F.col("n") * 7 + 1) % 25, (F.col("n") * 7 + 3) % 25)).alias("dst"))
    return graph.bounded_bfs(edges, n.select(F.col("n").alias("node")), 4)


@query("""with recursive e as (select distinct o_custkey src, (o_custkey * 31 + o_orderkey) % (select count(*) from customer) dst from orders), r as (select 1::bigint node union select dst from r join e on e.src = r.node) select node from r""")
def reachability(s: SparkSession, d: str) -> DataFrame:
    # an edge for every order between customers, whose keys run from 0
    customers = t(s, d, "customer").agg(F.count("*").alias("n"))
    o = t(s, d, "orders").join(F.broadcast(customers), F.lit(True))  # one row
    edges = o.select(F.col("o_custkey").alias("src"), ((F.col("o_custkey") * 31 + F.col("o_orderkey")) % F.col("n")).alias("dst"))
    return graph.reachable(edges, s.range(1, 2).select(F.col("id").alias("node")))


@query("select o_custkey, count(*) n, round(sum(case when o_custkey % 10 = 0 then o_totalprice * 2 else o_totalprice end), 2) total from orders group by 1")
def splice_equivalence(s: SparkSession, d: str) -> DataFrame:
    o = t(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    changed = o.where("o_custkey % 10 = 0")
    fresh = changed.withColumn("o_totalprice", F.col("o_totalprice") * 2)
    return maps.splice(o, fresh, changed, ["o_custkey"]).groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""with x as (select o_orderpriority, count(*) f, count(*) filter (where o_orderstatus = 'P') fc, count(*) filter (where o_totalprice > 1000) e, count(*) filter (where o_totalprice > 230000) ec from orders group by 1)
    select o_orderpriority, fc / f file_churn, ec / e edge_churn, case when o_orderpriority like '1%' then 'warm' when fc / f > 0.25 or ec / e > 0.15 then 'rebuild' else 'incremental' end decision,
    case when o_orderpriority like '1%' then null when fc / f > 0.25 then 'file_churn' when ec / e > 0.15 then 'edge_churn' end reason from x""")
def drift_decision(s: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    x = t(s, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("files"), n(F.col("o_orderstatus") == "P").alias("files_changed"), n(F.col("o_totalprice") > 1000).alias("edges"), n(F.col("o_totalprice") > 230000).alias("edges_changed"))
    x = x.withColumns({"has_profile": F.lit(True), "same_sha": F.startswith("o_orderpriority", F.lit("1")), "anchor_changed": F.lit(False), "new_language": F.lit(False)})
    return maps.drift_decision(x).select("o_orderpriority", "file_churn", "edge_churn", "decision", "reason")


@query("select o_custkey, count(*) n from orders group by 1 order by n desc, o_custkey limit 5")
def top_k_noisiest(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(5)


@query("""select l_suppkey, l_orderkey, l_linenumber, l_partkey, "rank" from (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey)::int "rank" from lineitem) where "rank" <= 6""")
def top_k_per_group(s: SparkSession, d: str) -> DataFrame:
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")]
    return windows.top_rows(t(s, d, "lineitem"), ["l_suppkey"], order, 6).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "rank")


@query("""with f as (select user_id, event_type in ('error', 'purchase') high, (value / 10)::int c from events), u as (select distinct user_id from events), g as (select user_id, count(*) n from f where high and c >= 6 group by 1)
    select user_id run_id, coalesce(n, 0) triggers, case when n > 0 then 'flagged' else 'approved' end verdict from u left join g using (user_id)""")
def gate_verdict(s: SparkSession, d: str) -> DataFrame:
    e = t(s, d, "events").withColumnRenamed("user_id", "run_id")
    f = e.select("run_id", F.when(F.col("event_type").isin("error", "purchase"), "high").otherwise("low").alias("severity"), F.rint(F.col("value") / 10).cast("int").alias("confidence"), F.lit("validated").alias("status"), F.lit(True).alias("introduced_by_pr"))
    return fi.verdicts(e, f)


@query("select conv_id, case when count(distinct role) = 1 then max(role) end only_role, case when min(length(text)) = max(length(text)) then max(length(text)) end only_length from conversations group by conv_id")
def unique_or_null(s: SparkSession, d: str) -> DataFrame:
    c = t(s, d, "conversations").withColumn("n", F.length("text").cast("long"))
    return c.groupBy("conv_id").agg(joins.unique_or_null("role").alias("only_role"), joins.unique_or_null("n").alias("only_length"))


@query("""select l_returnflag, l_linestatus, sum(l_quantity) sum_qty, round(sum(l_extendedprice), 2) sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) sum_charge, round(avg(l_quantity), 6) avg_qty, count(*) n
    from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def pricing_summary(s: SparkSession, d: str) -> DataFrame:
    li = t(s, d, "lineitem").where(F.col("l_shipdate") <= F.to_timestamp_ntz(F.lit("1998-09-02 00:00:00")))
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(disc), 2).alias("sum_disc"), F.round(F.sum(disc * (1 + F.col("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"))


@query("""select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey and s_nationkey = c_nationkey
    join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey where r_name = 'ASIA' group by n_name""")
def local_supplier_volume(s: SparkSession, d: str) -> DataFrame:
    li = t(s, d, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    j = t(s, d, "customer").join(t(s, d, "orders"), F.col("o_custkey") == F.col("c_custkey")).join(li, F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(t(s, d, "supplier"), (F.col("s_suppkey") == F.col("l_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey"))).join(t(s, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return j.join(t(s, d, "region").where("r_name = 'ASIA'"), F.col("r_regionkey") == F.col("n_regionkey")).groupBy("n_name").agg(F.round(F.sum("v"), 2).alias("revenue"))


@query("""select user_id, event_id, value - lag(value) over (partition by user_id order by ts, event_id) delta, rank() over (partition by user_id order by value desc) value_rank from events""")
def window_rank(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id")
    return t(s, d, "events").select("user_id", "event_id", (F.col("value") - F.lag("value").over(w.orderBy("ts", "event_id"))).alias("delta"), long(F.rank().over(w.orderBy(F.desc("value")))).alias("value_rank"))


@query("select o_custkey k from orders where o_orderstatus = 'F' intersect select c_custkey from customer where c_acctbal > 0 except select o_custkey from orders where o_orderstatus = 'P'")
def set_ops(s: SparkSession, d: str) -> DataFrame:
    o, c = t(s, d, "orders"), t(s, d, "customer")
    return o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).intersect(c.where("c_acctbal > 0").select("c_custkey")).subtract(o.where("o_orderstatus = 'P'").select("o_custkey"))
