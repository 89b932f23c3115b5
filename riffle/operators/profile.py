"""A repository's security profile: endpoints and guards, the layered graph, access matrix, channels, totals, and its patching."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle.functions import catalog as C
from riffle.functions import text as X
from riffle.operators import graph, maps
from riffle.operators.joins import first_precedence
from riffle.sources import python_code
from riffle.storage import materialize

NODES = "id string, kind string, file string, name string, line int, detail string, pattern string"
EDGES = "src string, dst string, relation string"


def _none() -> Column:
    return F.lit(None).cast("string")


def _last(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def frameworks(facts: DataFrame, catalog: C.Catalog = C.PYTHON) -> DataFrame:
    """path, framework: the first of the catalog that a file imports."""
    order = {m: (i, name) for i, (name, fw) in reversed(list(enumerate(catalog["frameworks"].items()))) for m in fw["detect"]}
    top = F.split("name", r"\.")[0]
    found = F.create_map(*[x for m, (i, name) in order.items() for x in (F.lit(m), F.struct(F.lit(i).alias("i"), F.lit(name).alias("f")))])[top]
    return facts.where("kind = 'import'").select("path", found.alias("f")).where("f is not null").groupBy("path").agg(F.min("f").alias("f")).select("path", F.col("f.f").alias("framework"))


def endpoints(facts: DataFrame, catalog: C.Catalog = C.PYTHON) -> DataFrame:
    """path, symbol, name, line, end_line, framework, route, methods, guards (in order), guard_kind, guarded, opens_access.

    Functions under a route decorator: guarded by decorators, by injected dependencies, by those of the route, or by those of the
    router that the decorator is called on. Classes with a view base: guarded by mixins and by enforcing entries of class
    attributes, opened by opening ones; their methods are verbs, their route is unknown (empty). An opener beside a guard
    makes an endpoint unguarded. Only files that import a framework have endpoints.
    """
    of_file = frameworks(facts, catalog)
    f = facts.join(of_file, "path")
    named = lambda *keys: F.array(*[F.lit(f"{a}:{b}") for k in keys for a, b in C.framework_rows(catalog, k)])
    among = lambda name, *keys: F.array_contains(named(*keys), F.concat("framework", F.lit(":"), name))
    injects = F.col("framework").isin(*[n for n, fw in catalog["frameworks"].items() if fw.get("dependencies")])
    kwargs = sorted({fw["method_kwarg"] for fw in catalog["frameworks"].values() if fw.get("method_kwarg")})
    listed = F.regexp_extract("text", rf"(?:{'|'.join(kwargs) or '(?!)'})\s*=\s*[\[(]([^\])]*)[\])]", 1)
    verb, receiver = _last(F.col("name")), F.regexp_extract("name", r"^(.*)\.[^.]*$", 1)
    first = F.regexp_extract("text", r"""["']([^"']*)["']""", 1)
    verbs = F.transform(F.filter(F.split(listed, ","), lambda v: F.trim(v) != ""), lambda v: F.upper(F.regexp_replace(F.trim(v), "[\"']", "")))
    methods = F.when(listed != "", verbs).when(verb.isin(*C.HTTP_VERBS), F.array(F.upper(verb))).otherwise(F.array(F.lit("GET")))
    # a verb-shaped decorator whose text names an attribute path, such as patch("a.b"), makes no route
    routes = f.where("kind = 'decorator'").where(verb.isin(*sorted(C.route_verbs(catalog))) & F.contains("text", F.lit("(")) & ~(F.contains(first, F.lit(".")) & ~F.contains(first, F.lit("/"))))
    routes = routes.select("path", "symbol", F.struct("line", first.alias("route"), methods.alias("methods"), receiver.alias("receiver")).alias("r")).groupBy("path", "symbol").agg(F.min("r").alias("r"))
    functions = f.where("kind = 'function'").select("path", "symbol", "name", "line", "end_line", "framework").join(routes, ["path", "symbol"])
    mark = lambda df, order, kind, name: df.select("path", "symbol", F.struct(F.lit(order).alias("order"), "line", F.lit(kind).alias("kind"), name.alias("name")).alias("g"))
    guards = mark(f.where("kind = 'decorator'").where(among(_last(F.col("name")), "guards")), 0, "decorator", _last(F.col("name")))
    guards = guards.unionByName(mark(f.where("kind = 'injected'").where(injects), 1, "dependency", F.col("name")))
    guards = guards.unionByName(mark(f.where("kind = 'route_dependency'").where(injects), 2, "route_dependency", F.col("name")))
    bound = f.where("kind = 'router' and text <> ''").where(injects).select("path", F.col("name").alias("receiver"), F.col("text").alias("dependency"), F.col("line").alias("at"))
    routed = functions.select("path", "symbol", F.col("r.receiver").alias("receiver")).join(bound, ["path", "receiver"]).withColumn("line", F.col("at"))
    guards = guards.unionByName(mark(routed, 3, "router_dependency", F.col("dependency")))
    opened = f.where("kind = 'decorator'").where(among(_last(F.col("name")), "openers")).select("path", "symbol")
    # views
    views = f.where("kind = 'base'").where(among(F.col("name"), "views")).select("path", "symbol").distinct()
    classes = f.where("kind = 'class'").select("path", "symbol", "name", "line", "end_line", "framework").join(views, ["path", "symbol"], "left_semi")
    handler = f.where("kind = 'function'").where(F.col("name").isin(*C.HTTP_VERBS)).select("path", F.regexp_extract("symbol", r"^(.*)\.[^.]*$", 1).alias("symbol"), F.upper("name").alias("verb"))
    handled = handler.groupBy("path", "symbol").agg(F.array_sort(F.collect_set("verb")).alias("methods"))
    classes = classes.join(handled, ["path", "symbol"], "left").withColumn("r", F.struct(F.col("line"), F.lit("").alias("route"), F.coalesce("methods", F.array().cast("array<string>")).alias("methods"), F.lit("").alias("receiver"))).drop("methods")
    guards = guards.unionByName(mark(f.where("kind = 'base'").where(among(F.col("name"), "mixins")), 4, "mixin", F.col("name")))
    attributes = sorted({a for fw in catalog["frameworks"].values() for a in fw.get("class_attributes", ())})
    entries = f.where(F.col("kind") == "entry").where(F.col("text").isin(*attributes))
    guards = guards.unionByName(mark(entries.where(among(F.col("name"), "enforcing")), 5, "permission_classes", F.col("name")))
    opened = opened.unionByName(entries.where(among(F.col("name"), "openers")).select("path", "symbol")).distinct().withColumn("__open", F.lit(True))
    all_guards = guards.groupBy("path", "symbol").agg(F.array_sort(F.collect_set("g")).alias("gs"))
    every = functions.select(*classes.columns).unionByName(classes).join(all_guards, ["path", "symbol"], "left").join(opened, ["path", "symbol"], "left")
    names = F.coalesce(F.transform("gs", lambda g: g["name"]), F.array().cast("array<string>"))
    opens = F.coalesce("__open", F.lit(False))
    return every.select(
        "path", "symbol", "name", "line", "end_line", "framework", F.col("r.route").alias("route"), F.col("r.methods").alias("methods"), names.alias("guards"),
        F.element_at("gs", -1)["kind"].alias("guard_kind"), ((F.size(names) > 0) & ~opens).alias("guarded"), opens.alias("opens_access"),
    )


@dataclass
class Graph:
    """nodes (NODES), edges (EDGES) and taint (source, sink, sink_kind, path, sanitized_by, source_file, sink_file)."""

    nodes: DataFrame
    edges: DataFrame
    taint: DataFrame


def _suffixes(name: Column) -> Column:
    """All dotted suffixes of a name, itself first: what patterns are joined with."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def matched_calls(facts: DataFrame, catalog: C.Catalog = C.PYTHON) -> DataFrame:
    """path, line, name, holder, pattern, node_kind, detail: each call with every catalog pattern that it fits (exact ones only whole)."""
    spark = facts.sparkSession
    p = C.table(spark, C.call_patterns(catalog), "ordinal int, pattern string, exact boolean, node_kind string, detail string")
    calls = facts.where("kind = 'call' and name <> ''").select("path", "line", "name", "holder", F.explode(_suffixes(F.col("name"))).alias("pattern"))
    return calls.join(p, "pattern").where(~F.col("exact") | (F.col("pattern") == F.col("name"))).select("path", "line", "name", "holder", "pattern", "node_kind", "detail").distinct()


def matched_attributes(facts: DataFrame, catalog: C.Catalog = C.PYTHON) -> DataFrame:
    """path, line, name, holder, detail: attribute chains that a pattern is a suffix of; the first pattern of the catalog counts."""
    spark = facts.sparkSession
    p = C.table(spark, C.attribute_patterns(catalog), "ordinal int, pattern string, detail string")
    chains = facts.where("kind = 'attribute'").select("path", "line", "name", "holder").distinct().withColumn("pattern", F.explode(_suffixes(F.col("name"))))
    return chains.join(p, "pattern").groupBy("path", "line", "name", "holder").agg(F.min_by("detail", "ordinal").alias("detail"))


def sensitive_class(name: Column, catalog: C.Catalog = C.PYTHON) -> Column:
    """The class of the first sensitive term whose segments a name holds, else null."""
    out = F
    for term, c in C.sensitive_terms(catalog):
        out = out.when(X.segment_match(name, F.lit(term)), c)
    return out.otherwise(None)


def build_graph(facts: DataFrame, catalog: C.Catalog = C.PYTHON, most_hops: int = 4) -> Graph:
    """The four layers: files, symbols and calls; endpoints and guards; sources, sinks, sanitizers and sensitive fields; taint.

    A node that is added twice counts once, by its id; an edge counts only if both its ends are there. Ids hold the path, so
    that all but permissions belong to one file.
    """
    node = lambda df, kind, i, file, name, line, detail=None, pattern=None: df.select(i.alias("id"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), file.alias("file"), name.alias("name"), line.cast("int").alias("line"), (_none() if detail is None else detail).alias("detail"), (_none() if pattern is None else pattern).alias("pattern"))
    edge = lambda df, a, b, relation: df.select(a.alias("src"), b.alias("dst"), F.lit(relation).alias("relation"))
    path, sym = F.col("path"), lambda c: F.concat(F.lit("sym:"), c)
    facts, _ = materialize(facts, "facts")  # every layer below reads them: sources are parsed once
    parsed = facts.where("kind <> 'error'").select("path").distinct()
    functions = facts.where("kind = 'function'")
    # layers that are used several times are written, so that they are made once and plans stay small
    ep, _ = materialize(endpoints(facts, catalog).withColumn("eid", F.concat(F.lit("endpoint:"), "symbol")), "endpoints")
    calls, _ = materialize(matched_calls(facts, catalog).withColumn("nid", F.concat_ws(":", "node_kind", "path", F.col("line").cast("string"), "name")), "catalog-calls")
    attrs, _ = materialize(matched_attributes(facts, catalog).withColumn("nid", F.concat_ws(":", F.lit("source"), "path", F.col("line").cast("string"), "name")), "catalog-attributes")
    fields = facts.where("kind = 'assignment' and name <> ''").withColumn("class", sensitive_class(_last(F.col("name")), catalog)).where("class is not null")
    fields = fields.groupBy("path", "name").agg(F.min(F.struct("line", "class", "owner")).alias("f")).withColumn("nid", F.concat(F.lit("sensitive_field:"), "path", F.lit(":"), "name"))
    nodes = node(parsed, "file", F.concat(F.lit("file:"), path), path, path, F.lit(None))
    nodes = nodes.unionByName(node(functions, "symbol", sym(F.col("symbol")), path, F.col("symbol"), F.col("line")))
    nodes = nodes.unionByName(node(ep, "endpoint", F.col("eid"), path, F.col("name"), F.col("line"), F.when(F.col("guarded"), "guarded").otherwise("unguarded")))
    nodes = nodes.unionByName(node(ep.select(F.explode("guards").alias("g")), "permission", F.concat(F.lit("permission:"), "g"), F.lit(""), F.col("g"), F.lit(None)))
    nodes = nodes.unionByName(node(calls, F.col("node_kind"), F.col("nid"), path, F.col("name"), F.col("line"), F.col("detail"), F.col("pattern")))
    nodes = nodes.unionByName(node(attrs, "source", F.col("nid"), path, F.col("name"), F.col("line"), F.col("detail")))
    nodes = nodes.unionByName(node(fields, "sensitive_field", F.col("nid"), path, F.col("name"), F.col("f.line"), F.col("f.class")))
    rest = F.struct("kind", "file", "name", "line", "detail", "pattern")
    nodes, _ = materialize(nodes.groupBy("id").agg(F.min(rest).alias("n")).select("id", "n.*"), "nodes")
    edges = edge(functions, F.concat(F.lit("file:"), path), sym(F.col("symbol")), "contains")
    edges = edges.unionByName(edge(python_code.call_edges(facts), sym(F.col("src")), sym(F.col("dst")), "calls"))
    edges = edges.unionByName(edge(ep, F.col("eid"), sym(F.col("symbol")), "implements"))
    edges = edges.unionByName(edge(ep.select("eid", "symbol", F.explode("methods").alias("m")), F.col("eid"), sym(F.concat("symbol", F.lit("."), F.lower("m"))), "implements"))
    edges = edges.unionByName(edge(ep.select("eid", F.explode("guards").alias("g")), F.concat(F.lit("permission:"), "g"), F.col("eid"), "guards"))
    edges = edges.unionByName(edge(calls.where("holder is not null"), sym(F.col("holder")), F.col("nid"), "contains"))
    edges = edges.unionByName(edge(attrs.where("holder is not null"), sym(F.col("holder")), F.col("nid"), "contains"))
    edges = edges.unionByName(edge(fields.where("f.owner is not null"), F.concat(F.lit("file:"), path), F.col("nid"), "contains"))
    ids = nodes.select("id")
    edges = edges.distinct().join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "relation")
    edges, _ = materialize(edges, "graph-edges")
    inside = calls.where("holder is not null")
    starts = inside.where("node_kind = 'source'").select(F.col("nid").alias("id"), F.col("holder").alias("symbol"), "pattern", F.col("detail").alias("kind"))
    starts = starts.unionByName(attrs.where("holder is not null").select(F.col("nid").alias("id"), F.col("holder").alias("symbol"), _none().alias("pattern"), F.col("detail").alias("kind")))
    ends = inside.where("node_kind = 'sink'").select(F.col("nid").alias("id"), F.col("holder").alias("symbol"), "pattern", F.col("detail").alias("kind"))
    clean = inside.where("node_kind = 'sanitizer'").select(F.col("holder").alias("symbol"), "name", F.col("detail").alias("kind"))
    taint, _ = materialize(graph.taint_pairs(starts, ends, clean, python_code.call_edges(facts), most_hops), "taint")
    edges = edges.unionByName(taint.select(F.col("source").alias("src"), F.col("sink").alias("dst"), F.when(F.size("sanitized_by") > 0, "sanitizes").otherwise("taints").alias("relation")).distinct())
    file_of = lambda c: F.regexp_extract(c, r"^([^:]*):", 1)
    taint = taint.withColumns({"source_file": file_of(F.element_at("path", 1)), "sink_file": file_of(F.element_at("path", -1))})
    return Graph(nodes, edges, taint)


def flow(taint: DataFrame) -> DataFrame:
    """taint with data_flow: source, sanitizers in between, sink, in order, as (role, name)."""
    step = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("name"))
    return taint.withColumn("data_flow", F.concat(F.array(step("source", F.col("source"))), F.transform("sanitized_by", lambda s: step("sanitizer", s)), F.array(step("sink", F.col("sink")))))


def nodes_of_kind(g: Graph, kind: str) -> DataFrame:
    return g.nodes.where(F.col("kind") == kind)


def edges_of(g: Graph, relation: str) -> DataFrame:
    return g.edges.where(F.col("relation") == relation)


def paths_to(g: Graph, sink_kind: str) -> DataFrame:
    return g.taint.where(F.col("sink_kind") == sink_kind)


def unguarded_endpoints(g: Graph) -> DataFrame:
    return g.nodes.where("kind = 'endpoint' and detail = 'unguarded'")


def save_graph(g: Graph, path: str) -> None:
    """The graph as three tables below a folder; one that is there already is not replaced."""
    for name in ("nodes", "edges", "taint"):
        getattr(g, name).write.mode("errorifexists").parquet(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str) -> Graph:
    return Graph(*(spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges", "taint")))


def head_graph(files: DataFrame, changes: DataFrame, catalog: C.Catalog = C.PYTHON) -> Graph:
    """A graph of the changed files alone, of their new side: neither deleted nor binary ones (changes: path, change, is_binary)."""
    live = changes.where("change <> 'deleted' and not is_binary").select("path")
    return build_graph(python_code.scan_paths(files, live)[0], catalog)


# -- what a profile lists ----------------------------------------------------------------------------------------------


def _route_name() -> Column:
    return F.when(F.col("route") != "", F.col("route")).otherwise(F.concat(F.lit("(unresolved:"), "name", F.lit(")")))


def access_matrix(ep: DataFrame) -> DataFrame:
    """A row for each endpoint: endpoint, http_method, controller, required_roles, auth_pattern, enforcement, file, line."""
    pattern = F.when(F.size("guards") > 0, F.concat(F.coalesce("guard_kind", F.lit("other")), F.lit(":"), F.col("guards")[0])).otherwise("none")
    method = F.when(F.size("methods") > 0, F.array_join("methods", ",")).otherwise("GET")
    return ep.select(_route_name().alias("endpoint"), method.alias("http_method"), F.col("name").alias("controller"), F.col("guards").alias("required_roles"), pattern.alias("auth_pattern"), F.when(F.col("guarded"), "enforced").otherwise("none").alias("enforcement"), F.col("path").alias("file"), "line")


def io_channels(ep: DataFrame) -> DataFrame:
    """name, kind, direction, authenticated, description, files, entry_symbols: the HTTP surface; other channels can't be seen in structure."""
    said = F.concat(F.array_join("methods", "/"), F.lit(" handled by "), "name", F.lit(" ("), "framework", F.lit(")"))
    return ep.select(_route_name().alias("name"), F.lit("http_api").alias("kind"), F.lit("inbound").alias("direction"), F.col("guarded").alias("authenticated"), said.alias("description"), F.array("path").alias("files"), F.array("name").alias("entry_symbols"))


def sensitive_fields(nodes: DataFrame) -> DataFrame:
    """name, classification, file, line of sensitive assignments."""
    return nodes.where("kind = 'sensitive_field'").select("name", F.col("detail").alias("classification"), "file", "line")


def signals(g: Graph, matrix: DataFrame) -> DataFrame:
    """path, kind, line, confidence: what graph (8) and profile (9) say about places; an endpoint that opens access is authz."""
    of_kind = F.when(F.col("kind") == "endpoint", "endpoint").when(F.col("kind").isin("source", "sink", "sanitizer", "sensitive_field"), F.col("kind"))
    own = g.nodes.select(F.col("file").alias("path"), of_kind.alias("kind"), F.coalesce("line", F.lit(0)).alias("line"), F.lit(8).alias("confidence")).where("kind is not null")
    guards = matrix.where(F.size("required_roles") > 0).select(F.col("file").alias("path"), F.lit("authz").alias("kind"), "line", F.lit(9).alias("confidence"))
    return own.unionByName(guards).distinct()


def file_facts(g: Graph, ep: DataFrame) -> DataFrame:
    """path, taint_lines (of either end of a path), sinks (line and class of every sink), unguarded_lines: sorted sets by file."""
    ends = g.taint.select(F.explode(F.array("source", "sink")).alias("id")).distinct().join(g.nodes, "id")
    none = F.lit(None)
    rows = ends.select(F.col("file").alias("path"), F.col("line").alias("taint"), none.cast("struct<line:int,class:string>").alias("sink"), none.cast("int").alias("open"))
    rows = rows.unionByName(nodes_of_kind(g, "sink").select(F.col("file").alias("path"), none.cast("int").alias("taint"), F.struct("line", F.col("detail").alias("class")).alias("sink"), none.cast("int").alias("open")))
    rows = rows.unionByName(ep.where("not guarded").select("path", none.cast("int").alias("taint"), none.cast("struct<line:int,class:string>").alias("sink"), F.col("line").alias("open")))
    sets = lambda c: F.array_sort(F.collect_set(c))
    return rows.groupBy("path").agg(sets("taint").alias("taint_lines"), sets("sink").alias("sinks"), sets("open").alias("unguarded_lines"))


# -- totals, drift and patching ----------------------------------------------------------------------------------------


def fingerprint_files(sizes: DataFrame, facts: DataFrame) -> DataFrame:
    """path, size, symbols, edges of every file (sizes: path, size).

    A caller's edges go to the first file (by path) with the stem of the caller's file, so that files of one stem share the first one's.
    """
    stem = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.py$", "")
    symbols = facts.where("kind in ('function', 'class')").groupBy("path").agg(F.count("*").alias("symbols"))
    callers = facts.where("kind = 'call' and holder is not null").select("path", "holder", "name").distinct().groupBy(stem(F.col("path")).alias("stem")).agg(F.count("*").alias("edges"))
    first = sizes.groupBy(stem(F.col("path")).alias("stem")).agg(F.min("path").alias("path")).join(callers, "stem").select("path", "edges")
    return sizes.select("path", "size").join(symbols, "path", "left").join(first, "path", "left").na.fill(0, ["symbols", "edges"])


def fingerprint_totals(files: DataFrame) -> DataFrame:
    """file_count, total_size, total_symbols, total_edges."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return files.agg(F.count("*").alias("file_count"), total("size").alias("total_size"), total("symbols").alias("total_symbols"), total("edges").alias("total_edges"))


def affected_paths(changes: DataFrame, recorded: DataFrame, now: DataFrame) -> DataFrame:
    """path, touched, evicted: files that the change touches or whose size is not the recorded one; deleted and renamed paths are evicted alone.

    changes: path, previous_path, change, is_binary; recorded and now: path, size. A recorded file that is gone counts as moved;
    a recorded size of 0 is unknown.
    """
    own = changes.where("not is_binary and change <> 'deleted'").select("path")
    r, n = recorded.select("path", F.col("size").alias("was")), now.select("path", F.col("size").alias("is"))
    moved = r.join(n, "path", "left").where("`is` is null or (was <> 0 and was <> `is`)").select("path")
    touched = own.union(moved).distinct().withColumn("touched", F.lit(True))
    gone = changes.where("change = 'deleted'").select("path").union(changes.where("change = 'renamed' and previous_path is not null").select("previous_path")).distinct().withColumn("evicted", F.lit(True))
    return touched.join(gone, "path", "full").na.fill(False, ["touched", "evicted"])


def action(decisions: DataFrame, has_checkout: Column, may_build: Column) -> DataFrame:
    """decisions (maps.drift_decision) with action: what is done when the decision can't be carried out.

    warm reuses. Without the files nothing can be built: a cached profile is reused although stale, else the profile is skipped.
    incremental patches; cold and rebuild build whole, or fall back likewise where building is switched off.
    """
    cached = F.col("has_profile")
    fall_back = F.when(cached, "stale_reuse").otherwise("skipped")
    can = has_checkout & (may_build | (F.col("decision") == "incremental"))
    chosen = first_precedence([(F.col("decision") == "warm", "reuse"), (can & (F.col("decision") == "incremental"), "patch"), (can, "build")], None)
    return decisions.withColumn("action", F.coalesce(chosen, fall_back))


def patch_graph(old: Graph, fresh: Graph, affected: DataFrame) -> Graph:
    """old without all that comes from affected paths, and the fresh graph of the touched ones; permissions that nothing refers to go."""
    paths = affected.select(F.col("path").alias("file")).distinct()
    gone = old.nodes.join(paths, "file", "left_semi").select("id")
    nodes = maps.splice(old.nodes, fresh.nodes, affected.select(F.col("path").alias("file")), ["file"])
    nodes = nodes.groupBy("id").agg(F.min(F.struct("kind", "file", "name", "line", "detail", "pattern")).alias("n")).select("id", "n.*")
    kept = old.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select(*old.edges.columns)
    edges = kept.unionByName(fresh.edges).distinct()
    taint = old.taint.join(paths.withColumnRenamed("file", "sink_file"), "sink_file", "left_anti").join(paths.withColumnRenamed("file", "source_file"), "source_file", "left_anti").select(*old.taint.columns)
    return Graph(maps.prune_orphans(nodes, edges, F.col("file") == ""), edges, taint.unionByName(fresh.taint).distinct())


def patch_matrix(old: DataFrame, fresh: DataFrame, affected: DataFrame) -> DataFrame:
    """The access matrix without rows of affected files, and the fresh rows."""
    return maps.splice(old, fresh, affected.select(F.col("path").alias("file")), ["file"])


def relifted(judged: DataFrame, fresh: DataFrame, affected: DataFrame) -> DataFrame:
    """file, controller of judged rows (of a model) of affected files that come back by structure alone; deleted endpoints are not among them."""
    dropped = judged.join(affected.select(F.col("path").alias("file")).distinct(), "file", "left_semi").select("file", "controller")
    return dropped.join(fresh.select("file", "controller").distinct(), ["file", "controller"], "left_semi").distinct()
