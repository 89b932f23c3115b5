"""Scanner reports: SARIF results, OSV packages, replies of a model, stored runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle.functions import tables as T
from riffle.functions import text as X

SARIF = """struct<runs: array<struct<
  tool: struct<driver: struct<rules: array<struct<id: string, defaultConfiguration: struct<level: string>, properties: map<string, string>>>>>,
  results: array<struct<ruleId: string, ruleIndex: int, level: string, message: struct<text: string>, properties: map<string, string>,
    locations: array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int, endLine: int, snippet: struct<text: string>>>>>>>>>>"""
OSV = """struct<results: array<struct<source: struct<path: string>, packages: array<struct<package: struct<name: string, version: string>,
  groups: array<struct<max_severity: string>>,
  vulnerabilities: array<struct<id: string, aliases: array<string>, summary: string, details: string, severity: array<struct<score: string>>, database_specific: struct<severity: string>,
    affected: array<struct<package: struct<name: string>, ranges: array<struct<events: array<struct<fixed: string>>>>>>>>>>>>>"""
REPLY = "struct<findings: array<struct<file: string, start_line: int, end_line: int, cwe: string, severity: string, title: string, why: string>>>"


def json_part(text: Column) -> Column:
    """From the first brace on: tools print banners before their report."""
    at = F.instr(text, "{")
    return F.when(at > 1, F.substr(text, at)).otherwise(text)


def relative(uri: Column, root: str | None) -> Column:
    out = F.regexp_replace(X.strip(F.coalesce(uri, F.lit(""))), "^file://", "")
    if root:
        out = F.when(F.startswith(out, F.lit(root.rstrip("/"))), F.substr(out, F.lit(len(root.rstrip("/")) + 1))).otherwise(out)
    return F.regexp_replace(out, "^/+", "")


def read_sarif(reports: DataFrame, key: str = "run_id", text: str = "text", root: str | None = None) -> DataFrame:
    """key, run_no, result_no and the flat fields of every result; fields that are missing get defaults.

    Rules are found by id, else by index; a result's properties overlay its rule's. Text that is no JSON gives no rows.
    """
    doc = reports.select(key, F.from_json(json_part(F.col(text)), SARIF).alias("d"))
    runs = doc.select(key, F.posexplode("d.runs").alias("run_no", "run"))
    res = runs.select(key, "run_no", F.coalesce(F.col("run.tool.driver.rules"), F.array().cast("array<struct<id:string,defaultConfiguration:struct<level:string>,properties:map<string,string>>>")).alias("rules"), F.posexplode("run.results").alias("result_no", "r"))
    by_index = F.when(F.col("r.ruleIndex") >= 0, F.get("rules", F.col("r.ruleIndex")))["id"]
    rule_id = F.coalesce(F.nullif(F.col("r.ruleId"), F.lit("")), by_index, F.lit(""))
    res = res.withColumn("rule_id", rule_id).withColumn("rule", F.element_at(F.concat(F.filter("rules", lambda x: x["id"] == F.col("rule_id")), F.array(F.lit(None).cast("struct<id:string,defaultConfiguration:struct<level:string>,properties:map<string,string>>"))), 1))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    own, base = F.coalesce("r.properties", none), F.coalesce("rule.properties", none)
    props = F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k)), own)
    place = F.get("r.locations", F.lit(0))["physicalLocation"]
    start = F.coalesce(place["region"]["startLine"], F.lit(0))
    return res.withColumn("properties", props).select(
        key, "run_no", "result_no", "rule_id",
        X.strip(F.coalesce("r.message.text", F.lit(""))).alias("message"),
        relative(place["artifactLocation"]["uri"], root).alias("path"),
        start.alias("start_line"),
        F.coalesce(F.nullif(place["region"]["endLine"], F.lit(0)), start).alias("end_line"),
        F.coalesce(F.nullif(F.col("r.level"), F.lit("")), F.nullif(F.col("rule.defaultConfiguration.level"), F.lit("")), F.lit("warning")).alias("level"),
        F.expr("try_cast(element_at(properties, 'security-severity') as double)").alias("security_severity"),
        X.strip(F.coalesce(place["region"]["snippet"]["text"], F.lit(""))).alias("snippet"),
        "properties",
    )


def read_osv(reports: DataFrame, key: str = "run_id", text: str = "text", root: str | None = None) -> DataFrame:
    """One row for each vulnerable package: path, name, version, ids, cves, severity, vector, best fix, headline."""
    doc = reports.select(key, F.from_json(json_part(F.col(text)), OSV).alias("d"))
    pk = doc.select(key, F.explode("d.results").alias("s")).select(key, relative(F.col("s.source.path"), root).alias("path"), F.explode("s.packages").alias("p"))
    pk = pk.withColumn("v", F.col("p.vulnerabilities")).where(F.size("v") > 0)
    name = X.strip(F.coalesce("p.package.name", F.lit("")))
    label = F.transform("v", lambda v: F.lower(v["database_specific"]["severity"]))
    label_rank = F.transform(label, lambda s: T.severity_rank(F.when(s == "moderate", "medium").otherwise(s)))
    score = F.transform(F.coalesce("p.groups", F.array().cast("array<struct<max_severity:string>>")), lambda g: F.try_to_number(g["max_severity"], F.lit("99.99")).cast("double"))
    score_rank = F.transform(score, lambda x: F.when(x >= 9, 4).when(x >= 7, 3).when(x >= 4, 2).when(x.isNotNull(), 1))
    worst = F.coalesce(F.greatest(F.array_max(label_rank), F.array_max(score_rank)), F.lit(2))
    vectors = F.filter(F.flatten(F.transform("v", lambda v: F.transform(F.coalesce(v["severity"], F.array().cast("array<struct<score:string>>")), lambda s: s["score"]))), lambda s: F.startswith(s, F.lit("CVSS:")))
    mine = lambda a: F.coalesce(a["package"]["name"], F.lit("")).isin("") | (F.lower(a["package"]["name"]) == F.lower(name))
    empty = lambda kind: F.array().cast(kind)
    events = "array<struct<fixed:string>>"
    ranges = f"array<struct<events:{events}>>"
    affected = f"array<struct<package:struct<name:string>,ranges:{ranges}>>"
    of_range = lambda r: F.transform(F.coalesce(r["events"], empty(events)), lambda e: e["fixed"])
    of_affected = lambda a: F.flatten(F.transform(F.coalesce(a["ranges"], empty(ranges)), of_range))
    fixes = F.filter(F.flatten(F.transform("v", lambda v: F.flatten(F.transform(F.filter(F.coalesce(v["affected"], empty(affected)), mine), of_affected)))), lambda f: f.isNotNull() & (f != ""))
    best = F.array_max(F.transform(fixes, lambda f: F.struct(X.version_key(f).alias("k"), f.alias("f"))))["f"]
    said = F.filter(F.transform("v", lambda v: X.strip(F.coalesce(F.nullif(v["summary"], F.lit("")), v["details"], F.lit("")))), lambda s: s != "")
    return pk.select(
        key, "path", name.alias("name"), X.strip(F.coalesce("p.package.version", F.lit(""))).alias("version"),
        F.filter(F.transform("v", lambda v: v["id"]), lambda x: x.isNotNull()).alias("ids"),
        F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform("v", lambda v: F.coalesce(v["aliases"], empty("array<string>")))), lambda a: F.startswith(a, F.lit("CVE-"))))).alias("cves"),
        T.lookup(worst, dict(enumerate(T.SEVERITIES))).alias("severity"),
        F.get(vectors, F.lit(0)).alias("vector"), best.alias("fixed"), F.substring(F.get(said, F.lit(0)), 1, 200).alias("headline"),
    )


def changed_packages_only(packages: DataFrame, deltas: DataFrame, first_party: DataFrame, key: str = "run_id") -> DataFrame:
    """packages with status: first_party (by key, path, name), out_of_delta (not added or changed), or reported; case-insensitive."""
    own = first_party.select(key, "path", F.lower("name").alias("__n")).distinct().withColumn("__own", F.lit(True))
    new = deltas.where("kind in ('added', 'changed')").select(key, F.lower("name").alias("__n")).distinct().withColumn("__new", F.lit(True))
    out = packages.withColumn("__n", F.lower("name")).join(own, [key, "path", "__n"], "left").join(new, [key, "__n"], "left")
    status = F.when(F.col("__own"), "first_party").when(F.col("__new").isNull(), "out_of_delta").otherwise("reported")
    return out.withColumn("status", status).select(*packages.columns, "status")


def read_replies(replies: DataFrame, key: str = "case_id", text: str = "text") -> DataFrame:
    """Rows of JSON replies, fenced or bare, with note: why a row is unusable (null if it is usable)."""
    fenced = F.regexp_extract(F.col(text), r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    bare = F.regexp_extract(F.col(text), r"(?s)(\{.*\})", 1)
    doc = replies.select(key, F.from_json(F.when(fenced != "", fenced).otherwise(bare), REPLY).alias("d"))
    rows = doc.select(key, F.posexplode_outer("d.findings").alias("ordinal", "f"))
    note = F.when(F.col("f").isNull(), "no findings").when(F.coalesce("f.file", F.lit("")) == "", "no file").when(F.coalesce("f.start_line", F.lit(0)) < 1, "no line").when(~F.lower("f.severity").isin(*T.SEVERITIES), "unknown severity")
    return rows.select(key, "ordinal", "f.*", note.alias("note")).withColumns({"end_line": F.coalesce("end_line", "start_line"), "cwe": X.normalized_cwe(F.col("cwe"))})


def load_versioned(spark: SparkSession, path: str, schema: str, version: int, column: str = "dump_version") -> DataFrame:
    """JSON documents of exactly this version; any other stops the query."""
    rows = spark.read.schema(schema).json(path, multiLine=True)
    ok = F.when(F.col(column).eqNullSafe(F.lit(version)), F.col(column)).otherwise(F.raise_error(F.lit(f"{column} is not {version}")).cast("int"))
    return rows.withColumn(column, ok)
