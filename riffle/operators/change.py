"""Change analysis: signals by span, family routing, the three-tier filter, groups, escalation, context bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riffle.functions import tables as T
from riffle.functions import text as X
from riffle.operators.joins import first_precedence
from riffle.operators.scan import inert

# Path shapes that touch something, documents, and words of security tests.
PATH_SIGNALS = (
    ("**/settings.py", "config"),
    ("**/settings/*.py", "config"),
    ("**/config.py", "config"),
    ("**/urls.py", "endpoint"),
    ("**/routes.py", "endpoint"),
    ("**/middleware.py", "authz"),
    ("**/permissions.py", "authz"),
    ("**/auth.py", "auth"),
    ("**/authentication.py", "auth"),
    ("**/security.py", "authz"),
)
DOCUMENT_EXTENSIONS = (".md", ".rst", ".adoc", ".txt", ".text")
AUTHN_HINTS = ("login", "authenticate", "authentication", "jwt", "session", "token", "current_user", "oauth", "basic", "bearer", "api_key", "apikey", "mfa", "otp", "signin", "sign_in")
AUTHZ_TEST_TERMS = ("403", "forbidden", "permission", "unauthorized_access", "is_admin", "role", "authz", "access_denied", "no_access")
AUTHN_TEST_TERMS = ("401", "unauthorized", "login", "logged_in", "authenticate", "token", "session", "credential")
ASSERTIONS = ("assert", "status_code", "raises")


def authn_or_authz(name: Column) -> Column:
    return F.when(F.lower(name).rlike("|".join(AUTHN_HINTS)), "auth").otherwise("authz")


def path_signals(changes: DataFrame) -> DataFrame:
    """run_id, path, kind, line 0 and confidence of what a file's path and flags say by themselves."""
    shapes = F.array(*[F.when(F.lower("path").rlike(X.glob_regex(g, crosses_slash=True).replace(".*/", "(?:.*/)?", 1)), F.lit(k)) for g, k in PATH_SIGNALS], F.when(F.col("is_lockfile") | F.col("is_dep_manifest"), F.lit("dependency")), F.when(F.col("is_iac"), F.lit("config")))
    return changes.select("run_id", "path", F.explode(F.array_distinct(F.filter(shapes, lambda s: s.isNotNull()))).alias("kind")).withColumns({"line": F.lit(0), "confidence": F.lit(6)})


def signals_in(spans: DataFrame, signals: DataFrame) -> DataFrame:
    """spans (run_id, path, hunk_id, start, end) with touches (sorted) and the largest confidence of their signals.

    A signal on line 0 holds for the whole file, as do all for a span that is null; sanitizers and permissions are no touches.
    """
    s = signals.select(F.col("run_id").alias("__r"), F.col("path").alias("__p"), "kind", "line", F.col("confidence").alias("__c"))
    inside = (F.col("line") == 0) | F.col("start").isNull() | F.col("line").between(F.col("start"), F.col("end"))
    hit = spans.join(s, (F.col("run_id") == F.col("__r")) & (F.col("path") == F.col("__p")) & inside, "left")
    touch = F.when(F.col("kind").isin(*T.TOUCH_KINDS), F.col("kind"))
    return hit.groupBy(*spans.columns).agg(F.array_sort(F.collect_set(touch)).alias("touches"), F.max("__c").alias("signal_confidence"))


def edits_near(spans: DataFrame, edits: DataFrame) -> DataFrame:
    """spans (run_id, path, hunk_id, start, end) with edits: sorted kinds of the guard edits (run_id, path, kind, line) within EDIT_WINDOW lines.

    Removed lines are numbered in the old file, so that the window lets a deletion meet the hunk where it landed. A null span
    takes all edits of its file.
    """
    e = edits.select(F.col("run_id").alias("__r"), F.col("path").alias("__p"), F.col("kind").alias("__k"), F.col("line").alias("__at"))
    near = F.col("start").isNull() | F.col("__at").between(F.col("start") - T.EDIT_WINDOW, F.col("end") + T.EDIT_WINDOW)
    hit = spans.join(e, (F.col("run_id") == F.col("__r")) & (F.col("path") == F.col("__p")) & near, "left")
    return hit.groupBy(*spans.columns).agg(F.array_sort(F.collect_set("__k")).alias("edits"))


def rationale(touches: Column, why: Column, edits: Column, tainted: Column, weakened: Column, checklist: Column) -> Column:
    """Why a group stands out, in sentences: what it touches and by which signs, its guard edits (kind:name), taint, weakened tests, and the significant points."""
    surface = F.when(F.size(touches) > 0, F.concat(F.lit("touches "), F.array_join(F.array_sort(touches), ", "), F.lit(" ("), F.coalesce(F.nullif(why, F.lit("")), F.lit("path")), F.lit(")")))
    return F.concat_ws(
        ". ",
        F.coalesce(surface, F.lit("no security surface is known for this file")),
        F.when(F.size(edits) > 0, F.array_join(F.array_sort(F.array_distinct(edits)), "; ")),
        F.when(tainted, F.lit("a taint path passes through the changed lines")),
        F.when(weakened, F.lit("a security assertion was removed from a test")),
        F.when(F.size(checklist) > 0, F.concat(F.lit("significant: "), F.array_join(checklist, "; "))),
    )


def security_relevant(signals: DataFrame) -> DataFrame:
    return signals.where(F.col("kind").isin(*T.GUARDRAIL_KINDS)).select("run_id", "path").distinct()


def route_families(touches: Column, sinks: Column, tainted: Column) -> Column:
    """Sorted distinct families of a set of touches, classes of sinks and taint."""
    by_touch = [F.when(F.array_contains(touches, k), F.lit(f)) for k, f in T.ROUTES]
    log = F.array_contains(touches, "sensitive_field") & (F.array_contains(touches, "sink") | F.array_contains(sinks, "log"))
    more = [F.when(F.array_contains(sinks, "deserialize"), F.lit("Software/Data Integrity")), F.when(log, F.lit("Logging & Alerting")), F.when(tainted, F.lit("Injection"))]
    return F.array_sort(F.array_distinct(F.filter(F.array(*by_touch, *more), lambda f: f.isNotNull())))


def weakened_tests(changes: DataFrame, lines: DataFrame) -> DataFrame:
    """run_id, path, families of test files from which a security assertion was removed."""
    removed = lines.where("tag = '-'").join(changes.where("is_test").select("run_id", "path"), ["run_id", "path"])
    text = removed.groupBy("run_id", "path").agg(F.lower(F.array_join(F.collect_list("text"), "\n")).alias("t"))
    has = lambda terms: F.col("t").rlike("|".join(terms))
    families = F.filter(F.array(F.when(has(AUTHZ_TEST_TERMS), F.lit("Broken Access Control")), F.when(has(AUTHN_TEST_TERMS), F.lit("Authentication Failures"))), lambda f: f.isNotNull())
    return text.where(has(ASSERTIONS)).select("run_id", "path", families.alias("families")).where(F.size("families") > 0)


def filter_changes(changes: DataFrame, captured: DataFrame, formatting: DataFrame, relevant: DataFrame, flagged: DataFrame, weakened: DataFrame) -> DataFrame:
    """changes with decision (kept or dropped), reason, and guardrail_considered; by the first rule that applies.

    A file that the sentinel flagged, or a weakened test, is kept. Candidates to drop are binary, generated, documents,
    lockfiles whose churn is recorded, and formatting only. The guardrail keeps a candidate that is security-relevant, binaries
    excepted. All side tables have run_id and path.
    """
    out = changes
    for name, side in (("captured", captured), ("formatting", formatting), ("relevant", relevant), ("flagged", flagged), ("weakened", weakened)):
        out = out.join(side.select("run_id", "path").distinct().withColumn(f"__{name}", F.lit(True)), ["run_id", "path"], "left")
    is_document = X.extension(F.col("path")).isin(*DOCUMENT_EXTENSIONS) & ~F.col("is_dep_manifest") & ~F.col("is_lockfile") & ~F.col("is_iac")
    tier = F.when(F.col("is_binary"), "binary").when(F.col("is_generated"), "generated").when(is_document, "docs_only").when(F.col("is_lockfile") & F.col("__captured"), "lockfile_captured").when(F.col("__formatting"), "formatting_only")
    out = out.withColumn("__tier", tier)
    saved = F.col("__tier").isNotNull() & (F.col("__tier") != "binary") & F.col("__relevant")
    reason = first_precedence([(F.col("__flagged"), "sentinel"), (F.col("is_test") & F.col("__weakened"), "weakened_test"), (saved, "guardrail"), (F.col("__tier").isNotNull(), None)], "kept")
    reason = F.coalesce(reason, F.col("__tier"))
    kept = reason.isin("sentinel", "weakened_test", "guardrail", "kept")
    return out.select(*changes.columns, F.when(kept, "kept").otherwise("dropped").alias("decision"), reason.alias("reason"), F.when(~kept, F.col("__tier") != "binary").alias("guardrail_considered"))


def inert_hunks(changed: DataFrame, strings: DataFrame) -> DataFrame:
    """run_id, path, hunk_id of hunks whose changed lines are all blank or comments, none of the added ones inside a literal of several lines.

    changed: run_id, path, hunk_id, tag, new_ln, text; strings: path, start, end (python_code.string_lines of the new side).
    """
    lines = changed.where(F.col("tag").isin("+", "-"))
    inside = lines.where("tag = '+'").join(strings.select(F.col("path").alias("__p"), F.col("start").alias("__s"), F.col("end").alias("__e")), (F.col("path") == F.col("__p")) & F.col("new_ln").between(F.col("__s"), F.col("__e")), "left_semi")
    keys = ["run_id", "path", "hunk_id"]
    quiet = lines.groupBy(*keys).agg(F.every(inert(F.col("text"))).alias("q")).where("q").select(*keys)
    return quiet.join(inside.select(*keys).distinct(), keys, "left_anti")


def filter_stats(filtered: DataFrame) -> DataFrame:
    """run_id, decision, reason, n of filter_changes."""
    return filtered.groupBy("run_id", "decision", "reason").agg(F.count("*").alias("n"))


def triage_payload(hunks: DataFrame, most: int = T.TRIAGE_HUNKS, chars: int = T.TRIAGE_CHARS) -> DataFrame:
    """run_id, hunk_id, text of the first `most` hunks (by ordinal) of each run, each cut at `chars` characters: what a model is asked about."""
    first = F.row_number().over(Window.partitionBy("run_id").orderBy("ordinal"))
    return hunks.withColumn("__n", first).where(F.col("__n") <= most).select("run_id", "hunk_id", F.substring("text", 1, chars).alias("text"))


def triage_labels(replies: DataFrame, hunks: DataFrame) -> DataFrame:
    """run_id, hunk_id, label from replies (run_id, text): JSON objects by hunk id, fenced or bare; only yes, no and maybe about known hunks count."""
    bare = F.regexp_extract("text", r"(?s)(\{.*\})", 1)
    said = replies.select("run_id", F.explode(F.from_json(bare, "map<string,string>")).alias("hunk_id", "label")).withColumn("label", F.lower(F.trim("label")))
    return said.where(F.col("label").isin("yes", "no", "maybe")).join(hunks.select("run_id", "hunk_id").distinct(), ["run_id", "hunk_id"], "left_semi")


def apply_triage(kept: DataFrame, labels: DataFrame) -> DataFrame:
    """Hunks but those labelled "no" (run_id, hunk_id, label): anything else, or no label, keeps a hunk."""
    return kept.join(labels.where("label = 'no'").select("run_id", "hunk_id"), ["run_id", "hunk_id"], "left_anti")


def groups(hunks: DataFrame) -> DataFrame:
    """One group for each file and set of touches, with severity, confidence, kind and families.

    hunks: run_id, path, file_id, hunk_id, touches, signal_confidence, edits (kinds), sinks (classes), tainted, unguarded, weakened,
    is_test, is_iac, label. Edits add authz.
    """
    touched = F.array_sort(F.array_distinct(F.concat("touches", F.when((F.size("edits") > 0) | F.col("weakened"), F.array(F.lit("authz"))).otherwise(F.array().cast("array<string>")))))
    g = hunks.withColumn("touches", touched).groupBy("run_id", "path", "file_id", "touches").agg(
        F.array_sort(F.collect_list("hunk_id")).alias("hunk_ids"),
        F.max("signal_confidence").alias("c"),
        F.array_distinct(F.flatten(F.collect_list("edits"))).alias("edits"),
        F.array_distinct(F.flatten(F.collect_list("sinks"))).alias("sinks"),
        *(F.max(c).alias(c) for c in ("tainted", "unguarded", "weakened", "is_test", "is_iac")),
        F.array_sort(F.collect_set("label")).alias("labels"),
    )
    has = lambda *kinds: F.arrays_overlap("touches", F.array(*[F.lit(k) for k in kinds]))
    opened = F.arrays_overlap("edits", F.array(F.lit("guard_removed"), F.lit("access_opened")))
    severity = F.when(F.col("tainted") | F.col("unguarded") | opened, "high").when(F.size("touches") > 0, "medium").otherwise("low")
    confidence = F.coalesce(F.when(F.size("touches") > 0, F.col("c")), F.lit(5))
    confidence = F.when((F.size("edits") > 0) | F.col("weakened"), F.greatest(confidence, F.lit(7))).otherwise(confidence)
    confidence = F.when(F.col("labels") == F.array(F.lit("maybe")), F.least(confidence, F.lit(4))).otherwise(confidence)
    kind = F.when(has("endpoint", "auth", "authz", "source", "sink", "sensitive_field") | F.col("weakened"), "security").when(has("config", "dependency"), "architecture").when(F.col("is_test"), "quality").otherwise("convention")
    n = F.row_number().over(Window.partitionBy("run_id", "path").orderBy("touches")) - 1
    return g.select(
        "run_id", F.concat(F.substring("file_id", 1, 8), F.lit("-"), n.cast("string")).alias("id"), "path", "hunk_ids", "touches",
        route_families(F.col("touches"), F.col("sinks"), F.col("tainted")).alias("families"), kind.alias("kind"), severity.alias("projected_severity"), confidence.alias("confidence"),
        ((F.size("touches") > 0) | (F.size("edits") > 0) | F.col("is_iac") | F.col("weakened")).alias("significant"),
    )


def escalation(multi_hop: Column, guarded_endpoint: Column, control_flow: Column) -> Column:
    return first_precedence([(multi_hop, "multi_hop"), (guarded_endpoint, "full_file"), (control_flow, "full_file")], "none")


def bundles(slices: DataFrame, most_lines: int = 120) -> DataFrame:
    """run_id, group_id, slices (ordered, of at most most_lines lines each), number and characters of them."""
    cut = F.array_join(F.slice(F.split("text", "\n", -1), F.lit(1), F.lit(most_lines)), "\n")
    one = F.struct("ordinal", "path", "start", cut.alias("text"))
    return slices.groupBy("run_id", "group_id").agg(F.array_sort(F.collect_list(one)).alias("slices"), F.count("*").alias("n_slices"), F.sum(F.length(cut)).alias("slice_chars"))
