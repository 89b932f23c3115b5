"""Small dimension tables. Each is a fixed value of the data model, in natural order."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities by rank, bands of numeric scores, levels of scanner reports.
SEVERITIES = ("info", "low", "medium", "high", "critical")
SCORE_BANDS = ((9.0, "critical"), (7.0, "high"), (4.0, "medium"))
LEVELS = {"error": "high", "warning": "medium", "note": "low", "none": "info"}

# Languages by extension, and extensions of binary files.
LANGUAGES = {".py": "python", ".pyi": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".go": "go", ".rb": "ruby"}
BINARY_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".pdf", ".zip", ".gz", ".whl", ".so", ".dylib", ".class", ".jar", ".ico", ".woff", ".woff2")

# Phrases of generated headers, of which one of each kind has to stand in comment lines.
GENERATED_PHRASES = ("is generated", "was generated", "auto-generated", "autogenerated", "@generated", "generated via", "generated file")
EDIT_PHRASES = ("do not edit", "don't edit", "do not modify", "changes will be overwritten")
COMMENT_STARTS = ("#", "//", "/*", "*", "<!--", "--", ";", "!")
HEADER_LINES = 10

# Dependency files by name, with ecosystem and format, and formats that are locks.
DEPENDENCY_FILES = {
    "poetry.lock": ("pypi", "toml_lock"),
    "uv.lock": ("pypi", "toml_lock"),
    "pdm.lock": ("pypi", "toml_lock"),
    "pipfile.lock": ("pypi", "pipfile_lock"),
    "pipfile": ("pypi", "toml_pairs"),
    "pyproject.toml": ("pypi", "pyproject"),
    "setup.py": ("pypi", "requirements"),
    "setup.cfg": ("pypi", "requirements"),
    "package-lock.json": ("npm", "npm_lock"),
    "yarn.lock": ("npm", "yarn_lock"),
    "package.json": ("npm", "package_json"),
    "go.mod": ("go", "go_mod"),
    "go.sum": ("go", "go_sum"),
    "cargo.lock": ("crates.io", "toml_lock"),
    "composer.lock": ("packagist", "composer_lock"),
    "gemfile.lock": ("rubygems", "gemfile_lock"),
}
REQUIREMENTS = r"^(requirements.*|constraints.*)\.txt$"
LOCK_FORMATS = ("toml_lock", "pipfile_lock", "npm_lock", "yarn_lock", "go_sum", "composer_lock", "gemfile_lock")
LOCKFILES = tuple(n for n, (_, f) in DEPENDENCY_FILES.items() if f in LOCK_FORMATS)
MANIFESTS = tuple(n for n, (_, f) in DEPENDENCY_FILES.items() if f not in LOCK_FORMATS)

# Weakness groups of one parent; they are disjoint.
CWE_GROUPS = (
    ("CWE-77", "CWE-78"),
    ("CWE-94", "CWE-95"),
    ("CWE-22", "CWE-23", "CWE-35", "CWE-36"),
    ("CWE-285", "CWE-862", "CWE-863", "CWE-639"),
    ("CWE-798", "CWE-259"),
    ("CWE-326", "CWE-327", "CWE-328"),
    ("CWE-937", "CWE-1035", "CWE-1104", "CWE-1395"),
    ("CWE-79", "CWE-1336"),
    ("CWE-59", "CWE-61"),
)

# Touches, those that hold a file back from filtering, and the families that they route to.
TOUCH_KINDS = ("endpoint", "auth", "authz", "source", "sink", "sensitive_field", "config", "dependency")
GUARDRAIL_KINDS = ("endpoint", "auth", "authz", "source", "sink", "sensitive_field", "sanitizer", "permission")
ROUTES = (
    ("endpoint", "Broken Access Control"),
    ("authz", "Broken Access Control"),
    ("auth", "Authentication Failures"),
    ("sink", "Injection"),
    ("source", "Injection"),
    ("sensitive_field", "Privacy / PII"),
    ("config", "Security Misconfiguration"),
    ("dependency", "Software Supply Chain"),
)

# Limits.
GATE_FLOOR, GATE_CONFIDENCE = "high", 6
FILE_CHURN, EDGE_CHURN = 0.25, 0.15
MOST_FILES, MOST_HUNKS, MOST_ADDITIONS = 300, 2000, 20000
MOST_LINE_CHARS, SENTINEL_SNIPPET, FINDING_SNIPPET = 4000, 200, 400
TRIAGE_HUNKS, TRIAGE_CHARS = 60, 1200
TRUST_PENALTY, EDIT_WINDOW, MOST_HOPS, MOST_NEIGHBOURS = 2, 3, 4, 6


def lookup(key: Column, table: Mapping[str, object], default: object = None) -> Column:
    """A constant map as an expression: it needs no join and stays inside generated code."""
    out = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]
    return out if default is None else F.coalesce(out, F.lit(default))


def severity_rank(severity: Column) -> Column:
    return lookup(severity, {s: i for i, s in enumerate(SEVERITIES)})


def severity_of_score(score: Column, level: Column) -> Column:
    """By numeric score where there is one (over 0 low, else info), by report level otherwise, medium for others."""
    by_score = F
    for floor, name in SCORE_BANDS:
        by_score = by_score.when(score >= floor, name)
    by_score = by_score.when(score > 0, "low").otherwise("info")
    return F.when(score.isNotNull(), by_score).otherwise(lookup(F.lower(level), LEVELS, "medium"))


def capped(severity: Column, ceiling: str) -> Column:
    return F.when(severity_rank(severity) > SEVERITIES.index(ceiling), ceiling).otherwise(severity)


def cwe_group(cwe: Column) -> Column:
    """The number of its group, null outside of all."""
    return lookup(cwe, {c: i for i, g in enumerate(CWE_GROUPS) for c in g})
