"""Dependency files in diffs: names and versions of either side, and their difference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riffle.functions import tables as T
from riffle.functions import text as X
from riffle.operators.maps import changes

# Requirement lines, keys that are no packages, shapes of version values; so are the patterns of the formats below.
REQUIREMENT = r"""^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*(?:([=<>!~^]{1,2}=?)\s*([^\s;,#\]"']+))?"""
NOT_REQUIREMENTS = r"^(-|#|git\+|http://|https://|\./|/|file:)"
NO_PACKAGES = ("name", "version", "description", "readme", "license", "authors", "requires-python", "python", "homepage", "repository", "documentation", "build-backend", "package-mode", "content-hash", "lock-version")
VERSION_VALUE = r"^(?:[\^~><=v]*\d|\*$|latest$|next$|(?:npm|git|github|file|link|workspace|portal):)"


def _entry(name: Column, version: Column, when: Column) -> Column:
    return F.when(when & (name != ""), F.struct(name.alias("name"), version.alias("version")))


def _requirement(line: Column) -> Column:
    s = X.strip(F.substring_index(line, "#", 1))
    return _entry(F.regexp_extract(s, REQUIREMENT, 1), F.regexp_extract(s, REQUIREMENT, 3), ~s.rlike(NOT_REQUIREMENTS))


def _pair(line: Column) -> Column:
    p = r'^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*=\s*[{"]?([^",}]*)'
    name = F.regexp_extract(line, p, 1)
    return _entry(name, X.strip(F.regexp_extract(line, p, 2)), ~F.lower(name).isin(*NO_PACKAGES))


def single_line(line: Column, table: Column) -> dict[str, Column]:
    """By format: the (name, version) that a line gives by itself. table: the last TOML table header in its hunk."""
    quoted = X.strip(line).rlike("^[\"']")
    inner = F.regexp_replace(F.regexp_replace(X.strip(line), "^,+|,+$", ""), "^[\"']+|[\"']+$", "")
    j = r'^\s*"([^"]+)"\s*:\s*"([^"]*)"'
    g = r"^\s*(?:require\s+)?([\w.\-]+/[\w.\-/~]+)\s+(v[\w.\-+]+)"
    words = F.filter(F.split(line, r"\s+"), lambda w: w != "")
    gem = r"^ {4,}([A-Za-z0-9][\w.-]*) \((\d[^)]*)\)\s*$"
    go = F.substring_index(line, "//", 1)
    return {
        "requirements": _requirement(line),
        "pyproject": F.when(X.strip(line).rlike(r"^\["), None).when(quoted, _requirement(inner)).when(F.contains(F.coalesce(table, F.lit("")), F.lit("dependencies")), _pair(line)),
        "toml_pairs": _pair(line),
        "package_json": _entry(F.regexp_extract(line, j, 1), F.regexp_extract(line, j, 2), ~F.lower(F.regexp_extract(line, j, 1)).isin(*NO_PACKAGES) & F.regexp_extract(line, j, 2).rlike(VERSION_VALUE)),
        "go_mod": _entry(F.regexp_extract(go, g, 1), F.regexp_extract(go, g, 2), F.lit(True)),
        "go_sum": _entry(F.coalesce(F.get(words, F.lit(0)), F.lit("")), F.regexp_replace(F.coalesce(F.get(words, F.lit(1)), F.lit("")), r"/go\.mod$", ""), F.startswith(F.coalesce(F.get(words, F.lit(1)), F.lit("")), F.lit("v"))),
        "gemfile_lock": _entry(F.regexp_extract(line, gem, 1), F.regexp_extract(line, gem, 2), F.lit(True)),
    }


def block(line: Column) -> dict[str, tuple[Column, Column]]:
    """By format: the name that a line opens a block with, and the version that a line closes it with (null if it doesn't)."""
    got = lambda p: F.nullif(F.regexp_extract(line, p, 1), F.lit(""))
    quoted = F.when(line.rlike(r'^\s*"version"\s*:\s*"[^"]*"'), F.regexp_extract(line, r'^\s*"version"\s*:\s*"([^"]*)"', 1))
    key = got(r'^\s*"([^"]+)"\s*:\s*\{')
    top = F.startswith(F.regexp_replace(line, r"\s", " "), F.lit(" "))
    name = F.regexp_replace(X.strip(F.substring_index(F.regexp_replace(line, r"[\s:]+$", ""), ",", 1)), "^[\"']+|[\"']+$", "")
    yarn = F.when((line != "") & ~top & line.rlike(r":\s*$"), F.regexp_replace(name, "(?<=.)@[^@]*$", ""))
    return {
        "toml_lock": (got(r'^\s*name\s*=\s*"([^"]+)"'), got(r'^\s*version\s*=\s*"([^"]+)"')),
        "pipfile_lock": (got(r'^\s*"([^"]+)"\s*:\s*\{\s*$'), F.regexp_replace(quoted, "^=+", "")),
        "npm_lock": (F.when(~key.isin("dependencies", "packages", "devDependencies", "peerDependencies"), F.element_at(F.split(key, "node_modules/", -1), -1)), F.when(key.isNull(), quoted)),
        "yarn_lock": (yarn, F.when(yarn.isNull(), got(r'^\s*version\s*[:"]?\s*"?([^"\s]+)"?'))),
        "composer_lock": (got(r'^\s*"name"\s*:\s*"([A-Za-z0-9][\w.-]*/[A-Za-z0-9][\w.-]*)"'), quoted),
    }


def format_of(path: Column) -> dict[str, Column]:
    """ecosystem and format by file name; null for other files."""
    name = F.lower(X.base_name(path))
    look = lambda n, i: T.lookup(n, {k: v[i] for k, v in T.DEPENDENCY_FILES.items()})
    kind = lambda n: F.struct(F.coalesce(look(n, 0), F.when(n.rlike(T.REQUIREMENTS), "pypi")).alias("ecosystem"), F.coalesce(look(n, 1), F.when(n.rlike(T.REQUIREMENTS), "requirements")).alias("format"))
    one = F.get(F.transform(F.array(name), kind), F.lit(0))  # else the name is made anew for each comparison
    return {"ecosystem": one["ecosystem"], "format": one["format"]}


def side_versions(lines: DataFrame, key: str = "run_id") -> DataFrame:
    """key, path, ecosystem, name, old, new, __b and __a of the lines of a diff: the first version of each package on either side counts.

    A block's name waits for the first version after it on the same side of the same hunk, and is used up by it. __b and __a are
    null where a side hasn't the package. Both sides are read in one pass, in the order that lines have.
    """
    found = lines.withColumns(format_of(F.col("path"))).where("format is not null")
    line = F.col("text")
    in_order = Window.partitionBy(key).orderBy("seq")
    up_to, before = in_order.rowsBetween(Window.unboundedPreceding, 0), in_order.rowsBetween(Window.unboundedPreceding, -1)
    header = F.when(X.strip(line).rlike(r"^\["), F.lower(F.regexp_replace(X.strip(line), r"^[\[\]]+|[\[\]]+$", "")))
    pick = lambda table: F.coalesce(*[F.when(F.col("format") == k, c) for k, c in table.items()])
    blocks = block(line)
    found = found.withColumns({"__header": header, "__open": pick({k: v[0] for k, v in blocks.items()}), "__close": pick({k: v[1] for k, v in blocks.items()})})
    sides = {"old": F.col("tag") != "+", "new": F.col("tag") != "-"}
    last = lambda on, c: F.last(F.when(on & F.col(c).isNotNull(), F.struct("file_no", "hunk_no", "seq", F.col(c).alias("is"))), ignorenulls=True).over(up_to)
    waits = {f"__{c}_{k}": last(on, f"__{c}") for k, on in sides.items() for c in ("header", "open")}
    used = {f"__used_{k}": F.max(F.when(on & F.col("__close").isNotNull(), F.col("seq"))).over(before) for k, on in sides.items()}
    found = found.withColumns(waits | used)

    def entry(k: str) -> Column:
        here = lambda c: (F.col(f"{c}.file_no") == F.col("file_no")) & (F.col(f"{c}.hunk_no") == F.col("hunk_no"))
        unused = F.coalesce(F.col(f"__used_{k}") < F.col(f"__open_{k}.seq"), F.lit(True))
        closed = F.when(F.col("__close").isNotNull() & F.col("__open").isNull() & here(f"__open_{k}") & unused, F.struct(F.col(f"__open_{k}.is").alias("name"), F.col("__close").alias("version")))
        table = F.when(here(f"__header_{k}"), F.col(f"__header_{k}.is"))
        return F.when(sides[k], F.coalesce(pick(single_line(line, table)), closed))

    entries = found.select(key, "path", "ecosystem", "hunk_no", "seq", F.explode(F.array(*(F.struct(F.lit(k).alias("side"), entry(k).alias("e")) for k in sides))).alias("x")).where("x.e is not null")
    named = entries.select(key, "path", "ecosystem", X.normalized_package(F.col("x.e.name"), F.col("ecosystem")).alias("name"), X.strip(F.col("x.e.version")).alias("version"), "x.side", F.struct("hunk_no", "seq").alias("__at")).where("name <> ''")
    first = lambda k: F.min_by("version", F.when(F.col("side") == k, F.col("__at"))).alias(k)
    there = lambda k: F.max(F.when(F.col("side") == k, True))
    return named.groupBy(key, "path", "ecosystem", "name").agg(first("old"), first("new"), there("old").alias("__b"), there("new").alias("__a"))


def dep_deltas(lines: DataFrame, key: str = "run_id") -> DataFrame:
    """key, path, ecosystem, name, kind (added, removed, changed), old, new of every dependency file in the diff."""
    return changes(side_versions(lines, key), [key, "path", "ecosystem", "name"])
