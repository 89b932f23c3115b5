"""Unified diffs as tables: files, hunks and numbered lines, by window functions over the lines of each diff."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riffle.functions import tables as T
from riffle.functions import text as X
from riffle.operators.scan import file_flags, language

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)$"


@dataclass
class Diff:
    """files (path, previous_path, change, binary), hunks (ranges, header) and lines (tag, old_ln, new_ln, text)."""

    files: DataFrame
    hunks: DataFrame
    lines: DataFrame


def _stripped(path: Column) -> Column:
    return F.regexp_replace(X.strip(path), "^[ab]/", "")


def read_diffs(diffs: DataFrame, key: str = "run_id", text: str = "text") -> Diff:
    """Parse every diff text. Null texts have no files.

    A hunk ends at the next line that begins with @@ or "diff --git ": lengths in its header are not used. Lines beginning with
    a backslash are skipped; what is neither + nor - is context. The b/ side of a file's header names it, deletions
    included. After a malformed hunk header, what follows in its file is skipped unless another header comes at once.
    """
    # what files and hunks reset is a difference from their header's running value, so that one sort by line serves every window
    every = diffs.select(F.col(key), F.posexplode(X.split_lines(F.col(text))).alias("at", "line"))
    line = F.col("line")
    every = every.withColumns({"is_file": F.startswith(line, F.lit("diff --git ")), "is_at": F.startswith(line, F.lit("@@"))})
    tag = F.when(F.substring(line, 1, 1).isin("+", "-"), F.substring(line, 1, 1)).otherwise(" ")
    every = every.withColumns({"good": F.col("is_at") & line.rlike(HUNK), "tag": F.when(~F.col("is_at") & ~F.startswith(line, F.lit("\\")), tag)})
    in_order = Window.partitionBy(key).orderBy("at")
    up_to = in_order.rowsBetween(Window.unboundedPreceding, 0)
    so_far = lambda when: F.count(F.when(when, 1)).over(up_to)
    latest = lambda when: F.max(F.when(when, F.col("at"))).over(up_to)
    every = every.withColumns({"file_no": so_far(F.col("is_file")), "file_at": latest(F.col("is_file")), "hunks": so_far(F.col("good")), "hunk_at": latest(F.col("is_at")), "o": so_far(F.col("tag") != "+"), "n": so_far(F.col("tag") != "-"), "after_bad": F.lag(F.col("is_at") & ~F.col("good")).over(in_order)}).where("file_no > 0")
    in_head = F.coalesce(F.col("hunk_at") < F.col("file_at"), F.lit(True))

    head = every.where(in_head)
    change = F.when(F.startswith(line, F.lit("new file mode")), "added").when(F.startswith(line, F.lit("deleted file mode")), "deleted").when(line.rlike("^rename (from|to) "), "renamed")
    last = lambda value: F.max_by(value, F.when(value.isNotNull(), F.col("at")))
    after = lambda prefix: F.when(F.startswith(line, F.lit(prefix)), F.substring(line, len(prefix) + 1, 1 << 30))
    named = lambda side: F.nullif(F.regexp_extract(line, "^diff --git a/(.+) b/(.+)$", side), F.lit(""))
    files = head.groupBy(key, "file_no").agg(
        F.max(F.when(F.col("is_file"), named(1))).alias("a"),
        F.max(F.when(F.col("is_file"), named(2))).alias("b"),
        last(change).alias("c"),
        last(X.strip(after("rename from "))).alias("previous_path"),
        last(_stripped(after("--- "))).alias("minus"),
        last(_stripped(after("+++ "))).alias("plus"),
        F.max(line.rlike("^Binary files|^GIT binary patch")).alias("binary"),
    )
    real = lambda c: F.when(F.col(c) != "/dev/null", F.col(c))
    path = F.coalesce("b", real("plus"), real("minus"), "a", F.lit("UNKNOWN"))
    files = files.select(
        key,
        "file_no",
        path.alias("path"),
        "previous_path",
        F.when(F.col("plus") == "/dev/null", "deleted").when(F.col("minus") == "/dev/null", "added").otherwise(F.coalesce("c", F.lit("modified"))).alias("change"),
        "binary",
    )
    # a line has its file's path and its hunk's starts from the running windows: a join could broadcast the lines
    number = lambda i, default: F.coalesce(F.nullif(F.regexp_extract(line, HUNK, i), F.lit("")).cast("int"), F.lit(default))
    last_of = lambda when, *values: F.last(F.when(when, F.struct(*values)), ignorenulls=True).over(up_to)
    said = lambda value: last_of(in_head & value.isNotNull(), F.col("file_no"), value.alias("is"))
    broken = ~F.col("is_at") & ~F.col("is_file") & F.col("after_bad")
    known = every.withColumns({
        "file": last_of(F.col("is_file"), named(1).alias("a"), named(2).alias("b"), "hunks"), "minus": said(_stripped(after("--- "))), "plus": said(_stripped(after("+++ "))), "broken_at": latest(broken),
        "hunk": last_of(F.col("good"), "o", "n", number(1, 0).alias("old_start"), number(3, 0).alias("new_start")),
    })
    own = lambda c: F.when(F.col(f"{c}.file_no") == F.col("file_no"), F.col(f"{c}.is"))
    alive = known.withColumns({"hunk_no": F.col("hunks") - F.col("file.hunks"), "dead": F.coalesce(F.col("broken_at") > F.col("file_at"), F.lit(False)), "a": F.col("file.a"), "b": F.col("file.b"), "minus": own("minus"), "plus": own("plus")})
    alive = alive.where("hunk_no > 0 and not dead").withColumn("path", path)
    hunks = alive.where("good").select(key, "file_no", "hunk_no", number(1, 0).alias("old_start"), number(2, 1).alias("old_len"), number(3, 0).alias("new_start"), number(4, 1).alias("new_len"), X.strip(F.regexp_extract(line, HUNK, 5)).alias("header"), "path")
    nth = lambda side: F.col(f"hunk.{side}_start") + F.col(side[0]) - F.col(f"hunk.{side[0]}") - 1
    lines = alive.where("tag is not null").select(
        key, "path", "file_no", "hunk_no", F.col("at").alias("seq"), "tag",
        F.when(F.col("tag") != "+", nth("old")).cast("int").alias("old_ln"),
        F.when(F.col("tag") != "-", nth("new")).cast("int").alias("new_ln"),
        F.substring(line, 2, 1 << 30).alias("text"),
    )
    return Diff(files, hunks, lines)


def side(lines: DataFrame, which: str) -> DataFrame:
    """Lines of the old (context and removed) or the new side (context and added)."""
    return lines.where(F.col("tag").isin(" ", "-" if which == "old" else "+"))


def touched_spans(diff: Diff, key: str = "run_id") -> DataFrame:
    """key, path, start, end: the new side of each hunk; none for a hunk without new lines."""
    return diff.hunks.where("new_len > 0").select(key, "path", F.col("new_start").alias("start"), (F.col("new_start") + F.col("new_len") - 1).alias("end"))


def manifest(diff: Diff, heads: DataFrame | None = None, key: str = "run_id") -> DataFrame:
    """file_change rows: id, language, flags and size of every file; heads (key, path, head) are the first bytes where known."""
    sizes = diff.lines.groupBy(key, "path").agg(F.count(F.when(F.col("tag") == "+", 1)).alias("additions"), F.count(F.when(F.col("tag") == "-", 1)).alias("deletions"))
    known = heads.select(key, "path", "head") if heads is not None else None
    files = diff.files if known is None else diff.files.join(known, [key, "path"], "left")
    flags = file_flags(F.col("path"), None if known is None else F.col("head"))
    flags["is_binary"] = flags["is_binary"] | F.col("binary")
    out = files.select(key, "file_no", "path", X.file_id(F.col("path")).alias("file_id"), "previous_path", "change", language(F.col("path")).alias("lang"), *(c.alias(k) for k, c in flags.items()))
    return out.join(sizes, [key, "path"], "left").na.fill(0, ["additions", "deletions"])


def totals(changes: DataFrame, diff: Diff, key: str = "run_id") -> DataFrame:
    """files, hunks, additions, deletions and oversize of every change; limits are strict."""
    hunks = diff.hunks.groupBy(key).agg(F.count("*").alias("hunks"))
    out = changes.groupBy(key).agg(F.count("*").alias("files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions")).join(hunks, key, "left").na.fill(0, ["hunks"])
    return out.withColumn("oversize", (F.col("files") > T.MOST_FILES) | (F.col("hunks") > T.MOST_HUNKS) | (F.col("additions") > T.MOST_ADDITIONS))
