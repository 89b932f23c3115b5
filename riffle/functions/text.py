"""Text functions with the exact semantics that findings need, as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line boundaries besides CR LF, and white space, in the Unicode sense.
LINE_ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
SPACE_CLASS = "[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def split_lines(text: Column) -> Column:
    """Lines of a text: every Unicode line boundary ends one, and no empty line follows the last boundary."""
    ended = F.regexp_replace(text, "\r\n|[" + LINE_ENDS + "]", "\n")
    parts = F.split(ended, "\n", -1)
    n = F.size(parts)
    return F.when(text.isNull(), None).when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), n - 1)).otherwise(parts)


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(text, F.lit(SPACES))


def collapsed(text: Column) -> Column:
    """Lower case, white space collapsed: the form of a snippet that fingerprints use."""
    return F.trim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+", " ")))


def fingerprint(*parts: Column) -> Column:
    """First 16 hex digits of SHA-1 over the parts joined by pipes; nulls count as empty. Holds no line number."""
    return F.substring(F.sha1(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary")), 1, 16)


def normalized_path(path: Column) -> Column:
    """Forward slashes, without leading ./ or slashes."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)*/*", "")


def file_id(path: Column) -> Column:
    return F.substring(F.sha1(path.cast("binary")), 1, 12)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def extension(path: Column) -> Column:
    """With its dot, in lower case; empty if the name has none."""
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1))


def suffix_match(name: Column, pattern: Column) -> Column:
    """Equal, or ends with a dot and the pattern."""
    return (name == pattern) | F.endswith(name, F.concat(F.lit("."), pattern))


def segment_match(name: Column, term: Column) -> Column:
    """The term's underscore segments follow each other in the name's."""
    return F.instr(F.concat(F.lit("_"), F.lower(name), F.lit("_")), F.concat(F.lit("_"), term, F.lit("_"))) > 0


def normalized_cwe(cwe: Column) -> Column:
    """CWE-n from n, cwe-n, CWE_n or CWEn; empty for nothing."""
    s = F.translate(F.upper(strip(F.coalesce(cwe, F.lit("")))), "_", "-")
    return F.when(s == "", "").when(F.startswith(s, F.lit("CWE-")), s).when(F.startswith(s, F.lit("CWE")), F.concat(F.lit("CWE-"), F.regexp_replace(F.substring(s, 4, 1 << 20), "^-+", ""))).otherwise(F.concat(F.lit("CWE-"), s))


def normalized_package(name: Column, ecosystem: Column) -> Column:
    """Lower case with runs of - _ . as one dash for pypi; other ecosystems keep the name."""
    return F.when(ecosystem == "pypi", F.regexp_replace(F.lower(name), r"[-_.]+", "-")).otherwise(name)


def version_key(version: Column) -> Column:
    """An array that orders versions: numeric segments by value, above non-numeric ones, which go by text."""
    parts = F.split(version, r"[.\-]", -1)
    number = lambda p: F.when(p.rlike("^[0-9]{1,18}$"), p.cast("long"))
    return F.transform(parts, lambda p: F.struct(number(p).isNotNull().alias("numeric"), F.coalesce(number(p), F.lit(0).cast("long")).alias("n"), F.when(number(p).isNull(), p).otherwise("").alias("text")))


def glob_regex(pattern: str, crosses_slash: bool) -> str:
    """A regular expression for a glob; `*` crosses slashes in one dialect, `**` alone does in the other."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if not crosses_slash and pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif c == "*":
            stars = len(pattern[i:]) - len(pattern[i:].lstrip("*"))
            out, i = out + (".*" if crosses_slash or stars > 1 else "[^/]*"), i + stars
        elif c == "?":
            out, i = out + ("." if crosses_slash else "[^/]"), i + 1
        else:
            out, i = out + re.escape(c), i + 1
    return f"(?s)^{out}$"


def span_of(text: Column) -> Column:
    """(start, end) of "a-b" or "a"; null if it is neither."""
    lo, hi = F.regexp_extract(text, r"^(\d+)(?:-\d+)?$", 1), F.regexp_extract(text, r"^\d+-(\d+)$", 1)
    return F.when(lo != "", F.struct(lo.cast("int").alias("start"), F.when(hi != "", hi).otherwise(lo).cast("int").alias("end")))


def fenced(text: Column, marker: str, replacement: str) -> Column:
    """Between two marker lines, with markers inside made harmless."""
    return F.concat(F.lit(marker + "\n"), F.replace(text, F.lit(marker), F.lit(replacement)), F.lit("\n" + marker))


def html_escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def iso_date(text: Column) -> Column:
    """The day of an ISO date or time stamp, in UTC where it has an offset; null for anything else."""
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))
    stamp = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), F.to_utc_timestamp(text.try_cast("timestamp"), F.current_timezone()).cast("date"))
    return F.coalesce(day, stamp)
