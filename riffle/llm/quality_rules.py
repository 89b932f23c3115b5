"""Quality rules as a learned decision list over document statistics.

Statistics of whole texts are made in one pass. Sequential covering then learns, on a bounded labelled sample, rules that
reject: each is a conjunction of thresholds, grown by information gain on one part of the sample and pruned on the other;
documents that it covers are set aside before the next is learned. The ordered list becomes one Spark CASE expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riffle.llm.common import labelled_sample, small_batches, texts_of

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks")


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words inside windows of three that occur twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1] if len(number) > 2_000_000 else ids[:-1] * len(number) + ids[1:]
    key = pair[:-1] * len(number) + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(len(words), dtype=bool)
    for k in range(window):
        inside[k : k + n] |= twice
    return int(inside.sum())


def statistics(text: bytes) -> tuple[int, ...]:
    """STATISTICS of a whole text. Words are separated by ASCII white space, lines by line feeds."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    kept = len(text)
    return (
        len(words),
        len(b"".join(words).decode("utf-8", "replace")),
        kept - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(set(words)),
        kept - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        kept - len(text.translate(None, b"0123456789")),
        kept - len(text.translate(None, b"!?.,;:")),
    )


def with_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` and the statistics as longs; null texts count as empty."""
    small_batches(docs.sparkSession)
    src = docs.select(*keep, F.col(text).alias("__text"))
    schema = src.drop("__text").withColumns({c: F.lit(0).cast("long") for c in STATISTICS}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([statistics(t) for t in texts_of(b, "__text")], dtype=np.int64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *(pa.array(rows[:, i]) for i in range(len(STATISTICS)))], names=schema.names)

    return src.mapInArrow(run, schema)


#: Features that rules may test: numerator and denominator (1 where None) among the statistics.
FEATURES = {
    "n_words": ("n_words", None),
    "mean_word": ("word_chars", "n_words"),
    "symbols_a_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "marks_a_word": ("n_marks", "n_words"),
    "words_a_line": ("n_words", "n_lines"),
}


def feature_matrix(rows: np.ndarray) -> np.ndarray:
    at = {c: rows[:, i].astype(float) for i, c in enumerate(STATISTICS)}
    return np.column_stack([at[a] / (1 if b is None else np.maximum(1, at[b])) for a, b in FEATURES.values()])


def feature(name: str) -> Column:
    a, b = FEATURES[name]
    return F.col(a).cast("double") / (F.lit(1.0) if b is None else F.greatest(F.lit(1.0), F.col(b).cast("double")))


@dataclass(frozen=True)
class Rule:
    """Rejects what meets all tests (feature, at_least, threshold)."""

    tests: tuple[tuple[str, bool, float], ...]

    def covers(self, x: np.ndarray) -> np.ndarray:
        names = list(FEATURES)
        hit = np.ones(len(x), dtype=bool)
        for name, at_least, t in self.tests:
            v = x[:, names.index(name)]
            hit &= v >= t if at_least else v < t
        return hit

    def condition(self) -> Column:
        out = F.lit(True)
        for name, at_least, t in self.tests:
            out = out & (feature(name) >= t if at_least else feature(name) < t)
        return out


def _grow(x: np.ndarray, bad: np.ndarray, most: int = 4) -> Rule:
    """Adds the test of the largest FOIL gain until no good document is covered, or none gains."""
    tests: list[tuple[str, bool, float]] = []
    inside = np.ones(len(x), dtype=bool)
    while len(tests) < most and (~bad[inside]).any():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        before, best = np.log2(p0 / (p0 + n0)), (0.0, None)
        for j, name in enumerate(FEATURES):
            v = x[inside, j]
            for t in np.unique(np.quantile(v, np.linspace(0.01, 0.99, 50))):
                for at_least in (True, False):
                    hit = v >= t if at_least else v < t
                    p = bad[inside][hit].sum()
                    n = hit.sum() - p
                    gain = p * (np.log2(p / (p + n)) - before) if p else 0
                    if gain > best[0] + 1e-9:
                        best = (gain, (name, at_least, round(float(t), 6)))
        if best[1] is None:
            break
        tests.append(best[1])
        inside &= Rule((best[1],)).covers(x)
        if not bad[inside].any():
            break
    return Rule(tuple(tests))


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> tuple[Rule, float, int]:
    """The beginning of the rule that is best on the pruning part, its precision there, and what it rejects rightly."""
    best = (-1.0, rule, 0.0, 0)
    for k in range(len(rule.tests), 0, -1):
        some = Rule(rule.tests[:k])
        hit = some.covers(x)
        p, n = int(bad[hit].sum()), int((~bad[hit]).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best[0]:
            best = (worth, some, p / (p + n), p)
    return best[1], best[2], best[3]


def learn(rows: np.ndarray, bad: np.ndarray, precision: float = 0.97, most: int = 12, seed: int = 2) -> list[Rule]:
    """The decision list from statistics and labels; a rule has to reach `precision` on the pruning part."""
    if not len(rows) or not bad.any() or bad.all():
        return []
    x, rng, out = feature_matrix(rows), np.random.default_rng(seed), []
    while len(out) < most and bad.sum() >= 3:
        grow = np.zeros(len(x), dtype=bool)
        for label in (True, False):  # two thirds of either class
            own = rng.permutation(np.flatnonzero(bad == label))
            grow[own[: max(1, 2 * len(own) // 3)]] = True
        rule = _grow(x[grow], bad[grow])
        if not rule.tests:
            break
        rule, share, right = _prune(rule, x[~grow], bad[~grow])
        if share < precision or not right:
            break
        out.append(rule)
        left = ~rule.covers(x)
        x, bad = x[left], bad[left]
    return out


def verdict(rules: list[Rule]) -> Column:
    """False for what the first fitting rule rejects, else true."""
    out = None
    for r in rules:
        out = F.when(r.condition(), F.lit(False)) if out is None else out.when(r.condition(), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, most_bytes: int = 8 << 20, folds: int = 1, held_out: int = 1) -> list[Rule]:
    """Rules from at most per_class whole labelled documents and most_bytes bytes of either class, outside the held-out fold (by default there is none)."""
    sample = labelled_sample(docs, labels, "quality", folds, held_out, per_class, most_bytes)
    rows = np.array([statistics(t) for t, _ in sample], dtype=np.int64).reshape(-1, len(STATISTICS))
    bad = np.array([y == 0 for _, y in sample], dtype=bool)
    # rules are for documents that pass the fixed limits
    open_ = ~((rows[:, 0] < 50) | (100 * rows[:, 4] > 50 * rows[:, 0])) if len(rows) else bad
    return learn(rows[open_], bad[open_])


def judge(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """doc_id, the base statistics, base_failed and kept of every row.

    Null and empty texts have no words and fail the base limits; repeated rows are judged one by one and alike; statistics are
    of whole texts, however long; a value that equals a threshold is at least it; without labels of both kinds there are
    no rules, and what passes the base limits is kept. An empty table gives no rows, and other columns are left out.
    """
    found = with_statistics(docs, ["doc_id"])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.select("doc_id", *STATISTICS[:5], failed.alias("base_failed"), (~failed & verdict(fit(docs, labels, **bounds))).alias("kept"))
