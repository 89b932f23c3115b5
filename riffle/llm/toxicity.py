"""Toxicity from subword-bag embeddings averaged into a linear softmax.

A passage of a few words is the bag of its words' byte n-grams (with a space at either end of a word), each hashed to an
embedding; their average goes into a linear softmax. Embeddings and softmax are trained jointly in numpy. A document is
as toxic as its most toxic passage: passages overlap (one starts at every word), cover the whole text, and training
follows the passage that scores highest, so that a few words in a long text are neither diluted nor missed.
Misspelt or inflected words share n-grams, hence vectors, with those seen in training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riffle.llm.common import free_name, id_fold, labelled_sample, slabs, small_batches, texts_of

NGRAMS = (3, 4, 5)
BUCKET_BITS = 18
#: Words of a passage.
PASSAGE = 4
DIM = 8
#: Bytes scored at a time; of a longer text, words that a slab ends in and the passages that reach on are carried over.
SLAB = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def lowered(text: bytes) -> bytes:
    return text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()


def _hashed(a: np.ndarray, space: np.ndarray, n: int) -> list[np.ndarray]:
    """For each n-gram length the bucket of the n-gram that starts at each of the first n places (0: it holds a space within)."""
    a = np.where(space, np.uint8(0x20), a).astype(np.uint32)
    h, blocked, out = a[:n].copy(), np.zeros(n, dtype=bool), []
    for k in range(1, max(NGRAMS)):
        h = h * np.uint32(0x01000193) + a[k : k + n]
        if k + 1 in NGRAMS:
            b = ((h * np.uint32(0x9E3779B1) + np.uint32(k)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)
            b[blocked] = 0
            out.append(b)
        blocked |= space[k : k + n]
    return out


def ngram_numbers(length: np.ndarray) -> np.ndarray:
    """N-grams of words of so many bytes: with its two spaces a word has length + 3 - n of them."""
    return sum(np.maximum(0, length + 3 - g) for g in NGRAMS)


def ngram_buckets(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased texts: for each n the bucket of the n-gram that starts at each place (0: none), word starts, n-grams of each word, and each word's text."""
    raw = b" " + b"  ".join(texts) + b"  " + b" " * max(NGRAMS)
    a = np.frombuffer(raw, dtype=np.uint8)
    space = _SPACE[a]
    n = len(a) - max(NGRAMS)
    inside = ~space
    starts = np.flatnonzero(inside[1:n] & space[: n - 1]) + 1
    stops = np.flatnonzero(space[1 : n + 1] & inside[:n]) + 1
    bounds = np.cumsum([0, *(len(t) + 2 for t in texts)])
    owner = np.searchsorted(bounds, starts - 1, side="right") - 1
    return _hashed(a, space, n), starts, ngram_numbers(stops - starts), owner


def passages(starts: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each word the position after the last word of the passage that it starts."""
    ends = np.arange(len(starts)) + PASSAGE
    last = np.searchsorted(owner, owner, side="right")
    return np.minimum(ends, last)


def _means(words: np.ndarray, counts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each word the average over the passage that it starts, from the words' sums and numbers of n-grams."""
    total, number = (np.concatenate(([0.0], np.cumsum(x))) for x in (words, counts))
    at = np.arange(len(ends))
    return (total[ends] - total[at]) / np.maximum(1, number[ends] - number[at])


def passage_scores(table: np.ndarray, buckets: list[np.ndarray], starts: np.ndarray, counts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Average of the n-grams' values in each passage."""
    if not len(starts):
        return np.zeros(0)
    values = table[buckets[0]]
    for b in buckets[1:]:
        values += table[b]
    return _means(np.add.reduceat(values, starts - 1, dtype=np.float64), counts, ends)


def long_score(text: bytes, table: np.ndarray) -> float:
    """The highest passage of a lower-cased text of any length, slab by slab; minus infinity without words.

    Sums and lengths of words are additive, so that a word may go on over slabs; words of which a passage still reaches
    on are kept for the next slab. Every word starts a passage, as in ngram_buckets.
    """
    pad = max(NGRAMS)
    best, sums, sizes, open_ = -np.inf, np.zeros(0), np.zeros(0, dtype=np.int64), False
    for at in range(0, len(text) + 1, SLAB):
        # places from the one before text[at] on; the last slab takes the space after the text too
        raw = (text[at - 1 : at] or b" ") + text[at : at + SLAB + pad]
        n = min(SLAB, len(text) + 1 - at)
        a = np.frombuffer(raw + b" " * (n + pad + 1 - len(raw)), dtype=np.uint8)
        space = _SPACE[a]
        values = sum(table[b].astype(np.float64) for b in _hashed(a, space, n))
        begins = np.flatnonzero(space[:n] & ~space[1 : n + 1])  # the places whose n-grams are the first of a word
        cuts = np.concatenate(([0], begins)) if not len(begins) or begins[0] else begins
        fresh = np.add.reduceat(values, cuts)
        letters = np.add.reduceat((~space[1 : n + 1]).astype(np.int64), cuts)
        if cuts[0] not in begins[:1]:  # what comes before the first beginning goes with the word that was open, if any
            if open_:
                sums[-1] += fresh[0]
                sizes[-1] += letters[0]
            fresh, letters = fresh[1:], letters[1:]
        sums, sizes = np.concatenate((sums, fresh)), np.concatenate((sizes, letters))
        last = at + SLAB > len(text)
        open_ = len(sums) > 0
        # a word is complete when the next one has begun
        whole = len(sums) if last else max(0, len(sums) - PASSAGE)
        if whole:
            z = _means(sums, ngram_numbers(sizes), np.minimum(np.arange(len(sums)) + PASSAGE, len(sums)))
            best = max(best, float(z[:whole].max()))
            sums, sizes = sums[whole:], sizes[whole:]
    return best


@dataclass
class ToxicityModel:
    """Embeddings (buckets x DIM), softmax weights (DIM x 2) and biases (2)."""

    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def table(self) -> tuple[np.ndarray, float]:
        """What each n-gram adds to the difference of the two logits, and the difference of the biases."""
        values = (self.embeddings @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32)
        values[0] = 0
        return values, float(self.bias[1] - self.bias[0])


def score(texts: list[bytes], table: np.ndarray, bias: float) -> np.ndarray:
    """Probability that each text is toxic: softmax at its highest passage; a text without words has that of an empty bag."""
    out = np.full(len(texts), -np.inf)
    some = [lowered(t) for t in texts]
    for lo, hi in slabs(some, SLAB):
        if len(some[lo]) > SLAB:
            out[lo] = long_score(some[lo], table)
            continue
        buckets, starts, counts, owner = ngram_buckets(some[lo:hi])
        if len(starts):
            z = passage_scores(table, buckets, starts, counts, passages(starts, owner))
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            out[lo + owner[first]] = np.maximum.reduceat(z, first)
    z = np.where(np.isneginf(out), min(0.0, bias), out + bias)
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(sample: list[tuple[bytes, int]], epochs: int = 10, rate: float = 0.3, seed: int = 5) -> ToxicityModel:
    """Embeddings start from each n-gram's smoothed log-odds over documents; then both layers follow each document's highest passage.

    A document's n-grams are made anew whenever it is looked at: kept, they would take twelve times the room of the texts.
    """
    rng = np.random.default_rng(seed)
    size = 1 << BUCKET_BITS
    emb = (rng.standard_normal((size, DIM)) * 0.01).astype(np.float32)
    w = (rng.standard_normal((DIM, 2)) * 0.1).astype(np.float32)
    bias = np.zeros(2)
    docs = [(lowered(t), y) for t, y in sample if t.strip()]
    if not docs or len({y for _, y in docs}) < 2:
        share = np.mean([y for _, y in docs]) if docs else 0.0
        bias[1] = np.log((share + 0.01) / (1.01 - share))
        return ToxicityModel(emb * 0, w, bias)
    with_it = np.zeros((2, size), dtype=np.int32)
    for t, y in docs:
        with_it[y, np.unique(np.concatenate(ngram_buckets([t])[0]))] += 1
    n = [max(1, sum(y == k for _, y in docs)) for k in (0, 1)]
    odds = np.log((with_it[1] + 0.5) / (n[1] + 1)) - np.log((with_it[0] + 0.5) / (n[0] + 1))
    seen = with_it.sum(axis=0) > 1
    emb[:, 0] = np.where(seen, odds, 0)
    w[0] = -1, 1
    bias[:] = 0.5, -0.5
    sq_emb, sq_w, sq_b = np.full((size, DIM), 1e-3, np.float32), np.full((DIM, 2), 1e-2), np.full(2, 1e-2)
    order = np.arange(len(docs))
    for epoch in range(epochs):
        rng.shuffle(order)
        for at in range(0, len(order), 48):
            u = (w[:, 1] - w[:, 0]).astype(np.float32)
            table = emb @ u
            table[0] = 0
            rows, grads, gw, gb = [], [], np.zeros((DIM, 2)), np.zeros(2)
            some = order[at : at + 48]
            for i in some:
                said, y = docs[i]
                buckets, starts, counts, owner = ngram_buckets([said])
                ends = passages(starts, owner)
                z = passage_scores(table, buckets, starts, counts, ends)
                top = int(z.argmax())
                lo, hi = starts[top] - 1, (starts[ends[top]] - 1 if ends[top] < len(starts) else len(buckets[0]))
                ids = np.concatenate([b[lo:hi] for b in buckets])
                ids = ids[ids > 0]
                if not len(ids):
                    continue
                p = 1 / (1 + np.exp(-np.clip(z[top] + bias[1] - bias[0], -50, 50)))
                err = (p - y) * (0.5 / n[y] * len(docs))
                mean = emb[ids].mean(axis=0)
                gw += np.outer(mean, [-err, err])
                gb += -err, err
                rows.append(ids)
                grads.append(np.full(len(ids), err / len(ids), dtype=np.float32))
            if not rows:
                continue
            ids, inverse = np.unique(np.concatenate(rows), return_inverse=True)
            g = np.bincount(inverse, np.concatenate(grads))[:, None] * u[None, :]
            sq_emb[ids] += g**2
            emb[ids] -= rate * g / np.sqrt(sq_emb[ids])
            sq_w += gw**2
            w -= (0.1 * rate * gw / np.sqrt(sq_w)).astype(np.float32)
            sq_b += gb**2
            bias -= 0.1 * rate * gb / np.sqrt(sq_b)
    return ToxicityModel(emb, w, bias)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, per_class: int = 1500, most_bytes: int = 8 << 20) -> ToxicityModel:
    """Train on at most per_class whole texts and most_bytes bytes of either label, outside the held-out fold."""
    return train(labelled_sample(docs, labels, "toxic", folds, held_out, per_class, most_bytes))


def scored(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "__toxicity") -> DataFrame:
    """docs with the probability as column `out`; null texts count as empty; other columns are passed on.

    A column that is named like `out` already is an error, so that callers with unknown columns choose the name by free_name().
    """
    if out in docs.columns:
        raise ValueError(f"docs have a column {out} already")
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model.table())  # one number for each bucket
    schema = docs.withColumn(out, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score(texts_of(b, text), table, bias))], names=schema.names)

    return docs.mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, **bounds: int) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs.

    Null and empty texts have the score of an empty bag; repeated rows are scored one by one and alike; texts of any length
    are scored whole; a null id is in the fold of the empty text; a score of exactly 0.5 predicts 1; without labels of both
    kinds all texts have one score. An empty table gives no rows, and other columns are left out.
    """
    model = fit(docs, labels, folds, held_out, **bounds)
    found = scored(docs.select("doc_id", "text"), model, out="score").drop("text")
    return found.select("doc_id", (id_fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **bounds: int) -> DataFrame:
    """Rows of docs below the threshold, with their columns, whatever they are named."""
    model, out = fit(docs, labels, **bounds), free_name(docs, "__toxicity")
    return scored(docs, model, out=out).where(F.col(out) < threshold).drop(out)
