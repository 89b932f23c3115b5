"""Document quality from a byte-level convolutional network in numpy.

A document's bytes are embedded and convolved by learned filters (8 bytes wide, every 4 bytes). Responses are max-pooled
within overlapping chunks of 512 bytes, one every 384, which cover the whole text; the chunks' pooled responses are combined
by their mean and maximum into one logit, hence one probability. The text is padded with zero bytes to whole
blocks, and the padding has an embedding of its own, so that very short texts look different too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riffle.llm.common import free_name, id_fold, labelled_sample, slabs, small_batches, texts_of

DIM, FILTERS = 6, 16
#: Bytes between neighbouring filter positions, and positions in a cell, the unit of pooling: 128 bytes.
STEP, CELL = 4, 32
#: A chunk is 4 cells, and starts every 3.
CHUNK_CELLS, CHUNK_STEP = 4, 3
SLAB = 1 << 20


@dataclass
class QualityModel:
    """Byte embeddings, filters over two neighbouring blocks, filter biases, output weights and bias."""

    embedding: np.ndarray  # 256 x DIM
    filters: np.ndarray  # 2 x (STEP * DIM) x FILTERS
    offset: np.ndarray  # FILTERS
    out: np.ndarray  # 2 * FILTERS: mean and maximum over chunks
    bias: float


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, each padded with zeros to whole cells (one at least), and the number of cells of each."""
    unit = STEP * CELL
    cells = np.array([max(1, -(-len(t) // unit)) for t in texts])
    return np.frombuffer(b"".join(t.ljust(n * unit, b"\0") for t, n in zip(texts, cells.tolist(), strict=True)), dtype=np.uint8), cells


def responses(model: QualityModel, raw: np.ndarray, ends: np.ndarray, follows: np.ndarray | None = None) -> np.ndarray:
    """Filter responses by cell and position: (cells, CELL, FILTERS), after ReLU. A filter looks at a block and the next one.

    ends: the last block of each text, after which zeros follow, as they do after all of raw unless `follows` has a block.
    """
    x = model.embedding[raw].reshape(-1, STEP * DIM)
    blocks, second = x @ model.filters[0], x @ model.filters[1]
    zero = model.embedding[np.zeros(STEP, dtype=np.uint8)].reshape(-1) @ model.filters[1]
    blocks[:-1] += second[1:]
    blocks[-1] += zero if follows is None else model.embedding[follows].reshape(-1) @ model.filters[1]
    inner = ends[ends < len(blocks) - 1]
    blocks[inner] += zero - second[inner + 1]
    blocks += model.offset
    np.maximum(blocks, 0, out=blocks)
    return blocks.reshape(-1, CELL, FILTERS)


def chunk_starts(cells: int) -> np.ndarray:
    return np.arange(0, max(1, cells - (CHUNK_CELLS - CHUNK_STEP)), CHUNK_STEP)


def pooled(cell_max: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """By text: mean over chunks, and maximum, of each filter's maximum in a chunk."""
    out = np.empty((len(cells), 2 * FILTERS), dtype=np.float32)
    at = 0
    for i, n in enumerate(cells.tolist()):
        own = cell_max[at : at + n]
        starts = chunk_starts(n)
        chunk = own[starts]
        for k in range(1, CHUNK_CELLS):
            np.maximum(chunk, own[np.minimum(starts + k, n - 1)], out=chunk)
        out[i, :FILTERS], out[i, FILTERS:] = chunk.mean(axis=0), chunk.max(axis=0)
        at += n
    return out


def score(model: QualityModel, texts: list[bytes]) -> np.ndarray:
    """Probability of good quality of each text. A text longer than a slab is convolved in pieces of whole cells."""
    out = np.empty(len(texts))
    unit = STEP * CELL
    for lo, hi in slabs(texts, SLAB):
        raw, cells = padded(texts[lo:hi])
        ends = np.cumsum(cells) * CELL - 1
        most = max(1, SLAB // unit) * unit
        maxima = []
        for at in range(0, len(raw), most):
            stop, own = at + most, ends[ends >= at // STEP] - at // STEP
            goes_on = stop < len(raw) and stop // STEP - 1 not in ends
            maxima.append(responses(model, raw[at:stop], own, raw[stop : stop + STEP] if goes_on else None).max(axis=1))
        out[lo:hi] = pooled(np.concatenate(maxima), cells) @ model.out + model.bias
    return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def cropped(text: bytes, rng: np.random.Generator) -> bytes:
    """In one of three draws a short stretch of whole words of a longer text, so that short texts are learned too."""
    if len(text) < 60 or rng.random() > 0.33:
        return text
    size = int(np.exp(rng.uniform(np.log(12), np.log(600))))
    at = int(rng.integers(0, max(1, len(text) - size)))
    part = text[at : at + size]
    words = part.split(b" ")
    return b" ".join(words[1:-1]) if len(words) > 3 else part


def train(sample: list[tuple[bytes, int]], prior: float | None = None, epochs: int = 16, rate: float = 0.01, seed: int = 3) -> QualityModel:
    """Adam on the log loss; both classes weigh alike in the steps, and the bias is then moved to `prior`, the odds of good documents (the sample's unless given)."""
    rng = np.random.default_rng(seed)
    width = STEP * DIM
    p = {
        "embedding": (rng.standard_normal((256, DIM)) * 0.5).astype(np.float32),
        "filters": (rng.standard_normal((2, width, FILTERS)) * (1.5 / np.sqrt(2 * width))).astype(np.float32),
        "offset": np.zeros(FILTERS, np.float32),
        "out": (rng.standard_normal(2 * FILTERS) * 0.1).astype(np.float32),
        "bias": np.zeros(1, np.float32),
    }
    share = np.array([sum(y == k for _, y in sample) for k in (0, 1)], dtype=float)
    if min(share) == 0:
        p["out"][:] = 0
        p["bias"][:] = np.log((share[1] + 0.5) / (share[0] + 0.5))
        return QualityModel(p["embedding"], p["filters"], p["offset"], p["out"], float(p["bias"][0]))
    weight = len(sample) / (2 * share)
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    order = np.arange(len(sample))
    for epoch in range(epochs):
        rng.shuffle(order)
        for at in range(0, len(order), 24):
            some = [(cropped(sample[i][0], rng), sample[i][1]) for i in order[at : at + 24]]
            raw, cells = padded([t for t, _ in some])
            y = np.array([c for _, c in some])
            model = QualityModel(p["embedding"], p["filters"], p["offset"], p["out"], float(p["bias"][0]))
            ends = np.cumsum(cells) * CELL - 1
            r = responses(model, raw, ends)
            best = r.argmax(axis=1)
            cell_max = np.take_along_axis(r, best[:, None, :], axis=1)[:, 0]
            features = pooled(cell_max, cells)
            prob = 1 / (1 + np.exp(-np.clip(features @ p["out"] + p["bias"][0], -30, 30)))
            err = ((prob - y) * weight[y] / len(some)).astype(np.float32)
            g = {"out": features.T @ err, "bias": np.array([err.sum()], np.float32)}
            # back to the cells that gave each chunk's maximum
            into = np.zeros_like(cell_max)
            base = 0
            for e, n in zip(err, cells.tolist(), strict=True):
                own, starts = cell_max[base : base + n], chunk_starts(n)
                idx = np.minimum(starts[:, None] + np.arange(CHUNK_CELLS), n - 1)
                pick = own[idx].argmax(axis=1)  # chunks x filters
                where = np.take_along_axis(idx, pick, axis=1)
                chunk = np.take_along_axis(own, where, axis=0)
                gc = np.broadcast_to(e * p["out"][:FILTERS] / len(starts), chunk.shape).copy()
                gc[chunk.argmax(axis=0), np.arange(FILTERS)] += e * p["out"][FILTERS:]
                np.add.at(into[base : base + n], (where, np.arange(FILTERS)[None, :]), gc)
                base += n
            into *= cell_max > 0
            cell, f = np.nonzero(into)
            value = into[cell, f]
            block = cell * CELL + best[cell, f]
            blocks = np.concatenate((raw.reshape(-1, STEP), np.zeros((1, STEP), np.uint8)))
            after = np.where(np.isin(block, ends), len(blocks) - 1, block + 1)
            g["offset"] = np.bincount(f, value, FILTERS).astype(np.float32)
            g["filters"], g["embedding"] = np.zeros_like(p["filters"]), np.zeros_like(p["embedding"])
            for half, where in enumerate((block, after)):
                bytes_ = blocks[where]
                x = p["embedding"][bytes_].reshape(-1, width) * value[:, None]
                for k in range(FILTERS):
                    g["filters"][half, :, k] = x[f == k].sum(axis=0)
                back = (p["filters"][half][:, f].T * value[:, None]).reshape(-1, STEP, DIM)
                flat = bytes_.ravel()
                for d in range(DIM):
                    g["embedding"][:, d] += np.bincount(flat, back[:, :, d].ravel(), 256).astype(np.float32)
            step += 1
            lr = rate * (0.5 * (1 + np.cos(np.pi * (epoch + at / len(order)) / epochs)) + 0.02)
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return QualityModel(p["embedding"], p["filters"], p["offset"], p["out"], float(p["bias"][0] + np.log(prior or share[1] / share[0])))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, per_class: int = 800, most_bytes: int = 4 << 20) -> QualityModel:
    """Train on at most per_class whole texts and most_bytes bytes of either label, outside the held-out fold."""
    sample = labelled_sample(docs, labels, "quality", folds, held_out, per_class, most_bytes)
    good = labels.where(id_fold(F.col("doc_id"), folds) != held_out).agg(F.sum(F.expr("int(quality = 1)")), F.sum(F.expr("int(quality = 0)"))).first()
    return train(sample, (good[0] + 1) / (good[1] + 1) if good[0] is not None else None)


def scored(docs: DataFrame, model: QualityModel, text: str = "text", out: str = "__quality") -> DataFrame:
    """docs with the probability as column `out`; null texts count as empty; other columns are passed on.

    A column that is named like `out` already is an error, so that callers with unknown columns choose the name by free_name().
    """
    if out in docs.columns:
        raise ValueError(f"docs have a column {out} already")
    small_batches(docs.sparkSession)
    schema = docs.withColumn(out, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score(model, texts_of(b, text)))], names=schema.names)

    return docs.mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, **bounds: int) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs.

    Null and empty texts are one cell of padding; repeated rows are scored one by one and alike; texts of any length are
    scored whole; a null id is in the fold of the empty text; a score of exactly 0.5 predicts 1; without labels of both kinds
    all texts have one score. An empty table gives no rows, and other columns are left out.
    """
    model = fit(docs, labels, folds, held_out, **bounds)
    found = scored(docs.select("doc_id", "text"), model, out="score").drop("text")
    return found.select("doc_id", (id_fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **bounds: int) -> DataFrame:
    """Rows of docs at the threshold or above, with their columns, whatever they are named."""
    model, out = fit(docs, labels, **bounds), free_name(docs, "__quality")
    return scored(docs, model, out=out).where(F.col(out) >= threshold).drop(out)
