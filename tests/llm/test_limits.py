"""Bounds and seams: token chunks of one hash, samples, long texts, forward passes, crowded prefixes, hot urls, held-out accuracy."""

import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from riffle.llm import common, pfair_mix, quality_cnn, quality_rules, registry, simhash_dedup, toxicity, url_filter

SF = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"


def thue_morse(n):
    t = "a"
    while len(t) < n:
        t += t.translate(str.maketrans("ab", "ba"))
    return t


def test_chunks_of_one_hash_have_their_own_ids():
    from riffle.llm.token_ids import IdCache
    from tokenizers import Tokenizer

    path = registry.tokenizer_path()
    tok, cache = Tokenizer.from_file(path), IdCache(path)
    t = thue_morse(2048)
    u = t.translate(str.maketrans("ab", "ba"))  # a polynomial hash can't tell these apart
    rng = random.Random(1)
    long = ["".join(rng.choice("abcxyz0!é") for _ in range(rng.randint(1000, 4000))) for _ in range(60)]
    for texts in ([t, u], [u, t], [f"{t} {u} {u} {t} x"], long, [f"{u} {x}" for x in long]):
        got = [np.frombuffer(x, "<u4").tolist() for x in cache.ids([x.encode() for x in texts])]
        assert got == [tok.encode(x, add_special_tokens=False).ids for x in texts]


def test_every_hash_colliding_still_gives_right_ids(monkeypatch):
    """With all hashes forced into eight values, only the comparison of bytes keeps chunks apart."""
    from riffle.llm import token_ids
    from tokenizers import Tokenizer

    path = registry.tokenizer_path()
    tok, cache = Tokenizer.from_file(path), token_ids.IdCache(path)
    cache.powers = cache.powers * np.uint64(0)  # all chunks of one length have one hash
    texts = ["the cat sat on the mat", "dog bit man", "a b c d a", "mat the dog"]
    assert [np.frombuffer(x, "<u4").tolist() for x in cache.ids([x.encode() for x in texts])] == [tok.encode(x, add_special_tokens=False).ids for x in texts]


def test_labelled_sample_is_bounded_and_has_long_texts(spark):
    rows = [(i, "short text") for i in range(200)] + [(0, f"repeat {k}") for k in range(3000)] + [(500, "long " * 40_000), (501, "long " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(200)] + [(500, 0, 0), (501, 1, 1), (501, 0, 0), (7, None, 5)], LABELS)
    got = common.labelled_sample(docs, labels, "toxic", 1, 1, 10_000, 1 << 20)
    assert len(got) == 202 and sum(len(t) > 100_000 for t, _ in got) == 2 and {y for t, y in got if len(t) > 100_000} == {0, 1}
    few = common.labelled_sample(docs, labels, "toxic", 1, 1, 10, 1 << 20)
    assert len(few) <= 20 and [x for x in got if x in few]
    small = common.labelled_sample(docs, labels, "toxic", 1, 1, 10_000, 1000)
    assert all(sum(len(t) for t, y in small if y == k) <= 1000 for k in (0, 1)) and small
    assert few == common.labelled_sample(docs.repartition(7), labels.repartition(3), "toxic", 1, 1, 10, 1 << 20)


@pytest.fixture(scope="module")
def bags():
    table = np.random.default_rng(0).standard_normal(1 << toxicity.BUCKET_BITS).astype(np.float32)
    table[0] = 0
    return table


def slow_toxicity(text, table):
    """The highest passage's mean over the n-grams of its words, in plain Python."""
    words = [b" " + w + b" " for w in text.split()]
    values = []
    for w in words:
        own = []
        for n in toxicity.NGRAMS:
            for at in range(len(w) - n + 1):
                h = w[at]
                for c in w[at + 1 : at + n]:
                    h = (h * 0x01000193 + c) % (1 << 32)
                own.append(float(table[((h * 0x9E3779B1 + n - 1) % (1 << 32)) >> (32 - toxicity.BUCKET_BITS)]))
        values.append(own)
    passages = [sum(values[i : i + toxicity.PASSAGE], []) for i in range(len(words))]
    return max((sum(p) / max(1, len(p)) for p in passages), default=None)


def test_toxicity_forward_pass(bags, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab c\n\t" if rng.random() < 0.5 else "abcdefghé") for _ in range(rng.randint(0, 300))).encode() for _ in range(150)]
    want = [1 / (1 + np.exp(-(slow_toxicity(t, bags) or 0.0) - 0.25)) if t.split() else 0.5 for t in texts]
    for slab in (1 << 20, 64, 17):  # whole, and cut within words and passages
        monkeypatch.setattr(toxicity, "SLAB", slab)
        assert np.allclose(toxicity.score(texts, bags, 0.25), want, atol=1e-5)


def test_passages_over_a_seam_are_scored(bags, monkeypatch):
    long = [bytes(random.Random(k).choices(b"abcdefgh", k=150)) for k in range(8000)]
    text = b" ".join(long)
    assert len(text) > toxicity.SLAB
    own = toxicity.score([text], bags, 0.0)[0]
    monkeypatch.setattr(toxicity, "SLAB", 1 << 22)
    assert own == pytest.approx(toxicity.score([text], bags, 0.0)[0], abs=1e-9)
    alone = b"x" * (3 << 20)  # one word longer than slabs
    a = toxicity.score([alone], bags, 0.0)[0]
    monkeypatch.setattr(toxicity, "SLAB", 1 << 20)
    assert a == pytest.approx(toxicity.score([alone], bags, 0.0)[0], abs=1e-9)


def slow_quality(model, text):
    """Blocks, filters, chunks, mean and maximum in plain Python."""
    unit = quality_cnn.STEP * quality_cnn.CELL
    cells = max(1, -(-len(text) // unit))
    raw = text.ljust(cells * unit, b"\0") + b"\0" * quality_cnn.STEP
    step, n = quality_cnn.STEP, cells * quality_cnn.CELL
    rows = []
    for b in range(n):
        x = np.concatenate([model.embedding[c] for c in raw[b * step : b * step + 2 * step]])
        rows.append(np.maximum(x @ model.filters.reshape(-1, quality_cnn.FILTERS) + model.offset, 0))
    tops = [np.max(rows[c * quality_cnn.CELL : (c + 1) * quality_cnn.CELL], axis=0) for c in range(cells)]
    chunks = [np.max(tops[c : c + quality_cnn.CHUNK_CELLS], axis=0) for c in range(0, max(1, cells - 1), quality_cnn.CHUNK_STEP)]
    z = np.concatenate((np.mean(chunks, axis=0), np.max(chunks, axis=0))) @ model.out + model.bias
    return 1 / (1 + np.exp(-z))


def test_quality_forward_pass():
    rng = random.Random(5)
    texts = [bytes(rng.choices(b"abc def\n.,#", k=n)) for n in (0, 1, 3, 4, 127, 128, 129, 500, 512, 513, 900, 2000)] + ["é😀".encode() * 50]
    model = quality_cnn.train([(t, i % 2) for i, t in enumerate(texts)], epochs=2)
    assert np.allclose(quality_cnn.score(model, texts), [slow_quality(model, t) for t in texts], atol=1e-5)


def labelled(column):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    return [(i, docs[i], y) for i, y in (r.values() for r in pq.read_table(f"{SF}/labels.parquet", columns=["doc_id", column]).to_pylist()) if y is not None and i in docs]


def auc(scores, truth):
    order = np.argsort(np.argsort(scores))
    n = truth.sum()
    return (order[truth].sum() - n * (n - 1) / 2) / (n * (~truth).sum())


def test_joint_training_lifts_held_out_toxicity():
    rows = labelled("toxic")
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    train = [(t, y) for i, t, y in rows if fold(i)]
    train = [x for y in (0, 1) for x in [r for r in train if r[1] == y][:400]]
    held = [(t, y) for i, t, y in rows if not fold(i)]
    truth = np.array([y == 1 for _, y in held])
    before, after = (auc(toxicity.score([t for t, _ in held], *toxicity.train(train, epochs=e).table()), truth) for e in (0, 8))
    assert after > 0.93 and after > before + 0.03


def test_rules_hold_on_documents_they_were_not_learned_from():
    rows = labelled("quality")
    numbers = np.array([quality_rules.statistics(t) for _, t, _ in rows])
    bad = np.array([y == 0 for *_, y in rows])
    failed = (numbers[:, 0] < 50) | (100 * numbers[:, 4] > 50 * numbers[:, 0])
    held = np.array([zlib.crc32(str(i).encode()) % 3 == 1 for i, *_ in rows])
    rules = quality_rules.learn(numbers[~held & ~failed], bad[~held & ~failed])
    x = quality_rules.feature_matrix(numbers)
    rejected = np.any([r.covers(x) for r in rules], axis=0) & held & ~failed
    assert rules and (rejected & bad).sum() / (held & ~failed & bad).sum() > 0.9 and (rejected & ~bad).sum() <= 0.02 * (held & ~bad & ~failed).sum()


@pytest.mark.parametrize("radius", [3, 4])
def test_crowded_prefixes_are_split_and_complete(spark, monkeypatch, radius):
    """A dense cluster that shares its low bits: prefixes are split until each has few variants; no link is lost."""
    monkeypatch.setattr(simhash_dedup, "MOST_PER_PREFIX", 30_000)
    rng = random.Random(radius)
    base, fps = rng.getrandbits(64), set()
    while len(fps) < 160:
        f = rng.choice([base, *fps]) if rng.random() < 0.6 else rng.getrandbits(64) & ~0xFFFF | base & 0xFFFF
        for _ in range(rng.randint(0, radius + 2)):
            f ^= 1 << rng.randrange(20, 64)
        fps.add(f)
    signed = [f - (f >> 63 << 64) for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    splits = []
    own = simhash_dedup._meet
    monkeypatch.setattr(simhash_dedup, "_meet", lambda rows, bits, r: splits.append(bits) or own(rows, bits, r))
    found = simhash_dedup.components(simhash_dedup.ball_links(frame, len(fps), radius)).collect()
    assert len(splits) > 2
    label = {f: f for f in signed}
    for a in sorted(signed):
        for b in signed:
            if a < b and ((a ^ b) % (1 << 64)).bit_count() <= radius:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    root = {f: f for f in signed} | {r.node: r.root for r in found}
    assert root == label


def test_keep_one_tells_texts_of_one_id_apart(spark):
    rows = [(1, "one two three four five six", "a"), (1, "seven eight nine ten eleven twelve", "b"), (2, "one two three four five six", "c"), (None, "thirteen fourteen fifteen", "d"), (None, "sixteen seventeen eighteen", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumn("fp", F.lit(1)).withColumn("c1", F.lit(2))
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["row"] for r in kept.collect()) == ["a", "b", "d", "e"]


def test_tail_of_the_mixture_stays_in_proportion(spark):
    """Slots after the first stream has run out: the others go on by their weights among themselves."""
    docs = spark.createDataFrame([(i, "abc"[0 if i < 30 else 1 + i % 2]) for i in range(300)], "doc_id long, source string")
    order = [r["__stream"] for r in pfair_mix.mix(docs, {"a": 4, "b": 1, "c": 1}, 1, block=1).orderBy("__slot").collect()]
    end = max(i for i, s in enumerate(order) if s == "a")
    tail = order[end + 1 :]
    for n in range(1, len(tail)):
        assert abs(tail[:n].count("b") - n / 2) <= 1.5
    # while a lasts it has its share of every prefix
    for n in range(1, end):
        assert abs(order[:n].count("a") - n * 4 / 6) <= 1


def test_classifiers_pass_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, "what a day " * 20 + ("moron" if i % 2 else "")) for i in range(60)], "doc_id long, text string").withColumn("__toxicity", F.lit("x")).withColumn("__QUALITY", F.lit("y"))
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(60)], LABELS)
    for out in (toxicity.keep_clean(docs, labels), quality_cnn.keep_good(docs, labels)):
        assert out.columns == docs.columns and 20 <= out.count() <= 45
    mixed = pfair_mix.in_order(docs.withColumn("source", F.lit("s")).withColumn("__slot", F.lit(1)), {"s": 1})
    assert mixed.columns[-2:] == ["source", "__slot"] and mixed.count() == 60
    with pytest.raises(ValueError):
        pfair_mix.mix(docs.withColumn("source", F.lit("s")).withColumn("__slot", F.lit(1)), {"s": 1})


def test_rule_hosts_are_lowered_as_urls_are(spark):
    pages = spark.createDataFrame([(1, "http://ÄB.COM/x"), (2, "http://äb.com/x")] + [(3, "http://hot.org/")] * 200, "page_id long, url string")
    rules = url_filter.rules_frame(spark, [("block", "ÄB.Com", "/"), ("block", "org", "/")])
    got = [(r.page_id, r.verdict) for r in url_filter.judge(pages, rules).collect()]
    assert sorted(set(got)) == [(1, "block"), (2, "allow"), (3, "block")] and len(got) == 202
