"""The pipeline and its stages against a plain version, on a small table with copies, toxic and poor documents, nulls and repeats."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from riffle.llm import common, quality_cnn, registry, toxicity
from test_ops import slow_bfd, slow_components, slow_fingerprint, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BAD = ["moron", "idiotic", "stupidity", "worthless"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(420):
        said = words(rng, rng.randint(5, 160)).split()
        toxic, good = i % 6 == 0, i % 7 > 0
        if toxic:
            said.insert(rng.randrange(len(said)), rng.choice(BAD))
        text = " ".join(said if good else [x + "###" for x in said])
        if i > 20 and i % 10 == 3:
            text = rows[rng.randrange(20)][1]
        elif i > 20 and i % 10 == 4:
            text = rows[rng.randrange(20)][1] + " " + words(rng, 1)
        rows.append((i, text, "en", f"src{min(3, i % 5)}" if i % 11 else None, len(text)))
        if i < 300:
            labels.append((i, int(good), int(toxic)))
    rows += [(1000, None, "en", "src0", 0), (1001, "", "en", "src1", 0), (None, words(rng, 90), None, None, None), rows[9], (1002, words(rng, 9000), "en", "src0", 1)]
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def slow_mixture(rows):
    """Rows in the order of the mixture: earliest deadline first, slot by slot and cycle by cycle."""
    streams = [*registry.WEIGHTS.items(), (None, registry.REST_WEIGHT)]
    number = {s: i for i, s in enumerate(registry.WEIGHTS)}
    queues = defaultdict(list)
    for r in rows:
        queues[number.get(r.source, len(streams) - 1)].append(r)
    block = registry.BLOCK_DOCS
    for q in queues.values():
        q.sort(key=lambda r: hashlib.md5(f"{registry.MIX_SEED}:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest())
    blocks = {s: [q[i : i + block] for i in range(0, len(q), block)] for s, q in queues.items()}
    out, taken = [], Counter()
    while any(taken[s] < len(b) for s, b in blocks.items()):
        ks = [min(w, len(blocks.get(s, ())) - taken[s]) for s, (_, w) in enumerate(streams)]
        total, done = sum(ks), Counter()
        for slot in range(total):
            due = [(((done[s] + 1) * total + k - 1) // k, s) for s, k in enumerate(ks) if done[s] < k and done[s] * total // k <= slot]
            s = min(due)[1]
            out += blocks[s][taken[s]]
            taken[s] += 1
            done[s] += 1
    return out


def test_stages_and_run_against_a_plain_version(spark, folder):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")

    def kept_by(name, now):
        out, _ = common.materialize(stage[name](spark, now, folder), "test-stage")
        assert out.columns == docs.columns
        return out

    # toxicity: each text by itself
    model = toxicity.train(common.labelled_sample(docs, labels, "toxic", 5, 0, 1500, 8 << 20))
    clean = kept_by("toxicity", docs)
    want = [r for r in docs.collect() if toxicity.score([(r.text or "").encode()], *model.table())[0] < 0.5]
    assert sorted(clean.collect(), key=key) == sorted(want, key=key) and 200 < len(want) < docs.count() - 30
    assert sum(any(b in (r.text or "") for b in BAD) for r in want) <= 3
    # quality
    network = quality_cnn.fit(clean, labels)
    good = kept_by("quality classifier", clean)
    want = [r for r in clean.collect() if quality_cnn.score(network, [(r.text or "").encode()])[0] >= 0.5]
    assert sorted(good.collect(), key=key) == sorted(want, key=key) and len(want) < clean.count()
    # near copies: the smallest id of each group
    single = kept_by("SimHash near-dedup", good)
    rows = good.collect()
    root = slow_components([slow_fingerprint(r.text) for r in rows])
    groups = defaultdict(list)
    for r in rows:
        groups[root[slow_fingerprint(r.text)]].append(r)
    want = [min(g, key=key) for g in groups.values()]
    assert sorted(single.collect(), key=key) == sorted(want, key=key) and len(want) < len(rows) - 20
    # the mixture's order
    mixed = kept_by("mixing sources", single)
    order = slow_mixture(single.collect())
    read = mixed.select("*", "_metadata.file_name", "_metadata.row_index").collect()
    assert [r.doc_id for r in sorted(read, key=lambda r: (r.file_name, r.row_index))] == [r.doc_id for r in order]
    # packing, and the whole
    tok = Tokenizer.from_file(registry.tokenizer_path())
    want, rank = Counter(), {}
    for n, r in enumerate(order):
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        rank[r.doc_id] = n
        for k, at in enumerate(range(0, len(ids), registry.SEQUENCE_TOKENS)):
            part = ids[at : at + registry.SEQUENCE_TOKENS]
            want[r.doc_id, k, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())] += 1
    for packed in (stage["best-fit packing"](spark, mixed, folder).collect(), corpus_pipeline.run(spark, folder).collect()):
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
        fill = defaultdict(list)
        for r in packed:
            fill[r.sequence_id].append(r)
        for parts in fill.values():
            parts.sort(key=lambda r: r.offset)
            assert [r.offset for r in parts] == [sum(p.length for p in parts[:i]) for i in range(len(parts))] and sum(p.length for p in parts) <= registry.SEQUENCE_TOKENS
        assert len(fill) == slow_bfd([r.length for r in packed], registry.SEQUENCE_TOKENS)
        # sequences are numbered by the earliest document of the mixture that they hold
        first = [min((rank[r.doc_id], r.piece) for r in fill[s]) for s in sorted(fill)]
        assert first == sorted(first)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rollup_queries_count_every_document(spark, folder):
    got = {(r.source, r.lang): (r.docs, r.tokens) for r in registry.token_rollup_words(spark, folder).collect()}
    want = defaultdict(lambda: (0, 0))
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        n, t = want[r.source, r.lang]
        want[r.source, r.lang] = (n + 1, t + len((r.text or "").encode().split()))
    assert got == dict(want)
    both = registry.op9_token_rollup(spark, folder).collect()
    assert {(r.source, r.lang): (r.docs, r.tokens) for r in both if r.tokenizer == "words_1"} == got
    from tokenizers import Tokenizer

    tok, bpe = Tokenizer.from_file(registry.tokenizer_path()), Counter()
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        bpe[r.source, r.lang] += len(tok.encode(r.text or "", add_special_tokens=False).ids)
    assert {(r.source, r.lang): r.tokens for r in both if r.tokenizer != "words_1"} == dict(bpe)
