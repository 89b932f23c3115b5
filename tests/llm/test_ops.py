"""Each operator against brute force or an exact round trip on small tables, with nulls, empty texts, ties and repeats."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from riffle.llm import best_fit_packing, chat_format, learned_partitions, pfair_mix, quality_cnn, quality_rules, registry, simhash_dedup, token_rollup, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else "".join(rng.choice(["an", "er", "tion", "ou", "th", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for i in range(120):
        text = words(rng, rng.randint(1, 120))
        if i % 10 == 3:
            text = out[rng.randrange(len(out))][1] or ""
        out.append((i, text, "en", f"src{i % 3}", len(text)))
    base = words(rng, 300)
    out += [(200 + k, base + " " + words(rng, 1), "en", "src0", 0) for k in range(8)]
    out += [(None, "a null id", None, None, None), (None, "a null id", None, None, None), (300, None, "en", "src1", 0), (301, "", "de", None, 0), (302, " \n\t ", "de", "", 3), (5, out[5][1], "en", "src2", out[5][4])]
    out.append((303, ("word" * 30 + " ") * 4000, "en", "src0", 1))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumn("__fp", F.lit("clash")).withColumn("k", F.lit(1)).cache()


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps, radius=4):
    label = {f: f for f in set(fps)}
    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    known = sorted(label)
    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                label[root(b)] = root(a)
    return {f: root(f) for f in known}


def test_simhash_components(docs, rows):
    found = simhash_dedup.near_duplicates(docs).collect()
    fps = [slow_fingerprint(r[1]) for r in rows]
    root = slow_components(fps)
    least = defaultdict(list)
    for r, f in zip(rows, fps, strict=True):
        least[root[f]].append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    want = Counter((r[0], f, least[root[f]]) for r, f in zip(rows, fps, strict=True))
    assert Counter((r.doc_id, r["__fp"] % (1 << 64), r["__component"]) for r in found) == want


def test_keep_one_keeps_the_smallest_id_of_each_group(docs, rows):
    kept = simhash_dedup.keep_one(docs).collect()
    root = slow_components([slow_fingerprint(r[1]) for r in rows])
    groups = defaultdict(list)
    for r in rows:
        groups[root[slow_fingerprint(r[1])]].append(r[0])
    want = Counter(min((x for x in v if x is not None), default=None) for v in groups.values())
    assert Counter(r.doc_id for r in kept) == want and set(kept[0].asDict()) == set(docs.columns)


def test_links_of_a_dense_prefix_are_complete_in_slices(monkeypatch):
    rng = random.Random(1)
    fps = [rng.getrandbits(64)]
    while len(fps) < 150:
        f = rng.choice(fps)
        for _ in range(rng.randint(1, 6)):
            f ^= 1 << rng.randrange(64)
        fps.append(f)
    root = slow_components(fps)
    for most in (10**9, 5000):
        monkeypatch.setattr(simhash_dedup, "VARIANTS_AT_ONCE", most)
        label = {f: f for f in set(fps)}
        def find(x):
            while label[x] != x:
                x = label[x]
            return x
        reach = lambda f, p: (f ^ p) & 3
        for p in range(4):
            some = np.array([f for f in set(fps) if reach(f, p).bit_count() <= 2], dtype=np.uint64)
            a, b = simhash_dedup.link_prefix(some, p, 2, 4)
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                label[find(x)] = find(y)
        parts, want = defaultdict(set), defaultdict(set)
        for f in set(fps):
            parts[find(f)].add(f)
            want[root[f]].add(f)
        assert sorted(map(sorted, parts.values())) == sorted(map(sorted, want.values()))


def test_empty_tables(spark):
    none, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert simhash_dedup.near_duplicates(none).count() == 0 and simhash_dedup.keep_one(none).count() == 0
    assert toxicity.judge(none, labels).count() == 0 and quality_cnn.judge(none, labels).count() == 0
    assert quality_rules.judge(none, labels).count() == 0
    assert pfair_mix.mix(none, {"a": 1}).count() == 0 and pfair_mix.in_order(none, {"a": 1}).count() == 0
    assert best_fit_packing.pack_documents(none, registry.tokenizer_path()).count() == 0
    assert chat_format.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert learned_partitions.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), url_filter.rules_frame(spark, registry.URL_RULES)).count() == 0


def test_mixture_deviates_by_less_than_a_block(docs, rows):
    weights = {"src0": 5, "src1": 2, "src2": 1}
    mixed = pfair_mix.mix(docs, weights, 1, block=4).collect()
    assert Counter(r.doc_id for r in mixed) == Counter(r[0] for r in rows)
    slots = defaultdict(set)
    for r in mixed:
        slots[r["__slot"]].add((r["__stream"], r["__block"]))
    assert sorted(slots) == list(range(len(slots))) and all(len(v) == 1 for v in slots.values())
    order = [next(iter(slots[i]))[0] for i in range(len(slots))]
    have = Counter(order)
    whole = min(have[s] // w for s, w in [*weights.items(), ("rest", 1)])  # cycles with all streams
    done = Counter()
    for i, s in enumerate(order[: whole * 9]):
        done[s] += 1
        assert all(abs(done[k] - w / 9 * (i + 1)) < 1 for k, w in [*weights.items(), ("rest", 1)])


def test_mixture_order_is_kept_in_partitions(spark, docs):
    weights = {"src0": 5, "src1": 2, "src2": 1}
    want = [r.doc_id for r in pfair_mix.mix(docs, weights, 1, 4).orderBy("__slot", "__place").collect()]
    got = pfair_mix.in_order(docs, weights, 1, 4, per_partition=30)
    assert [r.doc_id for r in got.collect()] == want and got.columns == docs.columns


def test_bad_weights(docs):
    with pytest.raises(ValueError):
        pfair_mix.mix(docs, {"a": 0})


def slow_judge(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(h + p, v) for v, h, p in registry.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, rule, verdict


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://EXAMPLE.com/en/x?a=/b#c", "https://www.example.com/en/", "http://a.www.example.com/en/1", "http://notexample.com/en/", "http://example.com", "http://example.com?x", "x://a.net/es/", "x://net/fr/://y", "x://a..net/fr/", "http://example.com:80/en/", "http://u@example.com/de/", "x://net/es", "http://example.com/en/", "http://example.com/en/", "a\nb://example.net/es/q", "http://ÄB.com/é"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, url_filter.rules_frame(spark, registry.URL_RULES)).collect()}
    assert got == {i: slow_judge(u) for i, u in enumerate(urls)}
    assert {r.verdict for r in url_filter.judge(pages, spark.createDataFrame([], "verdict string, rule_host string, rule_path string")).collect()} == {"allow"}


def slow_bfd(items, capacity):
    bins = []
    for x in sorted(items, reverse=True):
        best = min((r for r in bins if r >= x), default=None)
        if best is None:
            bins.append(capacity - x)
        else:
            bins.remove(best)
            bins.append(best - x)
    return len(bins)


def test_packing_round_trip(docs, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(registry.tokenizer_path())
    got = best_fit_packing.pack_documents(docs, registry.tokenizer_path(), 64).collect()
    want = Counter()
    for r in rows:
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want[r[0], k, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    fill = defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
    for parts in fill.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 64
    assert len(fill) == slow_bfd([r.length for r in got], 64)


def test_histogram_packing_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(150):
        capacity = rng.choice([1, 7, 16, 50])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 60))]
        assert best_fit_packing.pack_histogram(Counter(items), capacity)[1] == slow_bfd(items, capacity)


def test_token_ids_of_odd_texts():
    from riffle.llm.token_ids import IdCache
    from tokenizers import Tokenizer

    path = registry.tokenizer_path()
    tok, cache = Tokenizer.from_file(path), IdCache(path)
    texts = ["", " ", "a<|endoftext|>b <|startoftext|>", "é e\u0301 ﬁ", "x\u00a0y\x1cz\x85q\u2028r", "don't I'LL 's --'s", "ΣΑΣ İ ŉ ſ", "12½ ²³ªº µM", "x" * 500 + " y", "＝̸ ≠", "日本語 テスト", "\ud7ff😀 ok"]
    assert [np.frombuffer(x, "<u4").tolist() for x in cache.ids([t.encode() for t in texts])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_chat_round_trip(spark):
    evil = [chat_format.END, chat_format.BODY, chat_format.CLOSE, "\\", "<\\s>", "<s>", "[\\INST]", registry.INJECTION, "a\\<[b", "", None, "é😀\n", "</s", "\\\\"]
    rng = random.Random(7)
    data, k = [], 0
    for conv in range(12):
        for turn in range(rng.randint(1, 6)):
            data.append((conv, turn, rng.choice(["user", "assistant", "system", None, "a[INST]b", "x\\", "r</s>"]), rng.choice(evil) if rng.random() < 0.8 else rng.choice(evil[:10]) + rng.choice(evil[:10])))
            k += 1
    data += [(None, 0, "assistant", "null key"), (None, 0, "user", "another"), (20, None, "assistant", "late"), (20, 1, "user", "first"), (21, 1, "assistant", "same"), (21, 1, "assistant", "same")]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    formatted = chat_format.format_conversations(frame)
    got = defaultdict(list)
    for r in chat_format.digests(formatted).collect():
        got[r.conv_id].append(r)
    by = defaultdict(list)
    for i, (c, t, r, x) in enumerate(data):  # a row with a null key stands by itself
        by[c, i if c is None else 0].append((t is None, t or 0, r or "", x or ""))
    texts = defaultdict(list)
    for r in formatted.collect():
        texts[r.conv_id].append(r)
    assert len(got[None]) == 2
    for (c, _), turns in by.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        said = hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest()
        (g,) = [g for g in got[c] if g.turns_sha256 == said]
        (whole,) = [w for w in texts[c] if [(t.role, t.text) for t in w.turns] == [t[2:] for t in turns]]
        assert g.n_turns == len(turns) and g.loss_chars == len(loss) and g.formatted_chars == len(whole.formatted)
        assert g.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        # the mask, by itself: spans of the rendering, unescaped
        back = lambda t: __import__("re").sub(r"([<\[])\\|\\(\\)", lambda m: m[1] or m[2], t)
        cut = [whole.formatted[s.start : s.end] for s in whole.loss]
        assert "".join(back(x) if s.escaped else x for x, s in zip(cut, whole.loss, strict=True)) == loss
        # no control string in any role or text as rendered
        marks = __import__("re").findall(r"<s>|</s>|\[INST\]|\[/INST\]", whole.formatted)
        assert marks == ["<s>", "[INST]", "[/INST]", "</s>"] * len(turns)


def test_chat_oracle_on_control_strings(spark, tmp_path):
    """The DuckDB form escapes by the same rule, with texts that hold one control string only."""
    import duckdb

    texts = [*chat_format.CONTROLS, "plain", "a\\b", "<s", "[\\INST]", "ends\\", "", None, "x<s>y[/INST]z"]
    rows = [(c, t, r, x) for c, (r, x) in enumerate((r, x) for r in ("user", "assistant", "a<s>", "r\\", None) for x in texts) for t in (0, 1)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(tuple(r) for r in registry.op8_chat_format(spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    found = db.sql(registry.ORACLE_SQL["op8_chat_format"])
    want = sorted(found.fetchall())
    assert found.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"] and got == want


def nearest_of(x, ids, q, k=20):
    score = x @ x[ids.index(q)]
    return [(ids[i], score[i]) for i in np.lexsort((ids, -score)) if ids[i] != q][:k]


def test_nearest_vectors(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((300, 8)).astype(np.float32)
    v[50:90] = v[50]
    data = [(int(i), [float(y) for y in x]) for i, x in enumerate(v)]
    data += [(400, None), (401, [0.0] * 8), (402, [None] + [1.0] * 7), (403, [float("nan")] + [1.0] * 7), (404, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (405, [9.0] * 3), (406, []), data[7]]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash")).withColumn("k", F.lit(0))
    got = defaultdict(dict)
    for r in learned_partitions.nearest(frame, F.col("vec_id") % 20 == 0, target=1.0).collect():
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    x = np.vstack([v.astype(np.float64), [9.0] * 3 + [0.0] * 5])  # the short vector counts as filled up
    ids = [*range(300), 405]
    for q in range(0, 300, 20):
        want = nearest_of(x, ids, q)
        assert [got[q][k + 1][0] for k in range(20)] == [i for i, _ in want]
        assert np.allclose([got[q][k + 1][1] for k in range(20)], [s for _, s in want], rtol=0, atol=1e-12)
    assert set(got) == set(range(0, 300, 20))


def test_an_id_with_two_vectors_has_one_list(spark):
    rows = [(i, [float(i + 1), 1.0]) for i in range(30)] + [(0, [-5.0, 2.0]), (7, [3.0, -2.0])]
    got = learned_partitions.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0, target=1.0).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 21)) and len({r.vec_id for r in got}) == 20


@pytest.mark.parametrize("one_level", [256, 4])
def test_routing_reaches_its_recall_with_fewer_probes(spark, monkeypatch, one_level):
    """The whole search against brute force, on one level and on two."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((40, 16)) * 3
    x = centres[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 16))
    seen = []
    fit = learned_partitions.fit_router
    monkeypatch.setattr(learned_partitions, "fit_router", lambda *a, **b: seen.append(fit(*a, **b)) or seen[-1])
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in learned_partitions.nearest(frame, F.col("vec_id") % 20 == 0, per_partition=64, one_level=one_level).collect():
        got[r.query_id].append(r.vec_id)
    assert seen[0].probes < seen[0].b2.size and seen[0].b2.size == (64 if one_level == 256 else 8)
    hits = [len({i for i, _ in nearest_of(x, list(range(4000)), q)} & set(got[q])) / 20 for q in range(0, 4000, 20)]
    assert all(len(v) == 20 for v in got.values()) and np.mean(hits) >= 0.9


def test_partition_levels():
    assert learned_partitions.levels(100) == (1, 1) and learned_partitions.levels(500) == (8, 1) and learned_partitions.levels(51_000) == (64, 1)
    first, second = learned_partitions.levels(10**9)
    assert first == second == 1024


def slow_statistics(text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text) if x]
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = set()
    for i in range(len(w) - 2):
        if tri[w[i], w[i + 1], w[i + 2]] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_rule_statistics(docs, rows):
    texts = [r[1] or "" for r in rows] + ["a b c a b c", "x\n\nx\n x\nx", "é|é|é #", "\x0b\x0c\u00a0\u2003 z", "a a a a"]
    assert [quality_rules.statistics(t.encode())[:5] for t in texts] == [slow_statistics(t) for t in texts]


def test_rules_are_learned_and_emitted(spark):
    rng = random.Random(5)
    rows = [(i, words(rng, 80) if i % 4 else " ".join(x + "###" for x in words(rng, 80).split()), "en", "s", 0) for i in range(400)]
    labels = spark.createDataFrame([(r[0], int(r[0] % 4 > 0), 0) for r in rows[:300]], LABELS)
    got = quality_rules.judge(spark.createDataFrame(rows, DOCS), labels).collect()
    assert all(r.kept == (r.doc_id % 4 > 0) for r in got if not r.base_failed) and sum(not r.base_failed for r in got) > 300


def test_classifiers_learn(spark):
    rng = random.Random(6)
    bad = ["moron", "idiotic", "stupidity", "worthless"]
    rows = []
    for i in range(400):
        w = words(rng, rng.randint(10, 200)).split()
        if i % 5 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        text = " ".join(w)
        rows.append((i, text if i % 7 else " ".join(x + "###" for x in w), "en", "s", 0))
    rows += [(900, None, None, None, None), (901, "", None, None, None), (902, "What a stupid m0ron", None, None, None)]
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(r[0], int(r[0] % 7 > 0), int(r[0] % 5 == 0)) for r in rows[:400]], LABELS)
    tox = {r.doc_id: r for r in toxicity.judge(docs, labels).collect()}
    held = [r for i, r in tox.items() if r.held_out and i < 400]
    assert held and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in tox.items())
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in held]) > 0.95
    assert tox[902].predicted == 1 and tox[900].predicted == tox[901].predicted == 0
    qual = {r.doc_id: r for r in quality_cnn.judge(docs, labels).collect()}
    held = [r for i, r in qual.items() if r.held_out and i < 400]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in qual.items())
    assert np.mean([r.predicted == (r.doc_id % 7 > 0) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in [*tox.values(), *qual.values()])


def test_scores_do_not_depend_on_the_batch():
    rng = random.Random(9)
    texts = [words(rng, rng.randint(0, 900)).encode() for _ in range(40)] + [b"", b"x" * 3000, (words(rng, 50).encode() + b" ") * 3]
    q = quality_cnn.train([(t, i % 2) for i, t in enumerate(texts)], epochs=1)
    whole = quality_cnn.score(q, texts)
    assert np.allclose(whole, [quality_cnn.score(q, [t])[0] for t in texts], atol=1e-6)
    quality_cnn.SLAB, old = 1024, quality_cnn.SLAB
    try:
        assert np.allclose(whole, quality_cnn.score(q, texts), atol=1e-6)
    finally:
        quality_cnn.SLAB = old


def test_long_texts_are_scored_whole():
    said = [b"a fine day you", b"the rest of the day", b"a day of rest", b"you the fine"]
    model = toxicity.train([(t + b" moron " * y + t, y) for t in said for y in (0, 1)] * 5)
    long = b"a fine day " * 200_000
    low, high = toxicity.score([long, long + b"moron " + long], *model.table())
    assert low < 0.5 < high


def test_rollup(spark, docs, rows, tmp_path):
    counts = token_rollup.counted(docs.select("source", "lang", "text"), {token_rollup.WORDS: None, "bpe": registry.tokenizer_path()})
    store = token_rollup.RollupStore(spark, f"file://{tmp_path}/r")
    image = F.struct("source", "lang", "tokenizer", "tokens")
    none = F.lit(None).cast(counts.select(image).schema[0].dataType)
    assert store.totals().count() == 0
    assert store.commit("1", token_rollup.signed(counts.select(none.alias("old"), image.alias("new"))))
    assert not store.commit("1", token_rollup.signed(counts.select(none.alias("old"), image.alias("new"))))
    want = Counter()
    for r in rows:
        want[r[3], r[2]] += len((r[1] or "").split())
    got = {(r.source, r.lang): r.tokens for r in store.totals().where("tokenizer = 'words_1'").collect()}
    assert got == dict(want)
    gone = counts.where("source = 'src0'")
    more = F.struct("source", "lang", "tokenizer", (F.col("tokens") + 1).alias("tokens"))
    store.commit("2", token_rollup.signed(gone.select(image.alias("old"), none.alias("new"))))
    rest = counts.where("source = 'src1'")
    store.commit("3", token_rollup.signed(rest.select(image.alias("old"), more.alias("new"))))
    after = {(r.source, r.lang): r.tokens for r in store.totals().where("tokenizer = 'words_1'").collect()}
    assert not any(s == "src0" for s, _ in after)
    assert after["src1", "en"] == want["src1", "en"] + sum(r[3] == "src1" and r[2] == "en" for r in rows)
    # what an attempt wrote without its entry in the log does not count, nor does an entry that is not yet in its place
    half = tmp_path / "r" / "data" / "lost"
    half.mkdir()
    (half / "part-0.parquet").write_bytes(b"torn")
    (tmp_path / "r" / "log" / ".aside").write_bytes(b"{")
    totals = sorted(map(str, store.totals().collect()))
    assert store.committed() == ["1", "2", "3"] and totals
    assert not store._claim("log", "2", {"data": "other"})
    # compacting changes no total, keeps ids, and can be followed by more batches
    assert store.compact() and store.committed() == ["1", "2", "3"] and sorted(map(str, store.totals().collect())) == totals
    assert not store.commit("2", token_rollup.signed(gone.select(image.alias("old"), none.alias("new"))))
    assert store.commit("4", token_rollup.signed(gone.select(none.alias("old"), image.alias("new"))))
    assert store.compact() and store.remove_replaced() > 0 and not half.exists()
    back = {(r.source, r.lang): r.tokens for r in store.totals().where("tokenizer = 'words_1'").collect()}
    assert back["src0", "en"] == want["src0", "en"] and back["src1", "en"] == after["src1", "en"]
