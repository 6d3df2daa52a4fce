import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from soundweave.llm import common, lm_score, simhash, toxicity

from .cases import empty, frame, sort, texts


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(rows):
    """(fingerprint, root) of every row."""
    prints = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    return [(p, root(i)) for i, p in enumerate(prints)]


def brute_components(rows):
    found, low = brute_roots(rows), {}
    for (d, _), (_, r) in zip(rows, found):
        if d is not None:
            low[r] = min(low.get(r, d), d)
    return [(d, f"{p:016x}", low.get(r)) for (d, _), (p, r) in zip(rows, found)]


def test_components_match_brute_force(spark):
    rows = texts()
    long = next(t for d, t in rows if d == 304).split()
    rows += [(600 + i, " ".join(long[: 2000 + i])) for i in range(12)] + [(700, "A  b\tC"), (701, "a b c")]
    found = simhash.near_duplicates(frame(spark, rows))
    assert sort(simhash.fingerprint_rows(found).collect()) == sort(brute_components(rows))


def test_one_of_each_component_stays(spark):
    rows = texts()
    docs = frame(spark, rows)
    kept = simhash.one_of_each(docs, simhash.near_duplicates(docs))
    assert kept.columns == docs.columns
    own = [r[0] for r in kept.collect()]
    assert len(own) == len({r for _, r in brute_roots(rows)})
    assert all(d is None or d in {c for _, _, c in brute_components(rows)} for d in own)
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.one_of_each(empty(spark), simhash.near_duplicates(empty(spark))).count() == 0


def links(values):
    return {(i, j) for i in range(len(values)) for j in range(i) if (int(values[i]) ^ int(values[j])).bit_count() <= 2}


def classes(n, pairs):
    label = list(range(n))
    for _ in range(n):
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    return label


def test_simhash_stages_few_files(spark, tmp_path, monkeypatch):
    """Every file that is made starts processes beside an executor; small tables are staged in few, however they are dealt."""
    rows = texts()
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = simhash.near_duplicates(frame(spark, rows).repartition(3))
        assert sort(simhash.fingerprint_rows(found).collect()) == sort(brute_components(rows))
        assert found.rdd.getNumPartitions() == 1
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    stages = [len(list(s.glob("part-*.parquet"))) for s in tmp_path.glob("stage-*")]
    assert len(stages) > 6 and max(stages) <= 3


@pytest.mark.parametrize("n", [2, 24, 25, 64, 65, 200])
def test_bit_sliced_buckets_keep_every_component(n):
    rng = np.random.default_rng(n)
    centres = rng.integers(0, 2**63, 5).astype(np.uint64)
    values = np.unique(centres[rng.integers(0, 5, n)] ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)))
    zero = np.zeros(len(values), np.int64)
    a, b = simhash.bucket_links(zero, zero, values)
    at = {int(v): i for i, v in enumerate(values)}
    got = [(at[int(x)], at[int(y)]) for x, y in zip(a, b)]
    assert classes(len(values), got) == classes(len(values), links(values))
    assert len(got) < len(values)  # a forest, not all pairs


def test_many_buckets_at_once_keep_their_own_links():
    rng = np.random.default_rng(2)
    rows = sorted({(int(t), int(k), int(v)) for t, k, v in zip(rng.integers(0, 3, 900), rng.integers(0, 30, 900), rng.integers(0, 64, 900) * 37 % 256)} | {(4, 4, 1 << i) for i in range(60)} | {(5, 5, i) for i in range(0, 3000, 7)})
    tables, keys, values = (np.array(c) for c in zip(*rows))
    a, b = simhash.bucket_links(tables, keys, values.astype(np.uint64))
    for bucket in {r[:2] for r in rows}:
        own = [v for t, k, v in rows if (t, k) == bucket]
        roots = classes(len(own), links(np.array(own)))
        want = {(v, own[r]) for v, r in zip(own, roots) if own[r] != v}
        assert want <= set(zip(a.tolist(), b.tolist()))
    assert len(a) == sum(len(own) - len(set(classes(len(own), links(np.array(own))))) for bucket in {r[:2] for r in rows} for own in [[v for t, k, v in rows if (t, k) == bucket]])


def test_blocks_are_abandoned():
    values = np.array([0] * 0 + [3] + [(1 << 40) - 1 - i for i in range(200)], np.uint64)
    words, near = simhash.blocks_within(simhash.planes(values), 3, list(range(64)), 0)
    assert words.tolist() in ([0], [0, 3]) and int(near[0]) & 1  # the last block has room that is filled with zeros


def test_planes_and_counters():
    values = np.array([0, 1, 3, 7, 2**63, 2**64 - 1], np.uint64)
    p = simhash.planes(values)
    near = simhash.within((p[j] for j in range(64)), 1)
    assert [bool(int(near[0]) >> i & 1) for i in range(6)] == [True, True, True, False, True, False]
    far = simhash.planes(np.full(64, 2**64 - 1, np.uint64))
    assert simhash.within((far[j] for j in range(64)), 1) is None


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {(r["node"], r["root"]) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}


INSULTS = ["idiot", "moron", "scum", "pathetic"]


def labelled(n=400, seed=5):
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("abdeglnorstu"), 6)) for _ in range(300)]
    rows = []
    for i in range(n):
        own = rng.choice(vocabulary, 30).tolist()
        toxic = i % 3 == 0
        if toxic:
            own.insert(int(rng.integers(0, 30)), INSULTS[i % 4])
        rows.append((i, " ".join(own), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    rows = labelled()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return toxicity.train(docs, spark.createDataFrame([(d, 1, t) for d, _, t in rows], "doc_id long, quality int, toxic int"))


def test_held_out_rows_are_told_apart(spark, model):
    rows = labelled()
    toxic = {d: t for d, _, t in rows}
    got = toxicity.score(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), model).collect()
    held = [r for r in got if r["held_out"]]
    assert 40 < len(held) < 140
    assert np.mean([r["predicted"] == toxic[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_gaps_and_inserted_characters_are_tolerated(model):
    clean = model.scores([b"label nurse agent ground"])[0]
    for text in (b"you idiot", b"you IDIOT!", b"you i.d.i.o.t", b"you idxiot", b"you i d i o t", b"you 1d10t", b"pathettic"):
        assert model.scores([text])[0] > max(0.5, clean), text


def test_toxicity_cases(spark, model):
    rows = texts() + [(None, "idiot"), (500, "x" * 3000 + " idiot")]
    got = toxicity.score(frame(spark, rows), model).collect()
    assert len(got) == len(rows)
    assert all(r["held_out"] is False for r in got if r["doc_id"] is None)
    kept = toxicity.keep_clean(frame(spark, rows), model)
    assert kept.columns == frame(spark, rows).columns
    assert kept.count() == sum(r["predicted"] == 0 for r in got) < len(rows)
    nobody = toxicity.train(frame(spark, rows), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(frame(spark, rows), nobody).collect()} == {0.0}
    assert toxicity.score(empty(spark), model).count() == 0


def test_bound_never_hides_a_near_word(model):
    rng = np.random.default_rng(0)
    words = [bytes(w) for w in rng.integers(65, 95, (400, 9)).astype(np.uint8)]
    words += [w[:k] + bytes([70]) + w[k:] for w in model.landmarks for k in range(len(w))]
    words = [w for w in dict.fromkeys(words) if len(w) <= toxicity.WIDTH]
    values = toxicity.kernel(words, model.vectors)
    want = {w for w, v in zip(words, values) if v.max() > toxicity.LEAST + 1e-6}
    assert want <= set(model.near(words))


def slow_vector(word):
    """Every three letters in order, the beginning of the word being one, that span six places at most."""
    line = [toxicity.BEGIN] + [c - toxicity.SHIFT for c in word]
    out = Counter()
    for a, b, c in combinations(range(len(line)), 3):
        if c - a < toxicity.SPAN:
            out[line[a], line[b], line[c]] += toxicity.DECAY ** (c - a - 2)
    length = sum(v * v for v in out.values()) ** 0.5
    return {k: v / length for k, v in out.items()}


def slow_kernel(a, b):
    x, y = slow_vector(a), slow_vector(b)
    return sum(v * y.get(k, 0) for k, v in x.items())


def test_kernel_is_that_of_enumerated_triples():
    words = [w for text in (b"idiot idxiot i.d.i.o.t garden aaaaaa pathetic moron abcabcabcabc oto", "né été naïveté".encode()) for w in toxicity.words_of(text)]
    assert np.allclose(toxicity.kernel(words, toxicity.dense(words)), [[slow_kernel(a, b) for b in words] for a in words], atol=1e-5)


def test_scores_are_those_of_the_enumerated_kernel(model):
    for text in (b"you idiot label nurse", b"agent moron scum! idxiot garden", b"label nurse agent ground", b"x", b""):
        words, m = sorted(set(toxicity.words_of(text))), len(model.landmarks)
        k = np.array([[slow_kernel(w, v) for v in model.landmarks] for w in words]).reshape(-1, m)
        k = k[(k > toxicity.LEAST).any(axis=1)]
        x = np.zeros(3 * m)
        if len(k):
            over = np.clip((k - toxicity.LEAST) / (toxicity.SURE - toxicity.LEAST), 0, 1)
            x = np.concatenate([over.max(axis=0), np.clip((k.max(axis=0) - toxicity.SAME) / (1 - toxicity.SAME), 0, 1), over.sum(axis=0) / np.sqrt(max(len(words), toxicity.FEW))])
        assert abs(model.scores([text])[0] - 1 / (1 + np.exp(-(x @ model.weights + model.bias)))) < 1e-3


def test_a_rare_class_fills_half_of_the_sample(spark):
    rows = [r for r in labelled(900) if not r[2] or r[0] % 9 == 0]
    few = [(d, t) for d, _, t in rows]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = toxicity.train(docs, spark.createDataFrame(few, "doc_id long, toxic int"), 200)
    assert len(got.landmarks) >= 2
    scores = got.scores([t.encode() for _, t, _ in rows])
    assert scores[[i for i, (_, t) in enumerate(few) if t]].mean() > scores[[i for i, (_, t) in enumerate(few) if not t]].mean()


def test_kernel_is_normalised_and_symmetric():
    words = [toxicity.words_of(w)[0] for w in (b"idiot", b"idxiot", b"garden", b"aaaaaa")]
    values = toxicity.kernel(words, toxicity.dense(words))
    assert np.allclose(np.diag(values), 1, atol=1e-5) and np.allclose(values, values.T, atol=1e-5)
    assert values[0, 1] > 0.5 > values[0, 2]


def network(n=40, seed=0):
    rng = np.random.default_rng(seed)
    net = lm_score.Network(lm_score.huffman(rng.integers(1, 90, n), 5))
    net.weights = rng.normal(0, 0.5, net.weights.shape)
    return net


def test_gradient_is_that_of_the_loss():
    net, rng = network(), np.random.default_rng(1)
    near, target = rng.integers(0, 41, (60, 4)).astype(np.int32), rng.integers(0, 40, 60).astype(np.int32)
    got = np.zeros(net.weights.shape)
    for own, g in net.gradient(near, target):
        assert len(set(own.tolist())) == len(own)
        got[own] += g
    for r, c in [*zip(rng.integers(0, net.rows, 60).tolist(), rng.integers(0, lm_score.DIM, 60).tolist()), *((net.root + i, 3) for i in range(10)), (net.node, 15)]:
        net.weights[r, c] += 1e-5
        more = net.log_probs(near, target).sum()
        net.weights[r, c] -= 2e-5
        less = net.log_probs(near, target).sum()
        net.weights[r, c] += 1e-5
        assert abs(got[r, c] + (more - less) / 2e-5) < 1e-4, (r, c)


def test_leaves_add_up_to_one_and_start_at_the_counts():
    net = network()
    near = np.repeat(np.array([[1, 40, 3, 7]], np.int32), 40, axis=0)
    assert abs(np.exp(net.log_probs(near, np.arange(40))).sum() - 1) < 1e-9
    counts = np.array([50, 3, 9, 30, 1, 7])
    for roots in (1, 3, 32):
        start = lm_score.Network(lm_score.huffman(counts, roots))
        assert np.allclose(np.exp(start.log_probs(near[:6] % 6, np.arange(6))), counts / 100, atol=1e-5)
    one = lm_score.Network(lm_score.huffman(np.array([5.0])))
    assert one.log_probs(near[:2] * 0, np.zeros(2, np.int32)).tolist() == [0, 0] and not any(g.any() for _, g in one.gradient(near[:2] * 0, np.zeros(2, np.int32)))


def test_other_words_add_up_to_one():
    counts, spelled = np.array([5, 1, 3]), np.log(np.array([0.1, 0.05, 0.02]))
    found = lm_score.Vocabulary(np.zeros(0, np.uint64), np.zeros(0), 10.0, 3.0, 0.17)
    logs = found.other_log_probs(counts + 1, spelled)  # each with the masked one added, which is the tenth
    assert abs(np.exp(logs).sum() - 1) < 1e-9


def slow_scores(rows, leaves):
    """Counts by hand, and each word's probability with the untrained weights, which are those of the counts."""
    words = [[w.encode().translate(lm_score.LOWER) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] for _, t in rows]
    count = Counter(w for own in words for w in own)
    h = lambda w: xxhash.xxh64_intdigest(w)
    top = sorted(count, key=lambda w: (-count[w], np.uint64(h(w)).astype(np.int64)))[: leaves - 1]
    pairs = Counter()
    for w in (w for own in words for w in own):
        pairs.update(zip(b" " + w, w + b" "))
    after = Counter()
    for (a, _), n in pairs.items():
        after[a] += n
    spell = lambda w: np.prod([(pairs[a, b] + 0.5) / (after[a] + 0.5 * (255 if a == 32 else 256)) for a, b in zip(b" " + w, w + b" ")])
    n, t, rest = sum(count.values()) - sum(count[w] for w in top), len(count) - len(top), max(1e-9, 1 - sum(map(spell, top)))

    def log_prob(w):
        if w in top:
            return np.log(count[w] / (sum(count.values()) + (n == 0)))
        m, k = count[w] - 1, t - (count[w] == 1)
        share = min(spell(w) / rest, 1)
        return np.log(n / sum(count.values())) + np.log((m + k * share) / (n - 1 + k) if n > 1 else share)

    return [(d, len(own), sum(map(log_prob, own))) for (d, _), own in zip(rows, words)]


@pytest.mark.parametrize("leaves", [1, 20, 1 << 15])
def test_scores_are_sums_over_words(spark, monkeypatch, leaves):
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 2000)  # many blocks
    rows = texts()
    staged = lm_score.hashed(frame(spark, rows).repartition(3))
    counted, found = lm_score.vocabulary(staged, 50, leaves)
    assert counted.select("block").distinct().count() > 5
    net = lm_score.train(staged, found, 0)
    got = lm_score.score(staged, counted, found, net).collect()
    want = slow_scores(rows, leaves)
    assert sort((r["doc_id"], r["n_words"], round(r["log_prob"], 1)) for r in got) == sort((d, n, round(x, 1) + 0.0) for d, n, x in want)
    assert all(r["mean_log_prob"] is None and r["log_prob"] == 0 for r in got if r["n_words"] == 0)
    assert all(abs(r["perplexity"] - np.exp(-r["log_prob"] / r["n_words"])) < 1e-6 * r["perplexity"] for r in got if r["n_words"])


def test_training_tells_words_by_both_sides(spark):
    rng = np.random.default_rng(4)
    line = lambda: " ".join(f"a{k} b{k} c{k}" for k in rng.integers(0, 9, 30))
    rows = [(i, line()) for i in range(300)] + [(900, "a1 b1 c1"), (901, "a1 b2 c1"), (902, " "), (None, "a1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in lm_score.lm_scores(docs).collect()}
    assert len(got) == len(rows) and got[902]["log_prob"] == 0 and got[902]["perplexity"] is None
    assert got[900]["log_prob"] > got[901]["log_prob"] + 3
    unigram = np.log(1 / 27)
    assert np.mean([got[i]["mean_log_prob"] for i in range(300)]) > unigram + 1


def test_empty_table_scores_nothing(spark):
    assert lm_score.lm_scores(empty(spark)).count() == 0
    assert [r["n_words"] for r in lm_score.lm_scores(frame(spark, [(1, None), (2, " ")])).collect()] == [0, 0]


def test_words_are_split_as_bytes_are():
    rng = np.random.default_rng(0)
    odd = [None, "", " ", "A", " a  B\t", "x\x0b\x0cY\r\n", "\x1c\x1d z\x1f", "\x85 \xa0É é", "\u2003a\u3000", "\x00 \x00a"] + ["".join(rng.choice(list("aB \té\x1e\u2009\n"), 40)) for _ in range(60)]
    places, words, sizes = lm_score.distinct_words(pa.array(odd, pa.string()).slice(1).take(pa.array(range(len(odd) - 1))))
    want = [(t or "").encode().translate(lm_score.LOWER).split() for t in odd[1:]]
    assert [words[p] for p in places] == [w for own in want for w in own] and sizes.tolist() == list(map(len, want)) and len(set(words)) == len(words)


def test_neighbours_stay_within_a_text():
    own = lm_score.Texts(np.array([5, 6, 7, 8], np.int32), np.array([3, 0, 1]), 99)
    near = np.concatenate([n for n, _ in own.batches(2)])
    assert near.tolist() == [[99, 99, 6, 7], [99, 5, 7, 99], [5, 6, 99, 99], [99, 99, 99, 99]]


def test_changes_are_means_by_use():
    before = np.zeros((700, lm_score.DIM), np.float32)
    after, used = [before.copy(), before.copy()], [np.zeros(700, np.int64), np.zeros(700, np.int64)]
    after[0][600], used[0][600] = 1, 3
    after[1][600], used[1][600] = 5, 1
    after[1][2], used[1][2] = 7, 2
    got = {b: np.frombuffer(c, "<f4").reshape(-1, lm_score.DIM) for batch in lm_score.mean_changes(iter([lm_score.changes(before, a, u) for a, u in zip(after, used)])) for b, c in zip(batch.column("block").to_pylist(), batch.column("change").to_pylist())}
    assert (got[0][2] == 7).all() and (got[1][600 - 512] == 2).all() and got[0].sum() == 7 * lm_score.DIM
