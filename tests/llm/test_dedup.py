import hashlib
import re

import numpy as np
import pytest

from soundweave.llm import chunks, common, substring_dedup, suffix_dedup

from .cases import empty, frame, sort, texts

LAST = 2**63 - 1


def covered(sequence, size, low, doc):
    gone = [False] * len(sequence)
    for i in range(len(sequence) - size + 1):
        if low[sequence[i : i + size]] < doc:
            gone[i : i + size] = [True] * size
    return gone


def least(docs, size):
    low = {}
    for d, s in docs:
        for i in range(len(s) - size + 1):
            k = s[i : i + size]
            low[k] = min(low.get(k, LAST), d)
    return low


def brute_words(rows, size=50):
    docs = [(LAST if d is None else d, tuple(re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode()))) for d, t in rows]
    low, out = least(docs, size), []
    for d, w in docs:
        gone = covered(w, size, low, d)
        out.append((None if d == LAST else d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def brute_bytes(rows, size=50):
    docs = [(LAST if d is None else d, (t or "").encode()) for d, t in rows]
    low, out = least(docs, size), []
    for d, b in docs:
        gone = covered(b, size, low, d)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((None if d == LAST else d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("parts", "fan", "cells"), [(1, chunks.FAN, substring_dedup.SHARD_CELLS), (7, chunks.FAN, 300), (7, 3, 300)])
def test_words_match_brute_force(spark, parts, fan, cells):
    rows = texts()
    got = substring_dedup.dedup(frame(spark, rows).repartition(parts), fan, cells).drop("kept").collect()
    assert sort(got) == sort(brute_words(rows))
    assert sum(r["n_removed"] for r in got) > 500


def test_kept_words_are_the_text(spark):
    rows = [(1, "a b c"), (2, "a b c")]
    assert sort(substring_dedup.dedup(frame(spark, rows)).select("doc_id", "kept").collect()) == [(1, "a b c"), (2, "a b c")]


@pytest.mark.parametrize(("hot", "fan", "size"), [(1, chunks.FAN, 900), (2, 3, 900), (suffix_dedup.HOT, chunks.FAN, suffix_dedup.SHARD_BYTES)])
def test_bytes_match_brute_force(spark, hot, fan, size):
    rows = texts(2)
    got = suffix_dedup.dedup(frame(spark, rows).repartition(5), hot, fan, size).drop("kept").collect()
    assert sort(got) == sort(brute_bytes(rows))
    assert sum(r["n_removed"] for r in got) > 3000


def test_exactly_one_shared_window(spark):
    own = [f"w{i}" for i in range(50)]
    words = [(9, " ".join(["p"] + own + ["q"])), (4, " ".join(["r", "s"] + own)), (12, " ".join(["t"] + own[1:] + ["u"]))]
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup(frame(spark, words)).collect()} == {4: 0, 9: 50, 12: 0}
    letters = "".join(chr(200 + i) for i in range(25))  # 50 bytes
    strings = [(9, "p" + letters + "q"), (4, "rs" + letters), (12, "t" + letters[1:] + "uvw")]
    assert {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.dedup(frame(spark, strings)).collect()} == {4: (0, 0), 9: (50, 1), 12: (0, 0)}


def test_empty_tables(spark):
    assert substring_dedup.dedup(empty(spark)).count() == 0
    assert suffix_dedup.dedup(empty(spark)).count() == 0


def test_suffix_sort_orders_groups_and_finds_equals():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 99, 3000).astype(np.uint8)
    text[1000:1400] = text[200:600]
    text[2000:2200] = 97
    for n in (0, 1, 2, 700):
        starts, groups = np.sort(rng.choice(2900, n)), np.sort(rng.integers(0, 7, n)).astype(np.uint64)
        found = suffix_dedup.Suffixes(text, starts, groups)
        order = found.sort()
        keys = [(int(groups[i]), text[starts[i] : starts[i] + 50].tobytes()) for i in order]
        assert keys == sorted(keys)
        if n:
            assert found.equal_neighbours(order).tolist() == [i > 0 and keys[i] == keys[i - 1] for i in range(n)]


def test_collisions_are_found_by_bytes():
    text = np.frombuffer(b"abcdefgh" * 8 + b"abcdefgh" * 7 + b"abcdefgX", np.uint8)
    found = suffix_dedup.Suffixes(text, np.array([0, 64, 70]), np.zeros(3, np.uint64))
    found.whole[:] = 5  # as if all hashes collided
    order = found.sort()
    claimed = found.equal_neighbours(order)
    raw = [text[found.starts[i] : found.starts[i] + 50].tobytes() for i in order]
    assert raw == sorted(raw)
    assert claimed.tolist() == [i > 0 and raw[i] == raw[i - 1] for i in range(3)]


def test_number_of_messages_follows_the_input(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 2000)
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 2000)
    real, sent = chunks.answers, []

    def spy(messages, judge, kind):
        sent[-1] += messages.count()
        return real(messages, judge, kind)

    monkeypatch.setattr(chunks, "answers", spy)
    line = " ".join(f"w{i % 71}" for i in range(700))
    for n in (8, 32):
        docs = spark.createDataFrame([(i, f"{line} {i}") for i in range(n)], "doc_id long, text string").repartition(n)
        for dedup in (lambda: suffix_dedup.dedup(docs, 2, 4, 100), lambda: substring_dedup.dedup(docs, 4, 20)):
            sent.append(0)
            assert dedup().count() == n
    assert sent[2] <= 4.5 * sent[0] and sent[3] <= 4.5 * sent[1]  # from 8 chunks to 32, 16 shards in both


def test_large_shards_are_judged_in_parts(spark):
    """Beyond fan shards a message still moves once, and a shard judges its runs part by part."""
    assert suffix_dedup.shards_of(10 << 30, chunks.FAN, suffix_dedup.SHARD_BYTES, suffix_dedup.PARTS) == chunks.FAN  # some 6 GB of Parquet
    assert suffix_dedup.shards_of(100 << 30, chunks.FAN, suffix_dedup.SHARD_BYTES, suffix_dedup.PARTS) > chunks.FAN
    rows = texts()
    got = suffix_dedup.dedup(frame(spark, rows).repartition(5), 2, 3, 900, 1 << 20, 500).drop("kept").collect()
    assert sort(got) == sort(brute_bytes(rows))


def test_small_corpora_make_few_files(spark, tmp_path, monkeypatch):
    """Every file that is made starts processes beside an executor; a small corpus makes few, however it is dealt."""
    rows = texts()
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    held = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = suffix_dedup.dedup(frame(spark, rows).repartition(5), 2, shard_bytes=300)
        assert sort(found.drop("kept").collect()) == sort(brute_bytes(rows))
        assert found.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    stages = [len(list(s.glob("part-*.parquet"))) for s in tmp_path.glob("stage-*")]
    assert len(stages) == 3 and max(stages) <= spark.sparkContext.defaultParallelism


def test_parts_of_a_shard_answer_as_the_whole():
    rng = np.random.default_rng(8)
    blobs = []
    for k in range(5):
        text = rng.integers(0, 2, 3000).astype(np.uint8)
        text[:1000] = np.tile(np.arange(100, dtype=np.uint8), 10)
        start = np.arange(0, 2900, 50)
        runs = suffix_dedup.Runs(text, start, rng.integers(1, 40, len(start)), rng.integers(0, 30, len(start)).astype(np.uint64), rng.integers(0, 9, len(start)))
        blobs.append(dict(suffix_dedup.RunExchange().messages(runs.taken(runs.classes()[0]), 0, 1))[0])
    whole = suffix_dedup.RunExchange().judge(blobs)
    assert any(any(b) for b in whole)
    assert all(suffix_dedup.RunExchange(n).judge(blobs) == whole for n in (1, 700, 5000, 1 << 20))


def test_classes_are_those_of_all_keys(monkeypatch):
    """Where the short key of a class doesn't tell hashes apart, all keys decide."""
    rng = np.random.default_rng(9)
    text = rng.integers(0, 2, 4000).astype(np.uint8)
    start = np.sort(rng.integers(0, 3000, 400))
    runs = suffix_dedup.Runs(text, start, rng.integers(1, 4, 400), rng.integers(0, 3, 400).astype(np.uint64), rng.integers(0, 50, 400))
    real = suffix_dedup.hashes_of
    for hashes in (real, lambda *a: [x & np.uint64(3) for x in real(*a)]):
        monkeypatch.setattr(suffix_dedup, "hashes_of", hashes)
        chosen, place = runs.classes()
        raw = [(int(runs.anchor[i]), text[start[i] : start[i] + runs.count[i] + 49].tobytes()) for i in range(400)]
        assert np.all(np.diff(runs.anchor[chosen].astype(int)) >= 0)
        assert all(raw[i] == raw[chosen[place[i]]] for i in range(400))
        if hashes is real:
            least = {k: min(int(runs.doc[j]) for j in range(400) if raw[j] == k) for k in raw}
            assert len(chosen) == len(least) and all(runs.doc[c] == least[raw[c]] for c in chosen)


def test_equal_hashes_are_compared_byte_by_byte(monkeypatch):
    rng = np.random.default_rng(5)
    text = rng.integers(0, 256, 600).astype(np.uint8)
    text[300:400] = text[0:100]
    start = np.array([0, 100, 200, 300, 400])
    runs = suffix_dedup.Runs(text, start, np.full(5, 51), np.array([9, 9, 9, 9, 4], np.uint64), np.array([5, 4, 3, 2, 1]))
    monkeypatch.setattr(suffix_dedup, "hashes_of", lambda text, start, length: [np.zeros(len(start), np.uint64)] * 2)  # all collide
    chosen, place = runs.classes()
    assert np.all(np.diff(runs.anchor[chosen].astype(int)) >= 0)
    for i in range(5):
        at = chosen[place[i]]
        assert (text[start[i] : start[i] + 100] == text[start[at] : start[at] + 100]).all() and runs.doc[at] <= runs.doc[i]
    blob = dict(suffix_dedup.RunExchange().messages(runs.taken(np.array([4, 0, 1, 2, 3])), 0, 1))[0]
    (told,) = suffix_dedup.RunExchange().judge([blob])
    want = np.concatenate([np.zeros(51), np.ones(51), np.zeros(51 * 3)])  # in order of anchor: the run of doc 5 is that of doc 2
    assert chunks.flags(told, 255).tolist() == want.astype(bool).tolist()


def test_long_texts_are_whole(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in rng.integers(0, 20000, 250_000)]
    words[200_000:200_300] = words[1000:1300]
    long = " ".join(words)  # over 1 MB
    rows = [(1, " ".join(words[1000:1300])), (2, long), (3, "x" + long[5:]), (4, long[-400:])]
    assert len(long) > 1 << 20
    got = {r["doc_id"]: r for r in substring_dedup.dedup(frame(spark, rows)).collect()}
    assert [got[i]["n_removed"] for i in (1, 2)] == [0, 600] and got[3]["n_removed"] == got[3]["n_words"] - 1 and got[4]["n_removed"] > 0
    own = {r["doc_id"]: r for r in suffix_dedup.dedup(frame(spark, rows)).collect()}
    assert own[1]["n_removed"] == 0 and own[2]["n_spans"] == 2 and own[3]["n_removed"] == own[3]["n_bytes"] - 1 and own[4]["n_removed"] == 400


def test_sketch_never_underestimates():
    rng = np.random.default_rng(0)
    parts = [rng.integers(0, 5000, 3000).astype(np.uint64) for _ in range(4)]
    work = substring_dedup.Cells(12)
    messages = [dict(work.messages(substring_dedup.sketch(p, 0, 12)[:2], 0, 1))[0] for p in parts]
    hot = [chunks.flags(a, len(substring_dedup.sketch(p, 0, 12)[0])) for a, p in zip(work.judge(messages), parts)]
    keys, counts = np.unique(np.concatenate(parts), return_counts=True)
    repeated = set(keys[counts > 1].tolist())
    for p, h in zip(parts, hot):
        found, _, place = substring_dedup.sketch(p, 0, 12)
        for k, flag in zip(p.tolist(), h[place].tolist()):
            assert flag or k not in repeated


def test_rolling_hash_is_that_of_the_window():
    values = np.arange(300, dtype=np.uint64) % np.uint64(7)
    prefix = chunks.prefix_hash(values, 12345678901)
    h = chunks.window_hash(prefix, np.arange(250), 50, 12345678901)
    assert h[3] == h[10] == h[17] and h[3] != h[4]
