"""Texts of over a megabyte through every operator; short ones beside them stay what they are."""

import hashlib
import zlib

import numpy as np
import pytest

from soundweave.llm import chat, decontaminate, lm_score, media, packing, secrets, simhash, toxicity

from .cases import SYLLABLES, frame
from .test_models import brute_fingerprint
from .test_scans import RANKS, TOKENIZER, brute_contamination, check_packing


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(9)
    words = ["".join(w) for w in rng.choice(SYLLABLES, (230_000, 3))]
    words[::1000] = ["token=abcdefgh12345"] * 230
    long = " ".join(words)
    assert len(long) > 1 << 20
    return [(1, long), (2, "x" * 1_200_000), (3, "ba ke ti so"), (4, "\U0001f600é " * 300_000)]


def test_secrets(spark, rows):
    docs = frame(spark, rows)
    scanned = secrets.scan_secrets(docs)
    got = {r["doc_id"]: r for r in secrets.digests(scanned).collect()}
    assert [got[i]["n_assign"] for i in (1, 2, 3, 4)] == [230, 0, 0, 0]
    assert got[1]["base_sha256"] == hashlib.sha256(secrets.joined([x[:3] for x in secrets.base_findings(rows[0][1])]).encode()).hexdigest()
    masked = {r["doc_id"]: r["text"] for r in secrets.mask_secrets(docs, scanned).collect()}
    assert masked[1] == rows[0][1].replace("token=abcdefgh12345", "[SECRET]") and masked[4] == rows[3][1]


def test_fingerprints(spark, rows):
    got = {r["doc_id"]: r["fingerprint"] for r in simhash.fingerprint_rows(simhash.near_duplicates(frame(spark, rows))).collect()}
    assert got == {d: f"{brute_fingerprint(t):016x}" for d, t in rows}


def test_contamination(spark, rows):
    items = [(1, " ".join(rows[0][1].split()[150_000:150_040])), (2, "ba ke ti so")]
    got = decontaminate.contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).drop("spans").collect()
    assert sorted(map(tuple, got)) == sorted(brute_contamination(rows, items))


def test_packing(spark, rows):
    check_packing(rows, packing.pack(frame(spark, rows), TOKENIZER, RANKS).collect())


def test_audio(spark, rows):
    got = {r["doc_id"]: r for r in media.audio_digests(frame(spark, rows)).collect()}
    for d, t in rows:
        payload = media.payload_of(t.encode())
        assert got[d]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and got[d]["tail_crc32"] == zlib.crc32(payload[-64:]) and got[d]["n_bytes"] == len(t.encode())


def test_lm_scores(spark, rows):
    got = {r["doc_id"]: r for r in lm_score.lm_scores(frame(spark, rows)).collect()}
    assert {d: got[d]["n_words"] for d, _ in rows} == {d: len(t.split()) for d, t in rows}
    assert all(np.isfinite(r["log_prob"]) and r["log_prob"] < 0 for r in got.values())


def test_toxicity(spark, rows):
    model = toxicity.Model([toxicity.words_of(b"idiot")[0]], np.array([3.0, 3.0, 0.0]), -2.0)
    end = [(9, rows[0][1] + " idiot")]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(frame(spark, rows + end), model).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 0, 9: 1}


def test_conversations(spark, rows):
    turns = [(d, 0, "assistant", t) for d, t in rows]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, other int").toDF("conv_id", "turn", "role", "text", "Text")
    got = {r["conv_id"]: r for r in chat.conversation_digests(df, TOKENIZER).collect()}
    assert {d: (r["loss_chars"], r["loss_sha256"]) for d, r in got.items()} == {d: (len(t), hashlib.sha256(t.encode()).hexdigest()) for d, t in rows}
