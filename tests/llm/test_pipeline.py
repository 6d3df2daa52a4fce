"""The pipeline against the same decisions made one document at a time."""

import corpus_pipeline
from soundweave.llm import packing, secrets, toxicity
from soundweave.llm.common import stage

from .cases import empty, frame, texts
from .test_models import brute_roots, labelled
from .test_scans import SECRETS, brute_contamination, check_packing


def tables(spark, folder):
    rows = [(1000 + d, t) for d, t, _ in labelled()] + [(d, t) for d, t in dict(texts()).items() if d is not None] + [(104, dict(texts())[104])] + [(2000 + i, f"{t} ending {i}") for i, t in enumerate(SECRETS)]
    passage = next(t for d, t in rows if d == 20)
    items = [(1, " ".join(passage.split()[:12])), (2, None)]
    frame(spark, rows, extra=False).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1000 + d, 1, t) for d, _, t in labelled()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, items


def test_stages_and_run(spark, tmp_path):
    folder = str(tmp_path)
    rows, items = tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]

    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = [(d, t) for d, t in rows if model.scores([(t or "").encode()])[0] < 0.5]
    assert 100 < len(rows) - len(want) < 160
    got = {}
    for name, work in corpus_pipeline.STAGES:
        before = docs
        docs = stage(work(spark, docs, folder))
        got[name] = docs
        if name != "packing":
            assert docs.columns == before.columns
    pairs = lambda df: sorted((r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect())
    assert pairs(got["toxicity"]) == sorted((d, t or "") for d, t in want)

    best = {}
    for (d, t), (_, r) in zip(want, brute_roots(want)):
        best[r] = min(best.get(r, (d, t or "")), (d, t or ""), key=lambda x: x[0])
    kept = pairs(got["near_duplicates"])
    assert sorted(d for d, _ in kept) == sorted(d for d, _ in best.values()) and set(kept) <= {(d, t or "") for d, t in want}

    clean = [(d, t) for (d, t), w in zip(kept, brute_contamination(kept, items)) if not w[5]]
    assert len(clean) < len(kept) and pairs(got["decontamination"]) == sorted(clean)

    masked = {r["doc_id"]: (r["text"], r["n_chars"]) for r in got["secrets"].collect()}
    assert sorted(masked) == sorted(d for d, _ in clean)
    for d, t in clean:
        spans = [(a, b) for _, a, b, _ in secrets.base_findings(t)]
        if not spans and "q9Zk3" not in t:
            assert (masked[d][0] or "") == t
        else:
            assert not secrets.base_findings(masked[d][0]) or "[SECRET]" in masked[d][0]
            assert masked[d][1] == len(masked[d][0])
    final = [(d, t) for d, (t, _) in masked.items()]
    check_packing(final, got["packing"].collect())
    again = corpus_pipeline.run(spark, folder).collect()
    check_packing(final, again)
    assert {r["length"] <= packing.SEQUENCE for r in again} == {True}


def test_nulls_ties_and_repeated_rows_pass_every_stage(spark, tmp_path):
    folder = str(tmp_path)
    same = "one text that is here again and again with some words of its own"
    rows = [(None, same), (None, same), (7, same), (7, same), (8, None), (8, None), (None, None), (9, ""), (10, f"{same} " * 20_000), (11, "password=hunter2hunter2 of a text of its own")]
    frame(spark, rows, extra=False).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(None, "q"), (1, None), (1, ""), (2, "no such words anywhere in these texts at all my friend")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(None, 1, 1), (7, None, None), (8, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    # Of equal fingerprints one stays: the one text with the least doc_id, one of the empty ones, and the two others.
    assert sorted({r["doc_id"] for r in got}) == [7, 8, 10, 11]
    check_packing([(7, same), (8, ""), (10, rows[8][1]), (11, "[SECRET] of a text of its own")], got)


def test_empty_tables_pass_every_stage(spark, tmp_path):
    folder = str(tmp_path)
    empty(spark).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
