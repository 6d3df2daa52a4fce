"""A corpus pipeline: clean, thin, protect and pack documents.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.

* toxicity: documents predicted to be toxic go; the machine learns from the labels in sf_dir.
* near_duplicates: of each group of linked fingerprints the document with the least doc_id stays.
* decontamination: documents with a word inside a benchmark window go.
* secrets: findings are masked in the text, and n_chars follows; no document goes.
* packing: pieces of sequences, one row each.

Defined cases, in each stage by the operator's own rules: a null text counts as empty and stays null; rows of one
fingerprint, repeated rows and null texts among them, are one group, of which the least doc_id stays (a null one only
where there is no other; of repeated rows one); a null doc_id has no label; items without words contaminate nothing; texts
of any length are read whole; empty tables pass all stages; other columns of documents, whatever their names, go through
all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from soundweave.llm import decontaminate, packing, secrets, simhash, toxicity
from soundweave.llm.common import read, stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, simhash.near_duplicates(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.uncontaminated(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask_secrets(docs, secrets.scan_secrets(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(packing.TOKENIZER), public_tokenizers.path(packing.RANKS)).drop("cost")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: A trained machine and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is staged in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for _, work in STAGES[:-1]:
        docs = stage(work(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
