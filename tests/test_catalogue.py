"""Each registered query against its SQL on the smallest tables, and what the driver asks of the entry point."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from soundweave.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", catalogue.ORACLE_SQL)
def test_query_matches_sql(spark, base, name):
    df = catalogue.QUERIES[name](spark, DATA)
    found = base.execute(catalogue.ORACLE_SQL[name])
    names = sorted(c[0] for c in found.description)
    want = [dict(zip((c[0] for c in found.description), row)) for row in found.fetchall()]
    assert sorted(df.columns) == names
    assert sorted(repr([r[c] for c in names]) for r in df.collect()) == sorted(repr([r[c] for c in names]) for r in want)


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.ORACLE_SQL])
def test_query_without_sql_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 50
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_all_surfaces_are_read_by_longest_match(spark):
    words = catalogue.index_of(spark, DATA).lexicon.select("surface", "reading", "normalized", "cost", "mora_count").collect()
    known = {}
    for w in sorted(words, key=lambda w: (w["cost"], w["reading"], w["normalized"])):
        known.setdefault(w["surface"], (w["reading"], w["normalized"]))
    kana = lambda c: "\u3041" <= c <= "\u3096" or "\u30a1" <= c <= "\u30fa" or c == "ー"
    upper = lambda t: "".join(chr(ord(c) + 96) if "\u3041" <= c <= "\u3096" else c for c in t)

    def brute(text):
        if all(map(kana, text)):
            reading = upper(text)
        else:
            reading = None
        i, read, normal = 0, "", ""
        while i < len(text):
            n = next((n for n in range(min(12, len(text) - i), 0, -1) if text[i : i + n] in known), 0)
            r, m = known[text[i : i + n]] if n else (upper(text[i]) if kana(text[i]) else "", text[i])
            i, read, normal = i + max(n, 1), read + r, normal + m
        return reading or read, normal

    last = {}
    for w in words:
        last[w["mora_count"]] = max(last.get(w["mora_count"], ""), w["surface"])
    want = sorted((t, *brute(t)) for w in {(w["surface"], w["mora_count"]) for w in words} for t in [w[0] + last[w[1]]])
    got = catalogue.QUERIES["read_texts"](spark, DATA).collect()
    assert sorted((r["text"], r["reading"], r["normalized"]) for r in got) == want
    assert len({r["text_id"] for r in got}) == len(got) >= len(known)
