"""Small tables with every case that operators must handle."""

import random

SYLLABLES = "ba ke ti so mu ra ne pi do lu ša né".split()


def words(rng, n):
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]


def texts(seed=1):
    """(doc_id, text): nulls, blanks, copies, near copies, shared passages, long and odd texts, repeated rows."""
    rng = random.Random(seed)
    passage = " ".join(words(rng, 70))
    base = [" ".join(words(rng, rng.randint(1, 160))) for _ in range(30)]
    rows = list(enumerate(base))
    rows += [(100, None), (101, ""), (102, " \t\n "), (103, base[3]), (104, base[3]), (104, base[3]), (105, base[3] + " end"), (None, base[4]), (None, None), (5, base[6])]
    rows += [(200 + i, f"{base[i][:40]} {passage} {base[i + 1][:60]}") for i in range(8)]
    rows += [(300, "ha " * 400), (301, "ha " * 300 + "ho"), (302, "x" * 500), (303, "\x00\x1f  \U0001f600é" * 40), (304, " ".join(words(rng, 9000)))]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, extra=True):
    """A table of documents with columns whose names clash."""
    data = [(d, t, "en" if i % 2 else None, f"src{i % 3}" if i % 5 else None, None if t is None else len(t), "TEXT", 7) for i, (d, t) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long" + (", found string, _0 int" if extra else "")
    df = spark.createDataFrame([r if extra else r[:5] for r in data], schema)
    return df.toDF(*df.columns[:5], "Text", "row") if extra else df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def sort(rows):
    return sorted((tuple(r) for r in rows), key=repr)
