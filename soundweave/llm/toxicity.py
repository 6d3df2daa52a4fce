r"""Toxicity scores by a string-kernel support vector machine with Nyström landmarks.

The kernel of two words counts the letter triples they have in common as subsequences with gaps: a triple that spans s
letters weighs DECAY ** (s - 3), and spans up to SPAN count, so that `idxiot` or `i.d.i.o.t` stays near `idiot`; the beginning of
a word is a letter of its own. It is normalised to 1 for equal words. Landmarks are the words of the labelled training
rows that tell the classes apart best (a z-score of LEAST_Z or more), and no two of them alike. A document is known by
how near its nearest word is to each landmark, whether it is the same, and how many of its distinct words are near (per
square root of all), through the Nyström map K_mm ** -1/2; a linear machine with squared hinge loss separates the labels, and a logistic fit on its
margin gives the score. Landmarks that are in toxic rows only are added to the training rows alone and with a letter
inserted.

Training uses labelled rows with crc32(doc_id as text) mod 5 not 0, at most TRAIN_ROWS of them by order of a hash, half of
either class where both have enough (the documented bound); words are counted by the executors, and the driver gets TOP words and the rows' landmark features.
Scoring reads each whole text once, without a shuffle; of a word, an upper bound of its kernel with any landmark is
looked up first, and the exact kernel is computed only where the bound is over LEAST.

Defined cases: a null or empty text has no word and scores like one without insults; labels that are null don't count,
of several for one doc_id the largest does, and of several texts for one the least is learned from; without both labels every score is 0; a null doc_id is not held out;
repeated rows each give a row; an empty table gives an empty result; other columns are ignored; words that tell the classes
apart equally well are taken in order of their letters; a text of any length is read whole, and its distinct words are
looked at 4096 at a time.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, documents, filter_rows, map_groups, raw_texts, stage

TRAIN_ROWS = 6000
TOP, LANDMARKS = 400, 96
LEAST_Z, ALIKE = 4.0, 0.85
SPAN, DECAY = 6, 0.9
LEAST, SURE = 0.45, 0.6  # kernel values between which nearness grows from 0 to 1
SAME = 0.8  # and from which sameness does, up to 1
FEW = 100  # a text counts as having so many distinct words at least
WIDTH, OVERLAP = 24, 8  # longer words are looked at in windows of WIDTH letters
LEAST_DOCS = 3
ALTERED, CERTAIN = 2, 0.95  # forms of a landmark added to training, if so large a share of its rows is toxic

GAPS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]
WEIGHTS = np.array([DECAY ** (j - 2) for _, j in GAPS], np.float32)
#: Letters to 1-26, with look-alike digits and signs as letters; bytes beyond ASCII to 27-30; others are dropped.
LOOKALIKE = dict(zip(b"0134578@$!", b"oieastbasi", strict=True))
CODES = np.array([c - 96 if 97 <= (c := LOOKALIKE.get(b, b + 32 if 65 <= b <= 90 else b)) <= 122 else 27 + b % 4 if b >= 128 else 0 for b in range(256)], np.uint8)
#: A code as a byte that is no white space.
SHIFT = 64
TABLE = bytes(c + SHIFT if c else 32 for c in CODES.tolist())
DROPPED = bytes(b for b in range(256) if not CODES[b] and not bytes([b]).isspace())
SPELLED = re.compile(rb"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
DIMS, BEGIN, PARTS = 1 << 15, 31, 3

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def words_of(raw: bytes) -> list[bytes]:
    """The words of a text as letter codes, in order; runs of three or more single letters are also one word."""
    if not raw.isascii():
        raw = raw.decode().lower().encode()
    line = raw.translate(TABLE, DROPPED)
    words = line.split()
    out = [w for w in words if 2 < len(w) <= WIDTH]
    for w in words:
        if len(w) > WIDTH:
            out += [w[i : i + WIDTH] for i in range(0, len(w) - OVERLAP, WIDTH - OVERLAP)]
    for m in SPELLED.finditer(line):
        w = b"".join(m[0].split())
        out += [w[i : i + WIDTH] for i in range(0, max(1, len(w) - OVERLAP), WIDTH - OVERLAP)]
    return out


def triples(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(words, n) feature ids and weights; a weight is 0 where the word has ended."""
    wide = max(3, max(map(len, words)))
    letters = np.zeros((len(words), wide + SPAN), np.int32)
    letters[:, 0] = BEGIN
    codes = np.array(words, f"S{wide}").view(np.uint8).reshape(len(words), wide)
    letters[:, 1 : 1 + wide] = np.where(codes, codes - SHIFT, 0)
    ids, weights = [], []
    for (i, j), w in zip(GAPS, WEIGHTS, strict=True):
        a, b, c = letters[:, : wide - 1], letters[:, i : i + wide - 1], letters[:, j : j + wide - 1]
        ids.append((a << 10) | (b << 5) | c)
        weights.append(np.where(c > 0, w, np.float32(0)))
    return np.concatenate(ids, axis=1), np.concatenate(weights, axis=1)


def merged(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of the normalised sparse vectors, each feature once a row."""
    ids, weights = triples(words)
    rows, at = np.nonzero(weights)
    key, place = np.unique(rows * DIMS + ids[rows, at], return_inverse=True)
    value = np.bincount(place, weights[rows, at], len(key))
    row = key // DIMS
    length = np.sqrt(np.bincount(row, value * value, len(words)))
    return row, key % DIMS, (value / length[row]).astype(np.float32)


def dense(words: list[bytes]) -> np.ndarray:
    """(words, DIMS) normalised feature vectors, for few words."""
    out = np.zeros((len(words), DIMS), np.float32)
    row, feature, value = merged(words)
    out[row, feature] = value
    return out


def kernel(words: list[bytes], landmarks: np.ndarray, step: int = 1024) -> np.ndarray:
    """(words, landmarks) normalised kernel values; landmarks as dense vectors."""
    used = np.flatnonzero(landmarks.any(axis=0))  # only features that some landmark has matter
    column = np.full(DIMS, -1)
    column[used] = np.arange(len(used))
    small = np.ascontiguousarray(landmarks[:, used].T)
    out = [np.zeros((0, len(landmarks)), np.float32)]
    for i in range(0, len(words), step):
        part = words[i : i + step]
        row, feature, value = merged(part)
        have = column[feature] >= 0
        table = np.zeros((len(part), len(used)), np.float32)
        table[row[have], column[feature[have]]] = value[have]
        out.append(table @ small)
    return np.concatenate(out)


@dataclass
class Model:
    landmarks: list[bytes]
    weights: np.ndarray  # of features, the Nyström map included
    bias: float

    def prepare(self) -> None:
        self.vectors = dense(self.landmarks)
        self.bound = self.vectors.max(axis=0)
        # Landmarks that are alike share a bound, which is closer than that of all.
        leaders: list[int] = []
        alike = self.vectors @ self.vectors.T
        for i in range(len(self.landmarks)):
            if not leaders or alike[i, leaders].max() < 0.3:
                leaders.append(i)
        own = alike[:, leaders].argmax(axis=1)
        self.bounds = [self.vectors[own == k].max(axis=0) for k in range(len(leaders))]

    def near(self, words: list[bytes]) -> dict[bytes, np.ndarray]:
        """Of distinct words, those whose kernel with some landmark is over LEAST, with all their values."""
        if not words:
            return {}
        if not hasattr(self, "bound"):
            self.prepare()
        picked: list[bytes] = []
        words = sorted(words, key=len)  # the matrices are as wide as the longest word
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            ids, w = triples(part)
            # Repeated triples make a vector longer, never shorter: these are over the exact values.
            length = np.sqrt(np.maximum((w * w).sum(axis=1), 1e-9))
            some = np.flatnonzero((self.bound[ids] * w).sum(axis=1) > LEAST * length)
            ids, w, length = ids[some], w[some], length[some]
            hit = np.zeros(len(some), bool)
            for bound in self.bounds:
                left = np.flatnonzero(~hit)
                hit[left] = (bound[ids[left]] * w[left]).sum(axis=1) > LEAST * length[left]
            picked += [part[k] for k in some[hit].tolist()]
        values = kernel(picked, self.vectors)
        return {w: v for w, v in zip(picked, values, strict=True) if v.max() > LEAST}

    def features(self, raws: list[bytes]) -> np.ndarray:
        return self.features_of([set(words_of(raw)) for raw in raws])

    def features_of(self, sets: list[set[bytes]]) -> np.ndarray:
        """(texts, 3 x landmarks): how near the nearest word is (0 at LEAST, 1 from SURE on), how much the same (0 at SAME, 1
        at 1), and the sum of nearness over the distinct words, per square root of their number (FEW at least)."""
        m = len(self.landmarks)
        out = np.zeros((len(sets), PARTS * m), np.float32)
        near = self.near(list(set().union(*sets)))
        for row, own in zip(out, sets, strict=True):
            found = sorted(near.keys() & own)
            if found:
                values = np.stack([near[w] for w in found])
                over = np.clip((values - LEAST) / (SURE - LEAST), 0, 1)
                row[:m], row[m : 2 * m] = over.max(axis=0), np.clip((values.max(axis=0) - SAME) / (1 - SAME), 0, 1)
                row[2 * m :] = over.sum(axis=0) / np.sqrt(max(len(own), FEW))
        return out

    def scores(self, raws: list[bytes]) -> np.ndarray:
        if not self.landmarks:
            return np.zeros(len(raws))
        margin = self.features(raws).astype(np.float64) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -50, 50)))


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def choose(candidates: list[bytes], most: int = LANDMARKS) -> list[bytes]:
    """The first candidates that aren't much like one chosen already."""
    chosen: list[bytes] = []
    if candidates:
        vectors = dense(candidates)
        kept: list[int] = []
        for i, w in enumerate(candidates):
            if len(kept) < most and (not kept or (vectors[kept] @ vectors[i]).max() < ALIKE):
                kept.append(i)
                chosen.append(w)
    return chosen


def altered(word: bytes, rng: np.random.Generator, times: int = ALTERED) -> list[bytes]:
    """The word, and some forms with one letter more inside it."""
    out = [word]
    for _ in range(times):
        at = int(rng.integers(1, len(word)))
        out.append((word[:at] + bytes([SHIFT + int(rng.integers(1, 27))]) + word[at:])[:WIDTH])
    return out


def fit_machine(x: np.ndarray, y: np.ndarray, reg: float = 3e-4, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss (y in -1, 1), by Newton steps over the rows within
    the margin, halved until the loss falls."""
    a = np.hstack([x, np.ones((len(y), 1))])
    ridge = reg * np.append(np.ones(x.shape[1]), 1e-6)
    loss = lambda w: (np.maximum(0, 1 - y * (a @ w)) ** 2).mean() + (ridge * w * w).sum()
    w = np.zeros(a.shape[1])
    now = loss(w)
    for _ in range(steps):
        near = a[y * (a @ w) < 1]
        own = y[y * (a @ w) < 1]
        hess = near.T @ near / len(y) + np.diag(ridge + 1e-12)
        step = np.linalg.solve(hess, near.T @ own / len(y)) - w
        size = 1.0
        while size > 1e-4 and (new := loss(w + size * step)) > now:
            size /= 2
        if size <= 1e-4 or now - new < 1e-9:
            break
        w, now = w + size * step, new
    return w[:-1], float(w[-1])


def fit_logistic(margin: np.ndarray, y: np.ndarray, heavy: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(slope, offset) of the logistic curve through labels 0 and 1 of these weights, by Newton steps with a little
    shrinkage."""
    a, b = 1.0, 0.0
    x = np.column_stack([margin, np.ones(len(margin))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ [a, b], -30, 30)))
        grad = x.T @ (heavy * (p - y)) + 1e-2 * np.array([a - 1, b])
        hess = (x * (heavy * (p * (1 - p) + 1e-6))[:, None]).T @ x + 1e-2 * np.eye(2)
        a, b = np.array([a, b]) - np.linalg.solve(hess, grad)
    return float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    known = columns(labels, "doc_id", "toxic").select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("toxic in (0, 1) and id is not null").where(~held_out("id")).groupBy("id").agg(F.max("toxic").alias("toxic"))
    labelled = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    first = lambda toxic, n: known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("id"), "id").limit(n)
    sample = first(0, max(rows // 2, rows - labelled.get(1, 0))).unionByName(first(1, max(rows - rows // 2, rows - labelled.get(0, 0))))
    plain = documents(docs)
    rows_of = plain.join(F.broadcast(sample), plain["doc_id"] == sample["id"])  # rows many at most
    chosen = stage(rows_of.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))  # one row a doc_id

    def seen(batch: pa.RecordBatch) -> dict:
        sets = [set(words_of(raw)) for raw in raw_texts(batch)]
        toxic = batch.column("toxic").to_pylist()
        return {"word": [w for s in sets for w in s], "toxic": [t for s, t in zip(sets, toxic, strict=True) for _ in s]}

    size = {r["toxic"]: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    if not n0 or not n1:
        return Model([], np.zeros(0), 0.0)
    counts = map_groups(chosen, seen, "word binary, toxic int").groupBy("word").agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("n"))
    share, rate1, rate0 = F.col("n") / (n0 + n1), F.col("pos") / n1, (F.col("n") - F.col("pos")) / n0
    z = (rate1 - rate0) / F.sqrt(share * (1 - share) * (1 / n0 + 1 / n1) + 1e-12)
    best = counts.where(F.col("pos") >= min(LEAST_DOCS, n1)).withColumn("gain", z).where(F.col("gain") >= LEAST_Z)
    picked = best.orderBy(F.desc("gain"), "word").limit(TOP).collect()
    top = [bytes(r["word"]) for r in picked]
    certain = {bytes(r["word"]) for r in picked if r["pos"] >= CERTAIN * r["n"]}
    model = Model(choose(top), np.zeros(0), 0.0)
    if not model.landmarks:
        return Model([], np.zeros(0), 0.0)

    def featured(batch: pa.RecordBatch) -> dict:
        return {"x": list(model.features(raw_texts(batch))), "toxic": batch.column("toxic")}

    got = map_groups(chosen, featured, "x array<float>, toxic int").toPandas()
    x, y = np.stack(got["x"].to_numpy()).astype(np.float64), got["toxic"].to_numpy()
    model.prepare()
    rng = np.random.default_rng(0)
    forms = [f for w in model.landmarks if w in certain for f in altered(w, rng)]
    if forms:  # a landmark alone, or altered, is toxic as well
        x, y = np.concatenate([x, model.features_of([{f} for f in forms])]), np.append(y, np.ones(len(forms), int))
    values, vectors = np.linalg.eigh(model.vectors.astype(np.float64) @ model.vectors.T)
    nystrom = vectors @ np.diag(np.maximum(values, 1e-3) ** -0.5) @ vectors.T
    both = np.kron(np.eye(PARTS), nystrom)
    w, b = fit_machine(x @ both, np.where(y == 1, 1.0, -1.0))
    own = slice(0, len(got))  # the rows themselves, each class as heavy as among all labels
    heavy = np.where(y[own] == 1, labelled[1] / n1, labelled[0] / n0)
    slope, offset = fit_logistic((x[own] @ both) @ w + b, y[own], heavy * len(got) / heavy.sum())
    return Model(model.landmarks, slope * (both @ w), slope * b + offset)


def score(docs: DataFrame, model: Model) -> DataFrame:
    sent = _sent(docs.sparkSession, model)

    def run(batch: pa.RecordBatch) -> dict:
        own = _model(sent)
        values = own.scores(raw_texts(batch))
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": values, "predicted": (values >= 0.5).astype(np.int32)}

    return map_groups(documents(docs).withColumn("held_out", held_out()), run, SCHEMA)


_models: dict = {}


def _sent(spark, model: Model) -> tuple[str, object]:
    return uuid.uuid4().hex, spark.sparkContext.broadcast((model.landmarks, model.weights, model.bias))


def _model(sent: tuple[str, object]) -> Model:
    """The broadcast model, prepared once a worker."""
    name, value = sent
    if name not in _models:
        _models.clear()
        _models[name] = Model(*value.value)
    return _models[name]


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, that aren't predicted to be toxic; no shuffle."""
    sent = _sent(docs.sparkSession, model)
    return filter_rows(docs, lambda raws: (_model(sent).scores(raws) < 0.5).tolist())
