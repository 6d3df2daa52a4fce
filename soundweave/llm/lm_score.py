r"""Language-model scores by masked pseudo-likelihood.

Words [^\x20\x09-\x0D]+, A-Z lower-cased, are predicted from both sides; a document's score is the sum of the conditional
log-probabilities of its words, each with itself masked.

Vocabulary: every distinct word is counted over the whole corpus, exactly. The LEAVES - 1 most frequent words have a leaf
of their own in one of ROOTS Huffman trees over these counts; one more leaf stands for all other words, of which a word with m other
occurrences has (m + t * s) / (n + t), where the others occur n times as t distinct words and s is the word's share by
spelling (a byte-pair model of all words' letters, less what the leaves' words have). So each string has a probability
and all of them add up to one; a word that occurs nowhere else is told by its letters.

Network: the embeddings of the SIDE words before a word and the SIDE after it (a leaf beyond either end), scaled by
distance, are added and passed through tanh; a softmax chooses the tree, and every inner node on the way to the word's leaf
decides by a logistic unit of its own. Before training these decide as the counts do: training starts at the unigram model.

What is gathered: `hashed` stages texts as places in blocks of BLOCK_BYTES, and by block the distinct words (64-bit
hashes), how often each occurs and how it spells. `vocabulary` splits these by ranges of hashes into shards of SHARD words
at most, whose number follows the input, adds up the counts in each and gives them back to the blocks; no machine holds
all words. The leaves' words (the bound LEAVES) are all that the driver gets of them.

Training is in numpy and covers every word of every document once, in ROUNDS rounds of as many parts of the blocks: in each
every task starts from the same weights, takes Adagrad steps over its own documents, and gives back the change of each row of weights with the number of
times it was used. A row's new weights are the mean over tasks by that number; the sums are made block by block as
messages stream in, so the driver only gets one set of weights (some 6 MB). A lost task is trained again from the same
start.

Defined cases: a null or blank text has no words and log_prob 0, and a null mean; repeated rows each count and each give
a row; an empty table gives an empty result; other columns are ignored. Words that tie in frequency are ordered by hash.
Texts of any length are read whole; one over BLOCK_BYTES is a block of its own and is predicted BATCH words at a time. How rows lie in
partitions changes scores slightly, as it does for any training by parts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import spread
from .common import arrow_schema, documents, groups, raw_texts, record, stage

LEAVES, ROOTS = 1 << 15, 32
SIDE, DIM = 2, 16  # the last place of a hidden row is 1
ROUNDS, BATCH, RATE = 3, 4096, 0.3
BLOCK_BYTES, SHARD = 1 << 22, 1 << 22
ROWS = 512  # of weights in a message
OFFSETS = np.array([i for i in range(-SIDE, SIDE + 1) if i])

SPACE = 32
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
PLAIN = bytes(SPACE if b in b" \t\n\v\f\r" else LOWER[b] for b in range(256))
SCHEMA = "doc_id long, n_words long, log_prob double, mean_log_prob double, perplexity double"
HASHED = "block long, doc_ids array<long>, sizes array<long>, places binary, words binary, times binary, spelled binary"


# Letters -----------------------------------------------------------------------------------------------------------


def letter_pairs(docs: DataFrame) -> np.ndarray:
    """(256, 256) natural logarithms: the byte after a byte in a word, SPACE standing before and after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(1 << 16, np.int64)
        for part in groups(batches):
            raw = np.frombuffer(b" %b " % b" ".join(raw_texts(part)).translate(PLAIN), np.uint8)
            for i in range(0, len(raw) - 1, 1 << 20):
                own = raw[i : i + (1 << 20) + 1].astype(np.int32)
                found += np.bincount((own[:-1] << 8) + own[1:], minlength=1 << 16)
        found[(SPACE << 8) + SPACE] = 0
        at = np.flatnonzero(found)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(found[at], pa.int64())], names=["pair", "n"])

    pairs = np.full(1 << 16, 0.5)  # for pairs that no word has
    for pair, n in documents(docs).select("text").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n")).toLocalIterator():
        pairs[pair] += n
    pairs[(SPACE << 8) + SPACE] = 0
    pairs = pairs.reshape(256, 256)
    with np.errstate(divide="ignore"):
        return np.log(pairs / pairs.sum(axis=1, keepdims=True)).astype(np.float32)


def spellings(words: list[bytes], pairs: np.ndarray) -> np.ndarray:
    """Log-probabilities of words, not none, as strings of bytes."""
    raw = np.frombuffer(b" %b " % b" ".join(words), np.uint8)
    starts = np.flatnonzero(raw == SPACE)[:-1]
    return np.add.reduceat(pairs[raw[:-1], raw[1:]].astype(np.float64), starts).astype(np.float32)


# Vocabulary --------------------------------------------------------------------------------------------------------


def distinct_words(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(each word's place among the distinct words, these, the number of words of each text)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
    coded = pc.dictionary_encode(lists.flatten())
    places, words = coded.indices.to_numpy(), coded.dictionary.cast(pa.binary()).to_pylist()
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    if b"" in words:  # before or after white space
        none = words.index(b"")
        some = places != none
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[some], minlength=len(sizes))
        places = places[some]
        places = places - (places > none)
        del words[none]
    return places.astype("<u4"), words, sizes


def hashed(docs: DataFrame) -> DataFrame:
    """HASHED rows, staged, one a block: its documents with their numbers of words, each word's place (32 bits) among the
    block's distinct words, and these."""
    pairs, arrow = letter_pairs(docs), arrow_schema(docs.sparkSession, HASHED)
    sent = docs.sparkSession.sparkContext.broadcast(pairs)

    def block_of(part: pa.RecordBatch, block: int) -> dict:
        every, words, sizes = distinct_words(part.column("text"))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), "<u8", len(words))
        times = np.bincount(every, minlength=len(words)).astype("<u4")
        spelled = spellings(words, sent.value).astype("<f4") if words else np.zeros(0, "<f4")
        blobs = {"places": every, "words": hashes, "times": times, "spelled": spelled}
        return {"block": [block], "doc_ids": [part.column("doc_id").to_pylist()], "sizes": [sizes.tolist()]} | {k: [x.tobytes()] for k, x in blobs.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for i, part in enumerate(groups(batches, budget=BLOCK_BYTES)):
            yield record(block_of(part, first + i), arrow)

    return stage(documents(docs).mapInArrow(run, HASHED))


@dataclass
class Vocabulary:
    """The leaves' words, most frequent first, as hashes with counts; and of all other words: occurrences, distinct words,
    and the share of strings that no leaf has by spelling."""

    hashes: np.ndarray
    counts: np.ndarray
    n: float
    t: float
    rest: float

    def __post_init__(self) -> None:
        self.order = np.argsort(self.hashes)
        self.ranked = self.hashes[self.order]

    def ids(self, words: np.ndarray) -> np.ndarray:
        """The leaf of each hash; 0 is that of all other words."""
        if not len(self.ranked):
            return np.zeros(len(words), np.int32)
        at = np.minimum(np.searchsorted(self.ranked, words), len(self.ranked) - 1)
        return np.where(self.ranked[at] == words, self.order[at] + 1, 0).astype(np.int32)

    def other_log_probs(self, counts: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """Of words without a leaf, given that the word has none, with one occurrence of it masked."""
        n, t = self.n - 1, self.t - (counts == 1)
        share = np.minimum(spelled.astype(np.float64) - np.log(self.rest), 0)
        size = np.log(np.maximum(n + t, 1))
        with np.errstate(divide="ignore"):
            backed = np.where(n > 0, np.log(t) - size + share, share)
            return np.logaddexp(np.log(counts - 1.0) - size, backed)


COUNTED = "block long, shard int, counts binary, top array<struct<word: long, n: long, spelled: float>>, n long, t long"


def count_shard(table: pa.Table, most: int) -> pa.Table:
    """From rows (block, shard, words, times, spelled) of one shard, COUNTED rows: by block the corpus's count of each
    word; and in a row of its own the shard's most frequent words, its occurrences and its distinct words."""
    words, times, spelled = (np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()]) for c, kind in (("words", "<u8"), ("times", "<u4"), ("spelled", "<f4")))
    distinct, first, at = np.unique(words, return_index=True, return_inverse=True)
    n = np.bincount(at, times, len(distinct)).astype(np.int64)
    cuts = np.cumsum([len(x) // 8 for x in table.column("words").to_pylist()])[:-1]
    counts = [x.tobytes() for x in np.split(np.minimum(n[at], (1 << 32) - 1).astype("<u4"), cuts)]  # only leaves' words have more
    best = np.lexsort((distinct, -n))[:most]
    top = [{"word": w, "n": k, "spelled": s} for w, k, s in zip(distinct[best].view(np.int64).tolist(), n[best].tolist(), spelled[first[best]].tolist(), strict=True)]
    none, shard = [None] * len(counts), table.column("shard").to_pylist()
    return pa.table([
        pa.array([*table.column("block").to_pylist(), None], pa.int64()), pa.array([*shard, shard[0]], pa.int32()), pa.array([*counts, None], pa.binary()),
        pa.array([*none, top], pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64()), ("spelled", pa.float32())]))), pa.array([*none, int(n.sum())], pa.int64()), pa.array([*none, len(n)], pa.int64()),
    ], names=["block", "shard", "counts", "top", "n", "t"])


def vocabulary(rows: DataFrame, most: int = SHARD, leaves: int = LEAVES) -> tuple[DataFrame, Vocabulary]:
    """(block, shard, counts) with counts in the order of the words' hashes, and the corpus's vocabulary."""
    shards = 1 + (rows.agg(F.sum(F.length("words"))).first()[0] or 0) // (8 * most)
    shards = max(shards, rows.sparkSession.sparkContext.defaultParallelism)
    width = np.uint64((1 << 64) // shards + 1)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, *blobs in zip(*(batch.column(c).to_pylist() for c in ("block", "words", "times", "spelled")), strict=True):
                words, times, spelled = (np.frombuffer(x, k) for x, k in zip(blobs, ("<u8", "<u4", "<f4"), strict=True))
                order = np.argsort(words)
                words, times, spelled = words[order], times[order], spelled[order]
                shard = (words // width).astype(np.int32)
                own = np.unique(shard)
                cuts = np.searchsorted(shard, own)[1:]
                parts = [[x.tobytes() for x in np.split(v, cuts)] for v in (words, times, spelled)] if len(own) else [[], [], []]
                yield pa.record_batch([pa.array([block] * len(own), pa.int64()), pa.array(own, pa.int32()), *(pa.array(x, pa.binary()) for x in parts)], names=["block", "shard", "words", "times", "spelled"])

    apart = rows.where("words is not null").select("block", "words", "times", "spelled").mapInArrow(split, "block long, shard int, words binary, times binary, spelled binary")
    counted = stage(apart.repartition(shards, "shard").groupBy("shard").applyInArrow(lambda table: count_shard(table, leaves - 1), COUNTED))
    whole = counted.where("block is null")
    n, t = whole.agg(F.sum("n"), F.sum("t")).first()
    best = whole.select(F.explode("top").alias("x")).select("x.*").orderBy(F.desc("n"), "word").limit(leaves - 1).collect()  # the bound
    hashes, counts = np.array([r["word"] for r in best], np.int64).view(np.uint64), np.array([r["n"] for r in best], np.float64)
    known = float(np.exp(np.array([r["spelled"] for r in best], np.float64)).sum())
    found = Vocabulary(hashes, counts, float((n or 0) - counts.sum()), float((t or 0) - len(best)), max(1e-9, 1 - known))
    return counted.where("block is not null").select("block", "shard", "counts"), found


# The tree and the network ------------------------------------------------------------------------------------------


@dataclass
class Trees:
    """Of each leaf its tree, the inner nodes from the root on and the side taken at each (1 or -1), one leaf after
    another."""

    tree: np.ndarray
    first: np.ndarray
    size: np.ndarray
    nodes: np.ndarray
    sides: np.ndarray
    bias: np.ndarray  # of each node: the log of the odds of side 1 by the counts
    shares: np.ndarray  # of each tree: the log of its share

    @property
    def leaves(self) -> int:
        return len(self.size)


def huffman(counts: np.ndarray, roots: int = ROOTS) -> Trees:
    """The trees of leaves with these counts (a leaf without any counts as one)."""
    m = len(counts)
    weight = [max(1.0, float(c)) for c in counts]
    heap = [(w, i) for i, w in enumerate(weight)]
    heapq.heapify(heap)
    n = max(0, m - roots)
    parent, side, bias = [-1] * (m + n), [0] * (m + n), []
    for node in range(m, m + n):
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x], side[x], parent[y], side[y] = node, -1, node, 1
        bias.append(np.log(b / a))
        heapq.heappush(heap, (a + b, node))
    tree, paths = [0] * (m + n), [[] for _ in range(m + n)]
    for k, (_, root) in enumerate(sorted(heap)):
        tree[root] = k
    for node in range(m + n - 1, -1, -1):  # a parent has a greater number
        if (up := parent[node]) >= 0:
            tree[node], paths[node] = tree[up], [*paths[up], (up - m, side[node])]
    size = np.array([len(p) for p in paths[:m]], np.int64)
    table = np.array([p for own in paths[:m] for p in own], np.int32).reshape(-1, 2)
    shares = np.log(np.array([w for w, _ in sorted(heap)]) / sum(weight))
    return Trees(np.array(tree[:m], np.int32), np.cumsum(size) - size, size, table[:, 0].astype(np.uint16), table[:, 1].astype(np.float32), np.array(bias, np.float32), shares.astype(np.float32))


class Network:
    """Rows of weights: embeddings on the left, on the right (the last of either beyond the text's end), nodes, trees, and
    the scales of the 2 * SIDE places with the hidden row's bias."""

    def __init__(self, tree: Trees, weights: np.ndarray | None = None):
        self.tree, m = tree, tree.leaves
        self.right, self.node = m + 1, 2 * (m + 1)
        self.root = self.node + len(tree.bias)
        self.dense = self.root + len(tree.shares)
        self.rows = self.dense + 2 * SIDE + 1
        self.weights = self.initial() if weights is None else weights

    def initial(self, seed: int = 7) -> np.ndarray:
        out = np.zeros((self.rows, DIM), np.float32)
        out[: self.node] = np.random.default_rng(seed).normal(0, 0.3, (self.node, DIM))
        out[self.node : self.root, -1] = self.tree.bias
        out[self.root : self.dense, -1] = self.tree.shares
        out[self.dense : -1] = 0.5
        return out

    def forward(self, near: np.ndarray, target: np.ndarray) -> tuple:
        """(embeddings by place, hidden rows, log-probabilities of the trees, words' steps down their trees, their places,
        node rows, hidden rows by step, sums towards the sides taken) of words in their neighbourhoods."""
        w, scale = self.weights, self.weights[self.dense :]
        embedded = [np.take(w, near[:, i] + (self.right if i >= SIDE else 0), axis=0) for i in range(2 * SIDE)]
        total = embedded[0] * scale[0]
        for e, s in zip(embedded[1:], scale[1:-1], strict=True):
            total += e * s
        total += scale[-1]
        hidden = np.tanh(total)
        hidden[:, -1] = 1
        trees = w[self.root : self.dense] @ hidden.T  # a column a word, so that sums run over whole rows
        trees -= trees.max(axis=0)
        trees -= np.log(np.exp(trees).sum(axis=0))
        steps = self.tree.size[target]
        at = spread(self.tree.first[target], steps)
        rows = np.take(w[self.node : self.root], self.tree.nodes[at], axis=0)
        wide = np.repeat(hidden, steps, axis=0)
        return embedded, hidden, trees, steps, at, rows, wide, np.einsum("ij,ij->i", rows, wide) * self.tree.sides[at]

    def log_probs(self, near: np.ndarray, target: np.ndarray) -> np.ndarray:
        _, _, trees, steps, *_, z = self.forward(near, target)
        out = trees[self.tree.tree[target], np.arange(len(target))].astype(np.float64)
        some = steps > 0
        if some.any():
            logs = np.minimum(z, 0) - np.log1p(np.exp(-np.abs(z)))
            out[some] += np.add.reduceat(logs, (np.cumsum(steps) - steps)[some], dtype=np.float64)
        return out

    def gradient(self, near: np.ndarray, target: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of the summed negative log-probability: (row numbers, their gradients), no row twice."""
        embedded, hidden, trees, steps, at, rows, wide, z = self.forward(near, target)
        out = []
        d_trees = np.exp(trees)
        d_trees[self.tree.tree[target], np.arange(len(target))] -= 1
        d_total = d_trees.T @ self.weights[self.root : self.dense]
        if len(at):
            pull = (-self.tree.sides[at] / (1 + np.exp(np.clip(z, -30, 30))))[:, None]
            wide *= pull
            own, d_nodes = _summed(self.tree.nodes[at], wide)
            out.append((own + self.node, d_nodes))
            some = steps > 0
            rows *= pull
            d_total[some] += _segments(rows, (np.cumsum(steps) - steps)[some])
        d_total *= 1 - hidden * hidden
        scale = self.weights[self.dense :]
        for first, places in ((0, range(SIDE)), (self.right, range(SIDE, 2 * SIDE))):
            own, d = _summed(np.concatenate([near[:, i] for i in places]).astype(np.uint16), np.concatenate([d_total * scale[i] for i in places]))
            out.append((own + first, d))
        out.append((np.arange(self.root, self.rows), np.concatenate([d_trees @ hidden, np.stack([*[np.einsum("ij,ij->j", e, d_total) for e in embedded], d_total.sum(axis=0)])])))
        return out


def _segments(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows from each start to the next. Two numbers are added as one complex number, which is faster."""
    pairs = np.ascontiguousarray(rows).view(np.result_type(rows.dtype, np.complex64))
    return np.add.reduceat(pairs, starts, axis=0).view(rows.dtype)


def _summed(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct numbers in order, sums of their rows); index of 16 bits, which is sorted by radix."""
    order = np.argsort(index, kind="stable")
    ranked = index[order]
    new = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    return ranked[new].astype(np.int64), _segments(np.take(rows, order, axis=0), new)


class Texts:
    """The leaves of a block's words, and what is needed to look up their neighbours: texts lie apart by SIDE edges."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, edge: int):
        self.words = words
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.places = np.arange(len(words)) + SIDE * (1 + self.doc)
        self.padded = np.full(len(words) + SIDE * (1 + len(sizes)), edge, np.int32)
        self.padded[self.places] = words

    def batches(self, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(the 2 * SIDE neighbours, the words) in order, size words at a time."""
        for i in range(0, len(self.words), size):
            yield self.padded[self.places[i : i + size, None] + OFFSETS], self.words[i : i + size]


def learn(net: Network, texts: Iterator[Texts], rate: float = RATE) -> np.ndarray:
    """Adagrad over the words of the texts in order, BATCH words a step; how often each row was used. net is changed."""
    squares, used = np.full(net.weights.shape, 1e-4, np.float32), np.zeros(net.rows, np.int64)
    for block in texts:
        for near, target in block.batches(BATCH):
            for own, g in net.gradient(near, target):
                s = np.take(squares, own, axis=0)
                s += g * g
                squares[own] = s
                net.weights[own] = np.take(net.weights, own, axis=0) - rate * g / np.sqrt(s)
                used[own] += 1
    return used


def texts_of(batch: pa.RecordBatch | pa.Table, found: Vocabulary) -> Iterator[Texts]:
    for sizes, places, words in zip(*(batch.column(c).to_pylist() for c in ("sizes", "places", "words")), strict=True):
        yield Texts(found.ids(np.frombuffer(words, "<u8"))[np.frombuffer(places, "<u4")], np.array(sizes, np.int64), len(found.hashes) + 1)


CHANGE = "block int, used binary, change binary"  # of ROWS rows of weights: how often used, and by how much changed


def changes(before: np.ndarray, after: np.ndarray, used: np.ndarray) -> pa.RecordBatch:
    at = [i for i in range(0, len(used), ROWS) if used[i : i + ROWS].any()]
    some = [np.flatnonzero(used[i : i + ROWS]) + i for i in at]
    counts = [used[i : i + ROWS].astype("<u4").tobytes() for i in at]
    return pa.record_batch([pa.array([i // ROWS for i in at], pa.int32()), pa.array(counts, pa.binary()), pa.array([(after[k] - before[k]).astype("<f2").tobytes() for k in some], pa.binary())], names=["block", "used", "change"])


def mean_changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CHANGE rows, one a block, of the mean over tasks by use; one block's sums are all that is held for it."""
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for block, used, change in zip(*(batch.column(c).to_pylist() for c in ("block", "used", "change")), strict=True):
            n = np.frombuffer(used, "<u4").astype(np.float64)
            total, mean = sums.setdefault(block, (np.zeros(len(n)), np.zeros((len(n), DIM))))
            some = np.flatnonzero(n)
            total += n
            mean[some] += n[some, None] * np.frombuffer(change, "<f2").reshape(-1, DIM)
    for block, (total, mean) in sums.items():
        yield pa.record_batch([pa.array([block], pa.int32()), pa.array([total.astype("<u4").tobytes()], pa.binary()), pa.array([(mean / np.maximum(total, 1)[:, None]).astype("<f4").tobytes()], pa.binary())], names=["block", "used", "change"])


def train(rows: DataFrame, found: Vocabulary, rounds: int = ROUNDS) -> Network:
    """From hashed rows."""
    spark, net = rows.sparkSession, Network(huffman(np.append(found.n, found.counts)))
    for part in range(rounds):
        sent = spark.sparkContext.broadcast((net.tree, net.weights, found))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            tree, weights, own = sent.value
            local = Network(tree, weights.copy())
            used = learn(local, (t for batch in batches for t in texts_of(batch, own)))
            if used.any():
                yield changes(weights, local.weights, used)

        own = rows.where(F.pmod(F.xxhash64("block"), F.lit(rounds)) == part).select("sizes", "places", "words")
        blocks = -(-net.rows // ROWS)
        merged = own.mapInArrow(run, CHANGE).repartition(min(blocks, spark.sparkContext.defaultParallelism), "block").mapInArrow(mean_changes, CHANGE)
        for block, _, change in merged.toLocalIterator():  # one set of weights
            now = net.weights[block * ROWS : (block + 1) * ROWS]
            now += np.frombuffer(change, "<f4").reshape(now.shape)
    return net


# Scores ------------------------------------------------------------------------------------------------------------


def word_log_probs(net: Network, texts: Texts, size: int = 2 * BATCH) -> np.ndarray:
    """Of the leaf of each word."""
    return np.concatenate([np.zeros(0), *[net.log_probs(near, target) for near, target in texts.batches(size)]])


def rated(sizes: list[int], logs: list[float]) -> dict:
    means = [x / n if n else None for x, n in zip(logs, sizes, strict=True)]
    return {"n_words": sizes, "log_prob": logs, "mean_log_prob": means, "perplexity": [None if m is None else float(np.exp(-m)) for m in means]}


HALF_SCORED = "block long, doc_ids array<long>, sizes array<long>, logs binary, n_others binary, others binary, ranks binary, spelled binary"


def half_scored(batch: pa.RecordBatch, found: Vocabulary, net: Network) -> Iterator[dict]:
    """By block the log-probabilities of leaves, summed by document, and what is needed for words without a leaf: how many
    each document has, which they are, and of each distinct one its rank by hash among the block's words and its spelling."""
    columns = ("block", "doc_ids", "sizes", "places", "words", "spelled")
    for texts, (block, doc_ids, sizes, places, words, spelled) in zip(texts_of(batch, found), zip(*(batch.column(c).to_pylist() for c in columns), strict=True), strict=True):
        words, spelled, places = np.frombuffer(words, "<u8"), np.frombuffer(spelled, "<f4"), np.frombuffer(places, "<u4")
        order = np.argsort(words)
        ranks = np.flatnonzero(found.ids(words[order]) == 0)  # of the distinct words without a leaf
        number = np.zeros(len(words), np.uint32)
        number[order[ranks]] = np.arange(len(ranks))
        none = texts.words == 0
        logs, n = (np.bincount(texts.doc, x, len(sizes)) for x in (word_log_probs(net, texts), none))
        blobs = {"logs": logs, "n_others": n.astype("<u4"), "others": number[places[none]], "ranks": ranks.astype("<u4"), "spelled": spelled[order[ranks]]}
        yield {"block": [block], "doc_ids": [doc_ids], "sizes": [sizes]} | {k: [x.tobytes()] for k, x in blobs.items()}


def score(rows: DataFrame, counted: DataFrame, found: Vocabulary, net: Network) -> DataFrame:
    """SCHEMA, from hashed rows, which are the corpus of the vocabulary. The network scores them where they are; of a block
    only what concerns words without a leaf meets their counts, in one task."""
    spark = rows.sparkSession
    sent, half, arrow = spark.sparkContext.broadcast((net.tree, net.weights, found)), arrow_schema(spark, HALF_SCORED), arrow_schema(spark, SCHEMA)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, weights, own = sent.value
        for batch in batches:
            for row in half_scored(batch, own, Network(tree, weights)):
                yield record(row, half)

    def second(block: pa.Table, counts: pa.Table) -> pa.Table:
        one = {name: block.column(name)[0].as_py() for name in block.column_names}
        blob = lambda name, kind: np.frombuffer(one[name], kind)
        n = np.frombuffer(b"".join(x for _, x in sorted(zip(counts.column("shard").to_pylist(), counts.column("counts").to_pylist(), strict=True))), "<u4")
        others = sent.value[2].other_log_probs(n[blob("ranks", "<u4")].astype(np.float64), blob("spelled", "<f4"))
        doc = np.repeat(np.arange(len(one["sizes"])), blob("n_others", "<u4"))
        logs = blob("logs", "<f8") + np.bincount(doc, others[blob("others", "<u4")], len(one["sizes"]))
        return pa.Table.from_batches([record(rated(one["sizes"], logs.tolist()) | {"doc_id": one["doc_ids"]}, arrow)], arrow)

    tasks = max(2 * spark.sparkContext.defaultParallelism, 1 + (rows.agg(F.sum(F.length("places"))).first()[0] or 0) // (1 << 24))
    own = rows.select("block", "doc_ids", "sizes", "places", "words", "spelled").mapInArrow(first, HALF_SCORED)
    return own.repartition(tasks, "block").groupBy("block").cogroup(counted.repartition(tasks, "block").groupBy("block")).applyInArrow(second, SCHEMA)


def lm_scores(docs: DataFrame) -> DataFrame:
    """Trains on docs and scores them."""
    rows = hashed(docs)
    counted, found = vocabulary(rows)
    return score(rows, counted, found, train(rows, found))
