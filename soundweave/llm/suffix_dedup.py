"""Suffix-array dedup of bytes, by a hash-compared suffix sort.

A byte goes if it is covered by a string of SIZE bytes of its document that also starts in a document with a smaller
doc_id. Every document byte may start such a string, so only suffixes that can matter are brought together:

1. A string's anchor is the least hash of the GRAM-byte substrings in it; equal strings have equal anchors. Chunks of
   documents send their distinct anchors to shards, which answer which of them occur in two documents or more.
2. Consecutive strings with one anchor are a run. Each chunk sends the bytes of its distinct runs with such an anchor,
   and their least doc_id, to the anchor's shard. Runs with equal hashes are compared byte by byte; of equal ones the least
   doc_id decides. All suffixes of different runs with one anchor are sorted: by their first 8 bytes as a number, and those
   that share them by a merge sort whose comparison finds the common extension of two suffixes by binary search over prefix
   polynomial hashes, in log2(SIZE) steps at most, and then looks at one byte. Neighbours with one hash over SIZE bytes are
   equal strings; this is verified byte by byte, and a group in which a collision shows is sorted by its bytes instead. Each
   string gets the least doc_id of its equals.
3. Each chunk removes the strings that a smaller doc_id has.

An anchor that HOT chunks or more have would bring too much to one shard. Its runs are cut where a second anchor, the least
by another hash, changes; both together are the anchor of what is left. Equal strings have equal second anchors as well,
so nothing is lost, and strings in different surroundings go to different shards. Copies of one run are merged before they
go on wherever there are many shards (see chunks).

Defined cases: a null text is empty; texts below SIZE bytes stay whole; a null doc_id is larger than all others; rows of
one doc_id are judged against smaller ids only; matches never cross documents; an empty table gives an empty result;
other columns are ignored. Texts are processed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import FAN, MESSAGE, bits, bounds, chunked, compress, compressed, exchanged, expand, expanded, flags, mix, order_ids, powers, prefix_hash, spread, told_bits, total, unpack, with_answers
from .common import arrow_schema, map_groups, tasks

SIZE, GRAM = 50, 16
ANCHOR_BITS = 40
HOT = 32
LONG = 2 * (SIZE - GRAM)  # a run of more strings repeats its anchor
CHUNK = 2 << 20
SHARD_BYTES = 4 << 20  # of text for each shard
PART_BYTES = 32 << 20  # of runs that a shard judges at once
PARTS = 16  # of a shard before messages are merged on their way
BLOCK_BYTES = 1 << 16  # hashed at once; its arrays stay in a processor's cache
BASE, BASE_CHECK = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
REPEATED, RUNS = range(2)  # kinds of answers

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """A hash of each GRAM-byte substring."""
    raw = text.tobytes() + b"\0" * 8
    n = max(0, len(text) - GRAM + 1)
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    return mix_in_place(eight[:n] * np.uint64(BASE) + mix_in_place(eight[8 : 8 + n].copy()))


def mix_in_place(x: np.ndarray) -> np.ndarray:
    """mix, without new arrays for each step."""
    moved = np.empty_like(x)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x ^= np.right_shift(x, np.uint64(shift), out=moved)
        if by > 1:
            x *= np.uint64(by)
    return x


def least_in_windows(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each size consecutive values, by doubling."""
    width = 1
    while 2 * width <= size:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return np.minimum(values[: len(values) - (size - width)], values[size - width :]) if width < size else values


def least_grams(text: np.ndarray, salt: int = 0) -> np.ndarray:
    """The least hash of the GRAM-byte substrings of each string; with a salt, by another hash. Block by block."""
    n = len(text) - SIZE + 1
    out = np.empty(max(0, n), np.uint64)
    for lo in range(0, n, BLOCK_BYTES):
        hi = min(n, lo + BLOCK_BYTES)
        hashes = gram_hashes(text[lo : hi + SIZE - 1])
        out[lo:hi] = least_in_windows(mix_in_place(hashes ^ np.uint64(salt)) if salt else hashes, SIZE - GRAM + 1)
    return out


class Chunk:
    """The strings of a chunk as runs: start, number of strings, document and anchor of each."""

    def __init__(self, payload: bytes):
        self.ids, raws = unpack(payload)
        self.sizes = np.array([len(r) for r in raws], np.int64)
        self.text = np.frombuffer(b"".join(raws), np.uint8)
        del raws
        self.ends = np.cumsum(self.sizes)
        self.order = order_ids(self.ids)
        none = np.zeros(0, np.int64)
        self.start = self.count = self.doc = none
        self.anchor = none.astype(np.uint64)
        if len(self.text) < SIZE:
            return
        anchors = least_grams(self.text)
        n = np.maximum(self.sizes - SIZE + 1, 0)
        change = np.append(True, anchors[1:] != anchors[:-1])
        first = (self.ends - self.sizes)[n > 0]
        change[first] = True
        inside = np.zeros(len(anchors) + 1, np.int8)
        inside[first] += 1
        inside[first + n[n > 0]] -= 1
        valid = np.cumsum(inside[:-1], dtype=np.int8) > 0
        after = first + n[n > 0]
        change[after[after < len(change)]] = True
        cuts = np.flatnonzero(np.append(change, True))
        own = valid[cuts[:-1]]
        self.start, self.count = cuts[:-1][own], np.diff(cuts)[own]
        self.doc = np.searchsorted(self.ends, self.start, "right")
        # The least hashes are small numbers; mixed again, they spread evenly over the shards.
        self.anchor = mix(anchors[self.start] ^ np.uint64(BASE_CHECK)) >> np.uint64(64 - ANCHOR_BITS)

    def distinct_anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchors in order, whether each is in two documents of this chunk, each run's place among them)."""
        found, place = np.unique(self.anchor, return_inverse=True)
        low, high = np.full(len(found), np.iinfo(np.int64).max), np.full(len(found), -1)
        np.minimum.at(low, place, self.doc)
        np.maximum.at(high, place, self.doc)
        return found, low != high, place

    def runs(self, own: dict[tuple[int, int], bytes], ranges: int) -> Runs:
        """The runs whose anchor is repeated, in order of their starts; those of an anchor that is often are cut up."""
        found, _, place = self.distinct_anchors()
        told = ANCHORS.told((found, None), 0, ranges, {s: b for (k, s), b in own.items() if k == REPEATED})
        repeated, often = told[0][place], told[1][place]
        start, count, anchor, doc = (x[repeated] for x in (self.start, self.count, self.anchor, self.doc))
        if often.any():
            cut = often[repeated]
            second = least_grams(self.text, BASE)
            at, of = spread(start[cut], count[cut]), np.repeat(np.flatnonzero(cut), count[cut])
            new = np.append(True, (of[1:] != of[:-1]) | (second[at][1:] != second[at][:-1]))
            fresh, size = at[new], np.diff(np.append(np.flatnonzero(new), len(at)))
            both = mix(anchor[of[new]] ^ second[fresh]) >> np.uint64(64 - ANCHOR_BITS)
            start, count, anchor, doc = (np.concatenate(x) for x in ((start[~cut], fresh), (count[~cut], size), (anchor[~cut], both), (doc[~cut], doc[of[new]])))
            order = np.argsort(start)
            start, count, anchor, doc = (x[order] for x in (start, count, anchor, doc))
        return Runs(self.text, start, count, anchor, self.order[doc])


@dataclass
class Runs:
    """Runs of a text, in order of their starts: count[i] strings from start[i] on, with their anchor and doc_id."""

    text: np.ndarray
    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    doc: np.ndarray

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """(one of each distinct run with the least doc_id, in order of anchor; each run's place among them). Equal hashes
        are verified byte by byte; a run that differs is a class of its own."""
        length = self.count + SIZE - 1
        hashes = hashes_of(self.text, self.start, length)
        # The anchor and the top bits of a hash in one number; where they don't tell all classes apart, all keys are sorted.
        key = self.anchor << np.uint64(64 - ANCHOR_BITS) | hashes[0] >> np.uint64(ANCHOR_BITS)
        order = np.argsort(key)
        new = np.append(True, key[order[1:]] != key[order[:-1]])[: len(order)]
        columns = [x[order] for x in (*hashes, length)]
        if any((c[1:] != c[:-1])[~new[1:]].any() for c in columns):
            order = np.lexsort((length, hashes[1], hashes[0], self.anchor))
            columns = [x[order] for x in (self.anchor, *hashes, length)]
            new = np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))
        group, cuts = np.cumsum(new) - 1, np.flatnonzero(new)
        doc = self.doc[order]
        least = np.minimum.reduceat(doc, cuts)[group] if len(cuts) else doc
        chosen = order[np.minimum.reduceat(np.where(doc == least, np.arange(len(order)), len(order)), cuts)] if len(cuts) else order
        differs = ~self.same(order, chosen[group])
        if differs.any():
            group[differs] = len(chosen) + np.arange(int(differs.sum()))
            chosen = np.append(chosen, order[differs])
            by = np.argsort(self.anchor[chosen], kind="stable")
            back = np.empty(len(by), np.int64)
            back[by] = np.arange(len(by))
            chosen, group = chosen[by], back[group]
        place = np.empty(len(order), np.int64)
        place[order] = group
        return chosen, place

    def same(self, x: np.ndarray, y: np.ndarray, step: int = 1 << 20) -> np.ndarray:
        """Whether runs x and y, which are of one length, have the same bytes."""
        out = np.ones(len(x), bool)
        some = np.flatnonzero(x != y)
        length = self.count[x[some]] + SIZE - 1
        ends = np.cumsum(length)
        i = 0
        while i < len(some):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] - length[i] + step, "right")))
            n = length[i:j]
            equal = self.text[spread(self.start[x[some[i:j]]], n)] == self.text[spread(self.start[y[some[i:j]]], n)]
            out[some[i:j]] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
            i = j
        return out

    def taken(self, chosen: np.ndarray, texts: bool = True) -> Runs:
        """Those runs, with a text of their own (or none)."""
        length = self.count[chosen] + SIZE - 1
        return Runs(self.text[spread(self.start[chosen], length)] if texts else self.text[:0], np.cumsum(length) - length, self.count[chosen], self.anchor[chosen], self.doc[chosen])


def hashes_of(text: np.ndarray, start: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each substring; starts ascend. Blocks of the text are hashed in turn, so that memory stays small."""
    out = [np.zeros(len(start), np.uint64) for _ in range(2)]
    i = 0
    while i < len(start):
        lo = int(start[i])
        j = max(i + 1, int(np.searchsorted(start, lo + BLOCK_BYTES)))
        own = start[i:j] - lo
        values = text[lo : int((start[i:j] + length[i:j]).max())].astype(np.uint64) + np.uint64(1)
        for have, base in zip(out, (BASE, BASE_CHECK), strict=True):
            prefix = prefix_hash(values, base)
            have[i:j] = mix((prefix[own + length[i:j]] - prefix[own]) * powers(base, len(prefix))[1][own])
        i = j
    return out


# The suffix sort ---------------------------------------------------------------------------------------------------


class Suffixes:
    """Suffixes of a text, compared over their first SIZE bytes; each belongs to a group that comes first in the order."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, groups: np.ndarray):
        self.text, self.starts, self.groups = text, starts, groups
        self.prefix = prefix_hash(text.astype(np.uint64) + np.uint64(1), BASE)
        self.down = powers(BASE, len(self.prefix))[1]
        raw = text.tobytes()
        eight = np.ndarray((len(raw) - 7,), ">u8", raw, strides=(1,))
        self.first, self.second = eight[starts].astype(np.uint64), eight[starts + 8].astype(np.uint64)
        self.whole = (self.prefix[starts + SIZE] - self.prefix[starts]) * self.down[starts]

    def extension(self, a: np.ndarray, b: np.ndarray, known: int = 0) -> np.ndarray:
        """The common extension of suffixes at a and b (places in the text), SIZE at most, by binary search."""
        low, high = np.full(len(a), known), np.full(len(a), SIZE)
        before_a, before_b, down_a, down_b = self.prefix[a], self.prefix[b], self.down[a], self.down[b]
        for _ in range((SIZE - known).bit_length()):
            mid = (low + high + 1) >> 1
            same = (self.prefix[a + mid] - before_a) * down_a == (self.prefix[b + mid] - before_b) * down_b
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether suffix x is below suffix y, whether they are equal), for suffixes that share their first 8 bytes."""
        equal = self.whole[x] == self.whole[y]
        below = np.zeros(len(x), bool)
        other = np.flatnonzero(~equal)
        p, q = self.second[x[other]], self.second[y[other]]
        below[other] = p < q
        tied = other[p == q]
        if len(tied):
            a, b = self.starts[x[tied]], self.starts[y[tied]]
            at = np.minimum(self.extension(a, b, 16), SIZE - 1)
            below[tied] = self.text[a + at] < self.text[b + at]
        return below, equal

    def ranks(self, items: np.ndarray, left: np.ndarray, right: np.ndarray, rank: np.ndarray, or_equal: bool) -> np.ndarray:
        """How many of order[left:right] are below each item (or equal to it)."""
        base = left.copy()
        left, right = left.copy(), right.copy()
        live = np.flatnonzero(left < right)
        while len(live):
            mid = (left[live] + right[live]) // 2
            below, equal = self.less(rank[mid], items[live])
            goes = below | equal if or_equal else below
            left[live[goes]] = mid[goes] + 1
            right[live[~goes]] = mid[~goes]
            live = live[left[live] < right[live]]
        return left - base

    def by_first(self) -> np.ndarray:
        """The order by group and the first 8 bytes. Both are replaced by one number: that of the group among the groups and
        the top bits of the bytes; the places where these don't decide are sorted by all 8 bytes."""
        if not len(self.starts):
            return np.zeros(0, np.int64)
        change = self.groups[1:] != self.groups[:-1]
        in_order = (self.groups[1:] >= self.groups[:-1]).all()
        number = (np.cumsum(np.append(False, change)) if in_order else np.unique(self.groups, return_inverse=True)[1]).astype(np.uint64)
        width = int(number.max()).bit_length()
        key = number << np.uint64(64 - width) | self.first >> np.uint64(width) if width else self.first
        order = np.argsort(key)
        k, f = key[order], self.first[order]
        tied = (k[1:] == k[:-1]) & (f[1:] != f[:-1])
        if tied.any():
            keys = np.unique(k[1:][tied])
            at = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, k), len(keys) - 1)] == k)
            order[at] = order[at][np.lexsort((f[at], k[at]))]
        return order

    def sort(self) -> np.ndarray:
        """The order of the suffixes: by group and the first 8 bytes as a number, then a merge sort of those that share
        both; runs are merged only where such a class spans both."""
        n = len(self.starts)
        order = self.by_first()
        if n < 2:
            return order
        g, f = self.groups[order], self.first[order]
        new = np.append(True, (g[1:] != g[:-1]) | (f[1:] != f[:-1]))
        number = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], n)
        width = 1
        while width < n:  # a group of any size may span the middle of a wide run
            middle = np.arange(width, n, 2 * width)
            middle = middle[number[middle - 1] == number[middle]]
            if len(middle):
                g = number[middle]
                low, high = np.maximum(middle - width, begin[g]), np.minimum(np.minimum(middle + width, n), end[g])
                places = spread(low, high - low)
                pair = np.repeat(np.arange(len(middle)), high - low)
                m, lo, hi = middle[pair], low[pair], high[pair]
                on_left = places < m
                items = order[places]
                rank = self.ranks(items[on_left], m[on_left], hi[on_left], order, False)
                other = self.ranks(items[~on_left], lo[~on_left], m[~on_left], order, True)
                to = np.empty(len(places), np.int64)
                to[on_left] = places[on_left] + rank
                to[~on_left] = places[~on_left] - (m - lo)[~on_left] + other
                order = order.copy()
                order[to] = items
            width *= 2
        return order

    def equal_neighbours(self, order: np.ndarray) -> np.ndarray:
        """For each place of the order whether its suffix equals the one before, verified byte by byte; groups in which
        hashes and bytes disagree are put in order of their bytes, in place."""
        x, y = order[:-1], order[1:]
        a, b = self.starts[x], self.starts[y]
        claimed = np.zeros(len(order), bool)
        claimed[1:] = (self.groups[x] == self.groups[y]) & (self.whole[x] == self.whole[y])
        at = np.flatnonzero(claimed)
        wrong = at[~same_at(self.text, a[at - 1], b[at - 1])]
        for g in np.unique(self.groups[order[wrong]]).tolist():
            places = np.flatnonzero(self.groups[order] == g)
            raw = {i: self.text[self.starts[i] : self.starts[i] + SIZE].tobytes() for i in order[places].tolist()}
            ranked = sorted(raw, key=lambda i: (raw[i], i))
            order[places] = ranked
            claimed[places] = [False] + [raw[i] == raw[j] for i, j in zip(ranked[:-1], ranked[1:], strict=True)]
        return claimed


def same_at(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the SIZE bytes at a and at b are the same, byte by byte."""
    same = np.ones(len(a), bool)
    eight = np.ndarray((len(text) - 7,), "<u8", text.tobytes(), strides=(1,))
    for k in [*range(0, SIZE - 8, 8), SIZE - 8]:
        same &= eight[a + k] == eight[b + k]
    return same


def distinct_strings(text: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of distinct strings of one run, each string's place among them)."""
    starts = np.arange(count)
    h = hashes_of(text, starts, np.full(count, SIZE))
    order = np.lexsort((starts, h[1], h[0]))
    new = np.append(True, (h[0][order][1:] != h[0][order][:-1]) | (h[1][order][1:] != h[1][order][:-1]))
    first = np.empty(count, np.int64)
    first[order] = order[new][np.cumsum(new) - 1]
    first = np.where(same_at(text, starts, first), first, starts)
    return np.unique(first, return_inverse=True)


def least_equals(text: np.ndarray, start: np.ndarray, count: np.ndarray, anchor: np.ndarray, doc: np.ndarray, step: int = 1 << 17) -> np.ndarray:
    """For the strings of runs (in order of anchor) whether an equal string of another run has a smaller doc_id.

    Whole groups are sorted together, about step strings at a time. A run is long where one substring comes again and
    again (a repeated word); its strings repeat as well, and only distinct ones of each such run are sorted."""
    out = np.zeros(int(count.sum()), bool)
    begin = np.cumsum(count) - count
    thin = {i: distinct_strings(text[start[i] : start[i] + count[i] + SIZE - 1], int(count[i])) for i in np.flatnonzero(count > LONG).tolist()}
    sizes = count.copy()
    for i, (own, _) in thin.items():
        sizes[i] = len(own)
    ends = np.cumsum(sizes)
    new = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])) if len(anchor) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(anchor))
    i = 0
    while i < len(new):
        a, base = new[i], ends[new[i]] - sizes[new[i]]
        j = max(i + 1, int(np.searchsorted(ends[last - 1], base + step, "right")))
        b = last[j - 1]
        lo, hi = start[a], start[b - 1] + count[b - 1] + SIZE - 1
        places = spread(start[a:b] - lo, sizes[a:b])
        for k, (own, _) in thin.items():
            if a <= k < b:
                places[ends[k] - sizes[k] - base : ends[k] - base] = start[k] - lo + own
        found = Suffixes(text[lo:hi], places, np.repeat(anchor[a:b], sizes[a:b]))
        order = found.sort()
        claimed = found.equal_neighbours(order)
        ids = np.repeat(doc[a:b], sizes[a:b])[order]
        cuts = np.flatnonzero(~claimed)
        least = np.minimum.reduceat(ids, cuts)[np.cumsum(~claimed) - 1] if len(ids) else ids
        told = np.empty(len(order), bool)
        told[order] = least < ids
        plain = np.array([k not in thin for k in range(a, b)], bool)
        runs = np.flatnonzero(plain) + a
        out[spread(begin[runs], count[runs])] = told[spread(ends[runs] - sizes[runs] - base, sizes[runs])]
        for k in (np.flatnonzero(~plain) + a).tolist():
            out[begin[k] : begin[k] + count[k]] = told[ends[k] - sizes[k] - base : ends[k] - base][thin[k][1]]
        i = j
    return out


# Messages ----------------------------------------------------------------------------------------------------------


def join_parts(*parts: bytes) -> bytes:
    return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)


def split_parts(blob: bytes, n: int) -> list[bytes]:
    sizes = np.frombuffer(blob[: 8 * n], np.int64)
    ends = 8 * n + np.cumsum(sizes)
    return [blob[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


class Anchors:
    """The exchange of (anchors in order, whether each is in two documents, in how many chunks): which anchors are in two
    documents in all, and which in hot chunks or more."""

    def __init__(self, hot: int = HOT):
        self.hot = hot

    def read(self, blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        deltas, several, counts = split_parts(blob, 3)
        found = np.cumsum(expanded(deltas, np.uint64), dtype=np.uint64)
        return found, flags(several, len(found)), expanded(counts, np.uint32).astype(np.int64)

    def merge(self, tables: list) -> tuple[tuple, list[np.ndarray]]:
        every, several, counts = (np.concatenate([t[i] for t in tables]) for i in range(3))
        found, place, times = np.unique(every, return_inverse=True, return_counts=True)
        two = times > 1
        two[place[several]] = True
        n = np.bincount(place, counts, len(found)).astype(np.int64)
        return (found, two, n), np.split(place, np.cumsum([len(t[0]) for t in tables])[:-1])

    def messages(self, table: tuple, row: int, shards: int) -> Iterator[tuple[int, bytes]]:
        found, several, counts = table
        owners, cuts = bounds(found, shards, ANCHOR_BITS)
        for s, a, b in zip(owners.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield s, join_parts(compressed(np.diff(found[a:b], prepend=np.uint64(0))), bits(several[a:b]), compressed(np.minimum(counts[a:b], 1 << 31).astype(np.uint32)))

    def judge(self, blobs: list[bytes]) -> list[bytes]:
        (_, two, n), places = self.merge([self.read(b) for b in blobs])
        return [join_parts(bits(two[p]), bits(n[p] >= self.hot)) for p in places]

    def told(self, table: tuple, row: int, shards: int, own: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        both = {s: split_parts(b, 2) for s, b in own.items()}
        return tuple(told_bits(table[0], row, shards, ANCHOR_BITS, {s: b[i] for s, b in both.items()}) for i in range(2))

    def passed(self, table: tuple, merged: tuple, place: np.ndarray, told: tuple) -> bytes:
        return join_parts(*[bits(t[place]) for t in told])


ANCHORS = Anchors()


class RunExchange:
    """The exchange of distinct runs: for each string of each run whether a smaller doc_id has it."""

    def __init__(self, part_bytes: int = PART_BYTES):
        self.part_bytes = part_bytes

    def read(self, blob: bytes) -> Runs:
        a, d, c, t = split_parts(blob, 4)
        count = expanded(c, np.uint32).astype(np.int64)
        length = count + SIZE - 1
        return Runs(np.frombuffer(expand(t), np.uint8), np.cumsum(length) - length, count, np.cumsum(expanded(a, np.uint64), dtype=np.uint64), expanded(d, np.int64))

    def merge(self, tables: list[Runs]) -> tuple[Runs, list[np.ndarray]]:
        sizes = np.array([len(t.text) for t in tables])
        whole = Runs(np.concatenate([t.text for t in tables]), np.concatenate([t.start + at for t, at in zip(tables, (np.cumsum(sizes) - sizes).tolist(), strict=True)]), *(np.concatenate([getattr(t, k) for t in tables]) for k in ("count", "anchor", "doc")))
        chosen, place = whole.classes()
        return whole.taken(chosen), np.split(place, np.cumsum([len(t.count) for t in tables])[:-1])

    def messages(self, table: Runs, row: int, shards: int) -> Iterator[tuple[int, bytes]]:
        owners, cuts = bounds(table.anchor, shards, ANCHOR_BITS)
        for s, a, b in zip(owners.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            end = table.start[b - 1] + table.count[b - 1] + SIZE - 1
            text = table.text[table.start[a] : end].tobytes()
            yield s, join_parts(compressed(np.diff(table.anchor[a:b], prepend=np.uint64(0))), compressed(table.doc[a:b]), compressed(table.count[a:b].astype(np.uint32)), compress(text, 3))

    def judge(self, blobs: list[bytes]) -> list[bytes]:
        """Part by part, each a range of anchors; all the runs of a large shard are never expanded together."""
        heads = [self.head(b) for b in blobs]
        anchors = [np.cumsum(expanded(a, np.uint64), dtype=np.uint64) for a, _ in heads]
        sizes = [expanded(c, np.uint32).astype(np.int64) + SIZE - 1 for _, c in heads]
        parts = max(1, -(-sum(int(x.sum()) for x in sizes) // self.part_bytes))
        if parts == 1:
            return self.judged([self.read(b) for b in blobs])
        # Ends of the parts among the anchors: the sizes of all runs, summed in order of their anchors.
        every, size = np.concatenate(anchors), np.concatenate(sizes)
        order = np.argsort(every)
        summed = np.cumsum(size[order])
        ends = np.unique(every[order][np.searchsorted(summed, summed[-1] * np.arange(1, parts) // parts)])
        cuts = [np.concatenate([[0], np.searchsorted(a, ends, "right"), [len(a)]]) for a in anchors]
        told: list[list[np.ndarray]] = [[] for _ in blobs]
        for k in range(len(ends) + 1):
            own = [i for i, c in enumerate(cuts) if c[k] < c[k + 1]]
            tables = [self.read(blobs[i]).taken(np.arange(cuts[i][k], cuts[i][k + 1])) for i in own]
            for i, table, blob in zip(own, tables, self.judged(tables) if tables else [], strict=True):
                told[i].append(flags(blob, int(table.count.sum())))
        return [bits(np.concatenate([np.zeros(0, bool), *t])) for t in told]

    def head(self, blob: bytes) -> tuple[bytes, bytes]:
        """The parts of a message that hold anchors and counts."""
        a, _, c, _ = split_parts(blob, 4)
        return a, c

    def judged(self, tables: list[Runs]) -> list[bytes]:
        merged, places = self.merge(tables)
        chosen = merged.anchor
        # Anchors with two different runs or more.
        several = np.append(False, chosen[1:] == chosen[:-1])[: len(chosen)] | np.append(chosen[1:] == chosen[:-1], False)[: len(chosen)]
        picked = merged.taken(np.flatnonzero(several))
        told = np.zeros(int(merged.count.sum()), bool)
        told[np.repeat(several, merged.count)] = least_equals(picked.text, picked.start, picked.count, picked.anchor, picked.doc)
        return [self.passed(t, merged, p, told) for t, p in zip(tables, places, strict=True)]

    def told(self, table: Runs, row: int, shards: int, own: dict[int, bytes]) -> np.ndarray:
        owners, cuts = bounds(table.anchor, shards, ANCHOR_BITS)
        parts = zip(owners.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)
        return np.concatenate([np.zeros(0, bool), *[flags(own[s], int(table.count[a:b].sum())) for s, a, b in parts]])

    def passed(self, table: Runs, merged: Runs, place: np.ndarray, told: np.ndarray) -> bytes:
        """A run is judged as its equal of the least doc_id is, and all of it goes if that is smaller."""
        return bits(self.of_all(table.doc, table.count, merged, place, told))

    @staticmethod
    def of_all(doc: np.ndarray, count: np.ndarray, merged: Runs, place: np.ndarray, told: np.ndarray) -> np.ndarray:
        begin = np.cumsum(merged.count) - merged.count
        return told[spread(begin[place], count)] | np.repeat(merged.doc[place] < doc, count)


def shards_of(size: int, fan: int, shard_bytes: int, parts: int) -> int:
    """For size bytes of text. Up to fan shards, which judge their runs in up to parts parts, are enough for most inputs:
    each message moves once. Only beyond that messages are merged on their way (see chunks), and move thrice."""
    wanted = max(1, -(-size // shard_bytes))
    return min(wanted, fan) if wanted <= fan * parts else min(wanted, fan * fan)


def dedup(docs: DataFrame, hot: int = HOT, fan: int = FAN, shard_bytes: int = SHARD_BYTES, parts: int = PARTS, part_bytes: int = PART_BYTES) -> DataFrame:
    """SCHEMA, and kept binary: the bytes that stay."""
    spark = docs.sparkSession
    chunks = chunked(docs, CHUNK)
    n_chunks, size = total(chunks)
    shards = shards_of(size, fan, shard_bytes, parts)
    ranges, anchors, runs = min(shards, fan), Anchors(hot), RunExchange(part_bytes)

    def send_anchors(batch) -> dict:
        out = {"shard": [], "chunk": [], "blob": []}
        for number, payload in zip(batch.column("chunk").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            found, several, _ = Chunk(payload).distinct_anchors()
            for s, blob in anchors.messages((found, several, np.ones(len(found))), 0, ranges):
                out["shard"].append(s)
                out["chunk"].append(number)
                out["blob"].append(blob)
        return out

    both = exchanged(map_groups(chunks.select("chunk", "payload"), send_anchors, MESSAGE, "payload", 1), anchors, REPEATED, shards, n_chunks, fan, size)

    def send_runs(number: int, payload: bytes, own: dict) -> dict:
        found = Chunk(payload).runs(own, ranges)
        made = list(runs.messages(found.taken(found.classes()[0]), 0, ranges))
        return {"shard": [s for s, _ in made], "chunk": [number] * len(made), "blob": [b for _, b in made]}

    sent = with_answers(chunks, both, send_runs, MESSAGE, arrow_schema(spark, MESSAGE))
    judged = exchanged(sent, runs, RUNS, shards, n_chunks, fan, size)

    def finish(number: int, payload: bytes, own: dict) -> dict:
        chunk = Chunk(payload)
        gone_at = removed(chunk, own, ranges)
        edge = np.zeros(len(chunk.text) + 1, np.int8)
        edge[gone_at] += 1  # no start comes twice
        edge[gone_at + SIZE] -= 1
        gone = np.cumsum(edge[:-1], dtype=np.int8) > 0  # SIZE at most
        out = {"doc_id": chunk.ids, "n_bytes": chunk.sizes, "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for end, n in zip(chunk.ends.tolist(), chunk.sizes.tolist(), strict=True):
            g = gone[end - n : end]
            kept = chunk.text[end - n : end][~g].tobytes()
            out["n_removed"].append(n - len(kept))
            out["n_spans"].append(int(np.count_nonzero(g[1:] & ~g[:-1])) + int(n > 0 and g[0]))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept)
        return out

    schema = SCHEMA + ", kept binary"
    return tasks(with_answers(chunks, both.unionByName(judged), finish, schema, arrow_schema(spark, schema)), size)


def removed(chunk: Chunk, own: dict[tuple[int, int], bytes], ranges: int) -> np.ndarray:
    """The starts of strings that a smaller doc_id has too."""
    found = chunk.runs(own, ranges)
    chosen, place = found.classes()
    merged = found.taken(chosen, False)
    told = RunExchange().told(merged, 0, ranges, {s: b for (k, s), b in own.items() if k == RUNS})
    return spread(found.start, found.count)[RunExchange.of_all(found.doc, found.count, merged, place, told)]
