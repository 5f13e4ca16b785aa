"""Benchmark decontamination by the q-gram lemma.

A window of w bytes that occurs in a text with at most e edits shares w + 1 - q(e + 1)
q-grams with it there, all within e diagonals of one another. So shared q-grams are counted
in overlapping bands of diagonals, regions that reach the bound are kept, and a banded
alignment decides. Texts are compared as UTF-8 bytes with ASCII letters folded and every
ASCII white space as a blank; an item leaks if one of its windows does.

Windows start every quarter of their size, so a verbatim passage of 124 bytes of an item, or a
whole item of at least Q bytes, is surely found; items of under 24 bytes must be found without
an edit, those of fewer than Q bytes hold no q-gram and take no part. A q-gram that is very
common in a text and in the items (a rule of ``=`` signs) is not paired place by place: every
window's bound is lowered by the q-grams it so loses, and a window without others is aligned
with the whole stretch of text around them, so nothing is lost.

Cases: null and empty texts leak nothing; null items and null item ids take no part; equal items
report under each id, and all texts under one id are one item. Repeated rows of an id are one
document, null ids included. Ties go to the first place. Long texts are read in overlapping
parts. Other columns of either table are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts, utf8_buffer

WINDOW, RATE, Q, STEPS = 100, 0.06, 12, 4
BLOCK_BYTES = 4_000_000
PART_BYTES = 2_000_000  # of a long text that is searched at a time
PAIRS = 2_000_000  # pairs of a text's and the windows' places of one q-gram that are written out

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32


def grams(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q bytes from each place on."""
    n = len(raw) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    low, high = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for i in range(8):
        low |= raw[i : i + n].astype(np.uint64) << np.uint64(8 * i)
    for i in range(8, Q):
        high |= raw[i : i + n].astype(np.uint64) << np.uint64(8 * (i - 8))
    low *= np.uint64(0x9E3779B97F4A7C15)
    high *= np.uint64(0xC2B2AE3D27D4EB4F)
    low ^= high
    low ^= low >> np.uint64(29)
    low *= np.uint64(0xBF58476D1CE4E5B9)
    return low


@dataclass
class Bench:
    """Windows of all items end to end, with an index of their q-grams."""

    raw: np.ndarray
    start: np.ndarray  # of each window in ``raw``
    size: np.ndarray
    item: np.ndarray
    budget: np.ndarray
    bound: np.ndarray
    keys: np.ndarray  # sorted distinct q-grams
    first: np.ndarray  # of each key in ``places``
    places: np.ndarray
    window_of: np.ndarray
    bitmap: np.ndarray
    name: np.ndarray  # of each window: a hash of its item and bytes


def prepare(items: list[tuple[int, str]], window: int, rate: float) -> Bench | None:
    parts, start, size, item, names, at = [], [], [], [], [], 0
    for item_id, text in items:
        raw = _FOLD[np.frombuffer(text.encode(), np.uint8)]
        if len(raw) < Q:
            continue
        w = min(window, len(raw))
        for s in sorted({*range(0, len(raw) - w + 1, max(1, w // STEPS)), len(raw) - w}):
            parts.append(raw[s : s + w])
            start.append(at)
            size.append(w)
            item.append(item_id)
            names.append(int.from_bytes(hashlib.blake2b(raw[s : s + w].tobytes(), digest_size=8).digest(), "little", signed=True))
            at += w
    if not parts:
        return None
    raw, size = np.concatenate(parts), np.array(size)
    budget = np.minimum((rate * size).astype(np.int64), (size - Q) // Q)
    hashes, places = [], []
    for s, w in zip(start, size, strict=True):
        hashes.append(grams(raw[s : s + w]))
        places.append(np.arange(s, s + w - Q + 1))
    h, p = np.concatenate(hashes), np.concatenate(places)
    order = np.argsort(h, kind="stable")
    keys, first = np.unique(h[order], return_index=True)
    bitmap = np.zeros(1 << 20, bool)
    bitmap[(keys >> np.uint64(44)).astype(np.int64)] = True
    return Bench(raw, np.array(start), size, np.array(item), budget, size + 1 - Q * (budget + 1), keys, np.append(first, len(h)), p[order], np.repeat(np.arange(len(size)), size), bitmap, np.array(names, np.int64))


def matches(raw: np.ndarray, offsets: np.ndarray, b: Bench) -> list[tuple[int, int, int, int]]:
    """(document, window, edits, start) of every window found in a batch's folded bytes."""
    h = grams(raw)
    if not len(h):
        return []
    hit = np.flatnonzero(b.bitmap[(h >> np.uint64(44)).astype(np.int64)])
    at = np.minimum(np.searchsorted(b.keys, h[hit]), len(b.keys) - 1)
    same = b.keys[at] == h[hit]
    hit, at = hit[same], at[same]
    doc = np.searchsorted(offsets, hit, side="right") - 1
    inside = hit + Q <= offsets[doc + 1]
    hit, at, doc = hit[inside], at[inside], doc[inside]
    # a region needs this many hits within a window's reach, whatever they are hits of
    least, reach = int(b.bound.min()), int((b.size + b.budget).max())
    if len(hit) < least:
        return []
    dense = np.zeros(len(hit), np.int64)
    ends = np.arange(least - 1, len(hit))
    close = (hit[ends] - hit[ends - least + 1] <= reach) & (doc[ends] == doc[ends - least + 1])
    np.add.at(dense, (ends - least + 1)[close], 1)
    stop = np.zeros(len(hit) + 1, np.int64)
    np.add.at(stop, ends[close] + 1, 1)
    keep = np.cumsum(dense) - np.cumsum(stop[:-1]) > 0
    hit, at, doc = hit[keep], at[keep], doc[keep]
    pair, times = np.unique(np.stack([doc, at], 1), axis=0, return_counts=True)
    many = times * (b.first[pair[:, 1] + 1] - b.first[pair[:, 1]]) > PAIRS
    out = []
    crowded = np.unique(pair[many, 0])
    usual = ~np.isin(doc, crowded)
    out += _align(raw, offsets, _counted(hit[usual], at[usual], doc[usual], b, b.bound), b)
    for d in crowded:
        keys = pair[many & (pair[:, 0] == d), 1]
        own = np.flatnonzero(doc == d)
        lost = np.isin(at[own], keys)
        places = np.concatenate([b.places[b.first[k] : b.first[k + 1]] for k in keys])
        bound = b.bound - np.bincount(b.window_of[places], minlength=len(b.size))
        kept = own[~lost]
        out += _align(raw, offsets, _counted(hit[kept], at[kept], doc[kept], b, np.maximum(bound, 1)), b)
        for low, high in _stretches(hit[own[lost]], reach, int(offsets[d]), int(offsets[d + 1])):
            out += [(int(d), w, e, max(low + x - int(offsets[d]), 0)) for w, e, x in _aligned_anywhere(raw[low:high], np.flatnonzero(bound <= 0), b)]
    return out


def _counted(hit, at, doc, b: Bench, bound: np.ndarray) -> np.ndarray:
    """(document, window, band, shared q-grams) of the bands that reach the window's bound."""
    n = np.cumsum(b.first[at + 1] - b.first[at])
    found: list[np.ndarray] = []
    cuts = np.unique(np.append(np.searchsorted(n, np.arange(0, n[-1], PAIRS)), len(n))) if len(n) else [0]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):  # pairs of a text place and a window's place, PAIRS or so at a time
        found.append(_bands(hit[i:j], at[i:j], doc[i:j], b))
    pairs = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    if not len(pairs):
        return pairs
    # add up what parts have counted of the same band
    pairs = pairs[np.lexsort((pairs[:, 2], pairs[:, 1], pairs[:, 0]))]
    first = np.flatnonzero(np.append(True, (pairs[1:, :3] != pairs[:-1, :3]).any(1)))
    count = np.add.reduceat(pairs[:, 3], first)
    pairs = pairs[first]
    return pairs[count >= bound[pairs[:, 1]]]


def _stretches(hit: np.ndarray, reach: int, low: int, high: int) -> list[tuple[int, int]]:
    """Merged stretches of a text within ``reach`` of any of the sorted places."""
    cuts = np.flatnonzero(np.diff(hit) > 2 * reach)
    return [(max(low, int(a) - reach), min(high, int(z) + reach + Q)) for a, z in zip(hit[np.append(0, cuts + 1)], hit[np.append(cuts, len(hit) - 1)], strict=True)]


def _aligned_anywhere(text: np.ndarray, windows: np.ndarray, b: Bench) -> list[tuple[int, int, int]]:
    """(window, fewest edits, its start or a byte near it) of windows found anywhere in ``text`` within their budgets."""
    out = []
    for w in np.unique(b.size[windows]):
        same = windows[b.size[windows] == w]
        for i in range(0, len(same), 2000):
            own = same[i : i + 2000]
            pattern = b.raw[b.start[own][:, None] + np.arange(w)]
            rows = np.arange(1, w + 1)
            cost = np.tile(rows, (len(own), 1)).astype(np.int32)
            best, place = np.full(len(own), w), np.zeros(len(own), np.int64)
            for y, c in enumerate(text):
                above = np.concatenate([np.zeros((len(own), 1), np.int32), cost[:, :-1]], 1)
                cost = np.minimum(above + (pattern != c), cost + 1)
                cost = np.minimum(np.minimum.accumulate(cost - rows, axis=1), 0) + rows
                better = cost[:, -1] < best
                best[better], place[better] = cost[better, -1], y - w + 1
            out += [(int(k), int(e), int(x)) for k, e, x in zip(own, best, place, strict=True) if e <= b.budget[k]]
    return out


def _bands(hit, at, doc, b: Bench) -> np.ndarray:
    """(document, window, band, shared q-grams) with overlapping bands of 2(e + 1) diagonals, each text place once."""
    n = b.first[at + 1] - b.first[at]
    which = np.repeat(np.arange(len(hit)), n)
    place = b.places[np.repeat(b.first[at], n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)]
    window = b.window_of[place]
    diagonal = hit[which] - (place - b.start[window]) + int(b.size.max())
    step = b.budget[window] + 1
    band = diagonal // step
    rows = np.concatenate([np.stack([doc[which], window, band - k, hit[which]], 1) for k in (0, 1)])
    order = np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))
    rows = rows[order]
    rows = rows[np.append(True, (rows[1:] != rows[:-1]).any(1))] if len(rows) else rows
    if not len(rows):
        return np.zeros((0, 4), np.int64)
    first = np.flatnonzero(np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(1)))
    return np.concatenate([rows[first, :3], np.diff(np.append(first, len(rows)))[:, None]], 1)


def _align(raw, offsets, pairs, b: Bench) -> list[tuple[int, int, int, int]]:
    """Semi-global alignment of each window within its band of diagonals; all candidates of a size at once."""
    out = []
    for w, e in {(int(b.size[x]), int(b.budget[x])) for x in np.unique(pairs[:, 1])}:
        own = pairs[(b.size[pairs[:, 1]] == w) & (b.budget[pairs[:, 1]] == e)]
        width = 2 * (e + 1) + 2 * e + 1
        for i in range(0, len(own), 20_000):
            part = own[i : i + 20_000]
            low = part[:, 2] * (e + 1) - int(b.size.max()) - e  # text place that the band's first column pairs with the window's start
            lo, hi = offsets[part[:, 0]], offsets[part[:, 0] + 1]
            columns = np.arange(width)
            cost = np.zeros((len(part), width), np.int32)
            for row in range(w):
                y = low[:, None] + columns + row
                outside = (y < lo[:, None]) | (y >= hi[:, None])
                c = raw[np.clip(y, 0, len(raw) - 1)]
                new = cost + ((c != b.raw[b.start[part[:, 1]] + row][:, None]) | outside)
                new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
                cost = np.minimum.accumulate(new - columns, axis=1) + columns
            best = cost.min(1)
            ok = np.flatnonzero(best <= e)
            out += [(int(part[j, 0]), int(part[j, 1]), int(best[j]), int(max(low[j] + cost[j].argmin() - lo[j], 0))) for j in ok]
    return out


def find_leaks(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a (doc_id, item_id) that leaks: doc_id, item_id, fewest edits of a window, its byte, distinct windows found.

    The benchmark goes to the tasks in blocks of about ``block_bytes``, checked before: a
    larger benchmark takes more passes over the documents, never more memory."""
    docs = texts(documents)
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    found = []
    for i in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i)
        bench = prepare(sorted((r["item_id"], r["text"]) for r in own.collect()), window, rate)
        found.append(_scan(docs, bench))
    best = F.min(F.struct("edits", "start")).alias("best")
    hits = reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(best, F.countDistinct("name").cast("int").alias("windows"))
    return hits.select("doc_id", "item_id", F.col("best.edits").alias("edits"), F.col("best.start").alias("start"), "windows")


HITS = "doc_id bigint, item_id bigint, name bigint, edits int, start bigint"


def _scan(docs: DataFrame, bench: Bench | None) -> DataFrame:
    """HITS of every window found in every row."""
    if bench is None:
        return docs.sparkSession.createDataFrame([], HITS)
    shared = docs.sparkSession.sparkContext.broadcast(bench)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        b = shared.value
        raw, offsets = utf8_buffer(batch.column(1))
        folded = _FOLD[raw]
        reach = int((b.size + b.budget).max())
        found: list[tuple[int, int, int, int]] = []
        for first, last, low, high in _parts(offsets, reach):
            part = np.clip(offsets[first : last + 1], low, high) - low
            found += [(first + doc, window, edits, start + low - int(offsets[first]) if first + 1 == last else start) for doc, window, edits, start in matches(folded[low:high], part, b)]
        if not found:
            return None
        doc, window, edits, start = (np.array(c) for c in zip(*found, strict=True))
        return pa.record_batch([batch.column(0).take(pa.array(doc)), pa.array(b.item[window].astype(np.int64)), pa.array(b.name[window]), pa.array(edits.astype(np.int32)), pa.array(start.astype(np.int64))], names=["doc_id", "item_id", "name", "edits", "start"])

    return map_batches(docs, run, HITS)


def _parts(offsets: np.ndarray, reach: int) -> list[tuple[int, int, int, int]]:
    """(first row, last row + 1, first byte, last byte + 1): all rows at once, or a long text in parts that overlap by ``reach``."""
    if offsets[-1] <= 3 * PART_BYTES:
        return [(0, len(offsets) - 1, 0, int(offsets[-1]))]
    out = []
    for i in range(len(offsets) - 1):
        low, high = int(offsets[i]), int(offsets[i + 1])
        out += [(i, i + 1, a, min(a + PART_BYTES + reach, high)) for a in range(low, max(low + 1, high), PART_BYTES)]
    return out
