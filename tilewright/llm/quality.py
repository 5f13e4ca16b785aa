"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad; its features are its own and its neighbours' surface
statistics, and adjacent labels interact. Forward-backward marginals, weighted by line
length, give the document's score. Trained in numpy on documents whose label all their
lines take.

Cases: null and empty texts score the share of good training rows (0.5 without any);
empty lines weigh nothing. Texts of over 2 PART_BYTES are scored whole, but a chain begins anew after
each PART_BYTES or so. At 0.5 the prediction is 1. Other columns are ignored. Empty tables give empty tables; repeated rows are scored each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, mix64, remainder, texts, utf8_buffer
from .samples import labelled

SAMPLE_PER_CLASS = 1000
PART_BYTES = 1_000_000
N_BASE = 17


def _classes() -> np.ndarray:
    """0 other, 1 upper, 2 lower, 3 digit, 4 stop or comma, 5 exclamation, 6 symbol, 7 space, 8 beyond ASCII, 9 delimiter."""
    table = np.zeros(256, np.uint8)
    for i in range(256):
        c = chr(i)
        table[i] = 8 if i > 127 else 1 if c.isupper() else 2 if c.islower() else 3 if c.isdigit() else 4 if c in ".,;:'\"?-()" else 5 if c == "!" else 7 if c.isspace() else 9 if c in "|<>{}[]=/\\_" else 6 if i > 32 else 0
    return table


CLASSES = _classes()


def line_features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch's bytes: features by line, line lengths, and how many lines each document has."""
    n_docs = len(offsets) - 1
    breaks = np.flatnonzero(raw == 10)
    doc_of = np.searchsorted(offsets, breaks, side="right") - 1
    lines = np.bincount(doc_of, minlength=n_docs) + 1 if len(breaks) else np.ones(n_docs, np.int64)
    first = np.concatenate([[0], np.cumsum(lines)[:-1]]).astype(np.int64)
    total = int(lines.sum())
    starts = np.zeros(total, np.int64)
    is_first = np.zeros(total, bool)
    is_first[first] = True
    starts[first] = offsets[:-1]
    starts[~is_first] = breaks + 1
    ends = np.empty(total, np.int64)
    last = first + lines - 1
    is_last = np.zeros(total, bool)
    is_last[last] = True
    ends[last] = offsets[1:]
    ends[~is_last] = breaks
    length = ends - starts
    kind = CLASSES[raw]
    sums = np.zeros((total, 10))
    for k in range(1, 10):
        c = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)])
        sums[:, k] = c[ends] - c[starts]
    # words: runs of bytes that are no space, in a line
    solid = kind != 7
    begin = np.flatnonzero(solid & np.concatenate([[True], ~solid[:-1]]) | (solid & np.isin(np.arange(len(raw)), offsets[:-1]))) if len(raw) else np.zeros(0, np.int64)
    weight = mix64(np.arange(257, dtype=np.uint64))
    word_line = np.searchsorted(starts, begin, side="right") - 1
    if len(begin):
        place = np.arange(len(raw), dtype=np.int64)
        run = np.zeros(len(raw), np.int64)
        run[begin] = 1
        run = np.cumsum(run) - 1
        inside = solid & (run >= 0)
        offset = np.where(inside, np.minimum(place - begin[np.maximum(run, 0)], 255), 0)
        value = np.where(inside, (raw.astype(np.uint64) + np.uint64(1)) * weight[offset], np.uint64(0))
        words = np.add.reduceat(value, begin)
    else:
        words = np.zeros(0, np.uint64)
    n_words = np.bincount(word_line, minlength=total).astype(float)
    same = np.zeros(len(words))
    same[1:] = (words[1:] == words[:-1]) & (word_line[1:] == word_line[:-1])
    repeats = np.bincount(word_line, same, total)
    # lines that repeat within their document
    line_hash = np.zeros(total, np.uint64)
    if len(words):
        np.add.at(line_hash, word_line, words * weight[np.minimum(np.arange(len(words)) - np.searchsorted(word_line, word_line), 255)])
    doc_line = np.repeat(np.arange(n_docs, dtype=np.uint64), lines)
    _, inverse, count = np.unique(mix64(line_hash) ^ mix64(doc_line + np.uint64(1)), return_inverse=True, return_counts=True)
    repeated = (count[inverse] > 1) & (n_words > 0)
    size = np.maximum(length, 1)
    letters = np.maximum(sums[:, 1] + sums[:, 2], 1)
    base = np.stack([
        np.ones(total), sums[:, 1] / letters, sums[:, 3] / size, sums[:, 4] / size, sums[:, 5] / size, sums[:, 6] / size, sums[:, 7] / size, sums[:, 8] / size,
        np.log1p(length) / 8, np.minimum(length / np.maximum(n_words, 1), 30) / 10, repeats / np.maximum(n_words, 1), repeated.astype(float),
        (sums[:, 1] / letters > 0.5).astype(float), (sums[:, 6] / np.maximum(n_words, 1) > 0.5).astype(float), (repeats / np.maximum(n_words, 1) > 0.3).astype(float),
        sums[:, 9] / np.maximum(n_words, 1), (sums[:, 9] / np.maximum(n_words, 1) > 0.2).astype(float),
    ], 1)
    base[length == 0] = 0
    before, after = np.zeros_like(base), np.zeros_like(base)
    before[1:], after[:-1] = base[:-1], base[1:]
    before[is_first], after[is_last] = 0, 0
    return np.concatenate([base, before, after], 1), length, lines


@dataclass
class LineField:
    weights: np.ndarray  # of the log-odds of good
    transition: np.ndarray  # 2 x 2, added where a label follows another
    prior: float

    def marginals(self, features: np.ndarray, lines: np.ndarray) -> np.ndarray:
        return chain(features @ self.weights, self.transition, lines)[0]


def chain(odds: np.ndarray, transition: np.ndarray, lines: np.ndarray, weights: np.ndarray | None = None):
    """Forward-backward over all documents at once, longest first: P(good) by line, and pair marginals summed by the
    documents' ``weights``, if given."""
    n = len(lines)
    order = np.argsort(-lines, kind="stable")
    first = np.concatenate([[0], np.cumsum(lines)[:-1]])[order].astype(np.int64)
    lines = lines[order]
    longest = int(lines[0]) if n else 0
    active = np.searchsorted(-lines, -np.arange(longest), side="left")  # documents longer than t
    move = np.exp(transition)
    local = np.stack([np.exp(-np.logaddexp(0, odds)), np.exp(-np.logaddexp(0, -odds))], 1)
    alpha, scale = np.zeros((len(odds), 2)), np.ones(len(odds))
    for t in range(longest):
        at = first[: active[t]] + t
        a = local[at] * (alpha[at - 1] @ move if t else 1.0)
        scale[at] = a.sum(1)
        alpha[at] = a / scale[at][:, None]
    beta = np.ones((len(odds), 2))
    expected = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = first[: active[t + 1]] + t
        right = local[at + 1] * beta[at + 1] / scale[at + 1][:, None]
        if weights is not None:
            expected += move * ((alpha[at] * weights[order[: active[t + 1]], None]).T @ right)
        beta[at] = right @ move.T
    good = (alpha * beta)[:, 1] / np.maximum((alpha * beta).sum(1), 1e-300)
    return good, expected


def fit(rows: list[tuple], steps: int = 250, rate: float = 0.05, l2: float = 1e-4, pair_l2: float = 0.1) -> LineField:
    """Conditional maximum likelihood by Adam, every line labelled as its document; a document's log-likelihood counts by
    one over its lines, in unary and pair terms alike."""
    rows = [r for r in rows if r[1]]
    if not rows:
        return LineField(np.zeros(3 * N_BASE), np.zeros((2, 2)), 0.5)
    parts = [line_features(*utf8_buffer(pa.array([r[1] for r in rows[i : i + 100]], pa.large_string()))) for i in range(0, len(rows), 100)]
    features, lines = np.concatenate([x[0] for x in parts]), np.concatenate([x[2] for x in parts])
    good = np.array([float(r[2]) for r in rows])
    prior = float(good.mean())
    y = np.repeat(good, lines)
    each = 1.0 / lines  # a document counts once, however many lines it has
    share = np.repeat(each, lines)
    follow = np.zeros((2, 2))
    w, trans = np.zeros(features.shape[1]), np.zeros((2, 2))
    follow[0, 0], follow[1, 1] = ((1 - good) * (lines - 1) * each).sum(), (good * (lines - 1) * each).sum()
    m = [np.zeros_like(w), np.zeros_like(trans)]
    v = [np.zeros_like(w), np.zeros_like(trans)]
    for step in range(1, steps + 1):
        p, pairs = chain(features @ w, trans, lines, each)
        grads = [features.T @ ((p - y) * share) / len(rows) + l2 * w, (pairs - follow) / len(rows) + pair_l2 * trans]
        for i, (x, g) in enumerate(zip((w, trans), grads, strict=True)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            x -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-9)
    return LineField(w, trans, prior)


def _parts(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, bounds): stretches of whole documents, and of a long one parts that end with a line's break where
    there is one in reach; a chain begins anew with each part."""
    if offsets[-1] <= 4 * PART_BYTES:
        return [(np.arange(len(offsets) - 1), offsets)] if len(offsets) > 1 else []
    out = []
    for i in range(len(offsets) - 1):
        at, end = int(offsets[i]), int(offsets[i + 1])
        while end - at > 2 * PART_BYTES:
            breaks = np.flatnonzero(raw[at + PART_BYTES : at + 2 * PART_BYTES] == 10)
            stop = at + PART_BYTES + int(breaks[0]) + 1 if len(breaks) else at + 2 * PART_BYTES
            out.append((np.array([i]), np.array([at, stop])))
            at = stop
        out.append((np.array([i]), np.array([at, end])))
    return out


def score(docs: DataFrame, model: LineField) -> DataFrame:
    """doc_id, score, n_lines, bad_lines of every row of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        raw, offsets = utf8_buffer(batch.column(1))
        n = batch.num_rows
        weight, total, bad, lines_of = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for row, bounds in _parts(raw, offsets):
            features, length, lines = line_features(raw[bounds[0] : bounds[-1]], bounds - bounds[0])
            good = m.marginals(features, lines)
            first = np.concatenate([[0], np.cumsum(lines)[:-1]]).astype(np.int64)
            np.add.at(weight, row, np.add.reduceat(length, first).astype(float))
            np.add.at(total, row, np.add.reduceat(length * good, first))
            np.add.at(bad, row, np.add.reduceat(((good < 0.5) & (length > 0)).astype(np.int64), first))
            np.add.at(lines_of, row, lines - (bounds[1:] < offsets[row + 1]))  # a part ends with its last line's break
        value = np.where(weight > 0, total / np.maximum(weight, 1), m.prior)
        lines = lines_of
        return pa.record_batch([batch.column(0), pa.array(np.clip(value, 0, 1)), pa.array(lines.astype(np.int64)), pa.array(bad)], names=["doc_id", "score", "n_lines", "bad_lines"])

    return map_batches(docs, run, "doc_id bigint, score double, n_lines bigint, bad_lines bigint")


def classify(documents: DataFrame, labels: DataFrame, fold: int = 3, held: int = 1, sample_per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """Learn from labelled rows outside the held-out fold (at most ``sample_per_class`` a class); score every row."""
    docs = texts(documents)
    learn = remainder("doc_id", fold) != held
    rows = labelled(docs.where(learn), labels.where(learn), "quality", sample_per_class)
    out = score(docs, fit(rows))
    return out.select("doc_id", F.coalesce(remainder("doc_id", fold) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_lines", "bad_lines")
