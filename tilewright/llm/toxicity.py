"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

A word's input is its own vector (one for all rare words) beside the two end states of a
small bidirectional network over its characters. A second bidirectional network reads
windows of WINDOW words, attention pools its states, and a logistic unit scores the window.
Windows overlap by half and cover the whole text; a document scores as its worst window.
Everything is numpy, gradients included. Projections of distinct words are kept per worker.

Cases: null and empty texts, and texts without a word, score the base rate, below 0.5.
Long texts are scored whole, in overlapping parts; at 0.5 the prediction is 1; other columns are ignored.
Rows with null ids and repeated rows are scored each; empty tables give empty tables; with
no learnable row, or rows of one class only, every score is that class's rate.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, bounded_batches, pieces, remainder, split_batch, texts
from .samples import labelled

WORDS = re.compile(r"[^\W_]{1,24}")
WINDOW, STRIDE = 64, 32
SAMPLE_PER_CLASS, SAMPLE_WINDOWS, CHECK_WINDOWS = 600, 1500, 400
LONG, PART_WORDS = 2_000_000, 50_000  # characters from which texts are scored in parts, and words of a part
BREAK = re.compile(r"[\W_]")
CHARS, CHAR_DIM, CHAR_HIDDEN, WORD_DIM, HIDDEN, ATTENTION = 512, 8, 12, 8, 16, 16


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


def _scatter(n: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Rows of ``values`` summed by the row of an n-row table that each belongs to."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(at):
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(at[order]) != 0))
        out[at[order][first]] = np.add.reduceat(values[order], first, axis=0)
    return out


class Gru:
    """One direction over (rows, steps) with inputs already projected to the three gates."""

    def __init__(self, u: np.ndarray):
        self.u, self.h = u, u.shape[0]

    def forward(self, gates: np.ndarray, mask: np.ndarray, reverse: bool, keep: bool = True, shrinking: bool = False):
        """``shrinking``: rows come longest first and each is whole, so a step touches only rows that reach it."""
        n, steps, h = gates.shape[0], gates.shape[1], self.h
        state = np.zeros((n, h), np.float32)
        states, memory = None if shrinking else np.zeros((n, steps, h), np.float32), []
        reach = mask.sum(0) if shrinking else np.full(steps, n)
        for t in range(steps - 1, -1, -1) if reverse else range(steps):
            k = int(reach[t])
            x, m, before = gates[:k, t], mask[:k, t, None], state[:k].copy()
            s = before @ self.u
            zr = _sigmoid(x[:, : 2 * h] + s[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(x[:, 2 * h :] + r * s[:, 2 * h :])
            new = c + z * (before - c)
            if keep:
                memory.append((t, k, before, s, z, r, c, m))
            if shrinking:
                state[:k] = new
            else:
                state = np.where(m, new, before)
                states[:, t] = state
        return states, state, memory

    def backward(self, memory, d_states: np.ndarray | None, d_last: np.ndarray | None, shape: tuple) -> tuple[np.ndarray, np.ndarray]:
        n, steps, h = *shape, self.h
        d_gates, du = np.zeros((n, steps, 3 * h), np.float32), np.zeros_like(self.u)
        total = np.zeros((n, h), np.float32) if d_last is None else d_last.copy()
        for t, k, before, s, z, r, c, m in reversed(memory):
            d = total[:k]
            if d_states is not None:
                d = d + d_states[:k, t]
            own = d * m
            dc = own * (1 - z) * (1 - c * c)
            dz = own * (before - c) * z * (1 - z)
            g = d_gates[:k, t]
            g[:, :h], g[:, h : 2 * h], g[:, 2 * h :] = dz, dc * s[:, 2 * h :] * r * (1 - r), dc
            ds = g.copy()
            ds[:, 2 * h :] *= r
            du += before.T @ ds
            total[:k] = d - own + own * z + ds @ self.u.T
        return d_gates, du


class Network:
    def __init__(self, vocabulary: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        init = lambda *s: (rng.standard_normal(s) * (0.5 / np.sqrt(s[0]))).astype(np.float32)
        self.index = {w: i + 1 for i, w in enumerate(vocabulary)}
        inputs = WORD_DIM + 2 * CHAR_HIDDEN
        self.p = {
            "char": (rng.standard_normal((CHARS, CHAR_DIM)) * 0.3).astype(np.float32), "word": (rng.standard_normal((len(vocabulary) + 1, WORD_DIM)) * 0.005).astype(np.float32),
            "cw": init(CHAR_DIM, 6 * CHAR_HIDDEN), "cb": np.zeros(6 * CHAR_HIDDEN, np.float32), "cuf": init(CHAR_HIDDEN, 3 * CHAR_HIDDEN), "cub": init(CHAR_HIDDEN, 3 * CHAR_HIDDEN),
            "w": init(inputs, 6 * HIDDEN), "b": np.zeros(6 * HIDDEN, np.float32), "uf": init(HIDDEN, 3 * HIDDEN), "ub": init(HIDDEN, 3 * HIDDEN),
            "aw": init(2 * HIDDEN, ATTENTION), "ab": np.zeros(ATTENTION, np.float32), "av": init(ATTENTION, 1), "ow": init(2 * HIDDEN, 1), "ob": np.zeros(1, np.float32),
        }
        self.p["w"][:WORD_DIM] *= 3  # words speak first, characters join in as far as they help
        self.p["w"][WORD_DIM:] *= 0.5
        self.rate, self.shift = 0.1, 0.0

    def _chars(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        length = np.fromiter(map(len, words), np.int64, len(words))
        ids = np.zeros((len(words), max(1, int(length.max()))), np.int64)
        mask = np.arange(ids.shape[1]) < length[:, None]
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ids[mask] = np.where(codes < 384, codes, 384 + codes % 128)
        return ids, mask

    def project(self, words: list[str], keep: bool = False):
        """Gate inputs of each word for both directions."""
        p, c = self.p, 3 * CHAR_HIDDEN
        order = np.argsort([-len(w) for w in words], kind="stable")
        back = np.argsort(order, kind="stable")
        ids, mask = self._chars([words[i] for i in order])
        gates = (p["char"] @ p["cw"] + p["cb"])[ids]
        f = Gru(p["cuf"]).forward(gates[:, :, :c], mask, False, keep, True)
        b = Gru(p["cub"]).forward(gates[:, :, c:], mask, True, keep, True)
        at = np.fromiter((self.index.get(w, 0) for w in words), np.int64, len(words))
        x = np.concatenate([p["word"][at], f[1][back], b[1][back]], 1)
        return x @ p["w"] + p["b"], (ids, mask, f[2], b[2], at, x, order) if keep else None

    def pretrain(self, words: list[str], n0: np.ndarray, n1: np.ndarray, steps: int, batch: int = 1024, rate: float = 0.02) -> None:
        """Teach the character network which words come with which label, ``n0`` and ``n1`` being
        their balanced weights, and let the word network start from that direction."""
        p, c, h = self.p, 3 * CHAR_HIDDEN, CHAR_HIDDEN
        rng, total = np.random.default_rng(3), n0 + n1
        head = {"v": np.zeros((2 * h, 1), np.float32), "b": np.zeros(1, np.float32)}
        names = ("char", "cw", "cb", "cuf", "cub")
        moments: dict[str, tuple] = {}
        for step in range(1, steps + 1):
            own = rng.choice(len(words), batch, p=total / total.sum())
            own = own[np.argsort([-len(words[i]) for i in own], kind="stable")]
            ids, mask = self._chars([words[i] for i in own])
            gates = (p["char"] @ p["cw"] + p["cb"])[ids]
            _, f, mf = Gru(p["cuf"]).forward(gates[:, :, :c], mask, False, True, True)
            _, b, mb = Gru(p["cub"]).forward(gates[:, :, c:], mask, True, True, True)
            state = np.concatenate([f, b], 1)
            y = (n1[own] / total[own]).astype(np.float32)[:, None]
            d = (_sigmoid(state @ head["v"] + head["b"]) - y) / batch
            g = {"v": state.T @ d, "b": d.sum(0)}
            ds = d @ head["v"].T
            df, g["cuf"] = Gru(p["cuf"]).backward(mf, None, ds[:, :h], ids.shape)
            db, g["cub"] = Gru(p["cub"]).backward(mb, None, ds[:, h:], ids.shape)
            d_char = _scatter(CHARS, ids[mask], np.concatenate([df[mask], db[mask]], 1))
            g["cw"], g["cb"], g["char"] = p["char"].T @ d_char, d_char.sum(0), d_char @ p["cw"].T
            for k, x in g.items():
                value = p[k] if k in names else head[k]
                m, v = moments.setdefault(k, (np.zeros_like(value), np.zeros_like(value)))
                m += 0.1 * (x - m)
                v += 0.005 * (x * x - v)
                value -= rate * (1 - 0.9 * step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.995**step)) + 1e-8)
        p["w"][WORD_DIM:] = 0.1 * p["w"][WORD_DIM:] + head["v"] @ p["w"][:1]
        p["b"] += head["b"] @ p["w"][:1]

    def windows(self, gates: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows of word indices."""
        p, h = self.p, 3 * HIDDEN
        x = gates[index]
        f = Gru(p["uf"]).forward(x[:, :, :h], mask, False, keep)
        b = Gru(p["ub"]).forward(x[:, :, h:], mask, True, keep)
        states = np.concatenate([f[0], b[0]], 2)
        hidden = np.tanh(states @ p["aw"] + p["ab"])
        e = np.where(mask, (hidden @ p["av"])[:, :, 0], np.float32(-1e9))
        a = np.exp(e - e.max(1, keepdims=True))
        a /= a.sum(1, keepdims=True)
        pooled = (a[:, :, None] * states).sum(1)
        return (pooled @ p["ow"] + p["ob"])[:, 0], (f[2], b[2], states, hidden, a, pooled) if keep else None

    def gradients(self, words: list[str], index: np.ndarray, mask: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, h, c = self.p, 3 * HIDDEN, 3 * CHAR_HIDDEN
        gates, (ids, char_mask, cf, cb, at, x, order) = self.project(words, True)
        logit, (mf, mb, states, hidden, a, pooled) = self.windows(gates, index, mask, True)
        g: dict[str, np.ndarray] = {}
        d = ((_sigmoid(logit) - target) * weight / weight.sum()).astype(np.float32)[:, None]
        g["ow"], g["ob"] = pooled.T @ d, d.sum(0)
        d_pooled = d @ p["ow"].T
        d_states = a[:, :, None] * d_pooled[:, None, :]
        da = (states * d_pooled[:, None, :]).sum(2)
        de = a * (da - (a * da).sum(1, keepdims=True))
        dh = de[:, :, None] * p["av"][:, 0] * (1 - hidden * hidden)
        g["av"] = (hidden * de[:, :, None]).sum((0, 1))[:, None]
        g["aw"], g["ab"] = np.einsum("nts,nta->sa", states, dh), dh.sum((0, 1))
        d_states = d_states + dh @ p["aw"].T
        df, g["uf"] = Gru(p["uf"]).backward(mf, d_states[:, :, :HIDDEN], None, index.shape)
        db, g["ub"] = Gru(p["ub"]).backward(mb, d_states[:, :, HIDDEN:], None, index.shape)
        d_gates = _scatter(len(gates), index[mask], np.concatenate([df[mask], db[mask]], 1))
        g["w"], g["b"] = x.T @ d_gates, d_gates.sum(0)
        dx = d_gates @ p["w"].T
        g["word"] = _scatter(len(p["word"]), at, dx[:, :WORD_DIM])
        dx = dx[order]
        dcf, g["cuf"] = Gru(p["cuf"]).backward(cf, None, dx[:, WORD_DIM : WORD_DIM + CHAR_HIDDEN], ids.shape)
        dcb, g["cub"] = Gru(p["cub"]).backward(cb, None, dx[:, WORD_DIM + CHAR_HIDDEN :], ids.shape)
        d_char = _scatter(CHARS, ids[char_mask], np.concatenate([dcf[char_mask], dcb[char_mask]], 1))
        g["cw"], g["cb"] = p["char"].T @ d_char, d_char.sum(0)
        g["char"] = d_char @ p["cw"].T
        return g

    def document_logits(self, gates: np.ndarray, documents: list[np.ndarray]) -> np.ndarray:
        """The largest window logit of each document of word indices (none of them empty)."""
        owner, index, mask = cut([len(d) for d in documents], documents)
        out = np.full(len(documents), -np.inf, np.float32)
        for i in range(0, len(owner), 2048):
            steps = max(1, int(mask[i : i + 2048].sum(1).max()))
            logit, _ = self.windows(gates, index[i : i + 2048, :steps], mask[i : i + 2048, :steps])
            np.maximum.at(out, owner[i : i + 2048], logit)
        return out


def cut(lengths: list[int], documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All overlapping windows: (document, word indices, which of them are words). Longest first."""
    n = np.array(lengths)
    count = np.maximum(0, -(-(n - WINDOW) // STRIDE)) + 1
    owner = np.repeat(np.arange(len(n)), count)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = np.minimum(step * STRIDE, np.maximum(n[owner] - WINDOW, 0))
    mask = start[:, None] + np.arange(WINDOW) < n[owner][:, None]
    flat = np.concatenate(documents) if documents else np.zeros(0, np.int64)
    base = (np.cumsum(n) - n)[owner]
    index = flat[np.minimum(base[:, None] + start[:, None] + np.arange(WINDOW), len(flat) - 1)]
    order = np.argsort(-mask.sum(1), kind="stable")
    return owner[order], index[order], mask[order]


def fit(rows: list[tuple], steps: int = 200, batch: int = 64, rate: float = 0.01, slowness: float = 0.05, decay: float = 0.002, pretraining: int = 300, seed: int = 5, windows_per_class: int = SAMPLE_WINDOWS, check_windows: int = CHECK_WINDOWS) -> Network:
    """From (doc_id, text, label) rows: Adam on windows (at most ``windows_per_class`` drawn from the sample's, and
    ``check_windows`` a class of the documents held back), keeping the weights of the lowest loss
    on a fifth of the documents. Words that too few documents hold share one vector; the first
    component of the others starts at what their counts by label say beyond chance. Later
    on, windows of toxic documents that look clean count little: the label need not be theirs."""
    docs = [(WORDS.findall(t.lower()), float(y)) for _, t, y in rows]
    docs = [d for d in docs if d[0]]
    labels = np.array([y for _, y in docs])
    if not len(docs) or labels.min() == labels.max():
        net = Network([], seed)
        net.rate, net.shift = float(labels.mean()) if len(docs) else 0.1, np.nan
        return net
    rng = np.random.default_rng(seed)
    held = np.zeros(len(docs), bool)
    for y in (0, 1):
        own = rng.permutation(np.flatnonzero(labels == y))
        held[own[: len(own) // 5]] = True
    by_label = [Counter(), Counter()]
    for (words, y), h in zip(docs, held, strict=True):
        if not h:
            by_label[int(y)].update(set(words))
    n0, n1 = (max(1, int((labels[~held] == y).sum())) for y in (0, 1))
    least = max(4, (n0 + n1) // 200)
    vocabulary = sorted(w for w in {*by_label[0], *by_label[1]} if by_label[0][w] + by_label[1][w] >= least)
    net = Network(vocabulary, seed)
    c0, c1 = (np.array([c[w] for w in vocabulary], float) for c in by_label)
    both = (c0 + c1 + 1) / (n0 + n1 + 2)
    z = (c1 / n1 - c0 / n0) / np.sqrt(both * (1 - both) * (1 / n0 + 1 / n1))
    beyond = np.sign(z) * np.maximum(np.abs(z) - np.sqrt(2 * np.log(max(2, len(vocabulary)))), 0)
    net.p["word"][1:, 0] = np.clip(beyond, -3, 3)
    known = sorted({*by_label[0], *by_label[1]})
    net.pretrain(known, np.array([by_label[0][w] / n0 for w in known]), np.array([by_label[1][w] / n1 for w in known]), pretraining)
    kinds = sorted({w for words, _ in docs for w in words})
    number = {w: i for i, w in enumerate(kinds)}
    indices = [np.array([number[w] for w in words]) for words, _ in docs]
    owner, index, mask = cut([len(x) for x in indices], indices)
    target = labels[owner].astype(np.float32)
    pick = np.concatenate([rng.permutation(np.flatnonzero((target == y) & ~held[owner]))[:windows_per_class] for y in (0, 1)])
    check = np.concatenate([rng.permutation(np.flatnonzero((target == y) & held[owner]))[:check_windows] for y in (0, 1)])
    used = np.unique(index[check][mask[check]])
    local = np.searchsorted(used, index[check])
    local[~mask[check]] = 0
    used_words = [kinds[j] for j in used]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    believed, best = np.ones(len(owner), np.float32), (np.inf, {k: v.copy() for k, v in net.p.items()})
    per_epoch = max(1, -(-len(pick) // batch))
    every = min(per_epoch, max(1, steps // 12))
    order = np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if len(order) < 1:
            order = rng.permutation(pick)
        own, order = order[:batch], order[batch:]
        inside = mask[own] & (rng.random(mask[own].shape) > 0.1)  # words drop out
        inside[:, 0] |= ~inside.any(1)
        kept, flat = np.unique(index[own][inside], return_inverse=True)
        small = np.zeros((len(own), WINDOW), np.int64)
        small[inside] = flat
        weight = np.where(target[own] == 1, believed[own] * 0.5 / max(1e-6, (believed[pick] * target[pick]).sum()), 0.5 / max(1.0, (1 - target[pick]).sum()))
        g = net.gradients([kinds[j] for j in kept], small, inside, target[own], weight)
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        for k, x in g.items():
            x = x * min(1.0, 1.0 / max(norm, 1e-9))
            m, v = moments[k]
            m += 0.1 * (x - m)
            v += 0.001 * (x * x - v)
            slow = slowness if k in ("word", "char", "cw", "cuf", "cub") else 1.0  # what could learn texts by heart moves slowly
            net.p[k] -= slow * rate * (1 - 0.8 * step / steps) * ((m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + decay * net.p[k] * (k not in ("word", "char")))
        if step % every == 0 or step == steps:
            if len(check):
                logit, _ = net.windows(_gates(net, used_words), local, mask[check])
                y = target[check]
                losses = np.logaddexp(0, np.where(y == 1, -logit, logit))
                # a toxic document is as good as its worst windows
                loss = losses[y == 0].mean() + np.sort(losses[y == 1])[: max(1, int(0.8 * (y == 1).sum()))].mean() if 0 < y.sum() < len(y) else losses.mean()
                if loss < best[0]:
                    best = (float(loss), {k: v.copy() for k, v in net.p.items()})
            if step > steps // 3:
                positive = pick[target[pick] == 1]
                words_of = np.unique(index[positive][mask[positive]])
                at = np.searchsorted(words_of, index[positive])
                at[~mask[positive]] = 0
                logit, _ = net.windows(_gates(net, [kinds[j] for j in words_of]), at, mask[positive])
                believed[positive] = np.where(logit > -1.5, 1.0, 0.05)
    if np.isfinite(best[0]):
        net.p = best[1]
    logits = net.document_logits(_gates(net, kinds), indices)
    net.shift = float(_threshold(logits, labels))
    net.rate = min(0.45, float(labels.mean()))
    return net


def _gates(net: Network, words: list[str]) -> np.ndarray:
    return np.concatenate([net.project(words[i : i + 8192])[0] for i in range(0, len(words), 8192)])


def _threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the widest of the best cuts between the classes; as clean documents are many, their share right counts threefold."""
    order = np.argsort(logits)
    x, y = logits[order], labels[order]
    right = 3 * np.cumsum(1 - y)[:-1] / max(1, (1 - y).sum()) + (y.sum() - np.cumsum(y)[:-1]) / max(1, y.sum())
    best = np.flatnonzero(right >= right.max() - 1e-9)
    at = best[np.argmax(x[best + 1] - x[best])]
    return (x[at] + x[at + 1]) / 2


def _squash(logit):
    return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def _long_logit(net: Network, text: str) -> tuple[float, int]:
    """The largest window logit of a long text and its number of windows: parts of some words each, which
    overlap so that every window lies in one."""
    best, count, held = -np.inf, 0, []

    def scan(words: list[str]) -> float:
        kinds = sorted(set(words), key=lambda w: (len(w), w))
        number = {w: i for i, w in enumerate(kinds)}
        index = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        return max(best, float(net.document_logits(_gates(net, kinds), [index])[0]))

    for part in pieces(text, BREAK):
        held += WORDS.findall(part.lower())
        if len(held) > PART_WORDS:
            more = len(held) // STRIDE - 4
            best, count = scan(held[: WINDOW + STRIDE * more]), count + more + 1
            held = held[STRIDE * (more + 1) :]
    if held:
        best, count = scan(held), count + max(0, -(-(len(held) - WINDOW) // STRIDE)) + 1
    return best, count


_words: dict = {}  # of this Python worker: the network it has last used, and its words' projections


def score(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, score, n_windows of every row of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    bounded_batches(docs.sparkSession)

    def run(batches):
        net = shared.value
        if _words.get("of") is not net:
            _words.update(of=net, at=Cache(120_000), gates=np.zeros((0, 6 * HIDDEN), np.float32), used=0)
        for big in batches:
            for batch in split_batch(big, 1_500_000):
                whole = batch.column(1).to_pylist()
                found = [WORDS.findall(t.lower()) if t and len(t) < LONG else [] for t in whole]
                value, n_windows = np.full(len(found), net.rate), np.zeros(len(found), np.int64)
                has = [i for i, x in enumerate(found) if x]
                if not np.isnan(net.shift):
                    for i, t in enumerate(whole):
                        if t and len(t) >= LONG:
                            logit, n_windows[i] = _long_logit(net, t)
                            value[i] = _squash(logit - net.shift) if n_windows[i] else net.rate
                if has and not np.isnan(net.shift):
                    kinds = set().union(*(found[i] for i in has))
                    at = _words["at"]
                    missing = sorted(w for w in kinds if w not in at)
                    if len(at) + len(missing) > at.limit:
                        at.clear()
                        missing, _words["gates"] = sorted(kinds), np.zeros((0, 6 * HIDDEN), np.float32)
                        _words["used"] = 0
                    if missing:
                        missing.sort(key=len)
                        used, need = _words["used"], _words["used"] + len(missing)
                        at.update(zip(missing, range(used, need), strict=True))
                        if need > len(_words["gates"]):  # room grows by doubling
                            room = np.zeros((max(need, 2 * len(_words["gates"])), 6 * HIDDEN), np.float32)
                            room[:used] = _words["gates"][:used]
                            _words["gates"] = room
                        _words["gates"][used:need], _words["used"] = _gates(net, missing), need
                    indices = [np.fromiter(map(at.__getitem__, found[i]), np.int64, len(found[i])) for i in has]
                    logit = net.document_logits(_words["gates"], indices).astype(np.float64) - net.shift
                    value[has] = _squash(logit)
                    n_windows[has] = [max(0, -(-(len(x) - WINDOW) // STRIDE)) + 1 for x in indices]
                yield pa.record_batch([batch.column(0), pa.array(value), pa.array(n_windows)], names=["doc_id", "score", "n_windows"])

    return docs.mapInArrow(run, "doc_id bigint, score double, n_windows bigint")


def classify(documents: DataFrame, labels: DataFrame, fold: int = 5, held: int = 0, sample_per_class: int = SAMPLE_PER_CLASS, windows_per_class: int = SAMPLE_WINDOWS) -> DataFrame:
    """Learn from labelled rows outside the held-out fold (at most ``sample_per_class`` a class, and
    ``windows_per_class`` of their windows); score every row."""
    docs = texts(documents)
    learn = remainder("doc_id", fold) != held
    network = fit(labelled(docs.where(learn), labels.where(learn), "toxic", sample_per_class), windows_per_class=windows_per_class)
    return score(docs, network).select("doc_id", F.coalesce(remainder("doc_id", fold) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_windows")
