"""Language identification with interpolated Kneser-Ney character models.

One model a language over the letters of words (with a boundary on either side), kept
as sorted arrays of n-gram hashes with one column a language. A document goes to the
language of the lowest cross-entropy per character; texts far above what that
language's own texts of such a length show are rejected.

Cases: null text, or text without a letter, gives ``und``, score 0 and rejected. An
empty table gives an empty table; no learnable row at all gives ``und`` everywhere, and rejects nothing.
Repeated rows are scored each; other columns are ignored. Long texts are read in parts, of which only
their distinct words are kept. Ties go to the language that sorts first.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, map_batches, mix64, pieces, remainder
from .samples import by_class

LETTERS = re.compile(r"[^\W\d_]+")
OTHER = re.compile(r"[\W\d_]")
SAMPLE_PER_LANGUAGE = 400
ORDER = 5
FLOOR = -14.0  # log-probability of a character no model has seen
MARGIN, SPREADS = 0.35, 3.0  # nats a character, and spreads at a text's length, that known texts may lie above their mean
CHUNK = 16  # words of a stretch that shows the spread between characters


@dataclass
class CharModels:
    langs: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]  # by order: sorted hashes, log p by language (nan: unseen)
    backoffs: list[tuple[np.ndarray, np.ndarray]]  # by context order: sorted hashes, log weight by language
    limits: np.ndarray | None = None  # by language: mean, spread between texts, spread between characters within a text

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word, boundary included, by language."""
        codes, starts = _codes(words)
        hashes = _hashes(codes, starts)
        n, k = len(codes), len(self.langs)
        score, done, weight = np.full((n, k), FLOOR), np.zeros((n, k), bool), np.zeros((n, k))
        for order in range(ORDER, 0, -1):
            valid = hashes[order] != 0
            keys, values = self.grams[order]
            at, hit = _find(keys, hashes[order])
            hit &= valid
            found = np.full((n, k), np.nan)
            found[hit] = values[at[hit]]
            new = ~np.isnan(found) & ~done
            score[new] = (found + weight)[new]
            done |= new
            if order > 1:
                context = np.zeros(n, np.uint64)
                context[1:] = hashes[order - 1][:-1]
                keys, values = self.backoffs[order - 1]
                at, hit = _find(keys, context)
                hit &= valid
                weight[hit] += values[at[hit]]
        score[starts] = 0.0  # the opening boundary is given, not predicted
        return np.add.reduceat(score, starts, axis=0) if n else np.zeros((0, k))


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    joined = "".join(f" {w} " for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    return codes, np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(words) else np.zeros(0, np.int64)


def _hashes(codes: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """By order n: the hash of the n characters up to each position; 0 where the word is too short."""
    n = len(codes)
    first = np.zeros(n, np.int64)
    first[starts] = 1
    place = np.arange(n) - starts[np.cumsum(first) - 1] if n else np.zeros(0, np.int64)
    out: list[np.ndarray] = [np.zeros(n, np.uint64)]
    for order in range(1, ORDER + 1):
        before = np.zeros(n, np.uint64)
        before[1:] = out[order - 1][:-1]
        h = mix64((before * np.uint64(0x9E3779B97F4A7C15)) ^ (codes + np.uint64(order << 40))) | np.uint64(1)
        h[place < order - 1] = 0
        out.append(h)
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _fit_one(words: Counter) -> tuple[list[dict], list[dict]]:
    """Interpolated Kneser-Ney of one language: hash tables of log p by order and of back-off weights."""
    types = sorted(words)
    codes, starts = _codes(types)
    hashes = _hashes(codes, starts)
    repeat = np.repeat(np.array([words[w] for w in types], np.float64), np.diff(np.append(starts, len(codes))))
    opening = np.zeros(len(codes), bool)
    opening[starts] = True
    grams: list[dict] = [{}]
    backoffs: list[dict] = [{}]
    lower: tuple[np.ndarray, np.ndarray] | None = None
    for order in range(1, ORDER + 1):
        use = (hashes[order] != 0) & ~opening
        keys, index, inverse = np.unique(hashes[order][use], return_index=True, return_inverse=True)
        if not len(keys):
            grams.append({"k": keys, "v": np.zeros(0)})
            backoffs.append({"k": keys, "v": np.zeros(0)})
            continue
        raw = np.bincount(inverse, repeat[use])
        place = np.flatnonzero(use)[index]
        if order < ORDER:  # continuation counts, and raw ones for what only starts words
            longer = (hashes[order + 1] != 0) & use
            _, kind = np.unique(hashes[order + 1][longer], return_index=True)
            count = np.bincount(np.searchsorted(keys, hashes[order][longer][kind]), minlength=len(keys)).astype(np.float64)
            only = count == 0
            count[only] = np.minimum(raw[only], 1.0)
        else:
            count = raw
        ones, twos = float((count == 1).sum()), float((count == 2).sum())
        discount = min(0.9, max(0.1, ones / max(1.0, ones + 2 * twos)))
        context = hashes[order - 1][place - 1] if order > 1 else np.zeros(len(keys), np.uint64)
        ckeys, cinverse = np.unique(context, return_inverse=True)
        total, kinds = np.bincount(cinverse, count), np.bincount(cinverse)
        left = discount * kinds / total
        if order == 1:
            below = np.full(len(keys), 1.0 / max(256, 2 * len(keys)))
        else:
            below = np.exp(lower[1][np.searchsorted(lower[0], hashes[order - 1][place])])
        p = (count - discount) / total[cinverse] + left[cinverse] * below
        lower = (keys, np.log(p))
        grams.append({"k": keys, "v": np.log(p)})
        backoffs.append({"k": ckeys, "v": np.log(left)})  # weights of contexts of order - 1
    return grams, backoffs


def _merge(parts: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique(np.concatenate([p["k"] for p in parts])) if parts else np.zeros(0, np.uint64)
    values = np.full((len(keys), len(parts)), np.nan)
    for i, p in enumerate(parts):
        values[np.searchsorted(keys, p["k"]), i] = p["v"]
    return keys, values


def _count(texts: list[str]) -> Counter:
    words: Counter = Counter()
    for t in texts:
        for part in pieces(t, OTHER):
            words.update(LETTERS.findall(part.lower()))
    return words


def _train(by_lang: dict[str, list[str]]) -> CharModels:
    langs = sorted(by_lang)
    fitted = [_fit_one(_count(by_lang[x])) for x in langs]
    grams = [(np.zeros(0, np.uint64), np.zeros((0, len(langs))))]
    backoffs = [(np.zeros(0, np.uint64), np.zeros((0, len(langs))))]
    for order in range(1, ORDER + 1):
        grams.append(_merge([g[order] for g, _ in fitted]))
        if order > 1:
            keys, values = _merge([b[order] for _, b in fitted])
            backoffs.append((keys, np.nan_to_num(values, nan=0.0)))
    return CharModels(langs, grams, backoffs)


def _distinct_chars(owner: np.ndarray, at: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Characters of the distinct words of each of ``n`` owners: what a repeated word shows, it shows once."""
    pairs = np.unique(owner * np.int64(max(1, len(lengths))) + at)
    return np.bincount(pairs // max(1, len(lengths)), lengths[pairs % max(1, len(lengths))], minlength=n)


def _entropies(owner: np.ndarray, at: np.ndarray, scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy of each owner, and the characters of its distinct words."""
    return -np.bincount(owner, scores[at]) / np.bincount(owner, lengths[at]), _distinct_chars(owner, at, lengths, int(owner[-1]) + 1)


def _spread(x: np.ndarray) -> float:
    """Standard deviation by the median of deviations, so that a few mixed texts do not widen it."""
    return 1.4826 * float(np.median(np.abs(x - np.median(x)))) if len(x) else 0.0


def _limits(words: list[list[str]], model: CharModels, lang: int) -> tuple[float, float, float]:
    """Mean, spread between texts and spread between characters of held-out texts.

    The last is taken from stretches about their own text's entropy, so it holds nothing of the spread
    between texts; that one is what the texts show beyond it."""
    kinds = sorted({w for x in words for w in x})
    number = {w: i for i, w in enumerate(kinds)}
    scores, lengths = model.word_scores(kinds)[:, lang], np.array([len(w) + 1 for w in kinds], np.float64)
    counts = np.array([len(x) for x in words])
    at = np.array([number[w] for x in words for w in x], np.int64)
    owner = np.repeat(np.arange(len(words)), counts)
    entropy, chars = _entropies(owner, at, scores, lengths)
    place = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
    _, chunk = np.unique(owner * (place.max() // CHUNK + 1) + place // CHUNK, return_inverse=True)
    of = np.zeros(chunk[-1] + 1, np.int64)
    of[chunk] = owner
    own, own_chars = _entropies(chunk, at, scores, lengths)
    many = counts[of] > CHUNK
    within = _spread(((own - entropy[of]) * np.sqrt(own_chars))[many]) or float(((entropy - entropy.mean()) * np.sqrt(chars)).std())
    between = np.sqrt(max(0.0, _spread(entropy) ** 2 - within**2 * float(np.median(1 / chars))))
    return float(np.median(entropy)), float(between), within


def fit(rows: list[tuple]) -> CharModels | None:
    """From (doc_id, text, lang) rows. Limits of rejection come from models of every other row."""
    by_lang: dict[str, list[str]] = {}
    for _, text, lang in rows:
        if LETTERS.search(text):
            by_lang.setdefault(lang, []).append(text)
    if not by_lang:
        return None
    model = _train(by_lang)
    half = _train({x: t[::2] for x, t in by_lang.items()})
    limits = np.zeros((len(model.langs), 3))
    for i, lang in enumerate(model.langs):
        held = by_lang[lang][1::2] or by_lang[lang]
        words = [LETTERS.findall(t.lower()) for t in held]
        limits[i] = _limits(words, half, i)
    model.limits = limits
    return model


SCHEMA = "doc_id bigint, lang_pred string, score double, cross_entropy double, rejected boolean"


def predict(docs: DataFrame, model: CharModels | None) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy (nats a character), rejected for every row of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    memo: dict = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        n = len(texts)
        lang: list[str] = ["und"] * n
        score, entropy, rejected = np.zeros(n), np.full(n, np.nan), np.full(n, m is not None)
        if m is not None:
            found = [_count([t]) if t else Counter() for t in texts]
            kinds = set().union(*found) if found else set()
            cache = memo.setdefault("at", Cache())
            missing = [w for w in kinds if w not in cache]
            if missing:
                if len(cache) + len(missing) > cache.limit or "values" not in memo:
                    cache.clear()
                    missing = list(kinds)
                    memo["values"] = np.zeros((0, len(m.langs) + 1))
                new = np.concatenate([m.word_scores(missing), np.fromiter((len(w) + 1 for w in missing), float, len(missing))[:, None]], 1)
                base = len(memo["values"])
                memo["values"] = np.concatenate([memo["values"], new])
                cache.update(zip(missing, range(base, base + len(missing)), strict=True))
            has = [i for i, x in enumerate(found) if any(any(map(str.isalpha, w)) for w in x)]
            if has:
                counts = np.array([len(found[i]) for i in has])  # of distinct words
                at = np.fromiter((cache[w] for i in has for w in found[i]), np.int64, int(counts.sum()))
                times = np.fromiter((n for i in has for n in found[i].values()), float, len(at))
                firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
                sums = np.add.reduceat(memo["values"][at] * times[:, None], firsts, axis=0)
                chars = sums[:, -1:]
                ce = -sums[:, :-1] / chars
                best = ce.argmin(1)
                rows = np.arange(len(has))
                odds = np.exp(-(ce - ce[rows, best][:, None]) * np.minimum(chars, 60.0))
                posterior = 1.0 / odds.sum(1)
                low = ce[rows, best]
                mean, between, within = m.limits[best].T
                distinct = np.add.reduceat(memo["values"][at, -1], firsts)
                for j, i in enumerate(has):
                    lang[i] = m.langs[best[j]]
                score[has], entropy[has] = posterior, low
                rejected[has] = low > mean + MARGIN + SPREADS * np.sqrt(between**2 + within**2 / distinct)
        return pa.record_batch([ids, pa.array(lang), pa.array(score), pa.array(entropy, from_pandas=True), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    return map_batches(docs, run, SCHEMA)


def identify(documents: DataFrame, fold: int = 3, held: int = 1, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """Learn from rows outside the held-out fold that carry a lang; predict every row.

    ``sample_per_language`` bounds the rows a language that the models are fitted on.
    """
    own = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = by_class(own.where(remainder("doc_id", fold) != held), "lang", sample_per_language)
    result = predict(own.select("doc_id", "text"), fit(rows))
    return result.withColumn("held_out", F.coalesce(remainder("doc_id", fold) == held, F.lit(False)))
