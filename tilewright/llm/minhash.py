"""Near-duplicate groups by one-permutation MinHash, confirmed on full shingle sets.

A document's set of word shingles is hashed once; each of BANDS * ROWS equal ranges of the
hash keeps its minimum, and empty ranges borrow from a full one by a fixed random order
(optimal densification). Bands of ROWS minima are buckets. Equal sets are one class from
the start. In each bucket the member that meets most others over all its buckets, most
likely the original of its copies, is the centre of a star of candidate links, so candidates grow with memberships, not with their squares. All candidates are confirmed on
full sets. Where a star leaves a bucket in several components, its members outside the
centre's component are compared with all its members by their lowest hashes, block by block,
and what looks alike is confirmed too, so no bucket loses a link that its star missed.

Two sets at the threshold of 0.75 share none of 50 bands of 5 with a chance of 1.4e-6.

Cases: null and empty texts, and those without words, have empty sets, link with nothing
and are kept; fewer than five words are one shingle. Rows with a null id link with nothing
and have a null component. Repeated rows of an id are one document: all their texts link for
it, and each row reports its own set's size. Ties between centres go to the smaller id. The
words of long texts are hashed in parts, their sets are whole. Other columns are ignored,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, mix64, texts, utf8_buffer
from .components import connected_components

SHINGLE, BANDS, ROWS = 5, 50, 5
BINS = BANDS * ROWS
BLOCK = 2048  # members of a bucket that are compared with as many others at a time
PART_BYTES = 4_000_000  # of texts whose words are hashed at a time
KEPT = 256  # lowest hashes that stand for a set; sets up to this size are held whole
SLACK = 0.13  # about five standard errors of a similarity told from KEPT values
_P = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_RANK = np.argsort(np.argsort(np.random.default_rng(11).random((BINS, BINS)), axis=1), axis=1).astype(np.int32)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a batch's bytes (A-Z folded), and how many each document has."""
    n_docs = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(n_docs, np.int64)
    low = raw.copy()
    low[(raw >= 65) & (raw <= 90)] += 32
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    begin = np.flatnonzero(solid & (edge[:-1] | np.append(True, ~solid[:-1])))
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(n_docs, np.int64)
    run = np.zeros(len(raw), np.int32)
    run[begin] = 1
    run = np.cumsum(run, dtype=np.int32) - 1
    place = np.arange(len(raw), dtype=np.int64) - begin[np.maximum(run, 0)]
    place[~solid | (run < 0)] = 0
    power = np.full(int(place.max()) + 1, _P, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    value = _BYTE[low] * power[place]
    value[~solid] = 0
    length = np.add.reduceat(solid.astype(np.int64), begin)
    counts = np.diff(np.searchsorted(begin, offsets))
    return mix64(np.add.reduceat(value, begin) + length.astype(np.uint64)), counts


def _words_in_parts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes`` with parts of a long text one by one, cut at white space."""
    if len(raw) <= 2 * PART_BYTES:
        return word_hashes(raw, offsets)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    words, counts, at = [], np.zeros(len(offsets) - 1, np.int64), 0
    while at < len(raw):
        end = at + PART_BYTES
        end = len(raw) if end >= len(raw) else end + int(blank[end:].argmax()) if blank[end:].any() else len(raw)
        own, n = word_hashes(raw[at:end], np.clip(offsets, at, end) - at)
        words.append(own)
        counts += n
        at = end
    return np.concatenate(words), counts


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    words, counts = _words_in_parts(raw, offsets)
    grams = np.zeros(0, np.uint64)
    if len(words) >= SHINGLE:
        n = len(words) - SHINGLE + 1
        grams = sum(words[i : i + n] * _ODD[i] for i in range(SHINGLE))
        grams = mix64(grams)
    out, at = [], 0
    for c in counts.tolist():
        if c >= SHINGLE:
            out.append(np.unique(grams[at : at + c - SHINGLE + 1]))
        elif c:
            out.append(mix64(np.array([int((words[at : at + c] * _ODD[:c]).sum()) ^ (c << 20)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each of BINS ranges, empty ranges filled by optimal densification."""
    bins = ((shingles >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
    full = bins[first]
    out = np.zeros(BINS, np.uint64)
    out[full] = shingles[first]
    if len(full) < BINS:
        empty = np.setdiff1d(np.arange(BINS), full, assume_unique=True)
        out[empty] = out[full[_RANK[np.ix_(empty, full)].argmin(1)]]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = (mix64(sig).reshape(BANDS, ROWS) * _ODD[:ROWS]).sum(1)
    return mix64(parts + np.arange(1, BANDS + 1, dtype=np.uint64) * _P)


SKETCH = "doc_id bigint, n_shingles bigint, cls binary, bands array<bigint>, lowest binary"


def sketch(docs: DataFrame) -> DataFrame:
    """By row: set size, a 128-bit name of the set, band keys, and its lowest hashes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(*utf8_buffer(batch.column(1)))
        names, bands, sigs = [], [], []
        for s in sets:
            if len(s):
                one, two = mix64(s ^ _ODD[1]), mix64(s ^ _ODD[2])
                names.append(np.array([one.sum(), two.sum()], np.uint64).tobytes())
                bands.append(band_keys(signature(s)).view(np.int64))
                sigs.append(np.sort((s >> np.uint64(32)).astype(np.uint32))[:KEPT].tobytes())
            else:
                names.append(None)
                bands.append(None)
                sigs.append(None)
        return pa.record_batch([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "cls", "bands", "lowest"])

    return map_batches(docs, run, SKETCH)


def full_sets(docs: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(*utf8_buffer(batch.column(1)))], pa.binary())], names=["id", "set"])

    return map_batches(docs, run, "id bigint, set binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) with 100 * intersection >= percent * union of their full sets.

    A centre's set goes once to each salt of its partners, of about 500 each."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 500).cast("int").alias("salts"))
    salted = pairs.join(salts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    centres = salts.join(sets, salts["a"] == sets["id"]).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("b"), "set")
    partners = salted.join(sets, salted["b"] == sets["id"]).select("a", "salt", F.lit(1).alias("kind"), "b", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centre = None, []
        for batch in batches:
            a, salt, kind, b, data = (c.to_pylist() for c in batch.columns)
            found: tuple[list, list] = ([], [])
            for i in range(len(a)):
                if (a[i], salt[i]) != key:
                    key, centre = (a[i], salt[i]), []
                own = np.frombuffer(data[i], np.uint64)
                if kind[i] == 0:
                    centre.append(own)
                    continue
                for c in centre:
                    small, large = (own, c) if len(own) <= len(c) else (c, own)
                    if not len(small) or 100 * len(small) < percent * len(large):
                        continue
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    both = int((large[at] == small).sum())
                    if 100 * both >= percent * (len(small) + len(large) - both):
                        found[0].append(a[i])
                        found[1].append(b[i])
                        break
            yield pa.record_batch([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], names=["a", "b"])

    together = centres.unionByName(partners).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")
    return together.mapInArrow(run, "a bigint, b bigint")


def shared_counts(sketches: list[np.ndarray]):
    """A function that gives, for a sketch, how many of its values each of ``sketches`` holds."""
    values = np.concatenate(sketches)
    owner = np.repeat(np.arange(len(sketches)), [len(x) for x in sketches])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]

    def count(one: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(values, one, side="left"), np.searchsorted(values, one, side="right")
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(owner[at], minlength=len(sketches))

    return count


def likely(one: np.ndarray, n: int, other: np.ndarray, m: int, shared: int) -> float:
    """Similarity of two sets by their lowest values: exact where both are held whole."""
    top = min(one[-1] if n > KEPT else np.iinfo(np.uint32).max, other[-1] if m > KEPT else np.iinfo(np.uint32).max)
    a, b = np.searchsorted(one, top, side="right"), np.searchsorted(other, top, side="right")
    return shared / max(1, a + b - shared)


def _alike(members: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b) in different components from blocks of (key, i, j, kind, id, n, component, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, outside = None, []
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            found: set[tuple[int, int]] = set()
            at = 0
            while at < len(rows):
                now = rows[at][:3]
                end = at
                while end < len(rows) and rows[end][:3] == now:
                    end += 1
                if now != key:
                    key, outside = now, []
                outside += [r for r in rows[at:end] if r[3] == 0]
                inside = [r for r in rows[at:end] if r[3] == 1]
                at = end
                if not outside or not inside:
                    continue
                ids, n, component = (np.array([r[k] for r in inside]) for k in (4, 5, 6))
                sketches = [np.frombuffer(r[7], np.uint32) for r in inside]
                count = shared_counts(sketches)
                for r in outside:
                    own = np.frombuffer(r[7], np.uint32)
                    shared = count(own)
                    possible = (component != r[6]) & (100 * np.minimum(n, r[5]) >= percent * np.maximum(n, r[5])) & (2 * shared >= min(len(own), KEPT) * 0.5)
                    for k in np.flatnonzero(possible):
                        exact = max(n[k], r[5]) <= KEPT
                        if likely(own, r[5], sketches[k], n[k], int(shared[k])) >= percent / 100 - (0.01 if exact else SLACK):
                            found.add((min(r[4], int(ids[k])), max(r[4], int(ids[k]))))
            if found:
                a, b = zip(*found, strict=True)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return members.mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(documents: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    docs = texts(documents)
    rows = materialize(sketch(docs), "sketch")
    classes = rows.where("n_shingles > 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("lowest").alias("lowest"))
    classes = materialize(classes, "classes")
    exploded = classes.select(F.explode("bands").alias("key"), "id", "n")
    sizes = exploded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = materialize(exploded.join(sizes, "key"), "members")
    # who meets most others is the likeliest original of its copies, and so the best centre
    degree = members.groupBy("id").agg(F.sum("size").alias("degree"))
    centres = members.join(degree, "id").groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("last"), "n")).alias("centre"))
    members = materialize(members.join(centres, "key").withColumn("c", -F.col("centre.last")), "members")
    fits = (F.col("id") != F.col("c")) & (100 * F.least("n", "centre.n") >= percent * F.greatest("n", "centre.n"))
    stars = members.where(fits).groupBy(F.col("c").alias("a"), F.col("id").alias("b")).agg(F.first("centre.degree").alias("degree"))
    wanted = members.select("id").distinct()
    sets = materialize(full_sets(docs.join(wanted.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").where("text is not null")), "sets")
    stars = materialize(stars, "stars")
    # each member with its best centre first; most other stars then join what is joined already
    best = stars.groupBy("b").agg(F.max(F.struct("degree", (-F.col("a")).alias("last"))).alias("top")).select((-F.col("top.last")).alias("a"), "b")
    links = materialize(confirmed(best, sets, percent), "confirmed")
    component = connected_components(links)
    links = links.unionByName(materialize(confirmed(_apart(stars, component), sets, percent), "confirmed"))
    component = materialize(connected_components(links), "component")
    # buckets that their stars leave in several components
    of_centre = component.select(F.col("id").alias("c"), F.col("component").alias("own"))
    placed = members.where("size > 2").join(component, "id", "left").join(of_centre, "c", "left")
    placed = placed.select("key", "id", "n", F.coalesce("component", "id").alias("component"), F.coalesce("own", "c").alias("own"))
    state = placed.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.count_if(F.col("component") != F.col("own")).alias("n_out"), F.min("component").alias("low"), F.max("component").alias("high"),
    ).where("low <> high").select("key", "size", "n_out")
    # kept as a table, so that Spark may split a large bucket in the join
    active = materialize(placed.join(state, "key").withColumn("outside", F.col("component") != F.col("own")), "active")
    active = active.join(classes.select("id", "lowest").groupBy("id").agg(F.first("lowest").alias("lowest")), "id")
    ri, aj = F.ceil(F.col("n_out") / BLOCK).cast("int"), F.ceil(F.col("size") / BLOCK).cast("int")
    body = ["id", "n", "component", "lowest"]
    part = lambda k: F.pmod(F.xxhash64("id"), k).cast("int")
    left = active.where("outside").select("key", part(ri).alias("i"), F.explode(F.sequence(F.lit(0), aj - 1)).alias("j"), F.lit(0).alias("kind"), *body)
    right = active.select("key", F.explode(F.sequence(F.lit(0), ri - 1)).alias("i"), part(aj).alias("j"), F.lit(1).alias("kind"), *body)
    blocks = left.unionByName(right).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "kind")
    more = materialize(_alike(blocks, percent).join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "alike")
    if not more.isEmpty():
        component = connected_components(links.unionByName(confirmed(more, sets, percent)))
    named = classes.select("cls", "id").join(component, "id", "left").select("cls", F.coalesce("component", "id").alias("component"))
    out = rows.select("doc_id", "n_shingles", "cls").join(named, "cls", "left")
    component_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component_id.alias("component_id"), F.coalesce(F.col("doc_id") == component_id, F.lit(True)).alias("kept"))


def _apart(pairs: DataFrame, component: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components so far."""
    of = lambda c: component.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}"))
    joined = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return joined.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
