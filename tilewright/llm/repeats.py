"""Removal of long byte strings that an earlier document already has.

A byte goes if it lies in a string of DEPTH bytes that also starts in a document with a
smaller id. Suffixes are ordered only DEPTH bytes deep, most significant digit first, and
groups of one document drop out after each pass; groups left after the last are exactly the
repeated windows.

The first digit is the window's anchor, the 16 bytes of smallest hash in it. All windows of
one anchor are neighbours, so one entry stands for up to 35 suffixes. Spark deals entries
out by anchor and sorts them; the second digit is a 64-bit name of the whole stretch of text
behind an entry: entries equal in both hold equal windows only, and all but those of the
smallest id are settled. Anchors that still have differing stretches in several documents
fetch their bytes, and digits of eight bytes decide window by window. Every stage streams
sorted rows, so a task holds one group of an anchor, never a bucket.

Anchors of which there may be very many entries (an exact upper bound is counted for all, in
a table of fixed size) are dealt out window by window instead, under a name of the window,
and settled twice: first salted by document, then, of each salt only the smallest id, whole.

Cases: null text counts as empty. Rows with a null id lose nothing and make nothing else
lose; rows that share an id do not remove one another's bytes, whether their texts are
equal or not. Ties need no rule: equal windows of one id are all kept or all go. Texts of any
length are read in overlapping parts of BLOCK bytes. Columns other than doc_id and text are
ignored by ``remove_repeats`` and passed on by ``without_repeats``, whatever their names. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bounded_batches, free_shuffles, materialize, mix64, split_batch, text_bytes, utf8_buffer

DEPTH, GRAM = 50, 16
REACH = DEPTH - GRAM + 1
BUCKET_BYTES = 4_000_000  # of text that a shuffle partition stands for
BLOCK = 1_000_000  # bytes of text looked at together
CHUNK_WINDOWS = 300_000
CELLS = 1 << 20  # of the table that bounds how many entries an anchor has
MANY = 1000  # entries of an anchor that are dealt out by window, or a quarter of a shuffle partition's if that is more
_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_powers: dict[str, np.ndarray] = {}

ENTRY, COMMON, SPAN, ASK = 0, 1, 2, 3
#: ``note`` packs start (32 bits), place of the anchor (6), windows (6), kind (2); of a SPAN, ``name`` is its end
ROWS = "key bigint, name bigint, doc bigint, tag int, note bigint"
_NAMES = [c.split()[0] for c in ROWS.split(", ")]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, p in (("up", _P), ("down", _INVERSE)):
            a = np.full(n, p, np.uint64)
            a[0] = 1
            _powers[name] = np.cumprod(a)
    return _powers["up"], _powers["down"]


class Suffixes:
    """The anchors of a batch's bytes, and names of any stretch of it."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets, n = raw, offsets, len(raw)
        up, self.down = _power(n + 1)
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[:n])])
        self.start = self.place = self.windows = np.zeros(0, np.int64)
        if n < DEPTH:
            return
        valid = np.zeros(n + 1, np.int32)
        has = np.flatnonzero(np.diff(offsets) >= DEPTH)
        np.add.at(valid, offsets[has], 1)
        np.add.at(valid, offsets[has + 1] - DEPTH + 1, -1)
        valid = np.flatnonzero(np.cumsum(valid)[: n - DEPTH + 1] > 0)
        m = n - GRAM + 1
        value = mix64((self.prefix[GRAM:] - self.prefix[:m]) * self.down[:m])  # of the 16 bytes from each place on
        self.gram = value
        at = np.arange(m, dtype=np.int32)
        for step in (1, 2, 4, 8, 16, REACH - 32):  # spans 2, 4, 8, 16, 32, then REACH; the leftmost of equals
            later = value[step:] < value[:-step]
            at = np.where(later, at[step:], at[:-step])
            value = np.minimum(value[step:], value[:-step])
        anchor = at[valid]
        if not len(anchor):
            return
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        self.start, self.windows = valid[first], np.diff(np.append(first, len(anchor)))
        self.place = anchor[first] - self.start

    def anchors(self) -> np.ndarray:
        return mix64(self.gram[self.start + self.place] ^ _P)

    def names(self, start: np.ndarray, size: np.ndarray, salt: int = 0) -> np.ndarray:
        end = start + size
        return mix64(((self.prefix[end] - self.prefix[start]) * self.down[start] ^ np.uint64(salt * int(_P) & (1 << 64) - 1)) + size.astype(np.uint64))

    def forget(self) -> None:
        """Let go of what only anchors and names need."""
        self.prefix = self.gram = self.down = None


def _note(start, place, windows, kind) -> np.ndarray:
    return np.asarray(start, np.int64) | np.asarray(place, np.int64) << 32 | np.asarray(windows, np.int64) << 38 | np.asarray(kind, np.int64) << 44


def _parts(note: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, place, windows, kind"""
    return note & 0xFFFFFFFF, note >> 32 & 63, note >> 38 & 63, note >> 44


def _kind() -> Column:
    return F.shiftright("note", 44)


def _batch(columns: list[np.ndarray]) -> pa.RecordBatch:
    types = (np.int64, np.int64, np.int64, np.int32, np.int64)
    return pa.record_batch([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(t, copy=False)) for c, t in zip(columns, types, strict=True)], names=_NAMES)


def _short(key: np.ndarray) -> np.ndarray:
    """44 bits of a hash deal rows out; names tell them apart."""
    return key >> np.uint64(20)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(ids, tags, bytes, offsets, first byte) of some rows of (doc_id, tag, text), or of a part of one long text.

    Parts overlap by DEPTH - 1 bytes, so each window starts in one of them."""
    for small in split_batch(batch, BLOCK):
        raw, offsets = utf8_buffer(small.column(2))
        ids, tags = (small.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if len(raw) <= 2 * BLOCK:
            yield ids, tags, raw, offsets, 0
            continue
        for i in range(len(ids)):
            low, high = int(offsets[i]), int(offsets[i + 1])
            for begin in range(low, max(low + 1, high - DEPTH + 1), BLOCK):
                end = min(begin + BLOCK + DEPTH - 1, high)
                yield ids[i : i + 1], tags[i : i + 1], raw[begin:end], np.array([0, end - begin]), begin - low


def _cell(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(44)).astype(np.int64)  # of CELLS


def _common_cells(docs: DataFrame, buckets: int) -> np.ndarray:
    """By cell of anchors: whether it has so many entries that one of its anchors may be common.

    Every task counts all its entries by cell and hands over CELLS counts; what reaches the
    driver are CELLS bits, whatever the corpus."""
    step = CELLS // 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for _ids, _tags, raw, offsets, _first in _blocks(batch):
                s = Suffixes(raw, offsets)
                if len(s.start):
                    total += np.bincount(_cell(s.anchors()), minlength=CELLS)
        if total.any():
            for i in range(64):
                own = total[i * step : (i + 1) * step]
                at = np.flatnonzero(own)
                yield pa.record_batch([pa.array([i], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([own[at].astype(np.uint32).tobytes()], pa.binary())], names=["part", "at", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, at, n in zip(*batch.columns, strict=True):
                sums.setdefault(part.as_py(), np.zeros(step, np.int64))[np.frombuffer(at.as_py(), np.uint16)] += np.frombuffer(n.as_py(), np.uint32)
        for part, n in sums.items():
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([n.sum()], pa.int64()), pa.array([n.tobytes()], pa.binary())], names=["part", "total", "n"])

    sums = materialize(docs.mapInArrow(count, "part int, at binary, n binary").repartition(64, "part").mapInArrow(add, "part int, total bigint, n binary"), "cells")
    total = sums.agg(F.sum("total")).first()[0] or 0
    least = max(MANY, total // (4 * buckets), 4 * total // CELLS)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [np.packbits(np.frombuffer(n.as_py(), np.int64) >= least).tobytes() for n in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(bits, pa.binary())], names=["part", "bits"])

    out = np.zeros(CELLS, bool)
    for r in sums.select("part", "n").mapInArrow(mark, "part int, bits binary").collect():
        out[r["part"] * step : (r["part"] + 1) * step] = np.unpackbits(np.frombuffer(r["bits"], np.uint8)).view(bool)
    return out


def _spread(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """ROWS of entries, common windows, and spans that a block of texts has settled alone."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, tags, raw, offsets, first in _blocks(batch):
                s = Suffixes(raw, offsets)
                if not len(s.start):
                    continue
                start, place, windows, key = s.start, s.place, s.windows, s.anchors()
                name = s.names(start, windows + DEPTH - 1, 1) + place.astype(np.uint64)
                kind = np.full(len(start), ENTRY)
                many = shared.value[_cell(key)]
                if many.any():  # one entry a window, by the window's own name and then its anchor
                    n, few = windows[many], ~many
                    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    own, anchor = np.repeat(start[many], n) + step, np.repeat(place[many], n) - step
                    names = mix64(np.repeat(key[many], n) + anchor.astype(np.uint64))
                    key = np.concatenate([key[few], s.names(own, np.full(len(own), DEPTH), 2)])
                    start, place = np.concatenate([start[few], own]), np.concatenate([place[few], np.zeros(len(own), np.int64)])
                    windows, name = np.concatenate([windows[few], np.ones(len(own), np.int64)]), np.concatenate([name[few], names])
                    kind = np.concatenate([kind[few], np.full(len(own), COMMON)])
                s.forget()
                row = np.searchsorted(offsets, start, side="right") - 1
                doc = ids[row]
                order = np.lexsort((doc, name, key))
                gone = np.zeros(len(order), bool)
                gone[order] = _later(key[order], name[order], doc[order])
                if gone.any():
                    of, begin, end = _union(raw, offsets, start[gone], start[gone] + windows[gone] + DEPTH - 1)
                    yield _spans(ids[of], tags[of], begin - offsets[of] + first, end - offsets[of] + first)
                keep = np.flatnonzero(~gone)
                yield _batch([_short(key[keep]), name[keep], doc[keep], tags[row[keep]], _note(start[keep] - offsets[row[keep]] + first, place[keep], windows[keep], kind[keep])])

    return docs.mapInArrow(run, ROWS)


def _later(key: np.ndarray, name: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of sorted rows: whether a smaller document has the same key and name."""
    new = np.append(True, (key[1:] != key[:-1]) | (name[1:] != name[:-1])) if len(key) else np.zeros(0, bool)
    return doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]


def _spans(doc: np.ndarray, tag: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    key = _short(mix64(doc.astype(np.int64).view(np.uint64)))  # deals them out
    return _batch([key, end.astype(np.int64), doc, tag, _note(begin, 0, 0, SPAN)])


def _union(raw, offsets, begin, end) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged spans of a batch, cut at document borders: (row, begin, end)."""
    depth = np.zeros(len(raw) + 1, np.int32)
    np.add.at(depth, begin, 1)
    np.add.at(depth, end, -1)
    inside = np.cumsum(depth)[:-1] > 0
    border = np.zeros(len(raw) + 1, bool)
    border[offsets] = True
    starts = np.flatnonzero(inside & (border[:-1] | np.append(True, ~inside[:-1])))
    ends = np.flatnonzero(inside & (border[1:] | np.append(~inside[1:], True))) + 1
    return np.searchsorted(offsets, starts, side="right") - 1, starts, ends


def equal_windows(key: np.ndarray, doc: np.ndarray, at: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit passes over the DEPTH bytes from ``at`` on: windows whose equals an earlier
    document has, as (index, smallest document). Groups of one document leave after each pass."""
    padded = np.append(text, np.zeros(8, np.uint8))
    digit = np.zeros(len(text), np.uint64)
    for i in range(8):
        digit |= padded[i : i + len(text)].astype(np.uint64) << np.uint64(56 - 8 * i)
    active, group = np.arange(len(at)), key
    low = np.zeros(0, np.int64)
    for depth in range(0, DEPTH, 8):
        d = digit[at[active] + depth]
        if depth + 8 > DEPTH:
            d = d >> np.uint64(8 * (depth + 8 - DEPTH))
        order = np.lexsort((d, group))
        active, d, group = active[order], d[order], group[order]
        if not len(active):
            break
        new = np.append(True, (group[1:] != group[:-1]) | (d[1:] != d[:-1]))
        first = np.flatnonzero(new)
        low, high = np.minimum.reduceat(doc[active], first), np.maximum.reduceat(doc[active], first)
        number = np.cumsum(new) - 1
        keep = (low < high)[number]
        active, group, low = active[keep], number[keep].astype(np.uint64), low[number[keep]]
    return active[doc[active] > low], low[doc[active] > low]


def _groups(batches: Iterator[pa.RecordBatch], size: Callable[[list], int], least: int) -> Iterator[tuple[list, bool]]:
    """Columns of sorted batches, some at a time, and whether they are the last; the consumer sends
    back what must be seen again with the next (the rows of an unfinished key)."""
    held, n, carried = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += size(batch)
        if n >= max(least, 2 * (carried.num_rows if carried is not None else 0)):
            carried = yield _joined(carried, held), False
            held, n = [], 0
    yield _joined(carried, held), True


def _joined(carried: pa.RecordBatch | None, held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
    parts = ([carried] if carried is not None else []) + held
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if parts and sum(p.num_rows for p in parts) else None


def _settle(rows: DataFrame, buckets: int, salts: int) -> DataFrame:
    """Entries of an equal key and name but not the smallest id become spans. What is left: entries of anchors with
    differing stretches in several documents ask for their bytes; common windows stay while ``salts`` deal them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, back = _groups(batches, lambda b: b.num_rows, 100_000), None
        while True:
            try:
                batch, last = stream.send(back)
            except StopIteration:
                return
            back = None
            if batch is None:
                continue
            key, name, doc, tag, note = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            start, place, windows, kind = _parts(note)
            done = kind == SPAN
            if done.any():
                yield batch.filter(pa.array(done))
                key, name, doc, tag, note, start, place, windows, kind = (c[~done] for c in (key, name, doc, tag, note, start, place, windows, kind))
            if not len(key):
                continue
            gone = _later(key, name, doc)
            if gone.any():
                yield _spans(doc[gone], tag[gone], start[gone], start[gone] + windows[gone] + (DEPTH - 1))
            left = ~gone
            key, name, doc, tag, note, kind = (c[left] for c in (key, name, doc, tag, note, kind))
            open_ = np.zeros(len(key), bool) if last else key == key[-1]
            if open_.any():
                back = _batch([c[open_] for c in (key, name, doc, tag, note)])
                key, name, doc, tag, note, kind = (c[~open_] for c in (key, name, doc, tag, note, kind))
            if not len(key):
                continue
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
            ask = (np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first))[group] & (kind == ENTRY)
            out = ask | (kind == COMMON) & (salts > 1)
            if out.any():
                note = np.where(ask, note | ASK << 44, note)
                yield _batch([c[out] for c in (key, name, doc, tag, note)])

    salted = F.xxhash64("key", F.pmod(F.xxhash64("doc"), F.lit(salts)))
    dealt = F.when(_kind() == COMMON, salted).otherwise(F.col("key")) if salts > 1 else F.col("key")
    return rows.repartition(buckets, dealt).sortWithinPartitions("key", "name", "doc").mapInArrow(run, ROWS)


def _beside(notes: DataFrame, texts: DataFrame, buckets: int) -> DataFrame:
    """Notes (key, name, note) and the text rows of their document, by document, notes first."""
    kind = F.lit(0).alias("is_text")
    notes = notes.select("doc", "tag", kind, "key", "name", "note", *(F.lit(None).cast(t).alias(c) for c, t in texts.dtypes[2:]))
    own = texts.select(F.col("doc_id").alias("doc"), "tag", F.lit(1).alias("is_text"), *(F.lit(None).cast("bigint").alias(c) for c in ("key", "name", "note")), *texts.columns[2:])
    return notes.unionByName(own).repartition(buckets, "doc", "tag").sortWithinPartitions("doc", "tag", "is_text")


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray], pa.RecordBatch, np.ndarray]]:
    """From the rows of ``_beside``: (documents of notes, [tag, key, name, note], text rows, the group each text row belongs
    to), where note i belongs to group of(i), its last column. Notes wait for texts, so a long document's are held once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        is_text = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        if not is_text.any():
            held.append(batch.select(range(6)))
            continue
        notes = pa.Table.from_batches([*held, batch.filter(pa.array(~is_text)).select(range(6))]).combine_chunks()
        rows = batch.filter(pa.array(is_text))
        doc, tag, key, name, note = (notes.column(i).to_numpy() for i in (0, 1, 3, 4, 5))
        text_doc, text_tag = (rows.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        new = np.append(True, (text_doc[1:] != text_doc[:-1]) | (text_tag[1:] != text_tag[:-1]))
        group, first = np.cumsum(new) - 1, np.flatnonzero(new)
        # notes and texts are in one order, so a note's group is found by rank
        have = _pairs(text_doc[first], text_tag[first])
        want = _pairs(doc, tag)
        at = np.minimum(np.searchsorted(have, want), len(have) - 1)
        of = np.where(have[at] == want, at, -1)
        yield doc, [tag, key, name, note, of], rows, group
        later = (doc > text_doc[-1]) | (doc == text_doc[-1]) & (tag >= text_tag[-1])  # repeated rows, or the next text, may follow
        rest = notes.filter(pa.array(later))
        held = rest.to_batches() if rest.num_rows else []


def _pairs(doc: np.ndarray, tag: np.ndarray) -> np.ndarray:
    out = np.empty(len(doc), [("d", "<i8"), ("t", "<i4")])
    out["d"], out["t"] = doc, tag
    return out


def _gathered(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    return raw[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())]


BYTES = "key bigint, doc bigint, tag int, note bigint, bytes binary"


def _with_bytes(asked: DataFrame, texts: DataFrame, buckets: int) -> DataFrame:
    """Entries with the bytes of their stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, (tag, key, _name, note, of), rows, group in _meetings(batches):
            raw, offsets = utf8_buffer(rows.column(6))
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            met = np.flatnonzero(of >= 0)
            for i in range(0, len(met), 20_000):
                own = met[i : i + 20_000]
                start, _place, windows, _ = _parts(note[own])
                size = windows + DEPTH - 1
                data = _gathered(raw, offsets[first[of[own]]] + start, size)
                ends = np.append(0, np.cumsum(size)).astype(np.int32)
                strings = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends), pa.py_buffer(data)])
                yield pa.record_batch([pa.array(key[own]), pa.array(doc[own]), pa.array(tag[own]), pa.array(note[own]), strings], names=["key", "doc", "tag", "note", "bytes"])

    return _beside(asked, texts, buckets).mapInArrow(run, BYTES)


def _compare(rows: DataFrame, buckets: int) -> DataFrame:
    """Spans of the windows that a smaller document has under the same anchor, by their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, back = _groups(batches, lambda b: 18 * b.num_rows, CHUNK_WINDOWS), None
        while True:
            try:
                batch, last = stream.send(back)
            except StopIteration:
                return
            back = None
            if batch is None:
                continue
            key = batch.column(0).to_numpy(zero_copy_only=False)
            if not last:
                whole = int(np.searchsorted(key, key[-1], side="left"))
                back, batch, key = pa.concat_batches([batch.slice(whole)]), batch.slice(0, whole), key[:whole]
            if not len(key):
                continue
            doc, tag, note = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            start, place, windows, _kind_ = _parts(note)
            text, offsets = utf8_buffer(batch.column(4))
            number = np.cumsum(np.append(True, key[1:] != key[:-1]))
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for entry, step in _windows(place, windows):
                group = (number[entry] * 64 + place[entry] - step).astype(np.uint64)  # equal windows have their anchor at one place
                gone, _lowest = equal_windows(group, doc[entry], offsets[entry] + step, text)
                found.append((entry[gone], start[entry[gone]] + step[gone]))
            own, s = (np.concatenate(c) for c in zip(*found, strict=True))
            if len(own):
                order = np.lexsort((s, own))
                own, s = own[order], s[order]
                first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (s[1:] != s[:-1] + 1)))  # runs of windows are one span
                yield _spans(doc[own[first]], tag[own[first]], s[first], s[np.append(first[1:], len(s)) - 1] + DEPTH)

    return rows.repartition(buckets, "key").sortWithinPartitions("key").mapInArrow(run, ROWS)


def _windows(place: np.ndarray, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(entry, step) of all windows of entries; of very many, those that have their anchor at one place at a time."""
    if windows.sum() <= 4 * CHUNK_WINDOWS:
        entry = np.repeat(np.arange(len(windows)), windows)
        yield entry, np.arange(len(entry)) - np.repeat(np.cumsum(windows) - windows, windows)
        return
    for at in range(REACH):
        entry = np.flatnonzero((place >= at) & (place - at < windows))
        yield entry, place[entry] - at


Render = Callable[[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch | None]


def _apply(documents: DataFrame, render: Render, schema) -> DataFrame:
    """Find all repeated windows and hand rows of (doc_id, tag, text, any others) with their removed bytes to ``render``."""
    spark = documents.sparkSession
    bounded_batches(spark)
    own = documents.withColumn("text", F.coalesce("text", F.lit("")))
    named = own.where("doc_id is not null")
    _, total = text_bytes(named)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    # tags tell rows apart that share an id
    repeated = not named.groupBy("doc_id").count().where("count > 1").isEmpty()
    tag = F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int") if repeated else F.lit(0)
    rest = [c for c in documents.columns if c not in ("doc_id", "text")]
    named = named.select("doc_id", tag.alias("tag"), "text", *rest)
    texts = named.select("doc_id", "tag", "text")
    long = texts.where(F.octet_length("text") >= DEPTH)
    salts = max(8, min(4096, math.isqrt(total // BLOCK)))
    settled = materialize(_settle(_spread(long, _common_cells(long, buckets)), buckets, salts), "settled")
    free_shuffles(spark)
    once = long.dropDuplicates(["doc_id", "tag"]) if repeated else long
    compared = materialize(_compare(_with_bytes(settled.where(_kind() == ASK), once, buckets), buckets), "spans")
    free_shuffles(spark)
    common = _settle(settled.where(_kind() == COMMON), buckets, 1)
    spans = settled.where(_kind() == SPAN).unionByName(compared).unionByName(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _doc, (_tag, _key, end, note, of), rows, group in _meetings(batches):
            rows = rows.select([0, 1, *range(6, rows.num_columns)])
            met = np.flatnonzero(of >= 0)
            order = met[np.argsort(of[met], kind="stable")]
            cuts = np.searchsorted(of[order], np.arange(group[-1] + 2))
            at = 0
            for small in split_batch(rows, 4 * BLOCK):
                raw, offsets = utf8_buffer(small.column(2))
                depth = np.zeros(len(raw) + 1, np.int32)
                g = group[at : at + small.num_rows]
                n = cuts[g + 1] - cuts[g]
                span = order[np.repeat(cuts[g] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                base = np.repeat(offsets[:-1], n)
                np.add.at(depth, base + (note[span] & 0xFFFFFFFF), 1)
                np.add.at(depth, base + end[span], -1)
                at += small.num_rows
                out = render(small, raw, offsets, np.cumsum(depth)[:-1] > 0)
                if out is not None:
                    yield out

    def unnamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for small in split_batch(batch, 4 * BLOCK):
                raw, offsets = utf8_buffer(small.column(2))
                out = render(small, raw, offsets, np.zeros(len(raw), bool))
                if out is not None:
                    yield out

    nameless = own.where("doc_id is null").select("doc_id", F.lit(0).alias("tag"), "text", *rest)
    return _beside(spans, named, buckets).mapInArrow(run, schema).unionByName(nameless.mapInArrow(unnamed, schema))


DIGEST = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _digests(rows: pa.RecordBatch, raw: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
    border = np.zeros(len(raw) + 1, bool)
    border[offsets] = True
    runs = np.flatnonzero(gone & (border[:-1] | np.append(True, ~gone[:-1]))) if len(raw) else np.zeros(0, np.int64)
    kept = raw[~gone].tobytes()
    ends = np.concatenate([[0], np.cumsum(~gone)])[offsets]
    size = np.diff(offsets)
    digests = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    columns = [rows.column(0), pa.array(size), pa.array(size - np.diff(ends)), pa.array(np.diff(np.searchsorted(runs, offsets))), pa.array(digests, pa.string())]
    return pa.record_batch(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _apply(docs, _digests, DIGEST)


def whole_characters(raw: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """``gone`` without the characters it takes only part of."""
    if not len(raw):
        return gone
    first = (raw & 0xC0) != 0x80
    number = np.cumsum(first) - 1
    size, taken = np.bincount(number), np.bincount(number, gone)
    return (taken == size)[number]


def without_repeats(documents: DataFrame) -> DataFrame:
    """The documents with their repeated bytes removed, whole characters only, and n_chars set anew
    where the table has it; texts of which nothing is left are dropped, texts empty before are not."""
    columns = documents.columns
    others = [c for c in columns if c not in ("doc_id", "text", "n_chars")]
    counted = "n_chars" in columns
    others_of = F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)))
    rest = F.struct(F.col("text").isNull().alias("was_null"), *([F.col("n_chars")] if counted else []), others_of.alias("others"))
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", rest.alias("rest"))
    schema = docs.select("doc_id", "text", *([F.col("rest.n_chars").cast("bigint").alias("n_chars")] if counted else []), F.col("rest.others").alias("others")).schema
    arrow = to_arrow_schema(schema)

    def render(rows: pa.RecordBatch, raw: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> pa.RecordBatch | None:
        gone = whole_characters(raw, gone)
        stays = ~gone
        ends = np.concatenate([[0], np.cumsum(stays)])[offsets]
        size, left = np.diff(offsets), np.diff(ends)
        keep = pa.array((left > 0) | (size == 0))
        field = lambda name: pc.struct_field(rows.column(3), name)
        was_null = field("was_null").to_numpy(zero_copy_only=False).astype(bool)
        valid = pa.py_buffer(np.packbits(~was_null, bitorder="little"))
        text = pa.Array.from_buffers(pa.large_string(), len(size), [valid, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw[stays]))])
        out = [rows.column(0), text.cast(arrow.field("text").type)]
        if counted:
            characters = np.diff(np.concatenate([[0], np.cumsum(stays & ((raw & 0xC0) != 0x80))])[offsets])
            out.append(pc.if_else(pa.array(left < size), pa.array(characters, pa.int64()), field("n_chars").cast(pa.int64())))
        out.append(field("others"))
        return pa.record_batch(out, names=arrow.names).filter(keep)

    done = _apply(docs, render, schema)
    return done.select(*(F.col(c) if c in ("doc_id", "text") else F.col(c).cast(documents.schema[c].dataType) if c == "n_chars" else F.col("others")[f"c{others.index(c)}"].alias(c) for c in columns))
