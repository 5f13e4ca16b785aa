"""Best-fit-decreasing packing of token sequences.

Best fit decreasing sees only lengths, and there are at most ``budget`` of them. So the
lengths of all pieces are counted, the counts are packed exactly (bins alike are kept as
one group; a segment tree over remaining capacities finds the tightest open one in
logarithmic time), and each piece then looks up its place from its rank among pieces of
its length. What the driver holds is bounded by the budget, not by the corpus.

Cases: null text counts as empty, so a document of one token, the closing id. Null ids
are kept as rows. Repeated rows are packed each. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_symbols, materialize, split_batch, texts

#: How byte-level vocabularies cut a text before they merge (fixed by the vocabulary).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DOUBLE = re.compile(r"\s\s")
BLANKS = re.compile(r"\s{2,}")
LONGEST_BLANK = 200_000  # white spaces in a row; the look-ahead overflows tiktoken's stack at about a million
END = np.uint32(2).tobytes()


class CapacityTree:
    """A segment tree over capacities 0..size: how many groups of open bins have each."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.count = [0] * (2 * self.base)

    def add(self, capacity: int, n: int) -> None:
        at = self.base + capacity
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of at least ``need`` that an open group has."""
        at = self.base + need
        if self.count[at]:
            return need
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.base:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.base
            at >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], budget: int) -> tuple[np.ndarray, int]:
    """Place ``counts[length]`` items of each length. Rows of the plan: length, first rank,
    first bin, items a bin, offset of a bin's first; ranks run on from row to row."""
    tree, groups = CapacityTree(budget), [deque() for _ in range(budget + 1)]
    bins, plan = 0, []

    def put(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            groups[capacity].append((first, n))
            tree.add(capacity, 1)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                n = -(-left // (budget // length))
                put(budget, bins, n)
                bins += n
                continue
            first, n = groups[capacity].popleft()
            tree.add(capacity, -1)
            each = capacity // length
            full, rest = divmod(left, each)
            used = min(n, full)
            if used:
                plan.append((length, rank, first, each, budget - capacity))
                put(capacity - each * length, first, used)
                rank, left = rank + used * each, left - used * each
            if used < n and left and left < each:
                plan.append((length, rank, first + used, rest, budget - capacity))
                put(capacity - rest * length, first + used, 1)
                rank, left, used = rank + left, 0, used + 1
            put(capacity, first + used, n - used)
    return np.array(plan, np.int64).reshape(-1, 5), bins


def _long_blank(text: str) -> bool:
    return len(text) > LONGEST_BLANK and any(m.end() - m.start() > LONGEST_BLANK for m in BLANKS.finditer(text))


class TextEncoder:
    """Token ids of texts as little-endian uint32 bytes.

    The ids are those of ``tokenizers`` for the same file. Where the file's merges come in the
    order of their ids, ``tiktoken`` over the file's own vocabulary gives the same ids several
    times faster; texts that spell out a special token, or hold a very long run of white space,
    go to ``tokenizers`` itself."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        with open(tokenizer_file, encoding="utf-8") as f:
            data = json.load(f)
        vocab = data["model"]["vocab"]
        self.special = [t["content"] for t in data.get("added_tokens", [])]
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in data["model"].get("merges", [])]
        self.fast = None
        before = data.get("pre_tokenizer") or {}
        # PATTERN is how such a pre-tokenizer cuts; other files go to ``tokenizers`` itself
        cut_alike = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        if merged == sorted(merged) and not data.get("normalizer") and cut_alike:
            import tiktoken

            symbols = byte_symbols()
            ranks = {bytes(symbols[c] for c in t): i for t, i in vocab.items() if t not in self.special}
            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            # without two white spaces in a row the look-ahead never matters, and plain patterns run faster
            self.plain = tiktoken.Encoding("plain", pat_str=PATTERN.replace(r"|\s+(?!\S)", ""), mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.fast and not any(t in text for t in self.special) and not _long_blank(text):
            ids = array("I", (self.fast if DOUBLE.search(text) else self.plain).encode_ordinary(text))
            if sys.byteorder != "little":
                ids.byteswap()
            return ids.tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_encoders: dict[str, TextEncoder] = {}  # of this Python worker


def encoder_of(tokenizer_file: str) -> TextEncoder:
    if tokenizer_file not in _encoders:
        _encoders[tokenizer_file] = TextEncoder(tokenizer_file)
    return _encoders[tokenizer_file]


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint"


def tokenized_pieces(docs: DataFrame, tokenizer_file: str, budget: int) -> DataFrame:
    """The pieces of each document, with their rank among pieces of that length in their part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, seen, encoder = TaskContext.get().partitionId(), np.zeros(budget + 1, np.int64), encoder_of(tokenizer_file)
        for batch in batches:
            for small in split_batch(batch):
                rows: list[tuple] = []
                for doc, ids in zip(small.column(0).to_pylist(), map(encoder.encode, small.column(1).to_pylist()), strict=True):
                    view = memoryview(ids + END)
                    n, at, piece = len(view) // 4, 0, 0
                    while at < n:
                        length = (n % budget or budget) if at == 0 and n > budget else min(budget, n)
                        rows.append((doc, piece, at, length, zlib.crc32(view[4 * at : 4 * (at + length)]), seen[length]))
                        seen[length] += 1
                        at, piece = at + length, piece + 1
                doc, piece, start, length, crc, rank = zip(*rows, strict=True)
                yield pa.record_batch(
                    [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array(rank, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"],
                )

    return docs.mapInArrow(run, PIECES)


def place(pieces: DataFrame, budget: int) -> DataFrame:
    """Add sequence_id and offset to pieces that carry length, part and rank in their part."""
    by_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {int(r["length"]): int(r["n"]) for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``budget`` rows
    plan, _ = best_fit_decreasing(counts, budget)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((plan[:, 1], plan[:, 0]))
        table = plan[order]
        keys = table[:, 0] << 48 | table[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            row = table[np.searchsorted(keys, length << 48 | rank, side="right") - 1]
            i = rank - row[:, 1]
            yield pa.record_batch([*batch.columns[:5], pa.array(row[:, 2] + i // row[:, 3]), pa.array(row[:, 4] + i % row[:, 3] * length)], names=names)

    return ranked.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def pack(documents: DataFrame, tokenizer_file: str, budget: int = 1024) -> DataFrame:
    """Tokenize, cut what is longer than ``budget``, and pack all pieces into sequences of at most ``budget`` tokens."""
    pieces = materialize(tokenized_pieces(texts(documents), tokenizer_file, budget), "pieces")
    return place(pieces, budget)
