"""Token counts by a linear longest-match automaton.

The vocabulary's trie gets failure links and, for each node, how many tokens are complete
when matching fails there. One left-to-right walk over a chunk's bytes then gives the number
of greedy longest-match pieces without building any. Chunks (white space and what follows)
repeat, so each distinct one is walked once while it is cached.

Cases: null and empty texts have 0 tokens; long texts are read in parts that end where a chunk does.
Other columns are ignored. Rows with null ids and repeated rows are counted
each; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Cache, byte_symbols, map_batches, pieces, texts


SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space and what follows it: no token of a byte-level vocabulary goes on into the next white space.
BORDER = re.compile(f"[^{SPACE}](?=[{SPACE}])")
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


def vocabulary(path: str) -> list[bytes]:
    """The byte strings of a byte-level tokenizer file, special tokens left out."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    special = {t["content"] for t in data.get("added_tokens", [])}
    symbols = byte_symbols()
    return [bytes(symbols[c] for c in t) for t in data["model"]["vocab"] if t not in special]


def check_chunks(vocabulary: list[bytes]) -> None:
    """Chunks end before white space, so no token may run from text into it; other vocabularies need other chunks."""
    wide = re.compile(f"[^{SPACE}][{SPACE}]")
    bad = [t for t in vocabulary if wide.search(t.decode("utf-8", "ignore"))]
    if bad:
        raise ValueError(f"tokens run on into white space, so chunks would cut them: {bad[:3]}")


class LongestMatch:
    """Greedy longest-match piece counts in one pass. The vocabulary must hold all single bytes."""

    def __init__(self, vocabulary: list[bytes]):
        step: dict[int, int] = {}
        final, parents = [False], [(0, 0)]
        for token in vocabulary:
            at = 0
            for b in token:
                key = at << 8 | b
                if key not in step:
                    step[key] = len(final)
                    final.append(False)
                    parents.append((at, b))
                at = step[key]
            final[at] = at != 0
        if any(b not in step or not final[step[b]] for b in range(256)):
            raise ValueError("the vocabulary lacks a single byte, so some texts have no pieces")
        n = len(final)
        children: list[list[int]] = [[] for _ in range(n)]
        for v in range(1, n):
            children[parents[v][0]].append(v)
        fail, popped = [-1] * n, [0] * n
        queue = deque(children[0])
        while queue:
            v = queue.popleft()
            queue.extend(children[v])
            u, b = parents[v]
            if final[v]:
                fail[v], popped[v] = 0, 1
                continue
            z, count = fail[u], popped[u]
            while z >= 0 and (z << 8 | b) not in step:
                count += popped[z]
                z = fail[z]
            if z >= 0:
                fail[v], popped[v] = step[z << 8 | b], count
        self.step, self.fail, self.popped = step, fail, popped

    def count(self, text: bytes) -> int:
        step, fail, popped = self.step, self.fail, self.popped
        at = total = 0
        for b in text:
            while (to := step.get(at << 8 | b)) is None:
                total += popped[at]
                at = fail[at]
            at = to
        while at:
            total += popped[at]
            at = fail[at]
        return total


def _parts(text: str) -> Iterator[str]:
    """A long text in parts that end before white space, where chunks begin."""
    return pieces(text, BORDER)


_automata: dict[str, tuple[LongestMatch, Cache]] = {}  # of this Python worker


def count_tokens(documents: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens: greedy longest-match pieces of each chunk of each whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if tokenizer_file not in _automata:
            tokens_of = vocabulary(tokenizer_file)
            check_chunks(tokens_of)
            _automata[tokenizer_file] = LongestMatch(tokens_of), Cache()
        automaton, counts = _automata[tokenizer_file]
        rows = batch.column(1).to_pylist()
        tokens = []
        for t in rows:
            total = 0
            for part in _parts(t) if t else ():
                for chunk in CHUNK.findall(part):
                    n = counts.get(chunk)
                    if n is None:
                        n = automaton.count(chunk.encode())
                        if len(chunk) <= 200:
                            counts.make_room(1)
                            counts[chunk] = n
                    total += n
            tokens.append(total)
        return pa.record_batch([batch.column(0), pa.array([len(t.encode()) if t else 0 for t in rows], pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return map_batches(texts(documents), run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
