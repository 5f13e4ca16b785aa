"""Approximate nearest neighbours by additive quantisation.

Codebooks span all dimensions. They are fitted on a bounded sample by residual k-means, and
every vector is encoded by beam search over them. A query scores an index block by tables of
its inner products with the codewords; the best of a block are scored again exactly on the
original vectors, and the best of all blocks are the answer. Stored norms turn the same
tables into Euclidean distances for callers that ask for those (``measure="euclidean"``).

Cases: null or (for inner products) zero vectors, and those with a null or non-finite component or another
dimension than the most common one, take no part. Ties go to the smaller id. Repeated ids
are separate candidates, but a query never finds its own id. An empty table, or one without
queries, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 8192
BLOCK_ROWS = 8192
QUERY_ROWS = 256


def fit_codebooks(sample: np.ndarray, books: int = 16, size: int = 64, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """books x size x dimension codewords: k-means on what the books before leave over."""
    rng, left, out = np.random.default_rng(seed), sample.astype(np.float64), []
    for _ in range(books):
        words = left[rng.choice(len(left), size, replace=len(left) < size)].copy()
        for _ in range(rounds):
            near = ((words**2).sum(1) - 2 * left @ words.T).argmin(1)
            sums = np.zeros_like(words)
            np.add.at(sums, near, left)
            n = np.bincount(near, minlength=size)
            words[n > 0] = sums[n > 0] / n[n > 0][:, None]
        near = ((words**2).sum(1) - 2 * left @ words.T).argmin(1)
        left = left - words[near]
        out.append(words)
    return np.stack(out)


def encode(vectors: np.ndarray, codebooks: np.ndarray, beam: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Beam-search codes, and the squared norms of what they stand for."""
    n, (books, size, d) = len(vectors), codebooks.shape
    codes = np.zeros((n, 1, books), np.uint16)
    approx = np.zeros((n, 1, d))
    for b in range(books):
        words = codebooks[b]
        left = vectors[:, None, :] - approx
        cost = (left**2).sum(2)[:, :, None] - 2 * left @ words.T + (words**2).sum(1)
        keep = min(beam, cost.shape[1] * size)
        flat = cost.reshape(n, -1)
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(flat.shape[1]), (n, 1))
        parent, word = best // size, best % size
        rows = np.arange(n)[:, None]
        codes = codes[rows, parent].copy()
        codes[:, :, b] = word
        approx = approx[rows, parent] + words[word]
    error = ((vectors[:, None, :] - approx) ** 2).sum(2)
    best = error.argmin(1)
    rows = np.arange(n)
    return codes[rows, best], (approx[rows, best] ** 2).sum(1)


def table_scores(queries: np.ndarray, codes: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    """Inner products of queries with what the codes stand for, by lookup."""
    tables = np.einsum("qd,bsd->bqs", queries, codebooks).astype(np.float32)
    score = np.zeros((len(queries), len(codes)), np.float32)
    for b in range(len(codebooks)):
        score += np.take(tables[b], codes[:, b], axis=1)
    return score


def _usable(embeddings: DataFrame, id_column: str, column: str, zeros: bool = False) -> tuple[DataFrame, int]:
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    own = embeddings.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    own = own.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & (F.size(v) > 0 if zeros else F.exists(v, lambda x: x != 0)))
    sizes = own.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = int(sizes["d"]) if sizes else 0
    return own.where(F.size("v") == d), d


def _packed(df: DataFrame, d: int, block_rows: int) -> DataFrame:
    """Rows of (ids, vectors): up to ``block_rows`` vectors each, as raw bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d) if len(ids) else np.zeros((0, d))
            for i in range(0, len(ids), block_rows):
                yield pa.record_batch([pa.array([ids[i : i + block_rows].tobytes()], pa.binary()), pa.array([flat[i : i + block_rows].astype(np.float64).tobytes()], pa.binary())], names=["ids", "vectors"])

    return df.mapInArrow(run, "ids binary, vectors binary")


def search(embeddings: DataFrame, every: int = 20, k: int = 20, rerank: int = 400, id_column: str = "vec_id", column: str = "embedding", sample: int = SAMPLE, measure: str = "inner") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found for each row whose id is divisible by ``every``.

    ``sample`` bounds the rows the codebooks are fitted on (lowest id hashes); every row is
    indexed. ``rerank`` candidates of each index block are scored exactly. With ``measure``
    "euclidean" the k nearest are found, and score is minus their distance."""
    if measure not in ("inner", "euclidean"):
        raise ValueError(f"no such measure: {measure}")
    spark, euclidean = embeddings.sparkSession, measure == "euclidean"
    usable, d = _usable(embeddings, id_column, column, zeros=euclidean)
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if not d:
        return empty
    n = usable.count()
    groups = -(-n // BLOCK_ROWS)
    unit = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = usable.where(unit < 1.2 * sample / n).orderBy(unit, "vec_id").limit(sample).collect()
    codebooks = fit_codebooks(np.array([r["v"] for r in some]))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                small = batch.slice(i, 4096)
                ids = small.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                vectors = small.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                group = small.column(2).to_numpy(zero_copy_only=False)
                codes, norms = encode(vectors, codebooks)
                for g in np.unique(group):
                    at = group == g
                    yield pa.record_batch(
                        [pa.array([int(g)], pa.int32()), pa.array([b"i"], pa.binary()), *(pa.array([x[at].tobytes()], pa.binary()) for x in (ids, vectors, codes, norms))],
                        names=["g", "kind", "ids", "vectors", "codes", "norms"],
                    )

    schema = "g int, kind binary, ids binary, vectors binary, codes binary, norms binary"
    indexed = usable.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")).mapInArrow(index, schema)
    # each block of the stated query set meets each block of the index once
    queries = _packed(usable.where(F.col("vec_id") % every == 0).repartition(max(1, -(-n // every // 4096))), d, 4096)
    to_all = queries.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(b"q").alias("kind"), "ids", "vectors", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("binary").alias("norms"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, block = None, [], None
        for batch in batches:
            for r in batch.to_pylist():  # a group's index rows come first, then its query blocks one by one
                if r["g"] != current:
                    current, parts, block = r["g"], [], None
                if r["kind"] == b"i":
                    parts.append((np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"]).reshape(-1, d), np.frombuffer(r["codes"], np.uint16).reshape(-1, len(codebooks)), np.frombuffer(r["norms"])))
                    continue
                if not parts:
                    continue
                if block is None:
                    order = np.argsort(np.concatenate([x[0] for x in parts]), kind="stable")
                    block = [np.concatenate(x)[order] for x in zip(*parts, strict=True)]
                query_ids, queries = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"]).reshape(-1, d)
                for i in range(0, len(query_ids), QUERY_ROWS):
                    yield _best(query_ids[i : i + QUERY_ROWS], queries[i : i + QUERY_ROWS], *block, codebooks, k, rerank, euclidean)

    met = indexed.unionByName(to_all).repartition(groups, "g").sortWithinPartitions("g", "kind")
    found = met.mapInArrow(meet, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return first.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _best(query_ids, queries, ids, vectors, codes, norms, codebooks, k: int, rerank: int, euclidean: bool) -> pa.RecordBatch:
    """Of one index block, in id order: the k best of the ``rerank`` best by tables, scored exactly."""
    rough = table_scores(queries, codes, codebooks)
    if euclidean:  # minus the squared distance, but for the query's own norm
        rough = 2 * rough - norms.astype(np.float32)
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    m = min(rerank, len(ids))
    out: tuple[list, list, list] = ([], [], [])
    for row in range(len(query_ids)):
        s = rough[row]
        if m < len(ids):
            cut = np.partition(s, len(ids) - m)[len(ids) - m]
            above = np.flatnonzero(s > cut)
            near = np.sort(np.concatenate([above, np.flatnonzero(s == cut)[: m - len(above)]]))  # equal codes: smaller ids
        else:
            near = np.arange(len(ids))
        near = near[ids[near] != query_ids[row]]
        if euclidean:
            exact = -np.sqrt(((vectors[near] - queries[row]) ** 2).sum(1))
        else:
            exact = np.zeros(len(near))
            for d in range(vectors.shape[1]):  # component by component: one order of adding up, whatever the block
                exact += vectors[near, d] * queries[row, d]
        top = np.lexsort((ids[near], -exact))[:k]
        out[0].append(np.full(len(top), query_ids[row]))
        out[1].append(ids[near][top])
        out[2].append(exact[top])
    return pa.record_batch([pa.array(np.concatenate(x)) for x in out], names=["query_id", "vec_id", "score"])
