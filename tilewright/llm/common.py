"""Shared plumbing: scratch tables in the shared folder, folds, Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where that is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(path)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return path


_scratch: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, removed by release() or when the driver's Python ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    _scratch.append((spark, folder))
    return f"{folder}/{name}"


def release() -> None:
    """Remove all scratch folders of this driver; what was read from them lazily is gone after."""
    while _scratch:
        spark, folder = _scratch.pop()
        with contextlib.suppress(Exception):  # the session may have ended before
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


atexit.register(release)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cut lineage that outlives executors."""
    path = scratch_path(df.sparkSession, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """Let Arrow batches to Python workers hold about ``size`` bytes, unless the session sets a size of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "64m") in ("64m", "67108864b", "67108864"):
        spark.conf.set(key, size)


def free_shuffles(spark: SparkSession) -> None:
    """Ask the driver to collect its garbage, so that Spark removes the shuffle files of finished tables.

    The driver holds on to the last query it has run, so an empty one is run first."""
    spark.range(1).write.format("noop").mode("overwrite").save()
    gc.collect()
    spark._jvm.System.gc()


def remainder(column: str, k: int) -> Column:
    """crc32 of an id written as text, modulo k (null for a null id)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % k


def texts(docs: DataFrame) -> DataFrame:
    """Only doc_id (bigint) and text (string) of a documents table, whatever else it carries."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def text_bytes(docs: DataFrame) -> tuple[int, int]:
    """Rows and total UTF-8 bytes of the text column: one pass, two numbers."""
    row = docs.select(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    return int(row["n"]), int(row["b"])


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow over small batches; ``fn`` turns one record batch into one."""

    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for small in split_batch(batch):
                out = fn(small)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def split_batch(batch: pa.RecordBatch, target: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of about ``target`` bytes each, at least a row."""
    n = batch.num_rows
    if n == 0:
        return
    step = max(1, int(n * target / max(1, batch.nbytes)))
    for i in range(0, n, step):
        yield batch.slice(i, step)


def pieces(text: str, breaks: re.Pattern, size: int = 500_000) -> Iterator[str]:
    """Consecutive parts of a text, of about ``size`` characters, each but the last ending with a match of ``breaks``,
    so that a long text's words are never all in memory at once."""
    at = 0
    while len(text) - at > 2 * size:
        found = breaks.search(text, at + size)
        if not found:
            break
        end = found.end()
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The concatenated bytes of a string or binary column and its n+1 offsets (null: empty)."""
    column = column.cast(pa.large_binary())
    column = column.fill_null(b"") if column.null_count else column
    column = pa.concat_arrays([column])  # drops a slice's unused bytes
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    base = int(offsets[0])
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8, int(offsets[-1]) - base, base) if data is not None else np.empty(0, np.uint8)
    return raw, offsets - base


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift, multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Cache(dict):
    """A bounded memo: cleared when it would pass ``limit`` entries, so memory stays flat."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def make_room(self, n: int) -> None:
        if len(self) + n > self.limit:
            self.clear()


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
