"""Deterministic sharded WARC files: write from a table of pages, read back as a table.

Records are cut into shards at id boundaries taken from an exact histogram of bytes, sorted
by id, and rolled into files by compressed size. Each task writes under temporary names of
its own attempt; only what the winning attempts report is renamed and entered in the
manifest. The same table gives the same bytes in the same files.

A revisit names its response by page id, record id and target, so any reader can resolve it.

Cases: null html is an empty payload, a null url becomes ``urn:page:<id>``; pages with null
ids are written first and read back with null. Rows that share both id and payload are all
responses if theirs is the smallest id; rows of an id go by url, then payload. Long payloads are
records like any other, held one at a time by writer and reader. Other columns are ignored,
whatever their names. An empty table gives no files and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, scratch_path

SHARD_BYTES = 32_000_000
ROLL_BYTES = 16_000_000
RECORD_BYTES = 600  # of a record beside its payload
PARTS = 65_536  # ranges of ids that bytes are summed over
DATE = "1970-01-01T00:00:00Z"
SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_ID, '/'.join(map(str, parts)))}>"


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url)


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    press = zlib.compressobj(6, zlib.DEFLATED, 31)  # gzip, without a time stamp
    return press.compress(head.encode() + block + b"\r\n\r\n") + press.flush()


def warcinfo(name: str) -> bytes:
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id("info", name)), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")


def _target(page_id: int | None, url: str | None) -> str:
    return _clean(url) if url else f"urn:page:{page_id}"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """A response with its payload, or a revisit that names the response it repeats."""
    target = _target(page_id, url)
    revisit, size, digest = refers_to is not None, len(payload), _digest(payload)
    fields: list[tuple[str, object]] = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id, target, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", size), ("X-Page-Id", "" if page_id is None else page_id),
    ]
    if revisit:
        first = _target(refers_to, refers_url)
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(refers_to, first, digest)),
            ("WARC-Refers-To-Target-URI", first), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-Id", refers_to),
        ]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (b"" if revisit else payload)
    fields += [("WARC-Block-Digest", f"sha1:{_digest(block)}"), ("Content-Type", "application/http; msgtype=response")]
    return _record(fields, block)


def _hashed(pages: DataFrame) -> DataFrame:
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    return own.withColumn("n_bytes", F.octet_length("payload").cast("bigint")).withColumn("equal", F.unhex(F.sha2("payload", 256)))


def first_copies(hashed: DataFrame, min_revisit_bytes: int) -> DataFrame:
    """(page_id, equal, refers_to, refers_url) of the pages whose payload a smaller id has too.

    Groups are counted before anything is joined, so a payload that a third of all pages
    share costs one row a task; payloads themselves stay where they are."""
    keys = hashed.select("page_id", "url", "equal", "n_bytes").where((F.col("n_bytes") >= min_revisit_bytes) & F.col("page_id").isNotNull())
    groups = keys.groupBy("equal").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("equal", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url"))
    return keys.select("page_id", "equal").join(groups, "equal").where("page_id > refers_to").select("page_id", "equal", "refers_to", "refers_url").distinct()


def _sharded(records: DataFrame, sizes: DataFrame, shard_bytes: int) -> tuple[DataFrame, int]:
    """Add a shard number: runs of ids of about ``shard_bytes``, cut where the bytes of all smaller ids pass a multiple of it.

    Ids are counted in two steps, ranges between splitters that Spark's own range partitioner draws from the data and places
    within a range, so neither far ids nor many rows crowd a task; what is broadcast is the first byte of each range."""
    spark = sizes.sparkSession
    by_id = sizes.where("page_id is not null").groupBy("page_id").agg(F.sum(F.col("n_bytes") + RECORD_BYTES).cast("bigint").alias("b"))
    total = by_id.agg(F.coalesce(F.sum("b"), F.lit(0))).first()[0]
    parts = max(1, min(PARTS, -(-total // (16 * shard_bytes))))
    ranged = materialize(by_id.repartitionByRange(parts, "page_id").withColumn("part", F.spark_partition_id()), "sizes")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over at most PARTS rows
    offsets = ranged.groupBy("part").agg(F.sum("b").alias("b")).select("part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("offset"))
    within = F.sum("b").over(Window.partitionBy("part").orderBy("page_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("b")
    numbered = ranged.join(F.broadcast(offsets), "part").select("page_id", F.floor((F.col("offset") + within) / shard_bytes).cast("bigint").alias("_shard"))
    joined = records.join(numbered, "page_id", "left")
    return joined.withColumn("shard", F.coalesce("_shard", F.lit(-1))).drop("_shard"), max(1, -(-total // shard_bytes))


MANIFEST = "name string, temporary string, records bigint, bytes bigint, sha1 string, first_id bigint, last_id bigint"


def write(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write the files under ``folder``/data and the manifest under ``folder``/manifest; return the manifest."""
    spark = pages.sparkSession
    sizes = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(F.octet_length(F.col("html").cast("string")), F.lit(0)).alias("n_bytes"))
    hashed = _hashed(pages)
    # what a page repeats meets the page in its shard, so payloads are shuffled once
    nothing = lambda name, kind: F.lit(None).cast(kind).alias(name)
    copies = first_copies(hashed, min_revisit_bytes).select("page_id", F.lit(0).alias("kind"), nothing("url", "string"), nothing("payload", "binary"), nothing("n_bytes", "bigint"), "equal", "refers_to", "refers_url")
    records = hashed.select("page_id", F.lit(1).alias("kind"), "url", "payload", "n_bytes", "equal", nothing("refers_to", "bigint"), nothing("refers_url", "string"))
    records, n = _sharded(copies.unionByName(records), sizes, shard_bytes)
    ordered = records.repartitionByRange(n, "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "kind", "url", "equal")
    return commit(spark, ordered.mapInArrow(_writer(folder, roll_bytes), MANIFEST), folder)


def _writer(folder: str, roll_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        task = TaskContext.get()
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(f"{root}/_temporary", recursive=True)
        state: dict = {}
        rows: list[tuple] = []

        def close() -> None:
            if state:
                state["out"].close()
                rows.append((state["name"], state["temporary"], state["records"], state["bytes"], state["sha"].hexdigest(), state["first"], state["last"]))
                state.clear()

        def put(data: bytes) -> None:
            state["out"].write(data)
            state["bytes"] += len(data)
            state["sha"].update(data)

        shard, number, page, repeats = None, 0, None, {}
        for r in (row for batch in batches for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist()):
            if r["page_id"] != page:
                page, repeats = r["page_id"], {}
            if r["kind"] == 0:
                repeats[r["equal"]] = r["refers_to"], r["refers_url"]
                continue
            if r["shard"] != shard:
                close()
                shard, number = r["shard"], 0
            if state and state["bytes"] >= roll_bytes:
                close()
                number += 1
            if not state:
                name = f"shard-{shard:06d}-{number:05d}.warc.gz"
                temporary = f"_temporary/{name}.{task.stageId()}-{task.taskAttemptId()}-{uuid.uuid4().hex}"
                state.update(name=name, temporary=temporary, records=0, bytes=0, sha=hashlib.sha1(), first=r["page_id"], last=None, out=system.open_output_stream(f"{root}/{temporary}", compression=None))
                put(warcinfo(name))
            payload = r["payload"] or b""
            put(page_record(r["page_id"], r["url"], payload, *repeats.get(r["equal"], (None, None))))
            state["records"] += 1
            state["last"] = r["page_id"]
        close()
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["name", "temporary", "records", "bytes", "sha1", "first_id", "last_id"])

    return run


def commit(spark: SparkSession, written: DataFrame, folder: str) -> DataFrame:
    """Rename what winning attempts wrote, then publish the manifest. Repeating a rename is harmless."""
    staged = f"{folder}/_staged"
    written.write.parquet(staged)

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(f"{root}/data", recursive=True)
        for batch in batches:
            for r in batch.to_pylist():
                source, target = f"{root}/{r['temporary']}", f"{root}/data/{r['name']}"
                if system.get_file_info(source).type != fs.FileType.NotFound:
                    system.move(source, target)
                elif system.get_file_info(target).size != r["bytes"]:
                    raise OSError(f"{r['name']}: neither its temporary nor its committed file is whole")
            yield batch

    schema = T._parse_datatype_string(MANIFEST)
    spark.read.schema(schema).parquet(staged).mapInArrow(rename, MANIFEST).drop("temporary").write.json(f"{folder}/manifest")
    return spark.read.schema(T.StructType([f for f in schema.fields if f.name != "temporary"])).json(f"{folder}/manifest")


RECORDS = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary, file string"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each gzip member of a WARC file."""
    at, view = 0, memoryview(data)
    while at < len(data):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if at >= len(data):
                raise ValueError("a record is cut off")
            parts.append(member.decompress(view[at : at + 16_384]))
            at = min(at + 16_384, len(data))
        at -= len(member.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        yield fields, rest[: int(fields["Content-Length"])]


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The page records of all committed files; payload digests and sizes of responses are verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string())
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload", "file"]
        for batch in batches:
            for i in range(batch.num_rows):
                path, rows, held = batch.column(0)[i].as_py(), [], 0
                for fields, block in parse(batch.column(1)[i].as_py()):
                    if fields["WARC-Type"] not in ("response", "revisit"):
                        continue
                    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                    payload = None
                    if fields["WARC-Type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if len(payload) != size or _digest(payload) != digest:
                            raise ValueError(f"{path}: the payload of page {fields['X-Page-Id']} does not match its headers")
                    page, refers = fields["X-Page-Id"], fields.get("X-Refers-To-Page-Id")
                    rows.append((int(page) if page else None, fields["WARC-Target-URI"], fields["WARC-Type"], size, digest, int(refers) if refers else None, payload if payloads else None, path.rpartition("/")[2]))
                    held += len(payload or b"") * payloads
                    if held > 8_000_000 or len(rows) >= 20_000:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
    files = spark.read.format("binaryFile").schema(schema).option("pathGlobFilter", "*.warc.gz").load(f"{folder}/data")
    return files.select("path", "content").mapInArrow(run, RECORDS)


def archive(pages: DataFrame, min_revisit_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write all pages, then return what reading the archives back gives, without payloads."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    written = write(pages, folder, min_revisit_bytes)
    if written.isEmpty():
        return pages.sparkSession.createDataFrame([], RECORDS)
    return read(pages.sparkSession, folder, payloads=False)
