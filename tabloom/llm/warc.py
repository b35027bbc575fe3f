"""Deterministic sharded WARC writer and reader.

Records are put into the order of page id, digest and address, numbered exactly, and cut into shards
of equal numbers of records. A task writes its shards in turn: every record is a gzip member of its
own, headers and digests are made anew from the payload, and a file is closed once its compressed
size reaches ``roll_bytes``. Nothing depends on a clock, a random number or the cluster, so the same
table always gives the same files.

Files are written under temporary names, one for each attempt, and listed in a table. Only when that
table is complete are the listed files renamed; files of lost attempts are never listed. The manifest,
written last, is what readers go by.

Of records with equal payloads of at least 100 bytes that with the smallest page id is a response and
the others are revisits that name it; smaller payloads are always responses.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.session import cut_lineage, scratch_root

LEAST_REVISIT = 100
SHARD_ROWS = 4096
ROLL_BYTES = 64 << 20
BROADCAST_ROWS = 1_000_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "shard long, part int, temporary string, name string, records long, bytes long, file_sha256 string"


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}')}>"


def clean_address(url: str) -> str:
    """A header value: white space and control characters as percent codes."""
    return re.sub(r"[\x00-\x20\x7f-\xa0  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def record(page, url, payload: bytes | None, digest: str, size: int, refers_to, date: str) -> bytes:
    """One record; ``payload`` None makes a revisit of ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if payload is not None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {clean_address(url)}")
    if page is not None:
        lines.append(f"Page-ID: {page}")
    if payload is None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """``data`` as a gzip member without time or name."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Roll:
    """The archive file being written."""

    def __init__(self, files: pafs.FileSystem, root: str, shard: int, part: int) -> None:
        self.shard, self.part = shard, part
        self.name = f"{root}/archives/part-{shard:08d}-{part:04d}.warc.gz"
        self.temporary = f"{root}/_temporary/{uuid.uuid4().hex}.warc.gz"
        self.out = files.open_output_stream(self.temporary)
        self.bytes, self.records, self.sha = 0, 0, hashlib.sha256()

    def add(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.bytes, self.records = self.bytes + len(data), self.records + 1

    def close(self) -> tuple:
        self.out.close()
        return self.shard, self.part, self.temporary, self.name, self.records, self.bytes, self.sha.hexdigest()


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``position``, their exact place in ``order`` from 0, without one big window.

    Sampled ranges spread the sort; their counts, one row per range, give each range its start.
    """
    ranged = rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    inside = ranged.withColumn("place", F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1)
    counts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return inside.join(F.broadcast(starts), "range").withColumn("position", F.col("start") + F.col("place")).drop("range", "place", "start")


def planned(pages: DataFrame, id_col: str, url: str, html: str, shard_rows: int) -> DataFrame:
    """(page_id, url, digest, bytes, refers_to, shard, position): refers_to is null for responses."""
    payload = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    facts = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.col(f"`{url}`").alias("url"),
        F.sha2(payload, 256).alias("digest"),
        F.octet_length(payload).cast("long").alias("bytes"),
    )
    placed = cut_lineage(numbered(facts.distinct(), ["page_id", "digest", "url"]))
    first = placed.filter(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.filter("n > 1").drop("n")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return placed.join(first, "digest", "left").select(
        "page_id", "url", "digest", "bytes", refers.alias("refers_to"), F.floor(F.col("position") / shard_rows).cast("long").alias("shard"), "position"
    )


def write_archives(
    pages: DataFrame,
    root: str,
    id_col: str = "page_id",
    url: str = "url",
    html: str = "html",
    shard_rows: int = SHARD_ROWS,
    roll_bytes: int = ROLL_BYTES,
    date: str = DATE,
) -> DataFrame:
    """Write one record per row of ``pages`` below ``root`` (an URI all executors reach); the manifest.

    A null payload is empty, a null address leaves its header out. Rows that repeat a page id get a
    record each; those that repeat the payload too are all responses, as nothing tells them apart. A
    null page id comes first, leaves its header out, and is nobody's response. An empty table gives
    an empty manifest. Only the digests are sorted; payloads are shuffled once, those of responses only.
    """
    plan = cut_lineage(planned(pages, id_col, url, html, shard_rows))
    few = plan.count() <= BROADCAST_ROWS
    text = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("of"), F.col(f"`{url}`").alias("at"), text.alias("payload"))
    rows = rows.withColumn("sha", F.sha2("payload", 256))
    same = F.col("of").eqNullSafe(F.col("page_id")) & F.col("at").eqNullSafe(F.col("url")) & (F.col("sha") == F.col("digest"))
    kept = F.when(F.col("refers_to").isNull(), F.col("payload").cast("binary")).alias("payload")
    joined = rows.join(F.broadcast(plan) if few else plan, same).select("shard", "position", "page_id", "url", "digest", "bytes", "refers_to", kept)
    files, path = pafs.FileSystem.from_uri(root)
    files.create_dir(f"{path}/_temporary", recursive=True)
    files.create_dir(f"{path}/archives", recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(root)
        roll: Roll | None = None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if roll is not None and (roll.shard != row["shard"] or roll.bytes >= roll_bytes):
                    done.append(roll.close())
                    roll = Roll(store, base, row["shard"], roll.part + 1 if roll.shard == row["shard"] else 0)
                roll = roll or Roll(store, base, row["shard"], 0)
                data = record(row["page_id"], row["url"], row["payload"], row["digest"], row["bytes"], row["refers_to"], date)
                roll.add(member(data))
            yield listed(done)
        yield listed([roll.close()] if roll is not None else [])

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for row in batch.to_pylist():
                # a second attempt finds the file renamed
                if store.get_file_info(row["temporary"]).type != pafs.FileType.NotFound:
                    store.move(row["temporary"], row["name"])
            yield batch

    # a shard of responses without long texts is a few MB; its rows stream through sorted
    shards = joined.repartition("shard").sortWithinPartitions("shard", "position")
    written = cut_lineage(shards.mapInArrow(run, FILES))
    committed = written.repartition("name").mapInArrow(commit, FILES).drop("temporary")
    committed.write.mode("overwrite").json(f"{root}/manifest")
    return read_manifest(pages.sparkSession, root)


def listed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    names = [c.split(" ")[0] for c in FILES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """The committed files: (shard, part, name, records, bytes, file_sha256)."""
    return spark.read.schema(", ".join(c for c in FILES.split(", ") if not c.startswith("temporary"))).json(f"{root}/manifest")


def members(stream, step: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    unpack, parts, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(step)
        if not data:
            if parts:
                raise ValueError("the archive ends inside a record")
            return
        parts.append(unpack.decompress(data))
        rest = b""
        if unpack.eof:
            yield b"".join(parts)
            rest, unpack, parts = unpack.unused_data, zlib.decompressobj(31), []


def parsed(data: bytes) -> dict:
    """Headers and payload of a record; its digests are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"].removeprefix("sha256:"):
        raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
    number = lambda key: int(fields[key]) if key in fields else None
    return {
        "page_id": number("Page-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest,
        "record_type": kind, "refers_to": number("Refers-To-Page-ID"), "payload": payload if kind == "response" else None,
    }


RECORD = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
     ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
)


def read_archives(manifest: DataFrame, root: str, with_payload: bool = True) -> DataFrame:
    """The records of the files of a manifest, read as streams."""
    schema = RECORD if with_payload else pa.schema([f for f in RECORD if f.name != "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with store.open_input_stream(name) as stream:
                    held, size = [], 0
                    for data in members(stream):
                        one = parsed(data)
                        held.append({k: one[k] for k in schema.names})
                        size += len(data)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                    yield pa.RecordBatch.from_pylist(held, schema)

    kinds = {"int64": "long", "string": "string", "binary": "binary"}
    width = max(manifest.sparkSession.sparkContext.defaultParallelism, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("name").repartition(width, "name").mapInArrow(run, ", ".join(f"{f.name} {kinds[str(f.type)]}" for f in schema))


def new_root(spark: SparkSession) -> str:
    """A fresh folder below the session's shared scratch folder."""
    root = f"{scratch_root(spark)}/warc-{uuid.uuid4().hex}"
    return root if "://" in root else re.sub(r"^(file:)?/*", "file:///", root)
