"""WARC archives of pages, written in deterministic shards and read back.

Pages are sorted by page_id into shards whose bounds follow from the ids alone.  A shard's records go
to files that are rolled when they reach ``ROLL`` compressed bytes; every record is a gzip member of
its own.  Lengths, block and payload digests and record ids are made anew from the content.  Of
records with equal payloads the one with the largest page_id is the response, others revisit it.  Each
file is written under a name of its task attempt and renamed when it is whole, then the shard's
manifest likewise; the driver writes the manifest of all shards last, and readers open only what it
names.  A lost executor thus leaves temporary files, never half of an archive, and a repeated task
replaces files by equal ones.

Null html: an empty payload.  Null url: an empty target.  Null page_id: written after the others, with
no id.  Rows of equal page_id and payload: the first is the response, the others revisit it.  Of more
than LOOK * SHARD_ROWS pages shards grow, but a task reads its shard as a stream and holds one file of it.
Very long payloads are one record each.  An empty table gives a manifest without files.  Extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outrate.llm.common import table

ROLL = 64 << 20
#: Pages in a shard, about; and how many ids the driver looks at to set the bounds.
SHARD_ROWS, LOOK = 4000, 20_000
#: Bounds are looked up in two steps, so many at a time.
STEP = 128
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "shard int, name string, records long, bytes long, sha1 string"
READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _id(page_id: int | None, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{nth}')}>"


def record(page_id: int | None, nth: int, url: str, payload: bytes, payload_digest: str, refers_to: tuple[int | None, int] | None) -> bytes:
    """A record with regenerated headers; refers_to: page_id and number of the response that a revisit repeats."""
    if refers_to is None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    clean = url.replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_id(page_id, nth)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean}",
        *([] if page_id is None else [f"X-Page-ID: {page_id}"]), f"X-Payload-Length: {len(payload)}",
        *([] if refers_to is None else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_id(*refers_to)}", *([] if refers_to[0] is None else [f"X-Refers-To-Page: {refers_to[0]}"])]),
        f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record in an archive; the digests and lengths must hold."""
    while data:
        member = zlib.decompressobj(31)
        raw = member.decompress(data)
        if not member.eof:
            raise ValueError("an archive ends within a record")
        data = member.unused_data
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        block = rest[: int(fields["Content-Length"])]
        if rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
            raise ValueError("a record's length or digest does not hold")
        yield fields, block


def _commit(store: fs.FileSystem, path: str, data: bytes, attempt: int) -> None:
    """Writes under the attempt's own name, then renames."""
    head, _, name = path.rpartition("/")
    temporary = f"{head}/.{name}.{attempt}.tmp"
    with store.open_output_stream(temporary, compression=None) as out:
        out.write(data)
    store.move(temporary, path)


def _writer(path: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _filesystem(path)
        attempt = TaskContext.get().taskAttemptId()
        shard, files, members, size, last, nth, refers = None, [], [], 0, None, 0, {}

        def close() -> None:
            nonlocal members, size
            if members:
                data, name = b"".join(members), f"pages-{shard:06d}-{len(files):05d}.warc.gz"
                _commit(store, f"{top}/{name}", data, attempt)
                files.append({"shard": shard, "name": name, "records": len(members), "bytes": len(data), "sha1": hashlib.sha1(data).hexdigest()})
                members, size = [], 0

        def end() -> pa.RecordBatch:
            close()
            _commit(store, f"{top}/shard-{shard:06d}.json", "\n".join(map(json.dumps, files)).encode(), attempt)
            return pa.RecordBatch.from_pylist(files, schema=pa.schema([("shard", pa.int32()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())]))

        for b in batches:
            for row in b.to_pylist():
                if row["shard"] != shard:
                    if shard is not None:
                        yield end()
                    shard, files, last, nth = row["shard"], [], (), 0
                if row["page_id"] != last or last == ():
                    last, nth, refers, seen = row["page_id"], 0, {}, {}
                if row["kind"] == 0:  # what stands before the page: where equal payloads are
                    refers[row["digest"]] = row["refers_to"]
                    continue
                payload, url = (row["html"] or "").encode(), row["url"] or ""
                key = hashlib.sha1(payload).hexdigest()
                to = (refers[key], 0) if key in refers else (last, seen[key]) if key in seen else None
                seen.setdefault(key, nth)
                member = gzip.compress(record(last, nth, url, payload, digest(payload), to), 6, mtime=0)
                members.append(member)
                size, nth = size + len(member), nth + 1
                if size >= roll:
                    close()
        if shard is not None:
            yield end()

    return run


def bounds(pages: DataFrame) -> list[int]:
    """Ids at which shards begin, from the ids alone: evenly spaced among those whose hash is small, about LOOK of them."""
    n = pages.count()
    some = pages.where(F.pmod(F.xxhash64("page_id"), F.lit(max(1, n // LOOK))) == 0)
    ids = sorted(r[0] for r in some.select("page_id").where("page_id IS NOT NULL").distinct().collect())
    shards = max(1, n // SHARD_ROWS)
    return sorted({ids[len(ids) * k // shards] for k in range(1, shards)}) if ids else []


def _shard(page_id: Column, starts: list[int]) -> Column:
    """How many starts are not above the id: first among every STEP-th of them, then among those between."""
    numbers = lambda x: F.array(*[F.lit(v).cast("long") for v in x]).cast("array<bigint>")
    below = lambda x: F.size(F.filter(x, lambda v: v <= page_id))
    before = F.greatest(below(numbers(starts[::STEP])) - 1, F.lit(0)) * STEP
    return before + below(F.slice(numbers(starts), before + 1, F.lit(STEP)))


def write(pages: DataFrame, path: str, roll: int = ROLL) -> None:
    """pages (page_id, url, html) as archives in the folder path, with the manifest in ``manifest``."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    starts = bounds(pages)
    sha = table(pages.select("page_id", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("digest")), "digests")
    last = sha.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL")
    revisits = sha.join(last, "digest").where("page_id IS NULL OR page_id < refers_to").select("page_id", "digest", "refers_to").distinct()
    none = F.lit(None).cast("string")
    rows = pages.select("page_id", F.lit(1).alias("kind"), "url", "html", none.alias("digest"), F.lit(None).cast("long").alias("refers_to"))
    rows = rows.union(revisits.select("page_id", F.lit(0).alias("kind"), none.alias("url"), none.alias("html"), "digest", "refers_to"))
    shard = F.when(F.col("page_id").isNull(), len(starts)).otherwise(_shard(F.col("page_id"), starts)).cast("int")
    placed = rows.withColumn("shard", shard).repartition(len(starts) + 1, "shard")
    ordered = placed.sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "kind", "url", "html")
    store, top = _filesystem(path)
    store.create_dir(top, recursive=True)
    files = table(ordered.select("shard", "page_id", "kind", "url", "html", "digest", "refers_to").mapInArrow(_writer(path, roll), FILES), "files")
    files.orderBy("shard", "name").coalesce(1).write.json(f"{path}/manifest")


def _reader(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _filesystem(path)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for b in batches:
            for f in b.to_pylist():
                with store.open_input_stream(f"{top}/{f['name']}", compression=None) as x:
                    data = x.read()
                if hashlib.sha1(data).hexdigest() != f["sha1"]:
                    raise ValueError(f"{f['name']} is not what the manifest names")
                out = []
                for head, block in parse(data):
                    payload = block.partition(b"\r\n\r\n")[2] if head["WARC-Type"] == "response" else None
                    if payload is not None and f"sha1:{digest(payload)}" != head["WARC-Payload-Digest"]:
                        raise ValueError("a payload's digest does not hold")
                    out.append({
                        "page_id": int(head["X-Page-ID"]) if "X-Page-ID" in head else None, "url": head["WARC-Target-URI"], "record_type": head["WARC-Type"], "payload_bytes": int(head["X-Payload-Length"]),
                        "refers_to": int(head["X-Refers-To-Page"]) if "X-Refers-To-Page" in head else None, "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha1:"), "payload": payload,
                    })
                    if len(out) == 200:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out = []
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record that the manifest names, checked: its headers' fields and, for a response, the payload."""
    files = spark.read.schema(FILES).json(f"{path}/manifest")
    many = files.repartition(max(1, min(10_000, files.count())), "name")
    return many.mapInArrow(_reader(path), READ)
