"""Web archives: a deterministic sharded WARC writer and a reader.

Records are sorted by id within ranges of ids, written as one gzip member each, and files are rolled by their compressed size.
Headers and digests are made anew from the payload, so the same rows always give the same bytes. Files appear under
temporary names and are renamed when whole; the manifest lists those that count.

Defined results: a null payload is empty. Of equal payloads of at least ``min_bytes`` the row with the smallest id (null ids last)
is a response and the others revisit it, also when several rows share that id. A null id is written without one. Other columns
are not stored. An empty table gives no file.
"""
import base64
import hashlib
import uuid
import zlib

from pyspark.sql import DataFrame, functions as F

from curbloop.llm.batches import mapped
from curbloop.llm.files import CommittedFile, open_store
from curbloop.llm.ranges import order_key, weighted_splitters, with_range
from curbloop.operators.layout import skew_join
from curbloop.operators.scratch import stage

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, part int, path string, records long, bytes long"


def base32_sha1(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_id(page_id: int | None, digest: str) -> str:
    """A UUID of the free-form version that holds the page id, so equal rows get equal names."""
    number = (page_id or 0) & (1 << 64) - 1
    mark = int(digest[:14], 16) & (1 << 57) - 1 | (page_id is None) << 57
    bits = mark << 64 | number
    value = bits >> 74 << 80 | 8 << 76 | (bits >> 62 & 0xFFF) << 64 | 2 << 62 | bits & (1 << 62) - 1
    return f"<urn:uuid:{uuid.UUID(int=value)}>"


def page_of(name: str) -> int | None:
    """The page id in a record's name."""
    value = uuid.UUID(name[10:-1]).int
    bits = value >> 80 << 74 | (value >> 64 & 0xFFF) << 62 | value & (1 << 62) - 1
    number = bits & (1 << 64) - 1
    return None if bits >> 121 & 1 else number - (number >> 63 << 64)


def record(page_id, url, payload: bytes, digest: str, original, date: str) -> bytes:
    """One record. ``original``: (page id,) of the response that a revisit stands for, or None."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = head if original else head + payload
    lines = [VERSION, f"WARC-Type: {'revisit' if original else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}",
             f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{base32_sha1(digest)}",
             f"WARC-Block-Digest: sha1:{base32_sha1(hashlib.sha1(body).hexdigest())}", "Content-Type: application/http; msgtype=response"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(url.split()))
    if original:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(original[0], digest)}"]
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member without a time stamp."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _originals(rows: DataFrame, min_bytes: int) -> DataFrame:
    """Rows that revisit another: (_id, _digest, _original). Only ids and digests move, and large groups are salted."""
    narrow = rows.filter(F.octet_length("_payload") >= min_bytes).select("_id", "_digest")
    groups = narrow.groupBy("_digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    groups = stage(groups, "warc-groups")
    return skew_join(narrow, groups, ["_digest"], ["_id"])


def write_archive(pages: DataFrame, folder: str, page_id="page_id", url="url", payload="html", min_bytes: int = 0, shard_bytes: int = 64 << 20,
                  roll_bytes: int = 32 << 20, level: int = 5, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write all rows; returns the manifest (shard, part, path, records, bytes). ``roll_bytes`` of compressed records close a
    file; ``shard_bytes`` of payload make a range of ids."""
    rows = pages.select(F.col(page_id).cast("long").alias("_id"), F.col(url).alias("_url") if url else F.lit(None).cast("string").alias("_url"),
                        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("_payload"))
    rows = rows.withColumn("_digest", F.sha1("_payload"))
    size = F.octet_length("_payload") + 256
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    key = order_key("_id", "_digest")
    key_type = "struct<k0:bigint,k1:string>"
    splitters = weighted_splitters(rows, key, size, int(total // shard_bytes) + 1, total)
    links = _originals(rows, min_bytes).select("_id", F.lit(None).cast("string").alias("_url"), F.lit(None).cast("binary").alias("_payload"),
                                               "_digest", "_first", F.lit(True).alias("_link"))
    records = rows.select("_id", "_url", "_payload", "_digest", F.lit(None).cast("long").alias("_first"), F.lit(False).alias("_link"))
    # links come just before the record they belong to, so payloads move once
    both = with_range(links.unionByName(records), key, splitters, key_type, "_shard")
    both = both.repartitionById(len(splitters) + 1, "_shard").sortWithinPartitions(
        "_shard", "_id", "_digest", F.col("_link").desc(), F.col("_url"))

    def write(batches):
        import pyarrow as pa
        store, place = open_store(folder)
        store.create_dir(place)
        file, at, part, count, done, known, first_seen = None, None, 0, 0, [], {}, set()

        def close():
            done.append({"shard": at, "part": part, "path": file.commit(), "records": count, "bytes": file.size})

        for batch in batches:
            for r in range(0, len(batch), 256):
                for i, u, p, d, first, link, s in zip(*(c.to_pylist() for c in batch.slice(r, 256).columns)):
                    if link:
                        known = {(i, d): first}
                        continue
                    if file is not None and (s != at or file.size >= roll_bytes):
                        close()
                        file, part, count = None, part + 1 if s == at else 0, 0
                    if file is None:
                        at, file = s, CommittedFile(store, place, f"pages-{s:06d}-{part:04d}.warc.gz")
                    original = None
                    if (i, d) in known:  # one of a group: the first row of its smallest id is the response
                        if known[i, d] == i and (i, d) not in first_seen:
                            first_seen = {(i, d)}
                        else:
                            original = (known[i, d],)
                    file.write(member(record(i, u, p, d, original, date), level))
                    count += 1
        if file is not None:
            close()
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("path", pa.string()),
                                                                 ("records", pa.int64()), ("bytes", pa.int64())]))

    return stage(mapped(both.select("_id", "_url", "_payload", "_digest", "_first", "_link", "_shard"), write, MANIFEST), "warc-manifest")


def members(stream, chunk: int = 1 << 20):
    """The unpacked gzip members of a stream, one after another."""
    z, parts = zlib.decompressobj(31), []
    while data := stream.read(chunk):
        while data:
            parts.append(z.decompress(data))
            data = z.unused_data
            if z.eof:
                yield b"".join(parts)
                z, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends within a record")


def parse(raw: bytes) -> dict:
    """Headers and parts of a record; digests and lengths are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    h = dict(line.split(": ", 1) for line in lines)
    body = rest[:int(h["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest, revisit = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"] == "revisit"
    if first != VERSION or rest[len(body):] != b"\r\n\r\n" or not revisit and (
            len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record {h['WARC-Record-ID']}")
    return {"page_id": page_of(h["WARC-Record-ID"]), "url": h.get("WARC-Target-URI"), "record_type": h["WARC-Type"],
            "payload_bytes": length, "payload_digest": digest, "refers_to": page_of(h["WARC-Refers-To"]) if revisit else None,
            "payload": None if revisit else payload}


RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_archive(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of all files in the manifest. ``payloads=False`` checks payloads but does not return them."""
    def read(batches):
        import pyarrow as pa
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(name, kinds[kind]) for name, kind in (column.split() for column in RECORDS.split(", "))])
        store, _ = open_store(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for raw in members(stream):
                        row = parse(raw)
                        if not payloads:
                            row["payload"] = None
                        held.append(row)
                        size += len(row["payload"] or b"") + 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    return mapped(manifest.select("path").repartition(max(1, manifest.count())), read, RECORDS)
