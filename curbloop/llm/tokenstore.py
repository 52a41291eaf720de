"""Token ids in files: one concatenated id array with Elias-Fano encoded document boundaries.

File: ids | document ids | boundaries | footer. Boundaries are the running numbers of ids, so document k is the ids from select(k)
to select(k + 1). Both tables are Elias-Fano coded: low bits as they are, high bits in unary, with the place of every 256th
one kept so that a boundary is found without reading the table. Ids take 2 bytes if the vocabulary allows it, else 4.

Defined results: a null text is empty; an empty document is its end id alone. Documents are in ascending order of their ids, null
ids first; rows with equal ids follow each other. Every row is written. Extra columns are not stored. An empty table
gives no file.
"""
import json
import struct

from pyspark.sql import DataFrame, Window as W, functions as F

from curbloop.llm.batches import mapped
from curbloop.llm.files import CommittedFile, open_store
from curbloop.llm.ranges import order_key, weighted_splitters, with_range
from curbloop.llm.tokens import encoder, public_path
from curbloop.operators.scratch import stage

MAGIC, STEP, END_ID = b"EFTOKENS", 256, 1


class EliasFano:
    """An ascending list of n numbers from 0 to ``top``."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values) -> "EliasFano":
        import numpy as np
        values = np.asarray(values, np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        places = (values >> low_bits) + np.arange(n)  # of the ones
        bits = np.zeros((int(places[-1]) + 1 if n else 0), np.uint8)
        bits[places] = 1
        shifts = np.arange(low_bits)
        low = ((values[:, None] >> shifts) & 1).astype(np.uint8).ravel()
        return cls(n, low_bits, np.packbits(low, bitorder="little").tobytes(), np.packbits(bits, bitorder="little").tobytes(),
                   places[::STEP].astype("<u4"))

    def select(self, k: int) -> int:
        """The k-th number, from the sample before it."""
        import numpy as np
        at = int(self.samples[k // STEP])
        left, byte = k % STEP + 1, at // 8
        ones = np.unpackbits(np.frombuffer(self.high, np.uint8, 1, byte), bitorder="little")
        ones[:at % 8] = 0
        while ones.sum() < left:
            left, byte = left - int(ones.sum()), byte + 1
            ones = np.unpackbits(np.frombuffer(self.high, np.uint8, 1, byte), bitorder="little")
        place = byte * 8 + int(np.flatnonzero(ones)[left - 1])
        low = 0
        for b in range(self.low_bits):
            bit = k * self.low_bits + b
            low |= (self.low[bit // 8] >> bit % 8 & 1) << b
        return (place - k) << self.low_bits | low

    def run(self, k: int, n: int):
        """Numbers k to k + n - 1: the bits from the sample before the first to the sample after the last are decoded, no others."""
        import numpy as np
        n = min(n, self.n - k)
        if n <= 0:
            return np.zeros(0, np.int64)
        first, after = k // STEP, -(-(k + n) // STEP)
        begin = int(self.samples[first]) // 8
        end = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        places = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8, end - begin, begin), bitorder="little")) + begin * 8
        places = places[places >= int(self.samples[first])][k - first * STEP:][:n]
        begin = k * self.low_bits // 8
        low = np.unpackbits(np.frombuffer(self.low, np.uint8, -(-(k + n) * self.low_bits // 8) - begin, begin), bitorder="little")
        low = low[k * self.low_bits - begin * 8:][:n * self.low_bits].reshape(n, self.low_bits).astype(np.int64)
        return (places - np.arange(k, k + n)) << self.low_bits | low @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low + self.high + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> "EliasFano":
        import numpy as np
        n, low_bits, a, b, c = struct.unpack_from("<QBQQQ", raw)
        at = struct.calcsize("<QBQQQ")
        return cls(n, low_bits, raw[at:at + a], raw[at + a:at + a + b], np.frombuffer(raw, "<u4", c, at + a + b))


class StoreWriter:
    """Appends documents in ascending order of id; the tables follow the ids when the file is closed."""

    def __init__(self, store, folder: str, name: str, width: int):
        self.file, self.width, self.doc_ids, self.ends = CommittedFile(store, folder, name), width, [], [0]

    def add(self, doc_id, ids) -> None:
        self.file.write(ids.astype(f"<u{self.width}").tobytes())
        self.doc_ids.append(doc_id)
        self.ends.append(self.ends[-1] + len(ids))

    def commit(self) -> tuple:
        known = [d for d in self.doc_ids if d is not None]
        base = known[0] if known else 0
        tables = [EliasFano.build([d - base for d in known]).to_bytes(), EliasFano.build(self.ends).to_bytes()]
        footer = json.dumps({"width": self.width, "nulls": len(self.doc_ids) - len(known), "base": base, "sizes": [len(t) for t in tables]})
        for part in (*tables, footer.encode(), struct.pack("<I", len(footer.encode())), MAGIC):
            self.file.write(part)
        return self.file.commit(), len(self.doc_ids), self.ends[-1], self.file.size


class StoreFile:
    """Random access to one file: ``doc_id(k)``, ``span(k)``, ``ids(first, end)``, and blocks of documents."""

    def __init__(self, store, path: str):
        self.stream = store.open_input_file(path)
        size = self.stream.size()
        tail = self.stream.read_at(12, size - 12)
        if tail[4:] != MAGIC:
            raise ValueError(f"{path} is not a token store")
        n = struct.unpack("<I", tail[:4])[0]
        self.footer = json.loads(self.stream.read_at(n, size - 12 - n))
        a, b = self.footer["sizes"]
        self.known = EliasFano.from_bytes(self.stream.read_at(a, size - 12 - n - b - a))
        self.ends = EliasFano.from_bytes(self.stream.read_at(b, size - 12 - n - b))

    def __len__(self) -> int:
        return self.ends.n - 1

    def doc_id(self, k: int):
        k -= self.footer["nulls"]
        return None if k < 0 else self.footer["base"] + self.known.select(k)

    def block(self, k: int, n: int = STEP) -> tuple:
        """Ids of documents k to k + n - 1, and their boundaries, of which there is one more."""
        ends = self.ends.run(k, n + 1)
        nulls = min(max(0, self.footer["nulls"] - k), len(ends) - 1)
        first = max(0, k - self.footer["nulls"])
        return [None] * nulls + (self.known.run(first, len(ends) - 1 - nulls) + self.footer["base"]).tolist(), ends

    def span(self, k: int) -> tuple[int, int]:
        return self.ends.select(k), self.ends.select(k + 1)

    def ids(self, first: int, end: int):
        import numpy as np
        width = self.footer["width"]
        return np.frombuffer(self.stream.read_at((end - first) * width, first * width), f"<u{width}")


def write_store(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, shard_bytes: int = 64 << 20,
                doc_id="doc_id", text="text") -> DataFrame:
    """Encode whole texts and write one file per range of ids; returns the manifest (shard, path, docs, tokens, bytes)."""
    path = path or public_path("word_bpe_49k.json")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    key = order_key("doc_id", F.xxhash64("text"))  # rows that share an id are cut between texts
    splitters = weighted_splitters(rows, key, size, int(total // shard_bytes) + 1, total)
    width = 2 if encoder(path).tokenizer.get_vocab_size(True) <= 1 << 16 and end_id < 1 << 16 else 4

    def write(batches):
        import numpy as np
        import pyarrow as pa
        store, place = open_store(folder)
        store.create_dir(place)
        end, writer, shard, done = np.array([end_id], "<u4"), None, None, []
        for batch in batches:
            for first in range(0, len(batch), 128):
                shards, ids, texts = (c.to_pylist() for c in batch.slice(first, 128).columns)
                for s, d, raw in zip(shards, ids, encoder(path).encode([t or "" for t in texts])):
                    if s != shard:
                        if writer:
                            done.append((shard, *writer.commit()))
                        writer, shard = StoreWriter(store, place, f"tokens-{s:06d}.bin", width), s
                    writer.add(d, np.append(np.frombuffer(raw, "<u4"), end))
        if writer:
            done.append((shard, *writer.commit()))
        yield pa.RecordBatch.from_pylist([dict(zip(("shard", "path", "docs", "tokens", "bytes"), d)) for d in done], schema=pa.schema(
            [("shard", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())]))

    dealt = with_range(rows, key, splitters, "struct<k0:bigint,k1:bigint>", "shard").select("shard", "doc_id", "text")
    dealt = dealt.repartitionById(len(splitters) + 1, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    manifest = mapped(dealt, write, "shard int, path string, docs long, tokens long, bytes long")
    return stage(manifest, "token-manifest")


def read_store(manifest: DataFrame, folder: str, batch_ids: int = 1 << 20) -> DataFrame:
    """Documents (doc_id, start, n_tokens, ids) from the files: start counts the ids of all documents before.

    Boundaries are selected 256 documents at a time, so a task holds no table of a whole file."""
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    files = manifest.select("path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))

    def read(batches):
        import pyarrow as pa
        store, _ = open_store(folder)
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns)):
                file = StoreFile(store, path)
                for k in range(0, len(file), STEP):
                    names, ends = file.block(k)
                    at = 0
                    while at < len(names):
                        last = max(at + 1, int(ends.searchsorted(ends[at] + batch_ids, "right")) - 1)
                        ids = file.ids(int(ends[at]), int(ends[last])).astype("<u4")
                        cuts = ends[at:last + 1] - ends[at]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(names[at:last], pa.int64()), pa.array(ends[at:last] + start), pa.array(cuts[1:] - cuts[:-1]),
                            pa.array([ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())],
                            names=["doc_id", "start", "n_tokens", "ids"])
                        at = last

    n = max(1, manifest.count())
    return mapped(files.repartition(n), read, "doc_id long, start long, n_tokens long, ids binary")
