"""Encoding, packing and the token store: exact round trips."""
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from curbloop.llm import packing, queries, tokenstore
from curbloop.llm.tokens import Encoder, public_path
from curbloop.operators.scratch import new_path
from tests.llm.conftest import LONG, ODD

SF = "/root/testdata/sf0.001"
TEXTS = ["", " a", "a  b", "x.\n\nY", "don't.stop, now. it's", "<|endoftext|> a<|endoftext|>b", "...\nfoo..., bar.\nß ΑΣ. ΑΣ b", "a\tb c", "12,5 3. x1. 中文。 ok", "\x02 a",
         "é, ł. ał.", "İ. I, ſ.", "á. b", "word### ***", "x' 's. it's' 'll", " \n", "a\n", "THE!! END,", LONG[:5000]]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_ids_equal_the_library(spark, name):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text]
    own, library = Encoder(public_path(name), max_cached=500), Tokenizer.from_file(public_path(name))
    for k in range(0, len(texts), 7):
        for text, ids in zip(texts[k:k + 7], own.encode(texts[k:k + 7])):
            want = library.encode(text, add_special_tokens=False).ids
            assert ids == b"".join(i.to_bytes(4, "little") for i in want), text


def test_fullest_window_is_the_best_sum():
    rng = random.Random(4)
    for _ in range(200):
        capacity = rng.randint(5, 24)
        counts = {rng.randint(1, capacity): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        seed = max(counts)
        sums, rest = {seed}, dict(counts) | {seed: counts[seed] - 1}
        for length, n in rest.items():
            sums = {s + length * k for s in sums for k in range(n + 1)}
        got = packing.fullest(counts, seed, capacity)
        assert sum(n * length for length, n in got.items()) == max(s for s in sums if s <= capacity)
        assert all(n <= counts[length] for length, n in got.items())


def test_plan_uses_every_piece_once():
    rng = random.Random(5)
    counts = {length: rng.randint(1, 4000) for length in rng.sample(range(1, 1025), 300)}
    used = {}
    windows = packing.plan(counts)
    for times, chosen in windows:
        assert sum(n * length for length, n in chosen.items()) <= 1024
        for length, n in chosen.items():
            used[length] = used.get(length, 0) + times * n
    total = sum(n * length for length, n in counts.items())
    assert used == counts and total / (1024 * sum(t for t, _ in windows)) > 0.97
    with pytest.raises(ValueError):
        packing.plan({1025: 1})


def check_packed(rows):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return by_sequence


def test_packing_round_trip(docs, empty, clashing):
    pieces = packing.cut(clashing)
    packed = packing.pack(pieces, rows_per_bucket=3).cache()
    rows = packed.collect()
    parts = check_packed(rows)
    assert len(rows) == pieces.count() and sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    by_id = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert len(by_id) == len(parts) and all(len(i) == 4096 for i in by_id.values())
    for r in rows:
        assert bytes(by_id[r.sequence_id][4 * r.offset:4 * (r.offset + r.length)]) == bytes(r.ids)
    library = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    long = b"".join(bytes(r.ids) for r in sorted((r for r in rows if r.doc_id == 7), key=lambda r: r.start))
    assert long == b"".join(i.to_bytes(4, "little") for i in [*library.encode(LONG, add_special_tokens=False).ids, 0])
    assert sum(r.start == 0 for r in rows) == len(ODD)
    assert packing.pack(packing.cut(empty)).count() == 0


def test_packing_query(spark):
    rows = queries.op3_packing(spark, SF).collect()
    parts = check_packed(rows)
    assert sum(r.length for r in rows) / (1024 * len(parts)) > 0.98
    assert len({(r.doc_id, r.start) for r in rows}) == len(rows)


def test_elias_fano():
    rng = random.Random(6)
    for n, top in [(0, 0), (1, 0), (1, 10**9), (3000, 40), (3000, 10**12), (700, 700)]:
        values = sorted(rng.randint(0, top) for _ in range(n))
        coded = tokenstore.EliasFano.from_bytes(tokenstore.EliasFano.build(values).to_bytes())
        assert coded.run(0, n).tolist() == values
        for _ in range(40):
            k, length = rng.randint(0, n), rng.choice([0, 1, 5, 256, 257, 2000])
            assert coded.run(k, length).tolist() == values[k:k + length]
        assert [coded.select(k) for k in range(0, n, 7)] == values[::7]
        if n == 3000 and top > 10**9:
            assert len(coded.to_bytes()) < n * 5  # about 2 + log2(top / n) bits each


def test_boundaries_are_read_by_blocks():
    """A run touches the bytes between two samples only: those outside may be anything."""
    values = [i * 1000 + i % 7 for i in range(100_000)]
    coded = tokenstore.EliasFano.build(values)
    k = 51_200
    begin, end = int(coded.samples[k // 256]) // 8, int(coded.samples[k // 256 + 2]) // 8 + 1
    coded.high = b"\xff" * begin + coded.high[begin:end] + b"\xff" * (len(coded.high) - end)
    low = k * coded.low_bits // 8
    coded.low = b"\xff" * low + coded.low[low:low + 257 * coded.low_bits // 8 + 2] + b"\xff" * (len(coded.low) - low - 257 * coded.low_bits // 8 - 2)
    assert coded.run(k, 257).tolist() == values[k:k + 257]


def test_one_id_holding_most_rows_is_cut(spark):
    rows = spark.range(0, 4000, 1, 6).select(F.when(F.col("id") % 3 > 0, F.lit(5)).when(F.col("id") % 7 > 0, F.col("id")).alias("doc_id"),
                                             F.concat(F.lit("text "), F.col("id")).alias("text"))
    folder = new_path(spark, "test-store")
    manifest = tokenstore.write_store(rows, folder, shard_bytes=4000)
    share = 4000 / manifest.count()
    assert manifest.count() > 15 and manifest.agg(F.max("docs")).first()[0] < 2.5 * share
    got = tokenstore.read_store(manifest, folder).collect()
    library = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    want = sorted((r.doc_id is not None, r.doc_id or 0, tuple([*library.encode(r.text, add_special_tokens=False).ids, 1])) for r in rows.collect())
    have = sorted((r.doc_id is not None, r.doc_id or 0, struct.unpack(f"<{r.n_tokens}I", r.ids)) for r in got)
    assert have == want
    order = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)


def test_token_store_round_trip(spark, clashing, empty):
    folder = new_path(spark, "test-store")
    manifest = tokenstore.write_store(clashing, folder, shard_bytes=200)
    rows = tokenstore.read_store(manifest, folder, batch_ids=50).collect()
    assert len(rows) == len(ODD)
    library = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for row, (doc_id, text, *_) in zip(sorted(rows, key=lambda r: r.start), order):
        want = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert (row.doc_id, row.start, row.n_tokens) == (doc_id, at, len(want)) or doc_id == 8
        if doc_id != 8:
            assert bytes(row.ids) == b"".join(i.to_bytes(4, "little") for i in want)
        at += len(want)
    store, _ = tokenstore.open_store(folder)
    first = tokenstore.StoreFile(store, manifest.orderBy("shard").first().path)
    assert first.doc_id(0) is None and first.span(0)[0] == 0 and first.block(0)[0][0] is None
    other = new_path(spark, "test-store")
    again = tokenstore.write_store(clashing.repartition(5), other, shard_bytes=200)
    def contents(m):
        return [(r.shard, r.docs, r.tokens, zlib.crc32(open(r.path.removeprefix("file:"), "rb").read())) for r in m.orderBy("shard").collect()]
    assert contents(manifest) == contents(again)
    assert tokenstore.read_store(tokenstore.write_store(empty, other + "-empty"), other + "-empty").count() == 0


def test_token_store_query(spark):
    library = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    at = 0
    for r in queries.op8_token_store(spark, SF).orderBy("doc_id").collect():
        ids = [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        at += len(ids)
