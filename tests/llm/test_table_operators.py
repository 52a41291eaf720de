"""Archives, shards, neighbours, mix and near-duplicates on odd rows and against plain versions."""
import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases.check import compare, duck
from curbloop.llm import mixing, neardup, neighbours, queries, sharding, warc
from curbloop.operators.scratch import new_path
from tests.llm.conftest import LONG, ODD

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.SQL))
def test_equals_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), duck(SF), queries.SQL[name]).startswith("ok")


PAGES = [(5, "http://a b", "same"), (3, "u", "same"), (9, None, "same"), (3, "u", "same"), (1, "u", None), (2, "u", ""), (-4, "é", "é" * 50_000),
         (7, "u", "x\r\n\r\ny"), (None, "u", "same"), (None, "u", "alone"), (2**62, "u", "far")]


def test_archive_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit("own")).withColumn("part", F.lit(1))
    folder, other = new_path(spark, "test-warc"), new_path(spark, "test-warc")
    manifest = warc.write_archive(pages, folder, shard_bytes=600, roll_bytes=700)
    rows = warc.read_archive(manifest, folder).collect()
    assert len(rows) == len(PAGES) and manifest.agg(F.sum("records")).first()[0] == len(PAGES) and manifest.count() > 2
    full = {}
    for page_id, _, html in PAGES:
        full.setdefault((html or "").encode(), []).append(page_id)
    for payload, ids in full.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        own = [r for r in rows if r.payload_digest == digest]
        first = min((i for i in ids if i is not None), default=None)
        assert sorted(map(str, ids)) == sorted(str(r.page_id) for r in own) and {r.payload_bytes for r in own} == {len(payload)}
        responses = [r for r in own if r.record_type == "response"]
        assert len(responses) == 1 and responses[0].page_id == first and bytes(responses[0].payload) == payload
        assert all(r.refers_to == first and r.payload is None for r in own if r.record_type == "revisit")
    again = warc.write_archive(pages.repartition(4), other, shard_bytes=600, roll_bytes=700)

    def contents(m):
        return [(r.shard, r.part, r.records, zlib.crc32(open(r.path.removeprefix("file:"), "rb").read())) for r in m.orderBy("shard", "part").collect()]
    assert contents(manifest) == contents(again)
    small = warc.read_archive(warc.write_archive(pages, folder + "-5", min_bytes=5), folder + "-5")
    assert {r.record_type for r in small.collect()} == {"response"}
    assert warc.read_archive(warc.write_archive(pages.limit(0), folder + "-0"), folder + "-0").count() == 0


def test_record_names():
    for page_id in (0, 1, -1, 2**63 - 1, -2**63, None):
        assert warc.page_of(warc.record_id(page_id, "f" * 40)) == page_id
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, "u", b"abc", "0" * 40, None, "2024-01-01T00:00:00Z"))


def check_shards(rows, n_shards):
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r)
    for own in by_shard.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    sizes = [sum(r.size for r in by_shard.get(s, [])) for s in range(n_shards)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in rows) and set(by_shard) <= set(range(n_shards))


def test_shards(spark, clashing, empty):
    rows = sharding.shard(clashing.filter("doc_id is null or doc_id <> 7"), 3, rows_per_range=2, bytes_per_range=40).collect()
    assert len(rows) == len(ODD) - 1 and rows[0].kept == "own"
    check_shards(rows, 3)
    hot = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text")).otherwise(F.col("id").cast("string")).alias("text"))
    for rows_per_range in (100, 10_000):
        check_shards(sharding.shard(hot, 40, rows_per_range=rows_per_range, bytes_per_range=1 << 20).collect(), 40)
    assert sharding.shard(empty, 3).count() == 0
    assert "Python" not in sharding.shard(hot, 40)._jdf.queryExecution().executedPlan().toString()


def test_overfull_ranges_are_divided(spark):
    rows = spark.range(4000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("g"), "id", F.lit(10).alias("size"))
    key, kind = sharding.order_key("g", "id"), "struct<k0:bigint,k1:bigint>"
    splitters = sharding.split_ranges(rows, key, kind, F.col("size"), 200, 10**9, 100)
    held = rows.groupBy(sharding.range_index(key, splitters, kind).alias("r")).count().collect()
    assert max(r["count"] for r in held) <= 3 * 4000 // len(splitters) + 200 and len(held) == len(splitters) + 1


def test_splitters_follow_rows(spark):
    """Keys that many rows share, and null keys, are met by the draw as often as their rows say."""
    for copies, nulls in [(1000, 0), (10_000, 0), (1, 3)]:
        rows = spark.range(0, 200_000, 1, 8).select(F.when(F.col("id") % 10 >= nulls, (F.col("id") / copies).cast("long")).alias("g"), F.xxhash64("id").alias("h"))
        key, kind = sharding.order_key("g", "h"), "struct<k0:bigint,k1:bigint>"
        splitters = sharding.weighted_splitters(rows, key, F.lit(10), 20, 2_000_000)
        held = [r["count"] for r in rows.groupBy(sharding.range_index(key, splitters, kind).alias("r")).count().collect()]
        assert len(splitters) == 19 and len(held) == 20 and max(held) < 2 * 10_000
    by_key = sharding.order_key("g", F.lit(0))  # only the id: a range holds at most its share and one id more
    rows = spark.range(0, 200_000, 1, 8).select((F.col("id") / 1000).cast("long").alias("g"))
    splitters = sharding.weighted_splitters(rows, by_key, F.lit(10), 20, 2_000_000)
    assert rows.groupBy(sharding.range_index(by_key, splitters, "struct<k0:bigint,k1:int>").alias("r")).count().agg(F.max("count")).first()[0] < 20_000


def test_draws_do_not_grow_with_tasks(spark):
    for tasks in (32, 320):
        rows = spark.range(0, 400_000, 1, tasks).select(F.col("id").alias("g"))
        drawn = rows.filter(F.rand(1) * (400_000 / 8192) < 1).count()
        assert abs(drawn - 8192) < 600


def test_ranges_beyond_a_constant_array(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 5 > 0, F.col("id") % 1000).alias("g"), "id")
    key, kind = sharding.order_key("g", "id"), "struct<k0:bigint,k1:bigint>"
    splitters = sharding.weighted_splitters(rows, key, F.lit(1), 700, 3000)
    assert len(splitters) > 600
    for n in (len(splitters), 64, 63, 16, 15, 17):
        cut = splitters[:n]
        both = sharding.with_range(rows, key, cut, kind, "r", inline=4, block=16).withColumn("plain", sharding.range_index(key, cut, kind))
        assert both.filter("r <> plain or r is null").count() == 0 and both.count() == 3000


def sorted_and_cut(rows, n_shards):
    """Shards of (group, id, size) rows by sorting all of them: a row goes where its start lies in the running size."""
    total, at, out = sum(r[2] for r in rows), 0, {}
    for g, i, size in sorted(rows):
        out[i] = at * n_shards // total
        at += size
    return out


def test_shards_equal_sort_and_cut(spark):
    rows = [(i % 50 if i % 3 else 7, i, 1 + i * i % 97) for i in range(3000)]
    table = spark.createDataFrame(rows, "g long, doc_id long, weight long")
    for rows_per_range in (50, 10_000):
        got = sharding.shard(table, 9, size=F.col("weight"), group=F.col("g"), rows_per_range=rows_per_range).collect()
        want = sorted_and_cut(rows, 9)
        assert {r.doc_id: r.shard for r in got} == want
        slots = {}
        for g, i, _ in sorted(rows):
            slots.setdefault(want[i], []).append(i)
        assert all(slots[r.shard][r.slot] == r.doc_id for r in got)


def test_shard_query(spark):
    rows = queries.op5_sharding(spark, SF).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts) and all((r.size, r.text_crc32) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id])) for r in rows)
    check_shards(rows, 40)


def brute(vectors, query_ids, k):
    out = {}
    for q in query_ids:
        a = vectors[q]
        near = sorted((-float(np.dot(a, v) / np.sqrt(np.dot(a, a)) / np.sqrt(np.dot(v, v))), i) for i, v in vectors.items() if i != q)[:k]
        out[q] = [i for _, i in near]
    return out


@pytest.mark.parametrize("kind, tables", [("float", 4), ("double", 1)])
def test_neighbours_recall(spark, kind, tables):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(30, 24))
    x = (centers[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 24)) * 0.5).astype(np.float32)
    x[100:1100] = x[100]  # a third of all rows are one vector
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    got = {}
    for r in neighbours.nearest(rows, F.expr("id % 50 = 0"), 5, neighbours.Settings(tables=tables, hot_cell=200)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    want = brute({i: v.astype(float) for i, v in enumerate(x)}, range(0, 3000, 50), 5)
    hits = sum(len({v for _, v in got[q]} & set(w)) for q, w in want.items())
    assert set(got) == set(want) and hits / (5 * len(want)) >= 0.9
    assert [v for _, v in sorted(got[150])] == [100, 101, 102, 103, 104]


def test_neighbours_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
            (7, [1.0]), (8, [0.0, 3.0]), (None, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [1.0, 0.0]), (9, [])]
    table = spark.createDataFrame([(i, v, 1, "own") for i, v in rows], "vec_id long, embedding array<float>, rank int, score string")
    got = [tuple(r) for r in neighbours.nearest(table, F.expr("id % 50 = 0"), 5).orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got if g[0] == 0] == [(0, 1, 1), (0, 2, 50), (0, 3, 50), (0, 4, 8)]
    assert neighbours.nearest(table.limit(0), F.expr("id % 50 = 0")).count() == 0
    assert neighbours.nearest(table.filter("vec_id = 0"), F.expr("id % 50 = 0")).count() == 0


def test_doubles_keep_their_digits(spark):
    """Two vectors that are one as floats differ as doubles, and so do their scores."""
    near = [(1, [1.0, 1.0 + 1e-9, 0.0]), (2, [1.0, 1.0, 0.0]), (50, [1.0, 1.0 + 1e-9, 0.0]), (4, [0.0, 1.0, 1.0])]
    got = neighbours.nearest(spark.createDataFrame(near, "vec_id long, embedding array<double>"), F.expr("id = 50"), 3).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 4] and got[2].score == pytest.approx((1 + 1e-9) / np.sqrt(1 + (1 + 1e-9) ** 2) / np.sqrt(2), abs=1e-15)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_neighbour_query_recall(spark, sf, monkeypatch):
    fitted, fit = [], neighbours.fit
    monkeypatch.setattr(neighbours, "fit", lambda *a: fitted.append(fit(*a)) or fitted[-1])
    folder = f"/root/testdata/{sf}"
    vectors = {r.vec_id: np.array(r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    got = {}
    for r in queries.op6_neighbours(spark, folder).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(vectors, [i for i in vectors if i % 50 == 0], 5)
    assert sum(len(got[q] & set(w)) for q, w in want.items()) / (5 * len(want)) >= 0.9
    assert fitted[0][0].m >= 1  # vectors are hashed at every size


def test_probe_order():
    hashes = neighbours.Hashes(3, 3, neighbours.Settings())
    place = np.array([0.2, 0.5, 0.9])
    order = hashes.probes(place, 125)
    cost = [sum((s - f if s > 0 else f - s - 1) ** 2 if s else 0 for s, f in zip(o, place)) for o in order.tolist()]
    assert len({tuple(o) for o in order.tolist()}) == 125 and cost == sorted(cost) and order[0].tolist() == [0, 0, 0]
    assert (hashes.probes(place, 20) == order[:20]).all()


def filled(budget, caps, weights):
    """Water filling by halving: the rate at which the budget is used up."""
    low, high = 0.0, 1e12
    for _ in range(200):
        rate = (low + high) / 2
        low, high = (rate, high) if sum(min(c, rate * w) for c, w in zip(caps, weights)) < budget else (low, rate)
    return [min(c, high * w) for c, w in zip(caps, weights)]


def test_shortages_go_to_siblings_first(spark):
    rng = random.Random(3)
    for _ in range(6):
        caps, weights = [rng.randint(0, 1000) for _ in range(7)], [rng.randint(1, 9) for _ in range(7)]
        budget = rng.randint(0, sum(caps))
        rows = spark.createDataFrame([("p", str(i), c, w, budget) for i, (c, w) in enumerate(zip(caps, weights))], "domain string, lang string, cap long, weight long, budget long")
        got = [r.given for r in mixing.share_out(rows, ["domain"]).orderBy("lang").collect()]
        assert all(abs(g - w) <= 1 for g, w in zip(got, filled(budget, caps, weights)))
    leaves = spark.createDataFrame([("a", "x", "1", 10, 1), ("a", "y", "1", 1000, 9), ("b", "x", "1", 1000, 9)], "domain string, lang string, source string, tokens long, docs long")
    none = spark.createDataFrame([], "domain string, lang string, source string, weight long")
    got = {(r.domain, r.lang): r.budget for r in mixing.budgets(leaves, none, 400, 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 190, ("b", "x"): 200}


def test_mix_of_odd_rows(spark, clashing, empty):
    weights = queries.weights(spark)
    for small in (50_000, 0):  # broadcast and salted
        out = mixing.mix(clashing, weights, queries.domain_of(), max_epochs=3, small=small).collect()
        assert out[0].kept == "own" and all(0 <= r.epoch < 3 for r in out)
        assert len({(r.doc_id, r.text, r.lang, r.epoch) for r in out}) >= len({(r.doc_id, r.text, r.lang) for r in out})
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in ODD)
    whole = mixing.mix(clashing, weights, queries.domain_of(), total=10**9, max_epochs=2).collect()
    assert sum(r.tokens for r in whole) == 2 * total == 2 * sum(r.tokens for r in whole if r.epoch == 0)
    assert mixing.mix(empty, weights, queries.domain_of()).count() == 0
    none = mixing.mix(clashing, weights, queries.domain_of(), total=0)
    assert none.count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment():
    rng = random.Random(3)
    for _ in range(3000):
        a = [rng.randint(0, 3) for _ in range(rng.randint(0, 14))]
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            i = rng.randint(0, len(b))
            b[i:i + rng.randint(0, 1)] = [rng.randint(0, 3)] * rng.randint(0, 1)
        most = rng.randint(0, 8)
        assert neardup.edits_within(a, b, most) == (edits(a, b) <= most)


def test_sketch_keeps_order_and_occurrences():
    settings = neardup.Settings()
    words = neardup.word_hashes(" ".join(f"w{i}" for i in range(60)))
    swapped = np.concatenate([words[30:], words[:30]])
    again = np.concatenate([words, words])
    assert (neardup.sketch(words, settings) == neardup.sketch(words.copy(), settings)).all()
    assert (neardup.sketch(words, settings) != neardup.sketch(swapped, settings)).any()
    assert (neardup.sketch(words, settings) != neardup.sketch(again, settings)).any()
    assert len(neardup.sketch(words[:2], settings)) == settings.sketches


def near_copy(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.randint(0, 10**9)}"
    return out


def brute_classes(texts, similarity=0.8):
    parent = {k: k for k in texts}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k
    keys = list(texts)
    for x, i in enumerate(keys):
        for j in keys[:x]:
            a, b = texts[i].split(), texts[j].split()
            if top(i) != top(j) and (texts[i] == texts[j] or a and b and edits(a, b) <= int((1 - similarity) * max(len(a), len(b)) + 1e-9)):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    return {k: top(k) for k in texts}


@pytest.mark.parametrize("settings", [neardup.Settings(), neardup.Settings(hot=5, block=4, small=0)])
def test_classes_equal_brute_force(spark, settings):
    rng = random.Random(8)
    texts = {}
    for _ in range(14):
        words = [f"v{rng.randint(0, 4000)}" for _ in range(rng.randint(30, 60))]
        for copy in range(rng.choice([1, 1, 2, 9])):
            texts[len(texts) + 1] = " ".join(near_copy(rng, words, rng.randint(0, 3) if copy else 0))
    passage = " ".join(f"p{i}" for i in range(20))
    for _ in range(10):
        texts[len(texts) + 1] = " ".join([f"v{rng.randint(0, 4000)}" for _ in range(30)]) + " " + passage
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.classes(rows, settings).collect()}
    assert got == brute_classes(texts)
    kept = neardup.keep_one(rows, settings)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


@pytest.mark.parametrize("settings", [neardup.Settings(), neardup.Settings(hot=50, part=16, small=0, settled=40)])
def test_texts_with_a_long_common_passage(spark, settings):
    """Most pairs of a group are just too far apart, the group's first one included."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(78)]
    texts = {k: passage + [f"v{rng.randint(0, 60)}" for _ in range(22)] for k in range(150)}
    near = {(a, b) for a in texts for b in range(a) if neardup.edits_within(texts[a], texts[b], 20)}
    label = {k: k for k in texts}
    for _ in texts:
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    assert len(near) < 150 * 149 / 4 and len(set(label.values())) < 30
    rows = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in neardup.classes(rows, settings).collect()} == label


def test_scattered_edits_are_found(spark):
    """All pairs of few words, with edits of every kind, and nearly all of longer ones down to a similarity of 0.8."""
    rng = random.Random(12)
    rows, few, longer = [], [], []
    for n in [*range(5, 15)] * 6 + [15, 20, 30, 50, 79, 81, 100, 300] * 12:
        words = [f"v{rng.randint(0, 10**9)}" for _ in range(n)]
        allowed = int(0.2 * n + 1e-9)
        other = near_copy(rng, words, allowed)
        if n < 15 and rng.random() < 0.5:  # the copy is shorter
            other = near_copy(rng, words, allowed - 1)
            del other[rng.randrange(n)]
        (few if n < 15 else longer).append(len(rows))
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    rows += [(len(rows) + k, t) for k, t in enumerate(["a b c d e", "a b X d e", "k l m n", "k l Y n"])]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k + 1] == k for k in few) and got[len(rows) - 3] == len(rows) - 4 and got[len(rows) - 1] == len(rows) - 1
    assert sum(got[k + 1] == k for k in longer) >= 0.97 * len(longer)
    assert all(got[k] == k for k in [*few, *longer])


def test_classes_of_odd_rows(spark, clashing, empty):
    rows = [tuple(r) for r in neardup.classes(clashing).select("doc_id", "class_id", "class_size").collect()]
    assert len(rows) == len(ODD)
    assert sorted(r for r in rows if r[0] in (1, 2)) == [(1, 1, 2), (2, 1, 2)] and (3, 3, 1) in rows and (7, 7, 1) in rows
    assert [r for r in rows if r[0] == 8] == [(8, 8, 4)] * 3 and (None, 8, 4) in rows
    kept = neardup.keep_one(clashing)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 3, 4, 5, 6, 7, 8, 9, -10, 11])) and kept.columns == clashing.columns
    assert neardup.classes(empty).count() == 0 and neardup.keep_one(empty).count() == 0
    longer = spark.createDataFrame([(1, LONG), (2, LONG + " more"), (3, LONG[:len(LONG) // 2])], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in neardup.classes(longer).collect()} == {1: 1, 2: 1, 3: 3}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(1000, 900)], "a long, b long")
    labels = {r.node: r.label for r in neardup.components(edges).collect()}
    assert {labels[i] for i in range(201)} == {0} and labels[1000] == 900


def test_budgets_leave_out_what_lies_below_a_weight_of_zero(spark):
    leaves = spark.createDataFrame([("a", "en", "s", 1000, 1), ("a", "de", "s", 100, 1), ("b", "en", "s", 1000, 1), ("b", None, "s", 50, 1)],
                                   "domain string, lang string, source string, tokens long, docs long")
    weights = spark.createDataFrame([("a", "en", "s", 0), ("a", None, None, 1), ("b", None, None, 1)],
                                    "domain string, lang string, source string, weight long")
    got = {(r.domain, r.lang): r.budget for r in mixing.budgets(leaves, weights, 1000, 1).collect()}
    assert got == {("a", "en"): 0, ("a", "de"): 100, ("b", "en"): 850, ("b", None): 50}
