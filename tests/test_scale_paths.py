"""Salting, parts and stretches give the same rows as the plain way."""
import itertools
import random

import pytest
from pyspark.sql import functions as F

from curbloop.operators import layout, matching, spatial, trips
from curbloop.params import Params


def test_salted_join_equals_join(spark):
    big = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 7, id % 50) AS k")
    small = spark.range(50).selectExpr("id AS k", "id * 2 AS v").union(spark.range(5).selectExpr("7L AS k", "id AS v"))
    want = sorted(map(tuple, big.join(small, "k").select("id", "k", "v").collect()))
    got = layout.skew_join(big, small, ["k"], ["id"], max_rows=30)
    assert sorted(map(tuple, got.select("id", "k", "v").collect())) == want
    left = layout.skew_join(big, small.filter("k < 5"), ["k"], ["id"], max_rows=30, how="left")
    assert left.count() == 3000


def points(spark, sizes):
    return spark.createDataFrame([(t, i + 1, 10 * i, float(i * i), float(t)) for t, n in sizes.items() for i in range(n)],
                                 "trip_id long, ptid long, t long, x double, y double")


@pytest.mark.parametrize("part_rows", [3, 5, 1000])
def test_parts(spark, part_rows):
    df = points(spark, {1: 17, 2: 3, 3: 1})
    lagged = layout.with_lags(df, ["x"], 2, part_rows)
    got = {(r.trip_id, r.ptid): (r.prev1 and r.prev1.x, r.prev2 and r.prev2.x) for r in lagged.collect()}
    assert len(got) == 21
    for (t, i), (p1, p2) in got.items():
        assert p1 == ((i - 2) ** 2 if i > 1 else None) and p2 == ((i - 3) ** 2 if i > 2 else None)
    thin = layout.renumber(df.filter("ptid % 4 <> 2"), part_rows)
    for t, rows in itertools.groupby(sorted((r.trip_id, r.ptid, r.t) for r in thin.collect()), key=lambda r: r[0]):
        rows = list(rows)
        assert [r[1] for r in rows] == list(range(1, len(rows) + 1)) and [r[2] for r in rows] == sorted(r[2] for r in rows)
    parts = trips.line_parts(df, Params(part_rows=part_rows))
    assert parts.select(F.max(F.size("line"))).first()[0] <= part_rows


def test_dense_ids(spark):
    got = layout.dense_ids(spark.range(500).selectExpr("id % 90 AS d", "id AS s"), ["d"], ["d", "s"], buckets=16)
    assert sorted(r.trip_id for r in got.collect()) == list(range(1, 501))


@pytest.mark.parametrize("level", [2, 7, 4096])
def test_buckets_follow_rows(spark, level):
    rows = spark.range(500).selectExpr("id AS d")
    got = layout.dense_ids(rows, ["d"], ["d"], buckets=4, rows_per_bucket=3, level=level)
    assert sorted(r.trip_id for r in got.collect()) == list(range(1, 501))
    plain = {r.d: r.trip_id for r in layout.dense_ids(rows, ["d"], ["d"], buckets=167).collect()}
    assert {r.d: r.trip_id for r in got.collect()} == plain
    assert layout.dense_ids(rows.limit(0), ["d"], ["d"]).count() == 0


def busy_pings(spark):
    """One device holds half of all pings in one hour, most of its seconds several times; ten others are spread out."""
    rng = random.Random(8)
    rows = []
    for i in range(3000):
        t = rng.randrange(0, 500) if i % 3 else rng.randrange(1500, 3600)
        rows.append((i, "busy", t * 1000 + rng.randrange(1000), t, rng.uniform(0, 300), rng.uniform(0, 300)))
    for d in range(10):
        rows += [(10_000 + 300 * d + i, f"d{d}", (t := d * 977 + i * 45) * 1000, t, i * 20.0, d * 5.0) for i in range(300)]
    return spark.createDataFrame(rows, "gid long, device_id string, ts_ms long, t long, x double, y double")


@pytest.mark.parametrize("chunk_rows, known_keys", [(40, 100), (333, 100), (40, 0)])
def test_full_hours_are_cut(spark, chunk_rows, known_keys):
    rows = busy_pings(spark).withColumn("chunk", F.expr("t div 3600"))
    cut = layout.slots(rows, ["device_id", "chunk"], "t", chunk_rows, known_keys=known_keys)
    sizes = [r["count"] for r in cut.groupBy("device_id", "chunk", "slot").count().collect()]
    second = max(r["count"] for r in rows.groupBy("device_id", "t").count().collect())
    assert max(sizes) < chunk_rows + second and cut.count() == rows.count()
    assert cut.groupBy("device_id", "t").agg(F.count_distinct("slot").alias("n")).filter("n > 1").count() == 0
    busy = sorted((r.t, r.slot) for r in cut.filter("device_id = 'busy'").collect())
    assert [s for _, s in busy] == sorted(s for _, s in busy) and len({s for _, s in busy}) > 3000 // (2 * chunk_rows)


@pytest.mark.parametrize("chunk_rows", [1, 40, 333])
def test_cut_hours_do_not_change_trips(spark, chunk_rows):
    rows = busy_pings(spark)
    base = trips.segment_trips(rows, Params(trip_pings_min=5, chunk_rows=10**9))
    cut = trips.segment_trips(rows, Params(trip_pings_min=5, chunk_rows=chunk_rows))
    want = sorted(map(tuple, base.select(sorted(base.columns)).collect()), key=repr)
    assert want and sorted(map(tuple, cut.select(sorted(cut.columns)).collect()), key=repr) == want


@pytest.mark.parametrize("size", [2, 3, 7, 100])
def test_stretches_decode_the_best_chain(spark, size):
    rng = random.Random(4)
    rows, best = [], {}
    for trip, n in {1: 11, 2: 2, 3: 5}.items():
        score = {(k, a, b): rng.uniform(-9, 0) for k in range(n) for a in range(3) for b in range(3) if rng.random() < 0.9}
        rows += [(trip, k, a, b, s, n) for (k, a, b), s in score.items()]
        chains = {(a,): 0.0 for a in range(3)}
        for k in range(n):
            chains = {c + (b,): s + score[k, c[-1], b] for c, s in chains.items() for b in range(3) if (k, c[-1], b) in score}
            chains = dict(sorted(chains.items(), key=lambda c: -c[1])[:3000]) if len(chains) > 30000 else chains
        best[trip] = max(chains.items(), key=lambda c: c[1])[0]
    links = spark.createDataFrame(rows, "trip_id long, k long, a long, b long, score double, n_steps long")
    got = {}
    for r in sorted(matching.best_chains(links, Params(viterbi_steps=size)).collect(), key=lambda r: (r.trip_id, r.k)):
        got.setdefault(r.trip_id, [r.a]).append(r.b)
    assert {t: tuple(c) for t, c in got.items()} == best


def test_broken_chain_gives_no_match(spark):
    links = spark.createDataFrame([(1, 0, 0, 0, -1.0, 3), (1, 2, 0, 0, -1.0, 3)], "trip_id long, k long, a long, b long, score double, n_steps long")
    for size in (2, 10):
        assert matching.best_chains(links, Params(viterbi_steps=size)).count() == 0


def test_grid_join_equals_brute_force(spark):
    rng = random.Random(2)
    pts = [(i, rng.uniform(-300, 300), rng.uniform(-300, 300)) for i in range(200)]
    segs = [(i, *(rng.uniform(-300, 300) for _ in range(4))) for i in range(40)]
    p = spark.createDataFrame(pts, "pid long, x double, y double")
    s = spark.createDataFrame(segs, "sid long, x1 double, y1 double, x2 double, y2 double")
    for radius, size in ((20.0, None), (35.0, 10.0), (5.0, 200.0)):
        got = {(r.pid, r.sid) for r in spatial.near_segments(p, s, radius, ["pid"], size).select("pid", "sid").collect()}
        want = {(a[0], b[0]) for a in pts for b in segs if _gap(a, b) <= radius}
        assert got == want


def _gap(p, s):
    dx, dy = s[3] - s[1], s[4] - s[2]
    u = max(0, min(1, ((p[1] - s[1]) * dx + (p[2] - s[2]) * dy) / (dx * dx + dy * dy)))
    return ((p[1] - s[1] - u * dx) ** 2 + (p[2] - s[2] - u * dy) ** 2) ** 0.5


def test_polygon_with_hole(spark):
    rings = [("a", 0, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (900, 0), (900, 900), (0, 900), (0, 0)])]
    rings += [("a", 1, i, float(x), float(y)) for i, (x, y) in enumerate([(300, 300), (600, 300), (600, 600), (300, 600), (300, 300)])]
    sides = spatial.ring_segments(spark.createDataFrame(rings, "poly string, ring int, seq int, x double, y double"), "poly")
    pts = spark.createDataFrame([(1, 100.0, 450.0), (2, 450.0, 450.0), (3, 700.0, 100.0), (4, 950.0, 10.0), (5, 900.0, 10.0)], "id long, x double, y double")
    for size in (70.0, 500.0):
        assert {r.id for r in spatial.inside_polygons(pts, sides, "poly", ["id"], size).collect()} == {1, 3, 5}
    assert spatial.polygon_area(sides, "poly").first().area == 900 * 900 - 300 * 300


def test_known_route_in_order(spark):
    from cases import network as known
    from cases import inputs
    sf = "/root/testdata/sf0.001"
    matched = matching.map_match(known.driven_points(spark, sf).filter("trip_id < 4"), inputs.streets(spark, sf), None,
                                 Params(match_radius=25, viterbi_steps=16, part_rows=50))
    got, want = {}, {}
    for r in sorted(matched["visits"].collect(), key=lambda r: (r.trip_id, r.seq)):
        got.setdefault(r.trip_id, []).append(r.edge_id)
    for r in sorted(known.known_drives(spark, sf).filter("trip_id < 4").collect(), key=lambda r: (r.trip_id, r.step)):
        want.setdefault(r.trip_id, []).append(r.edge_id)
    assert got == want
