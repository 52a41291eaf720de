"""Boundaries and quirks on rows small enough to check by hand."""
import math

import pytest
from pyspark.sql import functions as F

from curbloop.functions import clock, geo
from curbloop.functions.projection import project_sql
from curbloop.operators import approach, classify, matching, network, trips
from curbloop.params import LambertZone, Params


def pings(spark, device, rows):
    """rows: (seconds, x) along a line."""
    return spark.createDataFrame([(i, device, int(t * 1000), int(t), float(x), 0.0) for i, (t, x) in enumerate(rows)],
                                 "gid long, device_id string, ts_ms long, t long, x double, y double")


def trips_of(spark, rows, **params):
    points = trips.segment_trips(pings(spark, "a", rows), Params(**{"trip_pings_min": 0, **params}))
    return [(r.trip_seq, r.ptid, r.t) for r in points.orderBy("t", "gid").collect()]


STEADY = [(60 * i, 500.0 * i) for i in range(6)]


@pytest.mark.parametrize("pause, n_trips", [(600, 1), (601, 2)])
def test_pause(spark, pause, n_trips):
    rows = STEADY + [(300 + pause + 60 * i, 3000.0 + 500 * i) for i in range(4)]
    assert max(s for s, _, _ in trips_of(spark, rows)) == n_trips


def test_stationary_restart_fuses_trips(spark):
    rows = STEADY + [(1000, 2500.0), (1060, 3000.0), (1120, 3500.0)]
    got = trips_of(spark, rows)
    assert {s for s, _, _ in got} == {1} and 1000 not in {t for _, _, t in got}


def test_speed_limit_is_exclusive(spark):
    at_limit = STEADY + [(300 + 36, 2500.0 + 1300)]
    below = STEADY + [(300 + 36, 2500.0 + 1299)]
    assert len(trips_of(spark, at_limit)) == 6 and len(trips_of(spark, below)) == 7


@pytest.mark.parametrize("n, kept", [(2, 0), (3, 3)])
def test_device_minimum(spark, n, kept):
    assert len(trips_of(spark, STEADY[:n])) == kept


@pytest.mark.parametrize("n, kept", [(10, 0), (11, 11)])
def test_trip_minimum(spark, n, kept):
    assert len(trips_of(spark, [(60 * i, 500.0 * i) for i in range(n)], trip_pings_min=10)) == kept


@pytest.mark.parametrize("chunk_secs", [1, 7, 100, 1000, 10**6])
def test_chunks_do_not_change_trips(spark, chunk_secs):
    rows = []
    t = 0
    for i in range(120):
        t += 700 if i % 37 == 0 else (i * 7) % 50
        rows.append((t, 300.0 * i + (i % 5) * 11))
    base = trips.segment_trips(pings(spark, "a", rows), Params(trip_pings_min=5, chunk_secs=10**9))
    cut = trips.segment_trips(pings(spark, "a", rows), Params(trip_pings_min=5, chunk_secs=chunk_secs))
    assert sorted(map(tuple, base.collect()), key=repr) == sorted(map(tuple, cut.collect()), key=repr)


def line(spark, rows, in_lot=None):
    """rows: (ptid, t, x[, in_lot]) -> points and ends; trips end at the last point."""
    df = spark.createDataFrame([(1, i + 1, int(r[0]), float(r[1]), 0.0, (r[2] if len(r) > 2 else in_lot)) for i, r in enumerate(rows)],
                               "trip_id long, ptid long, t long, x double, y double, in_lot boolean")
    return df, trips.trip_ends(df)


def metrics_of(spark, rows, **params):
    return approach.truncate_traces(*line(spark, rows), Params(**params)).first()


def test_equal_seconds_merge(spark):
    rows = [(0, 0), (10, 100), (10, 110), (20, 200), (60, 600)]
    got = metrics_of(spark, rows)
    assert got.npings == 4
    steps = approach.approach_points(*line(spark, rows)).filter("t = 10").first()
    assert (steps.ptid, steps.timedelta, steps.distdelta) == (3, 10, 110.0)


def test_one_hz_takes_the_two_step_distance(spark):
    rows = [(0, 0), (1, 10), (2, 20), (3, 30), (10, 40)]
    got = {r.t: r.distdelta for r in approach.approach_points(*line(spark, rows)).collect()}
    assert got[2] == 20 and got[3] == 20 and got[1] == 10 and got[10] == 10


def test_never_above_walking_speed(spark):
    got = metrics_of(spark, [(10 * i, i) for i in range(20)])
    assert got.id_walk == 1 and got.id_park == 1


def test_parking_starts_with_the_last_run(spark):
    rows = [(10 * i, 100 * i, i in (3, 4, 6, 7, 8, 9)) for i in range(10)]
    got = metrics_of(spark, rows)
    assert (got.id_walk, got.id_park, got.npingspark) == (10, 7, 3)


@pytest.mark.parametrize("chunk_secs", [30, 45, 60, 3600])
def test_hours_do_not_change_metrics(spark, chunk_secs):
    rows = [(7 * i + i % 3, 60 * i + (i % 4) * 9, i > 20 and i != 24) for i in range(40)]
    assert metrics_of(spark, rows, chunk_secs=chunk_secs, part_rows=4) == metrics_of(spark, rows)


def test_no_lot_layer(spark):
    got = metrics_of(spark, [(10 * i, 100 * i, None) for i in range(10)])
    assert got.id_park == got.id_walk == 10


def test_empty_slice_drops_trip(spark):
    points, ends = line(spark, [(10 * i, 100 * i) for i in range(10)])
    cuts = spark.createDataFrame([(1, 6, 9, 4)], "trip_id long, id_first long, id_walk long, id_park long")
    assert approach.slice_summary(approach.slice_points(points, ends, cuts)).count() == 0


def flags(spark, **values):
    row = {"matchdist": 500.0, "netwkdist": 490.0, "ids_repeat": 0, "max_dist": 500.0, "inbuffer_length": 400.0, "drive_secs": 100,
           "match_score": 0.95, "end_clazz": 41, "pingtime_mean": 10.0, "pingtime_max": 20, **values}
    kinds = {"ids_repeat": "long", "drive_secs": "long", "end_clazz": "int", "pingtime_max": "long"}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds.get(k, 'double')}" for k in row))
    df = df.selectExpr("*", *[f"0D AS {c}" for c in ("start_x", "start_y", "end_x", "end_y", "park_x", "park_y")])
    return classify.flag_usable(classify.classify_cruise(classify.add_distances(df))).first()


def test_repeats_without_route(spark):
    got = flags(spark, netwkdist=None, ids_repeat=2)
    assert (got.dist_ratio, got.cruise, got.high_cruise, got.cruise_time) == (None, True, None, None)


def test_route_without_match(spark):
    got = flags(spark, matchdist=None, netwkdist=100.0)
    assert (got.dist_ratio, got.cruise) == (1.0, False)


@pytest.mark.parametrize("excess, cruise, high", [(5, False, False), (5.5, True, False), (200, True, False), (200.5, True, True)])
def test_excess(spark, excess, cruise, high):
    got = flags(spark, matchdist=1000.0, netwkdist=1000.0 - excess, inbuffer_length=900.0)
    assert (got.cruise, got.high_cruise) == (cruise, high)
    assert got.cruise_time == (pytest.approx(excess / 10) if high else 0)


def test_unscored_trip_is_not_usable(spark):
    assert flags(spark, match_score=None).use_trip is False and flags(spark).use_trip is True


def test_weekdays(spark):
    days = spark.sql("SELECT explode(array(null, date'2022-12-25', date'2023-12-25', date'2022-11-24', date'2022-11-23')) AS d")
    plain = [r[0] for r in days.select(clock.is_workday(F.col("d"))).collect()]
    fixed = [r[0] for r in days.select(clock.is_workday(F.col("d"), True)).collect()]
    assert plain == [False, False, False, True, True] and fixed == [False, False, False, False, True]


def test_lambert_worked_example(spark):
    zone = LambertZone(33, 45, 23, -96, 0, 0, a=6378206.4, inv_f=1 / (1 - math.sqrt(1 - 0.00676866)))
    x, y = project_sql("-75D", "35D", zone)
    got = spark.sql(f"SELECT {x} AS x, {y} AS y").first()
    assert got.x == pytest.approx(1894410.9, abs=0.1) and got.y == pytest.approx(1564649.5, abs=0.1)


def test_text_round_trips(spark):
    got = spark.sql("SELECT array(named_struct('x', 1.5D, 'y', -2D, 'm', 7L), named_struct('x', 3D, 'y', 4D, 'm', 9L)) AS l, "
                    "'(37.5, -122.25)' AS m").select(
        geo.line_from_wkt(f"'LINESTRING M (1.5 -2.0 7, 3.0 4.0 9)'").alias("back"), "l", geo.line_to_wkt("l").alias("wkt"),
        geo.point_from_lat_lon_text("m").alias("p"), geo.remove_point("l", 1).alias("less"), geo.reverse_if("l", "true").alias("rev"),
        geo.merge_lines("array(l, reverse(l))").alias("merged")).first()
    assert got.back == got.l and got.wkt == "LINESTRING M (1.5 -2.0 7, 3.0 4.0 9)" and (got.p.x, got.p.y) == (-122.25, 37.5)
    assert got.less == got.l[1:] and got.rev == got.l[::-1] and len(got.merged) == 3


def square(spark):
    """1 -a-> 2 -b-> 3 and the long way round 2 -c-> 4 -d-> 3; all two-way."""
    rows = [(1, 1, 2, 0.0, 0.0, 100.0, 0.0), (2, 2, 3, 100.0, 0.0, 200.0, 0.0),
            (3, 2, 4, 100.0, 0.0, 100.0, 100.0), (4, 4, 3, 100.0, 100.0, 200.0, 0.0)]
    return spark.createDataFrame(rows, "id long, source long, target long, x1 double, y1 double, x2 double, y2 double").selectExpr(
        "id", "source", "target", "0.01D AS cost", "0.01D AS reverse_cost", "41 AS clazz",
        "array(named_struct('x', x1, 'y', y1), named_struct('x', x2, 'y', y2)) AS geom_way")


def route(spark, pairs, bans=()):
    trips_ = spark.createDataFrame(pairs, "trip_id long, edge_a long, frac_a double, edge_b long, frac_b double")
    banned = spark.createDataFrame(list(bans), "source_id long, target_id long") if bans else None
    return {r.trip_id: r.netwkdist for r in network.network_distance(trips_, square(spark), banned).collect()}


def test_routes(spark):
    got = route(spark, [(1, 1, 0.2, 1, 0.7), (2, 1, 0.5, 2, 0.25), (3, 2, 0.9, 1, 0.9)])
    assert got == {1: pytest.approx(50), 2: pytest.approx(75), 3: pytest.approx(100)}


def test_banned_turn_forces_a_detour(spark):
    assert route(spark, [(1, 1, 0.5, 2, 0.5)], [(1, 2)])[1] == pytest.approx(50 + 100 + 100 * math.sqrt(2) + 50)


def test_no_legal_route(spark):
    assert route(spark, [(1, 1, 0.5, 2, 0.5)], [(1, 2), (1, 3), (1, 1)])[1] is None


def test_repeated_streets(spark):
    visits = spark.createDataFrame([(1, i, e) for i, e in enumerate([5, 6, 5, 7, 5, 7])], "trip_id long, seq int, edge_id long")
    got = matching.edge_summary(visits).first()
    assert (got.ids_repeat, got.edge_id_start, got.edge_id_end) == (5, 5, 7)


def test_street_through_the_notch_of_a_block(spark):
    """A street between the arms of a U-shaped block is not in it; one along its base or on its inner side is."""
    from curbloop.operators import studies
    corners = [(0, 0), (100, 0), (100, 60), (70, 60), (70, 20), (30, 20), (30, 60), (0, 60), (0, 0)]
    sides = [(7, 0, k, float(a[0]), float(a[1]), float(b[0]), float(b[1])) for k, (a, b) in enumerate(zip(corners, corners[1:]))]
    blocks = spark.createDataFrame(sides, "block_id long, ring int, seq int, x1 double, y1 double, x2 double, y2 double")
    lines = {1: [(0, 40), (100, 40)], 2: [(0, 10), (100, 10)], 3: [(20, 20), (80, 20)], 4: [(30 - 40 / 3, 50), (70 + 40 / 3, 50)],
             5: [(10, 50), (10, 10), (90, 10), (90, 50)]}
    streets = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in line]) for k, line in lines.items()],
                                    "id long, geom_way array<struct<x: double, y: double>>")
    got = {r.id: r.sfpark_id for r in studies.street_block_ids(streets, blocks).collect()}
    assert got == {1: None, 2: "00007", 3: "00007", 4: None, 5: "00007"}


def plain_frechet(a, b):
    best = {}
    for i, p in enumerate(a):
        for j, q in enumerate(b):
            before = [best[k] for k in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if k in best]
            best[i, j] = max(math.dist(p, q), min(before, default=0.0))
    return best[len(a) - 1, len(b) - 1]


@pytest.mark.parametrize("part_rows", [1, 4, 100])
def test_frechet_distance_in_any_blocks(spark, part_rows):
    import random

    from curbloop.operators.frechet import frechet_distance
    draw = random.Random(5)

    def lines(sizes):
        return {k: [(draw.uniform(0, 100), draw.uniform(0, 100)) for _ in range(n)] for k, n in enumerate(sizes)}

    a, b = lines([1, 1, 7, 12, 5, 3, 4]), lines([1, 6, 1, 9, 11, 3])

    def table(of):
        return spark.createDataFrame([(k, 1 + i, x, y) for k, line in of.items() for i, (x, y) in enumerate(line)], "trip_id long, ptid long, x double, y double")

    unplaced = spark.createDataFrame([(3, 13 + i, None, 1.0) for i in range(7)] + [(3, 20, 1.0, 1.0)], "trip_id long, ptid long, x double, y double")
    a[3].append((1.0, 1.0))
    got = {r.trip_id: r.frechet for r in frechet_distance(table(a).filter("trip_id <> 3 OR ptid < 13").unionByName(unplaced), table(b), part_rows).collect()}
    assert got == {k: plain_frechet(a[k], b[k]) for k in a if k in b}
    assert frechet_distance(table(a).limit(0), table(b), part_rows).count() == 0


@pytest.mark.parametrize("part_rows", [2, 1000])
def test_household_lines_follow_the_numbers_of_their_points(spark, part_rows):
    from curbloop.operators import studies
    points = spark.createDataFrame([(9, 1, 1, 40 + 7 * i, 100 + i, float(i), 0.0) for i in (4, 0, 3, 1, 2)] + [(9, 1, 2, -5, 60, 8.0, 0.0), (9, 1, 2, 1, 61, 8.0, 6.0)]
                                   + [(8, 1, 1, 1, 5, 0.0, 0.0)], "gpstripid long, sampno long, vehno long, localid long, t long, x double, y double")
    ends = spark.createDataFrame([(9, 1, 1, 0.0, 0.0), (9, 1, 2, 0.0, 0.0)], "gpstripid long, sampno long, vehno long, end_x double, end_y double")
    traces, lines = studies.household_lines(points, studies.household_traces(points, ends), params=Params(part_rows=part_rows))
    ids = {r.vehno: r.trip_id for r in traces.collect()}
    assert sorted(ids.values()) == [1, 2] and {"start_x", "end_x", "endtime"} <= set(traces.columns)
    assert [tuple(r)[1:] for r in lines.filter(F.col("trip_id") == ids[1]).orderBy("ptid").collect()] == [(i + 1, 100 + i, float(i), 0.0) for i in range(5)]
    assert {r.trip_id: r.length for r in trips.line_lengths(lines, Params(part_rows=2)).collect()} == {ids[1]: 4.0, ids[2]: 6.0}


def test_survey_lines_have_a_cruise_line_where_the_guide_gives_one(spark):
    from curbloop.operators import studies
    logs = spark.createDataFrame([(k, "a" + k, 1, 1_000_000, i, 500 * i, 37.7 + 1e-5 * (i // 2), -122.4) for k in "pq" for i in range(8)],
                                 "traceid string, trace string, day int, start_ms long, framenum long, frametime long, lat double, lon double")
    guide = spark.createDataFrame([("ap", 1, "V_home x", "0:00:02")], "trace string, day int, video string, elapsed string")
    traces, points, cruising = studies.survey_lines(logs, guide, "sf", Params(part_rows=3))
    ids = {r.traceid: r for r in traces.collect()}
    assert [(r.ptid, r.t) for r in points.filter(F.col("trip_id") == ids["p"].trip_id).orderBy("ptid").collect()] == [(i + 1, 1000 + i) for i in range(4)]
    assert [(r.trip_id, r.ptid, r.t) for r in cruising.orderBy("ptid").collect()] == [(ids["p"].trip_id, 1, 1002), (ids["p"].trip_id, 2, 1003)]
    assert ids["p"].dest == "home" and ids["q"].dest == "" and abs(ids["p"].end_y - ids["p"].start_y - 3.33) < 0.02
    x, y = project_sql("-122.4D", "37.70003D", "sf")
    assert abs(spark.range(1).select(F.expr(y)).first()[0] - ids["p"].end_y) < 1e-6 and spark.range(1).select(F.expr(x)).first()[0] > 0
