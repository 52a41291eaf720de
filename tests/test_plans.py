"""The chain: laps, restarts, errant pings and the command line."""
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cases import inputs, network as known
from curbloop.operators import cleaning, matching
from curbloop.params import Params
from curbloop.plans import run

SF = "/root/testdata/sf0.001"


def laps(spark, params):
    points = known.lap_points(spark, SF).filter("trip_id < 4")
    return matching.map_match(points, known.one_way_streets(spark, SF), None, params)


def test_caps_do_not_change_the_match(spark):
    found = []
    for params in (Params(match_radius=25, route_speed=0), Params(match_radius=25, route_factor=20), Params(match_radius=25, viterbi_steps=2)):
        matched = laps(spark, params)
        found.append((sorted(map(tuple, matched["visits"].collect())), sorted((r.trip_id, round(r.matchdist, 3)) for r in matched["trips"].collect())))
    assert found[0] == found[1] == found[2] and len(found[0][1]) == 4


def line_of_streets(spark, rows):
    return spark.createDataFrame(rows, "id long, source long, target long, cost double, reverse_cost double, clazz int, geom_way array<struct<x:double,y:double>>")


def test_no_legal_way_splits_the_match(spark):
    streets = line_of_streets(spark, [(1, 1, 2, 0.01, 1e6, 41, [(0.0, 0.0), (100.0, 0.0)]), (2, 3, 4, 0.01, 1e6, 41, [(300.0, 0.0), (400.0, 0.0)])])
    points = spark.createDataFrame([(7, k + 1, 10 * k, x, 1.0) for k, x in enumerate([10.0, 60.0, 310.0, 370.0])], "trip_id long, ptid long, t long, x double, y double")
    matched = matching.map_match(points, streets, None, Params(match_radius=25))
    trip = matched["trips"].first()
    assert trip.n_gaps == 1 and round(trip.matchdist, 6) == 110
    assert [r.edge_id for r in matched["visits"].orderBy("seq").collect()] == [1, 2]


def test_a_dead_end_is_driven_out_of(spark):
    streets = line_of_streets(spark, [(1, 1, 2, 0.01, 0.01, 41, [(0.0, 0.0), (200.0, 0.0)]), (2, 2, 3, 0.01, 0.01, 41, [(200.0, 0.0), (200.0, 150.0)])])
    spots = [(20.0, 0.0), (120.0, 0.0), (200.0, 50.0), (200.0, 140.0), (200.0, 60.0), (130.0, 0.0), (30.0, 0.0)]
    points = spark.createDataFrame([(1, k + 1, 60 * k, x, y) for k, (x, y) in enumerate(spots)], "trip_id long, ptid long, t long, x double, y double")
    matched = matching.map_match(points, streets, None, Params(match_radius=10))
    assert [r.edge_id for r in matched["visits"].orderBy("seq").collect()] == [1, 2, 2, 1] and matched["trips"].first().n_gaps == 0


def plain_clean(points, limit=130):
    kept = []
    for p in points:
        if kept:
            hours, km = (p[0] - kept[-1][0]) / 3600, ((p[1] - kept[-1][1]) ** 2 + (p[2] - kept[-1][2]) ** 2) ** 0.5 / 1000
            if km / hours > limit if hours > 0 else km > 0:
                continue
        kept.append(p)
    return kept


def clean(spark, traces, **params):
    rows = [(trip, k + 1, *p) for trip, points in traces.items() for k, p in enumerate(points)]
    table = spark.createDataFrame(rows, "trip_id long, ptid long, t long, x double, y double")
    out = {}
    for r in cleaning.drop_fast_points(table, Params(**params)).orderBy("trip_id", "ptid").collect():
        out.setdefault(r.trip_id, []).append((r.ptid, r.t, r.x, r.y))
    assert all([p[0] for p in points] == list(range(1, len(points) + 1)) for points in out.values())
    return {trip: [p[1:] for p in points] for trip, points in out.items()}


def test_errant_pings(spark):
    spike = [(10 * k, 100.0 * k + (5000.0 if k in (3, 4) else 0.0), 0.0) for k in range(8)]
    rng = random.Random(1)
    wild = [(10 * k, rng.choice([0.0, 0.0, 3000.0, 9000.0]) + k, 0.0) for k in range(60)]
    traces = {1: spike, 2: wild, 3: [(0, 0.0, 0.0), (0, 5.0, 0.0), (0, 0.0, 0.0)], 4: [(10 * k, 50.0 * k, 0.0) for k in range(30)]}
    want = {trip: plain_clean(points) for trip, points in traces.items()}
    assert want[1] == [p for k, p in enumerate(spike) if k not in (3, 4)]
    for part_rows in (5, 7, 1000):
        assert clean(spark, traces, part_rows=part_rows) == want


def test_passes_do_not_grow_with_fast_points(spark, monkeypatch):
    written = []
    real = cleaning.stage
    monkeypatch.setattr(cleaning, "stage", lambda df, name: (written.append(name), real(df, name))[1])
    passes = []
    for n in (10, 1000):
        trace = [(10 * k, (1e6 if 5 <= k < 5 + n else 0.0) + 10.0 * (k % 2), 0.0) for k in range(n + 20)]
        assert len(clean(spark, {1: trace})[1]) == 20
        passes.append(written.count("judged"))
        written.clear()
    assert passes == [1, 1]


def test_restart_and_fingerprint(spark, tmp_path, monkeypatch):
    calls = []
    folder = str(tmp_path / "stages")
    stages = run.Stages(spark, folder, fingerprint="a")
    for _ in range(2):
        stages.keep("x", lambda: (calls.append(1), spark.range(3))[1])
    assert len(calls) == 1 and run.Stages(spark, folder, fingerprint="a").keep("x", lambda: calls.append(1)).count() == 3
    with pytest.raises(ValueError):
        run.Stages(spark, folder, fingerprint="b")
    run.Stages(spark, folder, force=True, fingerprint="b").keep("x", lambda: spark.range(4))
    assert run.Stages(spark, folder, fingerprint="b").keep("x", lambda: calls.append(1)).count() == 4 and len(calls) == 1


def test_finished_chain_is_not_matched_again(spark, tmp_path, monkeypatch):
    points = inputs.drives(spark, SF).filter("trip_id < 2")
    from curbloop.operators import trips
    ends, layers = trips.trip_ends(points), run.Layers(inputs.streets(spark, SF).filter("id < 841"))
    calls, real = [], matching.map_match
    monkeypatch.setattr(matching, "map_match", lambda *a, **k: (calls.append(1), real(*a, **k))[1])
    rows = [sorted(map(str, run.classify_traces(ends, points, layers, stages=run.Stages(spark, str(tmp_path / "s"))).collect())) for _ in range(2)]
    assert len(calls) == 1 and rows[0] == rows[1] and len(rows[0]) == 2


def test_command_line_in_a_fresh_process(spark, tmp_path):
    points = inputs.drives(spark, SF).filter("trip_id < 2")
    line = points.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("t", "x", "y"))).alias("p"))
    line.select("trip_id", F.expr("transform(p, q -> named_struct('x', q.x, 'y', q.y, 'm', q.t))").alias("lines_geom"),
                F.expr("named_struct('x', p[size(p) - 1].x, 'y', p[size(p) - 1].y)").alias("end_geom")).write.parquet(str(tmp_path / "traces"))
    inputs.streets(spark, SF).filter("id < 841").write.parquet(str(tmp_path / "streets"))
    script = Path(run.__file__)
    command = [sys.executable, str(script), "--traces", str(tmp_path / "traces"), "--streets", str(tmp_path / "streets"), "--out", str(tmp_path / "out"),
               "--time-zone", "America/Los_Angeles", "--set", "match_radius=40"]
    env = {"PATH": "/usr/bin:/bin", "JAVA_HOME": __import__("os").environ.get("JAVA_HOME", ""), "PYSPARK_PYTHON": sys.executable,
           "SPARK_LOCAL_DIRS": str(tmp_path), "PYSPARK_SUBMIT_ARGS": "--master local[4] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=4 pyspark-shell"}
    done = subprocess.run(command, cwd=tmp_path, env={k: v for k, v in env.items() if v}, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert spark.read.parquet(str(tmp_path / "out" / "trips")).count() == 2


def test_parameters_from_text():
    params = run.parse_params(["match_radius=25", "fix_holidays=true", "viterbi_steps=9"], "UTC")
    assert (params.match_radius, params.fix_holidays, params.viterbi_steps) == (25.0, True, 9)
    with pytest.raises(SystemExit):
        run.parse_params(["nothing=1"])
