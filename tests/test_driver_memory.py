"""Sides of joins that grow with the data are not collected by the driver, however small the plan takes them to be."""
import contextlib
import io

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from curbloop.operators import layout, matching, network, spatial

SF = "/root/testdata/sf0.001"


def collected(df) -> list[str]:
    """Joins of the plan whose one side is broadcast, but for those with a fixed list of rows."""
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return [line.strip() for line in text.getvalue().splitlines() if "BroadcastHashJoin" in line]


# a row for each of which the plan sees one, and there are a hundred
def streets(spark):
    return spark.range(4).selectExpr("id AS c", "explode(sequence(0L, 99L)) AS k").selectExpr(
        "c * 100 + k AS id", "c * 101 + k AS source", "c * 101 + k + 1 AS target", "1D AS cost", "1D AS reverse_cost", "41 AS clazz",
        "array(named_struct('x', 100D * k, 'y', 1000D * c), named_struct('x', 100D * k + 100, 'y', 1000D * c)) AS geom_way")


@pytest.mark.parametrize("name", ["household_traces", "matched_in_buffer", "lot_zone", "curb_distance", "parking_context", "nearest_lot", "end_block_group",
                                  "approach_metrics", "approach_slices", "turn_restrictions", "street_block_ids", "patched_streets", "large_lots"])
def test_query_collects_no_layer(spark, name):
    assert collected(entry.queries()[name](spark, SF)) == []


def test_grid_joins(spark):
    segments = spatial.street_segments(streets(spark).select("id", "geom_way"))
    points = spark.range(50).selectExpr("id AS pid", "40D * id AS x", "3D AS y")
    near = spatial.near_segments(points, segments, 20.0, ["pid"])
    assert collected(near) == [] and near.count() == 50 + 9
    inside = spatial.inside_polygons(points, segments, "id", ["pid"])
    assert collected(inside) == []


def test_salted_join(spark):
    big, small = spark.range(300).selectExpr("id", "id % 3 AS k"), spark.range(3).selectExpr("id AS k", "explode(sequence(1, 2)) AS v")
    joined = layout.skew_join(big, small, ["k"], ["id"], max_rows=30)
    assert all("copies" in line or "k#" in line for line in collected(joined)) and joined.count() == 600
    plain = layout.skew_join(big, small, ["k"], ["id"])
    assert collected(plain) == [] and plain.count() == 600


def test_network_joins(spark):
    arcs = network.arcs_of(streets(spark))
    bans = spark.createDataFrame([(0, 1)], "source_id long, target_id long")
    turns = network.turns_of(arcs, bans)
    assert collected(turns) == [] and turns.count() == 4 * 2 * 99 + 8 - 1  # two dead ends a row
    cut = network.cut_off(spark.createDataFrame([(0, 2, 0.0)], "src long, to long, cost double"), network.hops_of(arcs, turns),
                          spark.createDataFrame([(0, 0.5)], "src long, cap double"))
    assert collected(cut) == [] and [r.src for r in cut.collect()] == [0]


@pytest.mark.parametrize("via", [False, True])
def test_frontier_shuffled_or_broadcast(spark, via):
    arcs = network.arcs_of(streets(spark))
    hops = network.hops_of(arcs, network.turns_of(arcs), via)
    sources = spark.createDataFrame([(0, 9.0), (101, 3.0), (250, 0.0)], "src long, cap double")
    want = sorted(map(tuple, network.reach(sources, hops, via).collect()), key=repr)
    assert want and all(r[2] <= {0: 9, 101: 3, 250: 0}[r[0]] for r in want) and max(r[2] for r in want) > 8
    assert sorted(map(tuple, network.reach(sources, hops, via, known_rows=0).collect()), key=repr) == want
    # a search gone on with from an earlier one with lower caps ends in the same states
    early = network.reach(sources.withColumn("cap", F.col("cap") / 3), hops, via)
    assert sorted(map(tuple, network.reach(sources, hops, via, settled=early).collect()), key=repr) == want


def test_link_joins(spark):
    cands = spark.createDataFrame([(1, p, 10 * p, 1.0 * p, 0.0, 2 * a, 0.5, 100.0, -1.0) for p in (1, 2, 3) for a in (1, 2)],
                                  "trip_id long, ptid long, t long, x double, y double, arc long, pos double, length double, emission double")
    pairs = matching.link_pairs(cands)
    assert collected(pairs) == [] and pairs.count() == 8


@pytest.mark.parametrize("batch", [2, 10_000])
def test_parts_are_judged_in_one_flow(spark, monkeypatch, batch):
    """Parts that go on in the next batch of rows, and one row written per part instead of one per point."""
    from curbloop.operators import cleaning
    from curbloop.params import Params
    from tests.test_plans import clean, plain_clean
    written, real = [], cleaning.stage
    monkeypatch.setattr(cleaning, "stage", lambda df, name: (written.append((name, out := real(df, name))), out)[1])
    traces = {trip: [(10 * k, 50.0 * k + (9000.0 if (k * 7 + trip) % 10 < 4 else 0.0), 0.0) for k in range(40)] for trip in range(1, 6)}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert clean(spark, traces, part_rows=7) == {trip: plain_clean(points) for trip, points in traces.items()}
        assert all(df.count() == 5 * 6 for name, df in written if name == "judged")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_text_of_a_layer_is_read_once(spark, tmp_path):
    from curbloop.sources import readers
    readers.export_csv(streets(spark), str(tmp_path / "streets"))
    back = readers.read_layer(spark, str(tmp_path / "streets"), "streets")
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        back.explain()
    assert "FileScan csv" not in text.getvalue()
    want = sorted(map(tuple, streets(spark).select("id", "geom_way").collect()))
    assert sorted(map(tuple, back.select("id", "geom_way").collect())) == want
