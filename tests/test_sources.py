"""Readers, contracts and writers on small files."""
import random
import struct

import pytest
from pyspark.sql import functions as F

from curbloop.functions import geo
from curbloop.operators import studies
from curbloop.params import Params
from curbloop.plans import run
from curbloop.sources import readers


def test_survey_logs(spark, tmp_path):
    names = "Frame Number,Frame Time (ms),Forward Acceleration,GPS Latitude.1,GPS Longitude.1"
    (tmp_path / "Data Log May 26 2015 03_10 PM.csv").write_text(f"written by the camera\n{names}\n1,0,0.5,37.7,-122.4\n2,400,0.5,,\n3,1400,0.1,37.8,-122.5\n")
    (tmp_path / "Data Log May 27 2015 02_51 PM.csv").write_text(f"{names}\n1,100,0.5,37.7,-122.4\n")
    (tmp_path / "Data Log May 27 2015 12_57 PM.csv").write_text(f"x\n{names}\n1,100,0.5,37.7,-122.4\n")
    logs = readers.read_survey_logs(spark, str(tmp_path), skip_files=["12_57"])
    got = sorted((r.traceid, r.trace, r.day, r.framenum, r.frametime, r.lat) for r in logs.collect())
    first, second = "May 26, 2015 03:10 PM", "May 27, 2015 02:51 PM"
    assert got[0] == (first, "03_10", 26, 1, 0, 37.7) and got[2] == (first, "03_10", 26, 3, 1400, 37.8)
    assert [r[0] for r in got] == [first] * 3 + [second]
    assert {r.start_ms for r in logs.filter("day = 26").collect()} == {1432653000000}
    guide = spark.createDataFrame([("03_10", 26, "V_12 x", "0:00:01")], "trace string, day int, video string, elapsed string")
    trips, points = studies.survey_traces(logs, guide)
    row = trips.filter("dest = '12'").first()
    assert (row.n_points, row.n_cruise, row.end_lat, row.t0) == (2, 1, 37.8, 1432653000)
    twice = guide.union(guide)
    with pytest.raises(Exception, match="more than one guide row"):
        studies.survey_traces(logs, twice)[0].collect()


def test_survey_logs_with_quoted_cells(spark, tmp_path):
    names = '"Frame Number","Note, of the driver",Frame Time (ms),Forward Acceleration,"GPS Latitude.1",GPS Longitude.1'
    (tmp_path / "Data Log May 26 2015 03_10 PM.csv").write_text(f'{names}\n1,"left, then ""right"", then left",0,0.5,"37.7",-122.4\n2,,400,"0.25",,\n3,",",800,,37.8,-122.5\n')
    rows = sorted((r.framenum, r.frametime, r.forward_accel, r.lat, r.lon) for r in readers.read_survey_logs(spark, str(tmp_path)).collect())
    assert rows == [(1, 0, 0.5, 37.7, -122.4), (2, 400, 0.25, None, None), (3, 800, None, 37.8, -122.5)]


def test_video_pings(spark, tmp_path):
    (tmp_path / "v.csv").write_text("Device,Trip,LocalDateTime,Latitude,Longitude\n3,5,2015-05-01 10:00:00.123,42.2,-83.7\n3,5,2015-05-01 10:00:01.123,0,0\n")
    rows = readers.read_video_pings(spark, str(tmp_path)).collect()
    assert [(r.trip_id, r.epoch, r.latitude) for r in rows] == [(60005, 1430474400, 42.2)]


def test_ping_ids_are_stable(spark, tmp_path):
    (tmp_path / "p.csv").write_text("".join(f'"d{i}","t",47.6,-122.3,10,{1704067200000 + i}' + ',"a, b"' * 10 + "\n" for i in range(5)))
    one, two = ({r.gid for r in readers.read_pings(spark, str(tmp_path)).collect()} for _ in range(2))
    assert one == two and len(one) == 5


def test_contract(spark):
    with pytest.raises(ValueError, match="end_geom"):
        readers.check(spark.sql("SELECT 1 AS trip_id, 2 AS lines_geom"), "traces")


def test_vendor_traces(spark):
    table = spark.sql("SELECT 7L AS trip_id, array(named_struct('x', 1D, 'y', 2D, 'm', 10L), named_struct('x', 3D, 'y', 4D, 'm', 20L)) AS lines_geom,"
                      " named_struct('x', 3D, 'y', 4D) AS end_geom, true AS start_good")
    traces, points = run.vendor_traces(table)
    row = traces.first()
    assert (row.start_x, row.start_y, row.end_x, row.start_good) == (1, 2, 3, True)
    assert [tuple(r) for r in points.orderBy("ptid").collect()] == [(7, 1, 10, 1.0, 2.0), (7, 2, 20, 3.0, 4.0)]


def test_vendor_traces_in_parts(spark):
    """Parts of a long line are numbered on, in whatever order their rows come; a trace has one row."""
    rows = [(7, 1, [(3.0, 4.0, 30)], (9.0, 9.0)), (7, 0, [(1.0, 2.0, 10), (2.0, 2.0, 20)], (9.0, 9.0)), (8, 0, [(5.0, 5.0, 1)], (5.0, 5.0)), (7, 2, [(9.0, 9.0, 40)], (9.0, 9.0))]
    table = spark.createDataFrame(rows, "trip_id long, line_part long, lines_geom array<struct<x double, y double, m long>>, end_geom struct<x double, y double>")
    traces, points = run.vendor_traces(table)
    assert sorted(map(tuple, traces.select("trip_id", "start_x", "end_x").collect())) == [(7, 1.0, 9.0), (8, 5.0, 5.0)]
    assert sorted(map(tuple, points.select("trip_id", "ptid", "t").collect())) == [(7, 1, 10), (7, 2, 20), (7, 3, 30), (7, 4, 40), (8, 1, 1)]


def test_trace_files_hold_whole_lines(spark, tmp_path, monkeypatch):
    """A trip of more than part_rows points is written and read back to its end."""
    import duckdb
    import __spark_entry__ as entry
    from cases import chain
    from cases.check import compare
    monkeypatch.setattr(chain, "Params", lambda: Params(part_rows=30))
    spark.range(130).selectExpr("id AS event_id", "if(id < 100, 3L, 14L) AS user_id", "timestamp_seconds(1704067200 + id * 7) AS ts").write.parquet(
        str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert compare(entry.queries()["trace_files"](spark, str(tmp_path)), con, entry.oracle_sql()["trace_files"]) == "ok 2"


def test_stages_are_kept_and_redone(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for force, n in ((False, 1), (False, 1), (True, 2)):
        assert run.Stages(spark, str(tmp_path), force).keep("numbers", make).count() == 3 and len(made) == n


def test_export_and_merge(spark, tmp_path):
    streets = spark.sql("SELECT 1L AS id, array(named_struct('x', 1D, 'y', 2D)) AS geom_way")
    readers.export_csv(streets, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out")).first()
    assert back.id == "1" and bytes.fromhex(back.geom_way) == struct.pack("<BIIdd", 1, 2, 1, 1.0, 2.0)
    old = spark.sql("SELECT 1L AS trip_id, 5 AS speed, 6 AS kept")
    assert readers.merge_metrics(old, spark.sql("SELECT 1L AS trip_id, 9 AS speed")).first().asDict() == {"trip_id": 1, "kept": 6, "speed": 9}


def test_reprojected_streets(spark):
    streets = spark.sql("SELECT 1L AS id, array(named_struct('x', -122.33D, 'y', 47.6D), named_struct('x', -122.33D, 'y', 47.61D)) AS geom_way")
    a, b = readers.reproject_streets(streets, "wa").first().geom_way
    assert abs(((a.x - b.x) ** 2 + (a.y - b.y) ** 2) ** 0.5 - 1111.8) < 1


def test_snapshots(spark, tmp_path):
    from curbloop.sources.snapshots import Conflict, SnapshotTable, file_stamps
    table = SnapshotTable(spark, str(tmp_path / "table"))
    def number(rows):
        return rows.withColumn("trip_id", F.expr("id + 1"))
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.append(spark.range(3), "a", number) == 1 and table.append(spark.range(2), "b", number) == 2
    assert table.append(spark.range(2), "b", number) == 2  # the same batch again
    spark.range(9).write.parquet(str(tmp_path / "table/data/failed"))
    (tmp_path / "table/versions/_draft").write_text("half")
    assert sorted(r.trip_id for r in table.read().collect()) == [1, 2, 3, 4, 5] and table.read(1).count() == 3
    assert [(b["first_id"], b["last_id"], b["rows"]) for b in table.batches()] == [(1, 3, 3), (4, 5, 2)]
    with pytest.raises(Conflict):
        table.commit(1, [])
    assert table.append(spark.range(0), "none", number) == 3 and table.append(spark.range(1), "c", number) == 4
    table.clean()
    assert {p.name for p in (tmp_path / "table/versions").iterdir() if not p.name.startswith(".")} == {"4.json"}
    assert len(list((tmp_path / "table/data").iterdir())) == 4 and table.read().agg(F.max("trip_id")).first()[0] == 6
    before = file_stamps(spark, str(tmp_path / "table"))
    spark.range(1).write.parquet(str(tmp_path / "table/more"))
    assert len(file_stamps(spark, str(tmp_path / "table"))) > len(before) > 0 and file_stamps(spark, str(tmp_path / "nothing*")) == []


def test_stages_are_removed_when_not_needed(spark):
    import os

    from curbloop.operators import scratch
    with scratch.tidy(spark) as kept:
        gone = scratch.stage(spark.range(3), "gone")
        with scratch.tidy(spark) as inner:
            inside = inner(scratch.stage(gone.filter("id > 0"), "inside"))
        held = kept(scratch.stage(inside, "held"))
    assert held.count() == 2
    for df, there in ((gone, False), (inside, False), (held, True)):
        assert {os.path.exists(f.removeprefix("file://").removeprefix("file:")) for f in df.inputFiles()} == {there}


def _packed(line, order="<", kind=0x40000002, srid=None):
    head = struct.pack(order + "BI", order == "<", kind) + (b"" if srid is None else struct.pack(order + "I", srid))
    return (head + struct.pack(order + "I", len(line)) + b"".join(struct.pack(order + "d" * len(p), *p) for p in line)).hex().upper()


def test_binary_lines_keep_every_bit(spark):
    draw = random.Random(3)
    values = [0.0, -0.0, 1.0, -1.5, 5e-324, 2.2250738585072014e-308, -1e-310, 1.7976931348623157e308, float("inf"), -122.33]
    values += [v for v in (struct.unpack("<d", struct.pack("<Q", draw.getrandbits(64)))[0] for _ in range(300)) if v == v]
    lines = [[(draw.choice(values), draw.choice(values), draw.randint(-5, 2**40)) for _ in range(draw.randint(0, 9))] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(lines)), "id long, l array<struct<x:double,y:double,m:bigint>>")
    text = df.select("id", "l", geo.line_to_wkb("l").alias("w"), geo.line_to_wkb("l", False, 3493).alias("flat"))
    for r in text.select("*", geo.line_from_wkb("w").alias("back"), geo.line_from_wkb("flat").alias("bare")).collect():
        line = [tuple(p) for p in r.l]
        assert r.w == _packed(line) and r.flat == _packed([p[:2] for p in line], kind=0x20000002, srid=3493)
        assert repr(r.back) == repr(r.l) and [(p.x, p.y, p.m) for p in r.bare] == [(x, y, None) for x, y, _ in line]


def test_binary_lines_of_others(spark):
    """Both byte orders, both spellings, heights; what is not a whole line is null."""
    texts = [_packed([(1.0, 2.0, 3.0)], ">"), _packed([(1.0, 2.0, 3.0)], kind=2002).lower(), _packed([(1.0, 2.0, 9.0, 3.0)], ">", 3002),
             _packed([(1.0, 2.0, 9.0, 3.0)], kind=0xE0000002, srid=4326), None, "", "xx", "0102", _packed([(1.0, 2.0, 3.0)])[:-2], _packed([(1.0, 2.0)], kind=1)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, w string").select("id", geo.line_from_wkb("w").alias("l")).orderBy("id").collect()
    assert [[tuple(p) for p in r.l] for r in rows[:4]] == [[(1.0, 2.0, 3)]] * 4 and [r.l for r in rows[4:]] == [None] * 6


def test_layers_with_cells_of_another_type_are_refused(spark, tmp_path):
    good = "id,source,target,cost,reverse_cost,clazz,geom_way,name\n"
    line = _packed([(1.0, 2.0), (3.0, 4.0)], kind=2)
    (tmp_path / "good.csv").write_text(f"{good}1,2,3,0.5,,11,{line},Main St\n2,2,3,0.5,1,,,\n")
    rows = readers.read_layer(spark, str(tmp_path / "good.csv"), "streets").orderBy("id").collect()
    assert [tuple(p) for p in rows[0].geom_way] == [(1.0, 2.0), (3.0, 4.0)] and rows[0].name == "Main St" and rows[0].reverse_cost is None
    assert rows[1].geom_way is None and rows[1].clazz is None
    (tmp_path / "bad.csv").write_text(f"{good}1,2,3,half,1,11,{line},a\nx,2,3,1,1,11,{line[:-2]},b\ny,2,3,1,1,11,{line},c\n")
    with pytest.raises(ValueError, match=r"2 in id \(bigint\), 1 in cost \(double\), 1 in geom_way \(line\)"):
        readers.read_layer(spark, str(tmp_path / "bad.csv"), "streets")
    (tmp_path / "short.csv").write_text("id,source\n1,2\n")
    with pytest.raises(ValueError, match="lacks the columns"):
        readers.read_layer(spark, str(tmp_path / "short.csv"), "streets")


def test_traces_with_points_as_text(spark, tmp_path):
    rows = spark.sql("""SELECT 5L AS trip_id, array(named_struct('x', 1D, 'y', 2D, 'm', 7L), named_struct('x', 1.5D, 'y', 2D, 'm', 9L)) AS lines_geom,
                        named_struct('x', 1.5D, 'y', -2D) AS end_geom, true AS start_good UNION ALL SELECT 6, NULL, NULL, NULL""")
    readers.export_csv(rows, str(tmp_path / "traces"))
    back = readers.read_layer(spark, str(tmp_path / "traces"), "traces")
    assert back.orderBy("trip_id").select(*rows.columns).collect() == rows.orderBy("trip_id").collect()
