"""The whole chain: pings -> traces -> classified trips.

spark-submit curbloop/plans/run.py --pings DIR --streets DIR --vertices DIR --out DIR --region wa [--lots DIR ...]
spark-submit curbloop/plans/run.py --traces DIR --streets DIR --out DIR            (traces made by a vendor)

The package is sent to the executors; it need not be installed.
"""
import argparse
import dataclasses
import functools
import hashlib
import json
import sys
from dataclasses import dataclass
from pathlib import Path

if __name__ == "__main__":  # started as a file from anywhere
    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from pyspark.errors import AnalysisException  # noqa: E402
from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

from curbloop.operators import approach, classify, cleaning, context, matching, network, trips
from curbloop.operators.layout import shuffled
from curbloop.operators.scratch import send_package, stage
from curbloop.operators.spatial import street_segments
from curbloop.params import Params
from curbloop.sources import readers
from curbloop.sources.snapshots import file_stamps


@dataclass
class Layers:
    streets: DataFrame
    bans: DataFrame | None = None
    lots: DataFrame | None = None
    curbs: DataFrame | None = None
    block_groups: DataFrame | None = None


class Stages:
    """Named stages under one folder. A finished stage is read again unless the run is forced.

    ``fingerprint`` tells inputs and parameters apart: a folder made from others is refused."""

    def __init__(self, spark: SparkSession, folder: str | None, force: bool = False, fingerprint: str = ""):
        self.spark, self.folder, self.force = spark, folder, force
        if folder is not None and fingerprint:
            self._same(fingerprint)

    def _same(self, fingerprint: str) -> None:
        found = self._note("inputs")
        if found is None or self.force:
            self._write_note("inputs", fingerprint)
        elif found != fingerprint:
            raise ValueError(f"{self.folder} was made from other inputs or parameters: {found}. Use another folder, or force.")

    def keep(self, name: str, make) -> DataFrame:
        if self.folder is None:
            return stage(make(), name)
        path = f"{self.folder}/{name}"
        if self.force or self._note(f"finished/{name}") is None:
            readers.write_table(make(), path)
            self._write_note(f"finished/{name}", "written")
        return self.spark.read.parquet(path)

    def _note(self, name: str) -> str | None:
        try:
            return self.spark.read.text(f"{self.folder}/notes/{name}", wholetext=True).first()[0].strip()
        except AnalysisException:  # there is none
            return None

    def _write_note(self, name: str, value: str) -> None:
        self.spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/notes/{name}")


def pings_to_traces(pings: DataFrame, zone, params: Params = Params(), stages: Stages | None = None):
    """Usable traces with ids, and their points."""
    stages = stages or Stages(pings.sparkSession, None)
    points = stages.keep("trip_points", lambda: trips.segment_trips(trips.locate_pings(pings, zone, params), params))
    traces = stages.keep("traces", lambda: trips.number_traces(trips.usable_traces(trips.build_traces(points), params)))
    lines = stages.keep("trace_points", lambda: trips.trace_points(points, traces, params))
    return traces, lines


def classify_traces(traces: DataFrame, points: DataFrame, layers: Layers, params: Params = Params(),
                    stages: Stages | None = None) -> DataFrame:
    """Every computed column per trip. ``traces``: trip_id, end_x, end_y, start_x, start_y (and start_good); ``points``:
    trip_id, ptid, t, x, y."""
    stages = stages or Stages(points.sparkSession, None)
    readers.check(layers.streets, "streets")
    if "n_points" not in traces.columns:
        traces = traces.join(shuffled(trips.trip_ends(points).select("trip_id", "n_points")), "trip_id", "left")
    points = stages.keep("clean_points", lambda: cleaning.clean_traces(points, traces, params))
    sizes = trips.trip_ends(points).select("trip_id", "t0", "n_points")
    ends = stages.keep("ends", lambda: traces.drop("n_points", "t0").join(shuffled(sizes), "trip_id"))
    zoned = stages.keep("zoned_points", lambda: approach.lot_zone(points, layers.streets, layers.lots, params))
    metrics = stages.keep("approach", lambda: approach.truncate_traces(zoned, ends, params))
    sliced = stages.keep("slices", lambda: approach.slice_points(points, ends, metrics, params))
    summary = stages.keep("slice_summary", lambda: approach.slice_summary(sliced))

    @functools.cache
    def roads():
        return network.roads_of(layers.streets, layers.bans, params)

    @functools.cache
    def matched():
        return matching.map_match(sliced.filter("in_lbuff").select("trip_id", "ptid", "t", "x", "y"), layers.streets, layers.bans, params, roads())

    scores = stages.keep("matches", lambda: matched()["trips"])
    visits = stages.keep("edge_visits", lambda: matched()["visits"])
    pieces = stages.keep("matched_pieces", lambda: matched()["pieces"])
    stages.keep("cleaned_points", lambda: matched()["cleaned"])
    edges = matching.edge_summary(visits)
    inside = classify.length_in_buffer(matching.matched_segments(pieces, layers.streets), ends, params)

    wide = (traces.drop("n_points", "t0").join(shuffled(sizes), "trip_id", "left").join(shuffled(metrics), "trip_id", "left")
            .join(shuffled(summary), "trip_id", "left").join(shuffled(scores), "trip_id", "left").join(shuffled(edges), "trip_id", "left")
            .join(shuffled(inside), "trip_id", "left").withColumn("drive_secs", F.col("enterlot_t") - F.col("startpt_t")))
    wide = stages.keep("matched_trips", lambda: wide)
    routed = stages.keep("netwkdist", lambda: network.network_distance(
        _route_ends(wide, layers.streets), layers.streets, layers.bans, params, roads()))
    out = classify.add_time_fields(wide.join(shuffled(routed), "trip_id", "left"), params)
    out = classify.classify_cruise(classify.add_distances(out), params)
    out = context.add_parking_context(out, layers.streets, layers.lots, layers.curbs, layers.block_groups, params)
    return classify.flag_usable(out, params)


def _route_ends(wide: DataFrame, streets: DataFrame) -> DataFrame:
    """First and last street of matched trips and where on them the drive starts and ends."""
    segments = street_segments(streets.select(F.col("id").cast("bigint").alias("id"), "geom_way"))
    matched = wide.filter("edge_id_start is not null")

    def side(edge, x, y, name):
        spots = matched.select("trip_id", F.col(edge).alias("edge_id"), F.col(x).alias("x"), F.col(y).alias("y"))
        return network.locate_on_edges(spots, segments, ["trip_id"]).withColumnRenamed("frac", name)

    return (matched.select("trip_id", F.col("edge_id_start").alias("edge_a"), F.col("edge_id_end").alias("edge_b"))
            .join(shuffled(side("edge_id_start", "startpt_x", "startpt_y", "frac_a")), "trip_id")
            .join(shuffled(side("edge_id_end", "enterlot_x", "enterlot_y", "frac_b")), "trip_id"))


def vendor_traces(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Traces made by a vendor (trip_id, lines_geom, end_geom, optional start_geom and start_good) as (traces, points). With ``line_part`` a trace
    may have several rows, see ``explode_lines``; its other columns are those of part 0."""
    readers.check(table, "traces")
    points = trips.explode_lines(table)
    if "line_part" in table.columns:
        table = table.filter("line_part = 0")
    first = "start_geom" if "start_geom" in table.columns else "try_element_at(lines_geom, 1)"
    keep = [c for c in ("start_good", "end_good", "provider_type") if c in table.columns]
    return table.selectExpr("trip_id", f"({first}).x AS start_x", f"({first}).y AS start_y",
                            "end_geom.x AS end_x", "end_geom.y AS end_y", *keep), points


def parse_params(settings, time_zone=None) -> Params:
    """``name=value`` pairs over the defaults, with the types of the defaults."""
    kinds = {f.name: type(f.default) for f in dataclasses.fields(Params)}
    values = {}
    for setting in settings or []:
        name, _, value = setting.partition("=")
        if name not in kinds:
            raise SystemExit(f"unknown parameter {name}; there are {', '.join(kinds)}")
        values[name] = value.lower() in ("1", "true", "yes") if kinds[name] is bool else kinds[name](value)
    return Params(**values | ({"time_zone": time_zone} if time_zone else {}))


def main(argv=None) -> None:
    p = argparse.ArgumentParser()
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("--pings", help="raw ping files")
    source.add_argument("--traces", help="traces made by a vendor")
    for name in ("streets", "out"):
        p.add_argument("--" + name, required=True)
    for name in ("vertices", "lots", "curbs", "block-groups"):
        p.add_argument("--" + name)
    p.add_argument("--csv", action="store_true", help="layers and vendor traces are CSV with a header, lines as hexadecimal binary text")
    p.add_argument("--region", help="zone of the planar coordinates; needed for pings and for --degrees")
    p.add_argument("--degrees", action="store_true", help="streets are in degrees and are projected to the region's metres")
    p.add_argument("--time-zone", help="zone of hours and weekdays")
    p.add_argument("--set", action="append", metavar="NAME=VALUE", help="a parameter; may be repeated")
    p.add_argument("--append-to", metavar="DIR", help="also add the usable traces to this table, under new ids; the same pings are added once")
    p.add_argument("--force", action="store_true", help="redo finished stages")
    a = p.parse_args(argv)
    if (a.pings or a.degrees) and not a.region:
        p.error("--region is needed")
    params = parse_params(a.set, a.time_zone)
    spark = SparkSession.builder.appName("curbloop").getOrCreate()
    send_package(spark)

    def layer(path, table):
        return (readers.read_layer if a.csv else readers.read_table)(spark, path, table) if path else None

    streets = layer(a.streets, "streets")
    if a.degrees:
        streets = readers.reproject_streets(streets, a.region)
    vertices = layer(a.vertices, "vertices")
    bans = network.turn_restrictions(vertices, streets) if vertices is not None else None
    layers = Layers(streets, bans, layer(a.lots, "lots"), layer(a.curbs, "curbs"), layer(a.block_groups, "block_groups"))
    made_from = {k: v for k, v in vars(a).items() if k not in ("out", "force", "set", "time_zone", "append_to")} | dataclasses.asdict(params)
    # the files themselves count, not only where they are: a grown folder is another input
    inputs = [v for k, v in vars(a).items() if v and k in ("pings", "traces", "streets", "vertices", "lots", "curbs", "block_groups")]
    made_from["files"] = hashlib.sha256(json.dumps([file_stamps(spark, path) for path in inputs]).encode()).hexdigest()
    stages = Stages(spark, a.out + "/stages", a.force, json.dumps(made_from, sort_keys=True))
    if a.traces:
        traces, points = vendor_traces(layer(a.traces, "traces"))
    else:
        traces, points = pings_to_traces(readers.read_pings(spark, a.pings), a.region, params, stages)
        if a.append_to:
            batch = hashlib.sha256(json.dumps(file_stamps(spark, a.pings)).encode()).hexdigest()
            readers.append_traces(traces.drop("trip_id"), a.append_to, trips.number_traces, batch)
    readers.write_table(classify_traces(traces, points, layers, params, stages), a.out + "/trips")
    readers.write_table(classify.cruise_share(spark.read.parquet(a.out + "/trips"), "endhour", "weekday"), a.out + "/cruise_share")


if __name__ == "__main__":
    main()
