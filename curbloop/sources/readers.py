"""Readers with fixed schemas, table contracts, and writers."""
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from curbloop.functions import geo
from curbloop.functions.projection import project_line
from curbloop.operators.scratch import stage
from curbloop.sources.snapshots import SnapshotTable

# Column order of the input files.
PING_FILE = ("device_id STRING, id_type STRING, latitude DOUBLE, longitude DOUBLE, h_acc DOUBLE, timestamp BIGINT, "
             "ip_address STRING, device_os STRING, device_os_v STRING, user_agent STRING, country_code STRING, "
             "source_id STRING, publisher_id STRING, app_id STRING, location_cont STRING, geohash STRING")
SENSOR_FILE = (
    "block_id STRING, street_name STRING, block_num STRING, street_block STRING, area_type STRING, pm_district_name STRING, "
    "ratetext STRING, start_time_dt STRING, tot_time BIGINT, tot_occupied_time BIGINT, tot_vacant_time BIGINT, "
    "tot_unknown_time BIGINT, op_time BIGINT, op_occupied_time BIGINT, op_vacant_time BIGINT, op_unknown_time BIGINT, "
    "nonop_time BIGINT, nonop_occupied_time BIGINT, nonop_vacant_time BIGINT, nonop_unknown_time BIGINT, "
    "gmp_time BIGINT, gmp_occupied_time BIGINT, gmp_vacant_time BIGINT, gmp_unknown_time BIGINT, comm_time BIGINT, "
    "comm_occupied_time BIGINT, comm_vacant_time BIGINT, comm_unknown_time BIGINT, "
    "cal_month_name STRING, cal_year STRING, cal_date STRING, day_type STRING, time_of_day INT")
METER_FILE = ("post_id STRING, ms_id STRING, ms_spaceid INT, cap_color STRING, meter_type STRING, smart_mete STRING, "
              "activesens STRING, jurisdicti STRING, on_off_str STRING, osp_id INT, street_num INT, streetname STRING, "
              "street_seg INT, ratearea STRING, sfparkarea STRING, location STRING")

# Required columns of the input tables.
CONTRACTS = {
    "traces": ["trip_id", "lines_geom", "end_geom"],
    "streets": ["id", "source", "target", "cost", "reverse_cost", "clazz", "geom_way"],
    "vertices": ["id", "restrictions"],
    "turn_restrictions": ["source_id", "target_id"],
    "lots": ["lot_id", "x1", "y1", "x2", "y2"],
    "curbs": ["curb_id", "x1", "y1", "x2", "y2"],
    "block_groups": ["bg", "x1", "y1", "x2", "y2"],
}

# Types of the columns of layers in text files; ``line`` is binary text of a line, ``measured line`` of one with a measure, ``point`` is
# ``POINT (x y)``. The files may have more columns, which stay text, and may lack those that are not in the contract.
LAYER_TYPES = {
    "streets": {"id": "bigint", "osm_id": "bigint", "source": "bigint", "target": "bigint", "cost": "double", "reverse_cost": "double",
                "km": "double", "kmh": "double", "clazz": "int", "geom_way": "line"},
    "vertices": {"id": "bigint", "osm_id": "bigint", "restrictions": "string", "x": "double", "y": "double"},
    "turn_restrictions": {"source_id": "bigint", "target_id": "bigint"},
    "traces": {"trip_id": "bigint", "line_part": "bigint", "lines_geom": "measured line", "start_geom": "point", "end_geom": "point",
               "start_good": "boolean", "end_good": "boolean", "provider_type": "string"},
    "lots": {"lot_id": "bigint", "ring": "int", "seq": "int", "x1": "double", "y1": "double", "x2": "double", "y2": "double"},
    "curbs": {"curb_id": "bigint", "x1": "double", "y1": "double", "x2": "double", "y2": "double"},
    "block_groups": {"bg": "string", "ring": "int", "seq": "int", "x1": "double", "y1": "double", "x2": "double", "y2": "double"},
}


def check(df: DataFrame, table: str) -> DataFrame:
    missing = [c for c in CONTRACTS[table] if c not in df.columns]
    if missing:
        raise ValueError(f"{table} lacks the columns {', '.join(missing)}")
    return df


def read_pings(spark: SparkSession, path: str) -> DataFrame:
    """Headerless quoted CSV (gz or plain): gid, device_id, id_type, latitude, longitude, h_acc, ts_ms.

    A gz file is one task, so rows are spread over the cluster by the shuffle that follows. ``gid`` is a hash of the
    row, the same in every attempt and every later read; repeated rows share it.
    """
    rows = spark.read.schema(PING_FILE).option("quote", '"').csv(path)
    kept = rows.select("device_id", "id_type", "latitude", "longitude", "h_acc", F.col("timestamp").alias("ts_ms"))
    return kept.withColumn("gid", F.xxhash64(*kept.columns))


def read_sensors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SENSOR_FILE).option("header", True).csv(path)


def read_meters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METER_FILE).option("header", True).csv(path)


def read_table(spark: SparkSession, path: str, table: str, schema=None) -> DataFrame:
    """A Parquet table, or CSV with a header and a schema, checked against its contract."""
    df = spark.read.schema(schema).option("header", True).csv(path) if schema else spark.read.parquet(path)
    return check(df, table) if table in CONTRACTS else df


def read_layer(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A layer from CSV with a header, columns in any order, typed by ``LAYER_TYPES``. A cell that is not of its type is refused with the name of
    its column and the number of such cells; empty cells are null."""
    raw = check(spark.read.option("header", True).option("multiLine", False).csv(path), table)

    def typed(name, kind):
        if kind.endswith("line"):
            return geo.line_from_wkb(f"`{name}`", measured=kind == "measured line")
        if kind == "point":
            at = geo.point_from_wkt(f"`{name}`")
            return F.when(at["x"].isNotNull() & at["y"].isNotNull(), at)
        return F.col(name).try_cast(kind)

    own = {name: typed(name, kind) for name, kind in LAYER_TYPES[table].items() if name in raw.columns}
    # cells are read once: lines of text cost far more to read than to write and read again as arrays
    rows = stage(raw.withColumns(own | {f"_has_{name}": F.col(name).isNotNull() for name in own}), f"layer-{table}")
    wrong = rows.agg(*[F.count_if(F.col(f"_has_{name}") & F.col(name).isNull()).alias(name) for name in own]).first().asDict()
    if any(wrong.values()):
        found = ", ".join(f"{n} in {name} ({LAYER_TYPES[table][name]})" for name, n in wrong.items() if n)
        raise ValueError(f"{table}: cells of another type: {found}")
    return rows.drop(*[f"_has_{name}" for name in own])


def reproject_streets(streets: DataFrame, zone) -> DataFrame:
    """Street lines in degrees -> regional metres."""
    return streets.withColumn("geom_way", F.expr("transform(geom_way, p -> named_struct('x', p.x, 'y', p.y, 'm', 0L))")) \
        .withColumn("geom_way", project_line("geom_way", zone)) \
        .withColumn("geom_way", F.expr("transform(geom_way, p -> named_struct('x', p.x, 'y', p.y))"))


def _cells(line: str) -> Column:
    """Cells of a line of text: commas inside quotes do not part them, a doubled quote is a quote."""
    bare = r"""if(c LIKE '"%"' AND length(c) > 1, replace(substring(c, 2, length(c) - 2), '""', '"'), c)"""
    return F.expr(f"""transform(split({line}, r',(?=(?:[^"]*+"[^"]*+")*+[^"]*+$)', -1), c -> {bare})""")


def read_survey_logs(spark: SparkSession, path: str, skip_files=()) -> DataFrame:
    """Camera logs named like ``Data Log May 26 2015 02_51 PM.csv``; day and time come from the name.

    The header row is found by its first name, so files may have a line before it. Cells may be quoted. Files whose name contains one of
    ``skip_files`` are left out.
    """
    text = spark.read.text(path).select("value", F.input_file_name().alias("path"))
    text = text.withColumn("file", F.regexp_replace(F.element_at(F.split("path", "/"), -1), "%20", " "))
    # columns are looked up by name in the header of each file; one header per file, so the join side is tiny
    header = text.filter(F.col("value").contains("Frame Number")).select("path", _cells("value").alias("names"))
    cells = text.join(header, "path").filter(~F.col("value").contains("Frame Number")).withColumn("cells", _cells("value"))

    def cell(name, kind):
        return f"try_cast(get(cells, cast(array_position(transform(names, n -> trim(n)), '{name}') AS int) - 1) AS {kind})"

    wall = "to_timestamp(concat_ws(' ', part[2], part[3], part[4], replace(part[5], '_', ':'), left(part[6], 2)), 'MMM d yyyy hh:mm a')"
    for name in skip_files:
        cells = cells.filter(~F.col("file").contains(name))
    return (cells.withColumn("part", F.split("file", " "))
            .selectExpr("concat(part[2], ' ', part[3], ', ', part[4], ' ', replace(part[5], '_', ':'), ' ', left(part[6], 2)) AS traceid",
                        "part[5] AS trace", "cast(part[3] AS int) AS day",
                        f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01', cast({wall} AS timestamp_ntz)) AS start_ms",
                        f"{cell('Frame Number', 'bigint')} AS framenum", f"{cell('Frame Time (ms)', 'bigint')} AS frametime",
                        f"{cell('Forward Acceleration', 'double')} AS forward_accel",
                        f"{cell('GPS Latitude.1', 'double')} AS lat", f"{cell('GPS Longitude.1', 'double')} AS lon")
            .filter("framenum is not null or frametime is not null"))


def read_video_pings(spark: SparkSession, path: str) -> DataFrame:
    """Video trips (Device, Trip, LocalDateTime, Latitude, Longitude): zero positions go, trips get unique numbers."""
    rows = spark.read.schema("Device STRING, Trip BIGINT, LocalDateTime STRING, Latitude DOUBLE, Longitude DOUBLE").option("header", True).csv(path)
    return rows.filter("Latitude <> 0 and Longitude <> 0").selectExpr(
        "cast(regexp_replace(Device, '^\\ufeff', '') AS bigint) AS device", "Trip AS trip", "Latitude AS latitude", "Longitude AS longitude",
        "timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01', cast(left(LocalDateTime, length(LocalDateTime) - 4) AS timestamp_ntz)) AS epoch",
    ).withColumn("trip_id", F.expr("device * 20000 + trip"))


def preview(df: DataFrame, rows: int = 10) -> DataFrame:
    return df.limit(rows)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", sort_by=()) -> None:
    """``append`` adds usable traces, ``overwrite`` resets an output, ``ignore`` keeps a finished stage. ``sort_by`` orders the rows within
    each file, so readers can skip row groups."""
    (df.sortWithinPartitions(*sort_by) if sort_by else df).write.mode(mode).parquet(path)


def append_traces(traces: DataFrame, path: str, number, batch: str | None = None) -> DataFrame:
    """Add traces to a table under new ids that follow those in use; gives the table back. ``number`` gives ids 1, 2, 3, ... A ``batch`` that is
    in the table already is not added again, and one that failed leaves no trace."""
    table = SnapshotTable(traces.sparkSession, path)
    table.append(traces, batch, number, sort_by=["trip_id"])
    return table.read()


def export_csv(df: DataFrame, path: str) -> None:
    """Streets, vertices or traces as CSV with a header that ``read_layer`` reads; lines become binary text, points ``POINT (x y)``, other
    nested columns JSON."""
    def cell(name, kind):
        if kind.startswith("array<struct<x:double,y:double"):
            return geo.line_to_wkb(f"`{name}`", measured=",m:" in kind).alias(name)
        if kind.startswith("struct<x:double,y:double"):
            return F.when(F.col(name).isNotNull(), geo.point_to_wkt(f"`{name}`.x", f"`{name}`.y")).alias(name)
        return F.to_json(name).alias(name) if kind.startswith(("array", "struct")) else F.col(name)

    df.select(*[cell(*c) for c in df.dtypes]).write.mode("overwrite").option("header", True).csv(path)


def merge_metrics(traces: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per-trip results beside the traces, as a new table; columns that exist already are replaced."""
    stale = [c for c in metrics.columns if c in traces.columns and c != "trip_id"]
    return traces.drop(*stale).join(metrics, "trip_id", "left")
