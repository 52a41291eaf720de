"""Time parsing and calendar flags."""
from pyspark.sql import Column, DataFrame, functions as F


def epoch_seconds(ts_ms) -> Column:
    return F.expr(f"{ts_ms} div 1000")


def utc_timestamp(seconds) -> Column:
    return F.timestamp_seconds(seconds)


def local_wall_clock(seconds: Column, time_zone: str) -> Column:
    """Wall clock in a named zone for epoch seconds, whatever the session zone is."""
    return F.convert_timezone(F.lit("UTC"), F.lit(time_zone),
                              F.timestamp_add("SECOND", seconds, F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")))


def fourth_thursday(day: Column) -> Column:
    first = F.trunc(day, "month")
    # weekday() counts Monday as 0, Thursday is 3
    return F.date_add(first, F.pmod(F.lit(3) - F.weekday(first), F.lit(7)) + 21)


def is_workday(day: Column, fix_holidays: bool = False) -> Column:
    """Monday to Friday, without 1 January and 25 December (and, on request, Thanksgiving); null gives false."""
    holiday = F.date_format(day, "MM-dd").isin("01-01", "12-25")
    if fix_holidays:
        holiday = holiday | ((F.month(day) == 11) & (day == fourth_thursday(day)))
    return F.coalesce((F.weekday(day) < 5) & ~holiday, F.lit(False))


def _full_year(day: str) -> str:
    """``05-JAN-13`` -> ``05-Jan-2013``; two-digit years from 70 on belong to the last century."""
    yy = f"get(split({day}, '-'), 2)"
    return (f"concat_ws('-', get(split({day}, '-'), 0), initcap(get(split({day}, '-'), 1)),"
            f" concat(if({yy} < '70', '20', '19'), {yy}))")


def parse_day(text: str) -> Column:
    """``05-JAN-13`` -> date. Month names in any case; null where it is none."""
    return F.expr(f"to_date(try_to_timestamp({_full_year(text)}, 'dd-MMM-yyyy'))")


def with_local_12h(df: DataFrame, text: str, name: str, time_zone: str) -> DataFrame:
    """Add the instant of ``05-JAN-13 02.30.00.000000 PM`` in a named zone. Steps are columns so each is computed once."""
    day = _full_year(f"substring_index({text}, ' ', 1)")
    clock = f"regexp_replace(substring({text}, instr({text}, ' ') + 1), r'\\.\\d{{3,9}} ', ' ')"
    # read on the session clock and taken off it again, so only the named zone counts
    steps = (df.withColumn("_wall", F.expr(f"cast(try_to_timestamp(concat_ws(' ', {day}, {clock}), 'dd-MMM-yyyy hh.mm.ss a') AS timestamp_ntz)"))
             .withColumn("_utc", F.expr(f"convert_timezone('{time_zone}', 'UTC', _wall)"))
             .withColumn("_later", F.expr("_utc + INTERVAL 1 HOUR")))
    # an hour that comes twice when clocks go back means standard time
    utc = f"if(convert_timezone('UTC', '{time_zone}', _later) = _wall, _later, _utc)"
    seconds = F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {utc})")
    return steps.withColumn(name, F.timestamp_seconds(seconds)).drop("_wall", "_utc", "_later")
