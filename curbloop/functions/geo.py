"""Planar geometry as column arithmetic; everything stays inside whole-stage code generation.

Arguments are column names, numbers or other SQL fragments; results are columns.
"""
from pyspark.sql import Column, functions as F

LINE_TYPE = "array<struct<x:double,y:double,m:bigint>>"


def distance_sql(x1, y1, x2, y2) -> str:
    dx, dy = f"(({x1}) - ({x2}))", f"(({y1}) - ({y2}))"
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


def between_sql(a, b, share) -> str:
    return f"(({a}) + ({share}) * (({b}) - ({a})))"


def share_along_sql(px, py, x1, y1, x2, y2) -> str:
    dx, dy = f"(({x2}) - ({x1}))", f"(({y2}) - ({y1}))"
    return (f"coalesce(greatest(0D, least(1D, ((({px}) - ({x1})) * {dx} + (({py}) - ({y1})) * {dy})"
            f" / nullif({dx} * {dx} + {dy} * {dy}, 0D))), 0D)")


def segment_distance_sql(px, py, x1, y1, x2, y2) -> str:
    s = share_along_sql(px, py, x1, y1, x2, y2)
    return distance_sql(px, py, between_sql(x1, x2, s), between_sql(y1, y2, s))


def point_m(x, y, m) -> Column:
    return F.expr(f"named_struct('x', {x}, 'y', {y}, 'm', {m})")


def distance(x1, y1, x2, y2) -> Column:
    return F.expr(distance_sql(x1, y1, x2, y2))


def share_along(px, py, x1, y1, x2, y2) -> Column:
    """Position of the closest point of a segment, 0 at its start and 1 at its end."""
    return F.expr(share_along_sql(px, py, x1, y1, x2, y2))


def between(a, b, share) -> Column:
    return F.expr(between_sql(a, b, share))


def segment_distance(px, py, x1, y1, x2, y2) -> Column:
    return F.expr(segment_distance_sql(px, py, x1, y1, x2, y2))


def chord_length(x1, y1, x2, y2, cx, cy, radius) -> Column:
    """Length of the part of a segment inside a disc (exact circle)."""
    a = f"(pow({x2} - {x1}, 2) + pow({y2} - {y1}, 2))"
    b = f"(({x1} - {cx}) * ({x2} - {x1}) + ({y1} - {cy}) * ({y2} - {y1}))"
    disc = f"({b} * {b} - {a} * (pow({x1} - {cx}, 2) + pow({y1} - {cy}, 2) - pow({radius}, 2)))"
    root, safe_a = f"sqrt(greatest({disc}, 0D))", f"nullif({a}, 0D)"
    inside = f"least(1D, (-{b} + {root}) / {safe_a}) - greatest(0D, (-{b} - {root}) / {safe_a})"
    return F.expr(f"CASE WHEN {a} > 0 AND {disc} > 0 THEN greatest(0D, {inside}) * sqrt({a}) ELSE 0D END")


def crosses_ray(px, py, x1, y1, x2, y2) -> Column:
    """Does the ray from a point towards growing x cross the segment? An odd count means inside."""
    return F.expr(f"({y1} > {py}) <> ({y2} > {py}) AND "
                  f"{px} < {x1} + ({py} - {y1}) / nullif({y2} - {y1}, 0D) * ({x2} - {x1})")


# --- lines held as arrays -------------------------------------------------------------------------

def n_points(line) -> Column:
    return F.expr(f"coalesce(if({line} is null, 0, size({line})), 0)")


def start_point(line) -> Column:
    return F.expr(f"try_element_at({line}, 1)")


def end_point(line) -> Column:
    return F.expr(f"try_element_at({line}, -1)")


def step_lengths_sql(line) -> str:
    n = f"greatest(size({line}) - 1, 0)"
    return f"zip_with(slice({line}, 1, {n}), slice({line}, 2, {n}), (p, q) -> {distance_sql('p.x', 'p.y', 'q.x', 'q.y')})"


def line_length_sql(line) -> str:
    return f"aggregate({step_lengths_sql(line)}, 0D, (acc, d) -> acc + d)"


def line_length(line) -> Column:
    return F.expr(line_length_sql(line))


def remove_point(line, position: int) -> Column:
    """Drop the point at a 1-based position."""
    return F.expr(f"concat(slice({line}, 1, {position - 1}), slice({line}, {position + 1}, size({line})))")


def reverse_if(line, condition) -> Column:
    """Lines are drawn one way; turn those driven the other way."""
    return F.expr(f"if({condition}, reverse({line}), {line})")


def merge_lines(lines) -> Column:
    """One line of an array of lines that touch end to start."""
    return F.expr(f"concat(slice({lines}[0], 1, 1), flatten(transform({lines}, l -> slice(l, 2, size(l)))))")


# --- text ------------------------------------------------------------------------------------------

def line_to_wkt(line) -> Column:
    return F.expr(f"""concat('LINESTRING M (', concat_ws(', ', transform({line}, p ->
        concat_ws(' ', cast(p.x AS string), cast(p.y AS string), cast(p.m AS string)))), ')')""")


def point_to_wkt(x, y) -> Column:
    return F.expr(f"concat('POINT (', cast({x} AS string), ' ', cast({y} AS string), ')')")


_BODY = r"regexp_extract({text}, r'\(([^)]*)\)', 1)"


def line_from_wkt(text) -> Column:
    body = _BODY.format(text=text)
    return F.expr(f"""transform(transform(split({body}, r'\\s*,\\s*'), s -> split(s, ' ')), s -> named_struct(
        'x', try_cast(s[0] AS double), 'y', try_cast(s[1] AS double), 'm', try_cast(s[2] AS bigint)))""")


def point_from_wkt(text) -> Column:
    body = f"split({_BODY.format(text=text)}, ' ')"
    return F.expr(f"named_struct('x', try_cast(get({body}, 0) AS double), 'y', try_cast(get({body}, 1) AS double))")


def point_from_lat_lon_text(text) -> Column:
    """``(37.78, -122.41)`` -> lon as x, lat as y."""
    def part(n):
        return f"try_cast(regexp_extract({text}, r'\\(([-0-9.]+), ([-0-9.]+)\\)', {n}) AS double)"
    return F.expr(f"named_struct('x', {part(2)}, 'y', {part(1)})")


# --- well-known binary ------------------------------------------------------------------------------
# Hexadecimal text of lines as spatial databases export it: byte order, kind, number of the reference system if there is one, number of points, points.
# Kind 2 is a line; one bit each says that points have z, that they have m, and that a reference system follows. The other
# spelling of the same adds 1000 (z), 2000 (m) or 3000 (both) to the kind.
_HAS_Z, _HAS_M, _HAS_SRID = 0x80000000, 0x40000000, 0x20000000


def _swapped(hexed: str, size: int) -> str:
    """The bytes of a hexadecimal number of ``size`` bytes the other way round."""
    return f"concat({', '.join(f'substring({hexed}, {2 * k + 1}, 2)' for k in reversed(range(size)))})"


def _double_to_hex(value: str) -> str:
    """The eight bytes of a double, highest first; the parts of its hexadecimal form ``0x1.8p3`` are those of its bits."""
    # written and parted once per number: sign and 0, 1 or 0, fraction, exponent
    parts = f"split(format_string('%a', {value}), '[x.p]')"
    digits = ("concat(lpad(hex(if(s[0] = '-0', 2048, 0) + if(s[1] = '1', cast(s[3] AS int) + 1023, 0)), 3, '0'), upper(rpad(s[2], 13, '0')))")
    return (f"CASE WHEN {value} IS NULL OR isnan({value}) THEN '7FF8000000000000' WHEN {value} = double('Infinity') THEN '7FF0000000000000' "
            f"WHEN {value} = double('-Infinity') THEN 'FFF0000000000000' ELSE element_at(transform(array({parts}), s -> {digits}), 1) END")


def _hex_to_int(hexed: str) -> str:
    return f"cast(conv({hexed}, 16, 10) AS bigint)"


def _hex_to_double(hexed: str) -> str:
    bits = f"named_struct('head', {_hex_to_int(f'substring({hexed}, 1, 3)')}, 'rest', {_hex_to_int(f'substring({hexed}, 4, 13)')})"
    exponent = "(b.head & 2047)"
    size = (f"CASE WHEN {exponent} = 2047 THEN if(b.rest = 0, double('Infinity'), double('NaN')) "
            f"WHEN {exponent} = 0 THEN b.rest / 4503599627370496D * pow(2D, -1022) "
            f"ELSE (1 + b.rest / 4503599627370496D) * pow(2D, {exponent} - 1023) END")
    return f"element_at(transform(array({bits}), b -> if(b.head >= 2048, -1D, 1D) * ({size})), 1)"


def line_to_wkb(line, measured: bool = True, srid: int | None = None) -> Column:
    """Hexadecimal binary of an array line, lowest byte first, with its measure as a third number if ``measured``. A null line or one with a null
    point is null; a null coordinate becomes no number."""
    kind = 2 | (_HAS_M if measured else 0) | (_HAS_SRID if srid is not None else 0)
    head = "01" + kind.to_bytes(4, "little").hex().upper() + (srid.to_bytes(4, "little").hex().upper() if srid is not None else "")
    numbers = ["p.x", "p.y"] + (["cast(p.m AS double)"] if measured else [])
    point = f"element_at(transform(array({_double_to_hex('v')}), h -> {_swapped('h', 8)}), 1)"
    points = f"transform({line}, p -> concat_ws('', transform(array({', '.join(numbers)}), v -> {point})))"
    n = f"element_at(transform(array(lpad(hex(size({line})), 8, '0')), h -> {_swapped('h', 4)}), 1)"
    return F.expr(f"if({line} IS NULL OR exists({line}, p -> p IS NULL), NULL, concat('{head}', {n}, concat_ws('', {points})))")


def line_from_wkb(text, measured: bool = True) -> Column:
    """Array line (x, y, and the whole measure m if ``measured``) of hexadecimal binary in either byte order and spelling, with or without z, m
    and reference system. Text that is not a whole line is null; a line without a measure has a null m; z is passed over."""
    def number(at, size):  # a whole number, whatever the byte order
        raw = f"substring({text}, {at}, {2 * size})"
        return _hex_to_int(f"if(left({text}, 2) = '01', {_swapped(raw, size)}, {raw})")

    kind = number(3, 4)
    z = f"(({kind} & {_HAS_Z}) <> 0 OR ({kind} & 65535) div 1000 IN (1, 3))"
    m = f"(({kind} & {_HAS_M}) <> 0 OR ({kind} & 65535) div 1000 IN (2, 3))"
    start = f"if(({kind} & {_HAS_SRID}) <> 0, 19, 11)"
    width = f"(2 + if({z}, 1, 0) + if({m}, 1, 0))"
    # everything about the head is found once per line
    shape = f"named_struct('n', {number('q.start', 4)}, 'start', q.start, 'width', q.width, 'z', q.z, 'm', q.m, 'little', q.little, 'bytes', unhex({text}))"
    heads = (f"transform(array(named_struct('start', {start}, 'width', {width}, 'z', {z}, 'm', {m}, 'little', left({text}, 2) = '01')), q -> {shape})")

    def coordinate(place):
        # a place in bytes is found at once, one in text by counting from its start
        raw = f"hex(substring(q.bytes, cast((q.start + 9) div 2 + 8 * (k * q.width + {place}) AS int), 8))"
        return (f"element_at(transform(transform(array({raw}), r -> if(q.little, {_swapped('r', 8)}, r)), h -> {_hex_to_double('h')}), 1)")

    measure = f", 'm', if(q.m, try_cast({coordinate('if(q.z, 3, 2)')} AS bigint), NULL)" if measured else ""
    points = f"transform(sequence(0L, q.n - 1), k -> named_struct('x', {coordinate('0')}, 'y', {coordinate('1')}{measure}))"
    kind_of_point = "array<struct<x:double,y:double" + (",m:bigint>>" if measured else ">>")
    lines = (f"transform({heads}, q -> CASE WHEN length({text}) <> q.start + 7 + 16 * q.n * q.width THEN NULL "
             f"WHEN q.n = 0 THEN cast(array() AS {kind_of_point}) ELSE {points} END)")
    known = f"{text} RLIKE '^0[01][0-9A-Fa-f]{{16,}}$' AND ({kind} & 65535) % 1000 = 2"
    return F.expr(f"CASE WHEN {known} THEN element_at({lines}, 1) END")
