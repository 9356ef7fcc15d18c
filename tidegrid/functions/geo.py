"""Geographic Column expressions: boxes, geohash cells, spherical measures, planar grids."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrid.schema import Box

# Fixed value: the public geohash alphabet (digits and letters without a, i, l, o).
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def in_box(lat: Column | str, lon: Column | str, box: Box) -> Column:
    """Closed box test on plain columns, so that it reaches the file statistics."""
    lat, lon = _c(lat), _c(lon)
    rows = (lat >= box.south) & (lat <= box.north)
    if box.west <= box.east:
        return rows & (lon >= box.west) & (lon <= box.east)
    return rows & ((lon >= box.west) | (lon <= box.east))


def strictly_in_box(lat: Column | str, lon: Column | str, box: Box) -> Column:
    lat, lon = _c(lat), _c(lon)
    return (lat > box.south) & (lat < box.north) & (lon > box.west) & (lon < box.east)


def _halvings(v: Column, low: float, high: float, bits: int) -> Column:
    scaled = F.floor((v - F.lit(low)) / F.lit(high - low) * F.lit(float(1 << bits)))
    return F.greatest(F.least(scaled, F.lit((1 << bits) - 1)), F.lit(0)).cast("bigint")


def _bit_counts(precision: int) -> tuple[int, int]:
    total = 5 * precision
    return (total + 1) // 2, total // 2


def geohash_key(lat: Column | str, lon: Column | str, precision: int) -> Column:
    """A geohash cell as one number: cheap to group by, turned into text by :func:`geohash_text`."""
    n_lon, n_lat = _bit_counts(precision)
    x = _halvings(_c(lon), -180.0, 180.0, n_lon)
    y = _halvings(_c(lat), -90.0, 90.0, n_lat)
    return F.shiftleft(x, n_lat).bitwiseOR(y)


def geohash_text(key: Column | str, precision: int) -> Column:
    """Base-32 name of a cell number; longitude and latitude bits alternate, longitude first."""
    key = _c(key)
    n_lon, n_lat = _bit_counts(precision)
    chars = []
    for k in range(precision):
        value = None
        for b in range(5):
            pos = 5 * k + b
            if pos % 2 == 0:
                source = n_lat + n_lon - 1 - pos // 2
            else:
                source = n_lat - 1 - pos // 2
            bit = F.shiftleft(F.shiftright(key, source).bitwiseAND(F.lit(1)), 4 - b)
            value = bit if value is None else value.bitwiseOR(bit)
        chars.append(F.substring(F.lit(GEOHASH_ALPHABET), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*chars)


def geohash(lat: Column | str, lon: Column | str, precision: int) -> Column:
    return geohash_text(geohash_key(lat, lon, precision), precision)


def geohash_box(cell: Column | str, precision: int) -> Column:
    """Cell name to ``struct(south, west, north, east)``."""
    cell = _c(cell)
    n_lon, n_lat = _bit_counts(precision)
    x = y = F.lit(0).cast("bigint")
    for k in range(precision):
        value = (F.instr(F.lit(GEOHASH_ALPHABET), F.substring(cell, k + 1, 1)) - 1).cast("bigint")
        for b in range(5):
            bit = F.shiftright(value, 4 - b).bitwiseAND(F.lit(1))
            if (5 * k + b) % 2 == 0:
                x = F.shiftleft(x, 1).bitwiseOR(bit)
            else:
                y = F.shiftleft(y, 1).bitwiseOR(bit)
    dx, dy = 360.0 / (1 << n_lon), 180.0 / (1 << n_lat)
    return F.struct(
        (F.lit(-90.0) + y * F.lit(dy)).alias("south"),
        (F.lit(-180.0) + x * F.lit(dx)).alias("west"),
        (F.lit(-90.0) + (y + 1) * F.lit(dy)).alias("north"),
        (F.lit(-180.0) + (x + 1) * F.lit(dx)).alias("east"),
    )


def box_ring(box: Column | str) -> Column:
    """A box as a closed ring of [lon, lat] pairs: SW, NW, NE, SE, SW."""
    box = _c(box)
    s, w, n, e = (box.getField(k) for k in ("south", "west", "north", "east"))
    return F.array(F.array(w, s), F.array(w, n), F.array(e, n), F.array(e, s), F.array(w, s))


def cell_feature(cell: Column | str, precision: int, **props: Column) -> Column:
    """A cell as a polygon feature, ready for ``to_json``."""
    ring = box_ring(geohash_box(cell, precision))
    return F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
        F.struct(*[c.alias(k) for k, c in props.items()]).alias("properties"),
    )


def corners_from_sw_ne(sw_lat: Column, sw_lon: Column, ne_lat: Column, ne_lon: Column) -> Column:
    """South-west/north-east bounds to top-left/bottom-right bounds."""
    return F.struct(
        F.struct(_c(ne_lat).alias("lat"), _c(sw_lon).alias("lon")).alias("top_left"),
        F.struct(_c(sw_lat).alias("lat"), _c(ne_lon).alias("lon")).alias("bottom_right"),
    )


def sw_ne_from_corners(corners: Column | str) -> Column:
    """Top-left/bottom-right bounds to south-west/north-east bounds."""
    c = _c(corners)
    return F.struct(
        F.struct(c["bottom_right"]["lat"].alias("lat"), c["top_left"]["lon"].alias("lon")).alias("south_west"),
        F.struct(c["top_left"]["lat"].alias("lat"), c["bottom_right"]["lon"].alias("lon")).alias("north_east"),
    )


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Angle in radians between two points given in degrees (haversine form)."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    s = F.pow(F.sin((p2 - p1) / 2), 2)
    t = F.pow(F.sin((F.radians(_c(lon2)) - F.radians(_c(lon1))) / 2), 2)
    return 2 * F.asin(F.least(F.lit(1.0), F.sqrt(s + F.cos(p1) * F.cos(p2) * t)))


def hex_cell(x: Column | str, y: Column | str, radius: float) -> Column:
    """Hexagon (column, row) and centre of a planar point; odd rows are shifted half a column right.

    Of the rows below and above the point each offers its closest centre, and the closer of the two is taken,
    with distances in columns and rows. Of equally close ones the nearer row is taken, then the upper.
    """
    wide, high = radius * math.sqrt(3.0), radius * 1.5
    across, up = _c(x) / F.lit(wide), _c(y) / F.lit(high)

    def offer(row: Column) -> Column:
        shift = F.when(row % 2 == 0, 0.0).otherwise(0.5)
        col = F.floor(across - shift + 0.5)
        apart = F.pow(across - shift - col, 2) + F.pow(up - row, 2)
        return F.struct(
            apart.alias("apart"), F.abs(up - row).alias("rows"), (-row).alias("upper"),
            col.cast("bigint").alias("i"), row.cast("bigint").alias("j"), (col + shift).alias("place"))

    best = F.least(offer(F.floor(up)), offer(F.floor(up) + 1))
    return F.struct(best["i"].alias("i"), best["j"].alias("j"), (best["place"] * F.lit(wide)).alias("x"), (best["j"] * F.lit(high)).alias("y"))


def tile_xy(lat: Column | str, lon: Column | str, zoom: int) -> tuple[Column, Column]:
    """Web-Mercator tile column and row at a zoom level."""
    n = float(1 << zoom)
    top = (1 << zoom) - 1
    phi = F.radians(_c(lat))
    fx = F.floor((_c(lon) + 180.0) / 360.0 * n)
    fy = F.floor((1.0 - F.log(F.tan(phi) + 1.0 / F.cos(phi)) / F.lit(math.pi)) / 2.0 * n)

    def clamp(c: Column) -> Column:
        return F.greatest(F.least(c, F.lit(top)), F.lit(0)).cast("bigint")

    return clamp(fx), clamp(fy)
