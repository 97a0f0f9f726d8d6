"""Spatial expressions: great-circle distance, hexagonal cells, exact radius-join keys."""
from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .fixed_values import EARTH_RADIUS_KM
from .text import _col, let

# Published mean hexagon edge at resolution 8; each step scales by sqrt(7).
EDGE_KM_RES8 = 0.531414
REFERENCE_LATITUDE = 15.0


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    p1, p2 = F.radians(_col(lat1)), F.radians(_col(lat2))
    dp = F.radians(_col(lat2) - _col(lat1))
    dl = F.radians(_col(lon2) - _col(lon1))
    a = F.pow(F.sin(dp / 2), F.lit(2.0)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), F.lit(2.0))
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def geo_similarity(km: Column, scale_km: float) -> Column:
    return 1 - F.least(km, F.lit(float(scale_km))) / F.lit(float(scale_km))


def edge_km(resolution: int) -> float:
    return EDGE_KM_RES8 * math.sqrt(7.0) ** (8 - resolution)


def _plane(lat: Column, lon: Column, lat0: float) -> tuple[Column, Column]:
    x = EARTH_RADIUS_KM * F.radians(lon) * math.cos(math.radians(lat0))
    y = EARTH_RADIUS_KM * F.radians(lat)
    return x, y


def hex_axial(lat, lon, resolution: int = 8, lat0: float = REFERENCE_LATITUDE) -> Column:
    """Axial coordinates struct(q, r) of the flat-top hexagon holding a point.

    NULL or out-of-range coordinates give NULL.
    """
    la, lo = _col(lat).cast("double"), _col(lon).cast("double")
    x, y = _plane(la, lo, lat0)
    size = edge_km(resolution)
    q, r = x * (2.0 / 3.0 / size), y * (math.sqrt(3.0) / 3.0 / size) - x * (1.0 / 3.0 / size)
    # With s = -q - r, the hexagon around the origin is where q-r, r-s and s-q all lie
    # between -1 and 1. One step in q moves (q-r) + (q-s) by three, so whole steps can be
    # counted with floors; likewise for r.
    third = lambda a, b: F.floor((F.floor(a) + F.floor(b) + 2) / 3)
    cell_q, cell_r = third(q - r, q * 2 + r), third(r - q, r * 2 + q)
    valid = la.between(-90, 90) & lo.between(-180, 180)
    return F.when(valid, F.struct(cell_q.cast("long").alias("q"), cell_r.cast("long").alias("r")))


def hex_cell(lat, lon, resolution: int = 8, lat0: float = REFERENCE_LATITUDE) -> Column:
    """Cell id 'resolution:q:r'."""
    a = hex_axial(lat, lon, resolution, lat0)
    text = F.concat(F.lit(f"{resolution}:"), a["q"].cast("string"), F.lit(":"), a["r"].cast("string"))
    return F.when(a.isNotNull(), text)


def hex_centre(cell: Column | str, lat0: float = REFERENCE_LATITUDE) -> Column:
    """Centre of a cell as struct(lat, lon), read from the id alone."""
    def place(part):
        res, q, r = part[0].cast("int"), part[1].cast("double"), part[2].cast("double")
        size = EDGE_KM_RES8 * F.pow(F.lit(math.sqrt(7.0)), (F.lit(8) - res).cast("double"))
        x, y = size * 1.5 * q, size * math.sqrt(3.0) * (r + q / 2)
        return F.struct(F.degrees(y / EARTH_RADIUS_KM).alias("lat"),
                        F.degrees(x / (EARTH_RADIUS_KM * math.cos(math.radians(lat0)))).alias("lon"))

    return F.when(_col(cell).isNotNull(), let(F.split(_col(cell), ":"), place))


# --- keys for an exact radius join -------------------------------------------------
# Points are put in latitude bands `km` high. In band b the circle is cut into n(b)
# equal longitude cells, each at least as wide as the largest longitude gap two points
# within `km` can have there. So a point's partners lie in three bands and three cells.

def _band_height(km: float) -> float:
    return math.degrees(km / EARTH_RADIUS_KM) * (1 + 1e-9)


def lat_band(lat, km: float) -> Column:
    return F.floor(_col(lat) / _band_height(km)).cast("long")


def _lon_cells(band: Column, km: float) -> Column:
    far = F.least(F.lit(90.0), (F.abs(band) + 2) * _band_height(km))
    ratio = math.sin(km / (2 * EARTH_RADIUS_KM)) / F.greatest(F.lit(1e-12), F.cos(F.radians(far)))
    gap = F.degrees(2 * F.asin(F.least(F.lit(1.0), ratio))) * (1 + 1e-9)
    return F.greatest(F.lit(1), F.floor(F.lit(360.0) / gap)).cast("long")


def _lon_cell(lon: Column, n: Column) -> Column:
    return F.pmod(F.floor((lon + 180.0) / (F.lit(360.0) / n)).cast("long"), n)


def _packed(band: Column, cell: Column) -> Column:
    return F.coalesce(band * 2 ** 32 + cell, F.lit(-1).cast("long"))


def radius_key(lat, lon, km: float) -> Column:
    """The one key of a point on the build side: band and cell packed into a number.

    The inputs occur once in the expression and the key is never NULL, so filters inferred
    by the optimizer from a join on it stay small.
    """
    return let(lat_band(lat, km), lambda band: _packed(band, _lon_cell(_col(lon), _lon_cells(band, km))))


def radius_probe_keys(lat, lon, km: float) -> Column:
    """Up to nine keys under which all partners of a point are found, each once."""
    lon_c = _col(lon)
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))

    def in_band(target: Column) -> Column:
        return let(_lon_cells(target, km), lambda n: let(_lon_cell(lon_c, n), lambda cell: F.transform(
            steps, lambda d: _packed(target, F.pmod(cell + d, n)))))

    return F.array_distinct(F.flatten(let(lat_band(lat, km), lambda band: F.transform(
        steps, lambda o: in_band(band + o)))))


# --- the same with wider cells -----------------------------------------------------
# Cells `wide` times as high and broad as the radius: a probe looks only into those its
# circle touches, (1 + 2 / wide)^2 on average, so a row is copied less often.

#: Degrees added to every reach against rounding, about a centimetre.
_PAD = 1e-7


def _gap(far: Column, km: float) -> Column:
    """The largest longitude gap of two points within ``km`` that lie no farther than ``far`` degrees from the equator."""
    ratio = math.sin(min(km / (2 * EARTH_RADIUS_KM), math.pi / 2)) / F.greatest(F.lit(1e-12), F.cos(F.radians(F.least(F.lit(90.0), far))))
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), ratio))) * (1 + 1e-9) + _PAD


def _tile_columns(band: Column, km: float, wide: float) -> Column:
    far = (F.abs(band) + 2) * (_band_height(km) * wide)
    return F.greatest(F.lit(1), F.floor(F.lit(360.0) / (_gap(far, km) * wide))).cast("long")


def lat_reach(km: float) -> float:
    """The largest latitude gap in degrees of two points within ``km``."""
    return _band_height(km) + _PAD


def tile_key(lat, lon, km: float, wide: float) -> Column:
    """The one key of a point on the build side, never NULL."""
    return let(lat_band(lat, km * wide), lambda band: _packed(band, _lon_cell(_col(lon), _tile_columns(band, km, wide))))


def tile_probe_keys(lat, lon, km: float, wide: float) -> Column:
    """The keys under which all partners of a point within ``km`` are found, each once."""
    la, lo, height = _col(lat), _col(lon), _band_height(km * wide)
    at = lambda x, n: F.floor((x + 180.0) / (F.lit(360.0) / n)).cast("long")

    def in_band(target: Column, gap: Column) -> Column:
        def keys(n: Column) -> Column:
            first, last = at(lo - gap, n), at(lo + gap, n)
            cells = F.when(last - first >= n, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.sequence(first, last))
            return F.transform(cells, lambda c: _packed(target, F.pmod(c, n)))
        return let(_tile_columns(target, km, wide), keys)

    bands = F.sequence(F.floor((la - lat_reach(km)) / height).cast("long"), F.floor((la + lat_reach(km)) / height).cast("long"))
    return let(_gap(F.abs(la) + lat_reach(km), km), lambda gap: F.flatten(F.transform(bands, lambda b: in_band(b, gap))))
