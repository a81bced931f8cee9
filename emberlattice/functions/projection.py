"""WGS84 to UTM and back as column expressions (Krueger's series to the third order of the third flattening)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

A, FLAT, K0 = 6378137.0, 1 / 298.257223563, 0.9996
N = FLAT / (2 - FLAT)
RECTIFYING = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96, N**2 / 48 + N**3 / 15, 17 * N**3 / 480)
DELTA = (2 * N - 2 * N**2 / 3 - 2 * N**3, 7 * N**2 / 3 - 8 * N**3 / 5, 56 * N**3 / 15)
ECC = 2 * math.sqrt(N) / (1 + N)


def utm_zone(lon: Column) -> Column:
    return F.least(F.greatest(F.floor((lon + 180) / 6).cast("int") + 1, F.lit(1)), F.lit(60))


def utm_srid(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)


def utm(lon: Column, lat: Column, srid: Column) -> tuple[Column, Column]:
    """Easting and northing in the zone of srid (326zz north, 327zz south)."""
    centre = F.radians((srid % 100) * 6.0 - 183.0)
    phi, d = F.radians(lat), F.radians(lon) - centre
    t = F.sinh(F.atanh(F.sin(phi)) - ECC * F.atanh(ECC * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000.0 + K0 * RECTIFYING * east, F.when(srid >= 32700, 1e7).otherwise(0.0) + K0 * RECTIFYING * north


def utm_inverse(x: Column, y: Column, srid: Column) -> tuple[Column, Column]:
    """Longitude and latitude of an easting and northing in the zone of srid."""
    xi = (y - F.when(srid >= 32700, 1e7).otherwise(0.0)) / (K0 * RECTIFYING)
    eta = (x - 500000.0) / (K0 * RECTIFYING)
    north, east = xi, eta
    for j, b in enumerate(BETA, 1):
        north = north - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(north) / F.cosh(east))
    phi = chi
    for j, d in enumerate(DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return (srid % 100) * 6.0 - 183.0 + F.degrees(F.atan2(F.sinh(east), F.cos(north))), F.degrees(phi)


def utm_sql(lon: str, lat: str, srid: str) -> tuple[str, str]:
    """The same in DuckDB's SQL."""
    phi, d = f"radians({lat})", f"(radians({lon}) - radians(({srid} % 100) * 6.0::DOUBLE - 183.0::DOUBLE))"
    t = f"sinh(atanh(sin({phi})) - {ECC!r}::DOUBLE * atanh({ECC!r}::DOUBLE * sin({phi})))"
    xi, eta = f"atan2({t}, cos({d}))", f"atanh(sin({d}) / sqrt(1 + {t} * {t}))"
    east, north = eta, xi
    for j, a in enumerate(ALPHA, 1):
        east += f" + {a!r}::DOUBLE * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})"
        north += f" + {a!r}::DOUBLE * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})"
    scale = repr(K0 * RECTIFYING)
    return f"(500000.0 + {scale}::DOUBLE * ({east}))", f"(CASE WHEN {srid} >= 32700 THEN 1e7 ELSE 0 END + {scale}::DOUBLE * ({north}))"
