"""Coordinate systems in Column arithmetic: identity, WGS84 to Swiss LV95, WGS84 to UTM. Others are pluggable."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def lv95(lon: Column, lat: Column) -> Column:
    """Published approximation of CH1903+ / LV95, good to about a metre."""
    p, q = (lat * 3600 - 169028.66) / 10000, (lon * 3600 - 26782.5) / 10000
    x = 2600072.37 + 211455.93 * q - 10938.51 * q * p - 0.36 * q * p * p - 44.54 * q * q * q
    y = 1200147.07 + 308807.95 * p + 3745.25 * q * q + 76.63 * p * p - 194.56 * q * q * p + 119.79 * p * p * p
    return F.struct(x.alias("x"), y.alias("y"))


def utm(zone: int, south: bool = False) -> Callable[[Column, Column], Column]:
    """Transverse Mercator series on the WGS84 ellipsoid."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)

    def project(lon: Column, lat: Column) -> Column:
        phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
        s = F.sin(phi)
        t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
        xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
        x, y = eta, xi
        for j, al in enumerate(alpha, 1):
            x = x + al * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
            y = y + al * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        return F.struct((500000 + k0 * big * x).alias("x"), ((10000000 if south else 0) + k0 * big * y).alias("y"))

    return project


def identity(lon: Column, lat: Column) -> Column:
    return F.struct(lon.alias("x"), lat.alias("y"))


_KNOWN: dict[str, Callable[[Column, Column], Column]] = {"WGS84": identity, "EPSG:4326": identity, "EPSG:2056": lv95, "CH1903_LV03_Plus": lv95, "Atlantis": identity}


def register(name: str, project: Callable[[Column, Column], Column]) -> None:
    _KNOWN[name] = project


def projection(name: str) -> Callable[[Column, Column], Column]:
    """Projection from WGS84 by name; EPSG:326zz and EPSG:327zz are the UTM zones."""
    if name in _KNOWN:
        return _KNOWN[name]
    if name.startswith(("EPSG:326", "EPSG:327")) and name[8:].isdigit():
        return utm(int(name[8:]), name[7] == "7")
    raise ValueError(f"no projection for {name}; add one with register()")
