"""Map projections and affine transforms, as numbers and as Columns.

Every formula is written once over a small set of functions (:class:`_Math`),
so that it runs on floats and as Catalyst expressions alike; only the inverse
of the conic projection iterates, in a pandas UDF.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, functions as F

from ..operators.base import ArrayError

#: The WGS 84 ellipsoid.
A, FLATTENING = 6378137.0, 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
ECC = math.sqrt(E2)


class _Numbers:
    sin, cos, tan, atan, atan2, exp, log, sqrt, sinh, cosh, atanh, asinh = (
        math.sin, math.cos, math.tan, math.atan, math.atan2, math.exp, math.log, math.sqrt, math.sinh, math.cosh, math.atanh, math.asinh,
    )


class _Columns:
    sin, cos, tan, atan, atan2, exp, log, sqrt, sinh, cosh, atanh, asinh = (
        F.sin, F.cos, F.tan, F.atan, F.atan2, F.exp, F.ln, F.sqrt, F.sinh, F.cosh, F.atanh, F.asinh,
    )


def _lib(x):
    return _Columns if isinstance(x, Column) else _Numbers


@dataclass(frozen=True)
class Affine:
    """x = a col + b row + c, y = d col + e row + f."""

    a: float
    b: float
    c: float
    d: float
    e: float
    f: float

    def apply(self, col, row):
        return col * self.a + row * self.b + self.c, col * self.d + row * self.e + self.f

    def inverse(self) -> Affine:
        det = self.a * self.e - self.b * self.d
        if det == 0:
            raise ArrayError("the transform has no inverse")
        a, b, d, e = self.e / det, -self.b / det, -self.d / det, self.a / det
        return Affine(a, b, -(a * self.c + b * self.f), d, e, -(d * self.c + e * self.f))

    @classmethod
    def from_gdal(cls, t) -> Affine:
        return cls(t[1], t[2], t[0], t[4], t[5], t[3])

    def gdal(self) -> tuple[float, ...]:
        return self.c, self.a, self.b, self.f, self.d, self.e

    @classmethod
    def parse(cls, text: str) -> Affine:
        parts = text.replace(",", " ").split()
        if len(parts) != 6:
            raise ArrayError(f"six numbers, not {text!r}")
        return cls.from_gdal([float(p) for p in parts])


def pixel_labels(t: Affine, width: int, height: int) -> tuple[list[float], list[float]]:
    """World coordinates of pixel centres along both axes; no rotation."""
    if t.b or t.d:
        raise ArrayError("a rotated transform has no axes")
    return [t.a * (i + 0.5) + t.c for i in range(width)], [t.e * (j + 0.5) + t.f for j in range(height)]


class Mercator:
    """Spherical web Mercator."""

    def forward(self, lon, lat):
        m = _lib(lon)
        return lon * (A * math.pi / 180), m.log(m.tan(lat * (math.pi / 360) + math.pi / 4)) * A

    def inverse(self, x, y):
        m = _lib(x)
        return x * (180 / (A * math.pi)), m.atan(m.sinh(y * (1 / A))) * (180 / math.pi)


class TransverseMercator:
    """Ellipsoidal transverse Mercator by the series in the third flattening,
    exact to well below a millimetre within a zone."""

    def __init__(self, lon0: float, north: float = 0.0, scale: float = 0.9996, east: float = 500_000.0):
        self.lon0, self.north, self.scale, self.east = lon0, north, scale, east
        n = FLATTENING / (2 - FLATTENING)
        self.radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        self.up = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
        self.down = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
        self.back = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)

    def forward(self, lon, lat):
        m = _lib(lon)
        lam, phi = (lon - self.lon0) * (math.pi / 180), lat * (math.pi / 180)
        t = m.sinh(m.atanh(m.sin(phi)) - m.atanh(m.sin(phi) * ECC) * ECC)
        xi, eta = m.atan2(t, m.cos(lam)), m.asinh(m.sin(lam) / m.sqrt(t * t + m.cos(lam) * m.cos(lam)))
        x, y = eta, xi
        for k, c in enumerate(self.up, 1):
            x = x + m.cos(xi * (2 * k)) * m.sinh(eta * (2 * k)) * c
            y = y + m.sin(xi * (2 * k)) * m.cosh(eta * (2 * k)) * c
        return x * (self.scale * self.radius) + self.east, y * (self.scale * self.radius) + self.north

    def inverse(self, x, y):
        m = _lib(x)
        eta, xi = (x - self.east) * (1 / (self.scale * self.radius)), (y - self.north) * (1 / (self.scale * self.radius))
        e, z = eta, xi
        for k, c in enumerate(self.down, 1):
            e = e - m.cos(xi * (2 * k)) * m.sinh(eta * (2 * k)) * c
            z = z - m.sin(xi * (2 * k)) * m.cosh(eta * (2 * k)) * c
        chi = m.atan2(m.sin(z), m.sqrt(m.sinh(e) * m.sinh(e) + m.cos(z) * m.cos(z)))
        phi = chi
        for k, c in enumerate(self.back, 1):
            phi = phi + m.sin(chi * (2 * k)) * c
        return m.atan2(m.sinh(e), m.cos(z)) * (180 / math.pi) + self.lon0, phi * (180 / math.pi)


class LambertConic:
    """Conformal conic projection with two standard parallels."""

    def __init__(self, lon0: float, lat0: float, lat1: float, lat2: float, east: float, north: float):
        self.lon0, self.east, self.north = lon0, east, north
        q = [math.exp(-self._isometric(math.radians(x), _Numbers)) for x in (lat0, lat1, lat2)]
        m = [math.cos(math.radians(x)) / math.sqrt(1 - E2 * math.sin(math.radians(x)) ** 2) for x in (lat1, lat2)]
        self.n = math.log(m[0] / m[1]) / math.log(q[1] / q[2])
        self.radius = A * m[0] / (self.n * q[1] ** self.n)
        self.rho0 = self.radius * q[0] ** self.n

    @staticmethod
    def _isometric(phi, m):
        return m.atanh(m.sin(phi)) - m.atanh(m.sin(phi) * ECC) * ECC

    def forward(self, lon, lat):
        m = _lib(lon)
        rho = m.exp(self._isometric(lat * (math.pi / 180), m) * -self.n) * self.radius
        theta = (lon - self.lon0) * (math.pi / 180 * self.n)
        return m.sin(theta) * rho + self.east, m.cos(theta) * rho * -1 + (self.north + self.rho0)

    def inverse(self, x, y):
        m = _lib(x)
        dx, dy = x - self.east, y * -1 + (self.rho0 + self.north)
        psi = m.log(m.sqrt(dx * dx + dy * dy) * (1 / self.radius)) * (-1 / self.n)
        lon = m.atan2(dx, dy) * (180 / math.pi / self.n) + self.lon0
        if m is _Numbers:
            return lon, math.degrees(_latitude(psi))
        @F.pandas_udf("double")
        def back(p: pd.Series) -> pd.Series:
            import numpy as np

            s = np.tanh(p.to_numpy())
            for _ in range(12):
                s = np.tanh(p.to_numpy() + ECC * np.arctanh(ECC * s))
            return pd.Series(np.degrees(np.arcsin(s)))

        return lon, back(psi)


def _latitude(psi: float) -> float:
    """Latitude of an isometric latitude, by fixed-point steps on its sine."""
    s = math.tanh(psi)
    for _ in range(12):
        s = math.tanh(psi + ECC * math.atanh(ECC * s))
    return math.asin(s)


class _Degrees:
    def forward(self, lon, lat):
        return lon, lat

    inverse = forward


def crs_name(crs: str) -> str:
    """The number of an EPSG code in any common spelling."""
    return crs.strip().upper().replace("URN:OGC:DEF:CRS:EPSG::", "").replace("EPSG:", "")


def projection(crs: str):
    """WGS 84 degrees, web Mercator, Lambert-93 and the UTM zones."""
    code = crs_name(crs)
    if code in ("4326", "CRS84", "OGC:CRS84"):
        return _Degrees()
    if code in ("3857", "900913"):
        return Mercator()
    if code == "2154":
        return LambertConic(3.0, 46.5, 49.0, 44.0, 700_000.0, 6_600_000.0)
    if len(code) == 5 and code[:3] in ("326", "327") and code.isdigit() and 1 <= int(code[3:]) <= 60:
        return TransverseMercator(int(code[3:]) * 6 - 183.0, 10_000_000.0 if code[2] == "7" else 0.0)
    raise ArrayError(f"CRS {crs!r} is not known")


def transform(source: str, target: str, x, y):
    """Coordinates from one CRS to another, by way of WGS 84 degrees."""
    a, b = projection(source), projection(target)
    return (x, y) if crs_name(source) == crs_name(target) else b.forward(*a.inverse(x, y))


@dataclass(frozen=True)
class Geostationary:
    """View from a satellite above the equator, scanning in y first. Points
    are vectors in units of metres; a view is scanning angles times height."""

    lon0: float = 0.0
    height: float = 35785831.0
    a: float = 6378137.0
    b: float = 6356752.31414

    def forward(self, lon, lat):
        """(x, y, visible)."""
        m = _lib(lon)
        lam, phi = (lon - self.lon0) * (math.pi / 180), lat * (math.pi / 180)
        ratio = (self.b / self.a) ** 2
        n = m.sqrt(m.cos(phi) * m.cos(phi) + m.sin(phi) * m.sin(phi) * ratio)  # a / n: radius of curvature
        px, py, pz = m.cos(phi) * m.cos(lam) * self.a / n, m.cos(phi) * m.sin(lam) * self.a / n, m.sin(phi) * (self.a * ratio) / n
        away = px * -1 + (self.a + self.height)
        # visible while the line of sight meets the surface from outside
        seen = (away * px - py * py - pz * pz * (1 / ratio)) >= 0
        x, y = m.atan2(py, away) * self.height, m.atan2(pz, m.sqrt(py * py + away * away)) * self.height
        return _shown(x, y, seen)

    def inverse(self, x, y):
        """(lon, lat, on the Earth): the nearer point where the ray meets the ellipsoid."""
        m = _lib(x)
        ax, ay = x * (1 / self.height), y * (1 / self.height)
        dx, dy = -1.0, m.tan(ax)
        dz = m.tan(ay) * m.sqrt(dy * dy + 1)
        far, ratio = self.a + self.height, (self.a / self.b) ** 2
        q = dy * dy + dz * dz * ratio + 1
        root = q * (self.a**2 - far**2) + far**2
        if m is _Numbers:
            if root < 0:
                return float("nan"), float("nan"), False
            t = (far - math.sqrt(root)) / q
        else:
            t = (F.sqrt(F.when(root >= 0, root)) * -1 + far) / q
        px, py, pz = t * dx + far, t * dy, t * dz
        lon = m.atan2(py, px) * (180 / math.pi) + self.lon0
        lat = m.atan2(pz * ratio, m.sqrt(px * px + py * py)) * (180 / math.pi)
        return _shown(lon, lat, root >= 0)


def _shown(x, y, seen):
    if isinstance(seen, Column):
        nan = F.lit(float("nan"))
        return F.when(seen, x).otherwise(nan), F.when(seen, y).otherwise(nan), seen
    return (x, y, True) if seen else (float("nan"), float("nan"), False)
