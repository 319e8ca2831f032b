"""Map projections as column expressions: transverse Mercator from its parameters, both ways."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


@dataclass(frozen=True)
class TransverseMercator:
    """Origin in degrees, scale on the central meridian, false origin in metres, and the ellipsoid's larger radius and inverse flattening.

    Krüger's series to the fourth power of the third flattening: below a millimetre within some thousand kilometres of the central meridian. Latitudes run between the poles without these.
    Null and NaN coordinates stay so. No datum is shifted: both sides are on one ellipsoid.
    """

    latitude: float
    longitude: float
    scale: float = 1.0
    east: float = 0.0
    north: float = 0.0
    radius: float = 6378137.0
    flattening: float = 298.257223563

    @property
    def _n(self) -> float:
        f = 1 / self.flattening
        return f / (2 - f)

    @property
    def _unit(self) -> float:
        """Metres of the projection for one radian of the meridian."""
        n = self._n
        return self.scale * self.radius / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    @property
    def _forward(self) -> list[float]:
        n = self._n
        return [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]

    @property
    def _inverse(self) -> list[float]:
        n = self._n
        return [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]

    @property
    def _latitudes(self) -> list[float]:
        n = self._n
        return [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]

    @property
    def _origin(self) -> float:
        """The origin's place on the meridian, in radians of the projection."""
        e = 2 * math.sqrt(self._n) / (1 + self._n)
        s = math.sin(math.radians(self.latitude))
        xi = math.atan(math.sinh(math.atanh(s) - e * math.atanh(e * s)))
        return xi + sum(a * math.sin(2 * j * xi) for j, a in enumerate(self._forward, 1))

    def project(self, latitude: Column, longitude: Column) -> tuple[Column, Column]:
        """x (east) and y (north) in metres of degrees."""
        e = 2 * math.sqrt(self._n) / (1 + self._n)
        s, turn = F.sin(F.radians(latitude)), F.radians(longitude - F.lit(self.longitude))
        t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
        xi, eta = F.atan2(t, F.cos(turn)), F.asinh(F.sin(turn) / F.sqrt(t * t + F.cos(turn) * F.cos(turn)))
        up = xi + _sum([a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(self._forward, 1)])
        right = eta + _sum([a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(self._forward, 1)])
        return F.lit(self.east) + self._unit * right, F.lit(self.north) + self._unit * (up - self._origin)

    def locate(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Latitude and longitude in degrees of metres."""
        up, right = (y - F.lit(self.north)) / self._unit + self._origin, (x - F.lit(self.east)) / self._unit
        xi = up - _sum([b * F.sin(2 * j * up) * F.cosh(2 * j * right) for j, b in enumerate(self._inverse, 1)])
        eta = right - _sum([b * F.cos(2 * j * up) * F.sinh(2 * j * right) for j, b in enumerate(self._inverse, 1)])
        chi = F.asin(F.sin(xi) / F.cosh(eta))
        latitude = chi + _sum([d * F.sin(2 * j * chi) for j, d in enumerate(self._latitudes, 1)])
        return F.degrees(latitude), F.lit(self.longitude) + F.degrees(F.atan2(F.sinh(eta), F.cos(xi)))


#: Fixed values of the published definition of the SVY21 grid.
SVY21 = TransverseMercator(1.0 + 22.0 / 60, 103.0 + 50.0 / 60, 1.0, 28001.642, 38744.572)
