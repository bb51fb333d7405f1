"""Kinds of projection, each a set-up and two formulas.

A formula is written once over ``m``, a set of functions: ``COLUMNS`` builds Spark Columns of it, ``NUMBERS`` computes on the driver.
Forward formulas take radians east of the central meridian and radians north, and return x, y (metres without false origins) and
whether the place is inside the domain; inverse formulas go back, and return null or NaN outside it.  ``register_projection`` adds kinds.

Latitudes go between ellipsoid and sphere by the third flattening n or the squared eccentricity; what the series leave out is under
two millimetres on the earth (transverse Mercator: 20 centimetres at 70 degrees from the central meridian).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

HALF = math.pi / 2
#: Radians from a pole or an antipode within which a place counts as being there.
NEAR = 1e-10

COLUMNS = SimpleNamespace(sin=F.sin, cos=F.cos, tan=F.tan, asin=F.asin, atan=F.atan, atan2=F.atan2, sinh=F.sinh, cosh=F.cosh, atanh=F.atanh, sqrt=F.sqrt, exp=F.exp, ln=F.ln, abs=F.abs, power=F.pow, divide=F.try_divide, when=lambda c, a, b: F.when(c, a).otherwise(b), true=lambda x: F.lit(True))
NUMBERS = SimpleNamespace(sin=np.sin, cos=np.cos, tan=np.tan, asin=np.arcsin, atan=np.arctan, atan2=np.arctan2, sinh=np.sinh, cosh=np.cosh, atanh=np.arctanh, sqrt=np.sqrt, exp=np.exp, ln=np.log, abs=np.abs, power=np.power, divide=np.divide, when=np.where, true=lambda x: np.ones_like(x, bool))


@dataclass(frozen=True)
class Kind:
    """``options``: names of its numbers; ``setup(numbers, a, e)``: its constants, which may set lon_0, x_0 and y_0."""

    options: frozenset[str]
    setup: Callable
    forward: Callable
    inverse: Callable


KINDS: dict[str, Kind] = {}


def register_projection(name: str, setup: Callable, forward: Callable, inverse: Callable, options: tuple[str, ...] = ()) -> Kind:
    """Make a kind of projection known as ``+proj=name``."""
    if not all(map(callable, (setup, forward, inverse))):
        raise ValueError(f"{name}: setup, forward and inverse must be functions")
    KINDS[name] = k = Kind(frozenset(options), setup, forward, inverse)
    return k


# Latitudes.
def third_flattening(e: float) -> float:
    b = math.sqrt(1 - e * e)
    return (1 - b) / (1 + b)


def conformal_tangent(m, e: float, phi):
    """Tangent of the conformal latitude."""
    s = m.sin(phi)
    return m.sinh(m.atanh(s) - e * m.atanh(e * s) if e else m.atanh(s))


def from_conformal(m, e: float, chi):
    e2 = e * e
    return _series(m, chi, (e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360, 7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520, 7 * e2**3 / 120 + 81 * e2**4 / 1120, 4279 * e2**4 / 161280))


def _series(m, angle, factors):
    """The angle and multiples of the sines of its even multiples."""
    out = angle
    for k, f in enumerate(factors, 1):
        if f:
            out = out + f * m.sin(2 * k * angle)
    return out


def authalic(m, e: float, phi):
    """q, twice the sine of the authalic latitude on the sphere."""
    s = m.sin(phi)
    if not e:
        return 2 * s
    return (1 - e * e) * (s / (1 - e * e * s * s) + m.atanh(e * s) / e)


def from_authalic(m, e: float, beta):
    e2 = e * e
    return _series(m, beta, (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040, 23 * e2**2 / 360 + 251 * e2**3 / 3780, 761 * e2**3 / 45360))


def meridian(m, a: float, e: float, phi):
    """Metres from the equator along a meridian."""
    n = third_flattening(e)
    scale = a / (1 + n)
    return scale * (1 + n**2 / 4 + n**4 / 64) * phi + scale * (_series(m, phi, (-1.5 * (n - n**3 / 8), 15 / 16 * (n**2 - n**4 / 4), -35 / 48 * n**3, 315 / 512 * n**4)) - phi)


def from_meridian(m, a: float, e: float, y):
    n = third_flattening(e)
    mu = y / (a / (1 + n) * (1 + n**2 / 4 + n**4 / 64))
    return _series(m, mu, (1.5 * n - 27 / 32 * n**3, 21 / 16 * n**2 - 55 / 32 * n**4, 151 / 96 * n**3, 1097 / 512 * n**4))


def parallel(e: float, phi: float) -> float:
    """Radius of a parallel over the equatorial radius."""
    return math.cos(phi) / math.sqrt(1 - (e * math.sin(phi)) ** 2)


def _radians(numbers: dict, name: str, default: float = 0.0) -> float:
    v = math.radians(numbers.get(name, default))
    if abs(v) > HALF + NEAR:
        raise ValueError(f"{name} is beyond a pole")
    return v


def _scale(numbers: dict) -> float:
    k = numbers.get("k_0", numbers.get("k", 1.0))
    if not k > 0:
        raise ValueError("the scale factor must be above 0")
    return k


# Geographic coordinates: radians.
register_projection("longlat", lambda numbers, a, e: {}, lambda m, c, lam, phi: (lam, phi, m.true(phi)), lambda m, c, x, y: (x, y))
KINDS["latlong"] = KINDS["longlat"]


# Sinusoidal.
def _sinu_forward(m, c, lam, phi):
    s = c.e * m.sin(phi)
    return c.a * lam * m.cos(phi) / m.sqrt(1 - s * s), meridian(m, c.a, c.e, phi), m.true(phi)


def _sinu_inverse(m, c, x, y):
    phi = from_meridian(m, c.a, c.e, y)
    s = c.e * m.sin(phi)
    lam = m.when(m.abs(phi) < HALF - NEAR, m.divide(x * m.sqrt(1 - s * s), c.a * m.cos(phi)), 0.0)
    return lam, m.when(m.abs(phi) <= HALF + NEAR, phi, math.nan)


register_projection("sinu", lambda numbers, a, e: {"a": a, "e": e}, _sinu_forward, _sinu_inverse)


# Stereographic: polar or oblique by lat_0.
def _stere_setup(numbers, a, e):
    lat_0, k_0 = _radians(numbers, "lat_0"), _scale(numbers)
    c = {"e": e, "pole": 0}
    if abs(abs(lat_0) - HALF) < NEAR:
        c["pole"] = 1 if lat_0 > 0 else -1
        ts = abs(_radians(numbers, "lat_ts", 90.0))
        if abs(ts - HALF) < NEAR:
            c["size"] = 2 * a * k_0 / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))
        else:
            chi = math.atan(float(conformal_tangent(NUMBERS, e, ts)))
            c["size"] = a * k_0 * parallel(e, ts) / math.tan(math.pi / 4 - chi / 2)
    else:
        chi = math.atan(float(conformal_tangent(NUMBERS, e, lat_0)))
        c |= {"sin": math.sin(chi), "cos": math.cos(chi), "size": 2 * a * k_0 * parallel(e, lat_0) / math.cos(chi)}
    return c


def _stere_forward(m, c, lam, phi):
    if c.pole:
        chi = m.atan(conformal_tangent(m, c.e, c.pole * phi))
        rho = c.size * m.tan(math.pi / 4 - chi / 2)
        return rho * m.sin(lam), -c.pole * rho * m.cos(lam), c.pole * phi > NEAR - HALF
    chi = m.atan(conformal_tangent(m, c.e, phi))
    s, t, u = m.sin(chi), m.cos(chi) * m.cos(lam), m.cos(chi) * m.sin(lam)
    near = 1 + c.sin * s + c.cos * t
    k = m.divide(c.size + 0 * near, near)
    return k * u, k * (c.cos * s - c.sin * t), near > NEAR


def _stere_inverse(m, c, x, y):
    rho = m.sqrt(x * x + y * y)
    if c.pole:
        chi = HALF - 2 * m.atan(rho / c.size)
        return m.atan2(x, -c.pole * y), c.pole * from_conformal(m, c.e, chi)
    far = 2 * m.atan(rho / c.size)
    s, t = m.sin(far), m.cos(far)
    chi = m.when(rho > 0, m.asin(t * c.sin + m.divide(y * s * c.cos, rho)), math.asin(c.sin))
    return m.when(rho > 0, m.atan2(x * s, rho * c.cos * t - y * c.sin * s), 0.0), from_conformal(m, c.e, chi)


register_projection("stere", _stere_setup, _stere_forward, _stere_inverse, ("lat_0", "lat_ts", "k_0", "k"))


# Lambert's azimuthal equal-area: polar or oblique by lat_0.
def _laea_setup(numbers, a, e):
    lat_0 = _radians(numbers, "lat_0")
    full = float(authalic(NUMBERS, e, HALF))
    c = {"a": a, "e": e, "full": full, "pole": 0}
    if abs(abs(lat_0) - HALF) < NEAR:
        return c | {"pole": 1 if lat_0 > 0 else -1}
    beta = math.asin(float(authalic(NUMBERS, e, lat_0)) / full)
    size = a * math.sqrt(full / 2)
    return c | {"sin": math.sin(beta), "cos": math.cos(beta), "size": size, "squeeze": a * parallel(e, lat_0) / (size * math.cos(beta))}


def _laea_forward(m, c, lam, phi):
    q = authalic(m, c.e, phi)
    if c.pole:
        left = c.full - c.pole * q
        rho = c.a * m.sqrt(m.when(left > 0, left, 0.0))
        return rho * m.sin(lam), -c.pole * rho * m.cos(lam), c.pole * phi > NEAR - HALF
    s = q / c.full
    s = m.when(s > 1, 1.0, m.when(s < -1, -1.0, s))
    cos = m.sqrt(1 - s * s)
    near = 1 + c.sin * s + c.cos * cos * m.cos(lam)
    k = c.size * m.sqrt(m.when(near > NEAR, m.divide(2.0 + 0 * near, near), 0.0))
    return k * c.squeeze * cos * m.sin(lam), k / c.squeeze * (c.cos * s - c.sin * cos * m.cos(lam)), near > NEAR


def _laea_inverse(m, c, x, y):
    if c.pole:
        s = c.pole * (1 - (x * x + y * y) / (c.a * c.a * c.full))
        return m.atan2(x, -c.pole * y), from_authalic(m, c.e, m.asin(s))
    u, v = x / c.squeeze, y * c.squeeze
    rho = m.sqrt(u * u + v * v)
    far = 2 * m.asin(rho / (2 * c.size))
    s, t = m.sin(far), m.cos(far)
    beta = m.when(rho > 0, m.asin(t * c.sin + m.divide(v * s * c.cos, rho)), math.asin(c.sin))
    return m.when(rho > 0, m.atan2(u * s, rho * c.cos * t - v * c.sin * s), 0.0), from_authalic(m, c.e, beta)


register_projection("laea", _laea_setup, _laea_forward, _laea_inverse, ("lat_0",))


# Cylindrical equal-area.
def _cea_setup(numbers, a, e):
    ts = _radians(numbers, "lat_ts")
    if abs(ts) > HALF - NEAR:
        raise ValueError("lat_ts is at a pole")
    return {"a": a, "e": e, "k": parallel(e, ts) if "lat_ts" in numbers else _scale(numbers), "full": float(authalic(NUMBERS, e, HALF))}


register_projection(
    "cea",
    _cea_setup,
    lambda m, c, lam, phi: (c.a * c.k * lam, c.a / (2 * c.k) * authalic(m, c.e, phi), m.true(phi)),
    lambda m, c, x, y: (x / (c.a * c.k), from_authalic(m, c.e, m.asin(2 * c.k / (c.a * c.full) * y))),
    ("lat_ts", "k_0", "k"),
)


# Lambert's conformal conic.
def _lcc_setup(numbers, a, e):
    lat_0, lat_1 = _radians(numbers, "lat_0", numbers.get("lat_1", 0.0)), _radians(numbers, "lat_1")
    lat_2 = _radians(numbers, "lat_2", math.degrees(lat_1))
    if abs(lat_1 + lat_2) < NEAR or max(abs(lat_1), abs(lat_2)) > HALF - NEAR:
        raise ValueError("the standard parallels don't make a cone")
    t = lambda phi: 0.0 if phi > HALF - NEAR else math.exp(-math.asinh(float(conformal_tangent(NUMBERS, e, phi))))
    n = math.sin(lat_1)
    if abs(lat_1 - lat_2) > NEAR:
        n = math.log(parallel(e, lat_1) / parallel(e, lat_2)) / math.log(t(lat_1) / t(lat_2))
    size = a * _scale(numbers) * parallel(e, lat_1) / (n * t(lat_1) ** n)
    if lat_0 < NEAR - HALF and n > 0:
        raise ValueError("lat_0 is at the far pole")
    return {"e": e, "n": n, "size": size, "top": size * t(lat_0) ** n if lat_0 <= HALF - NEAR or n > 0 else 0.0}


def _lcc_forward(m, c, lam, phi):
    chi = m.atan(conformal_tangent(m, c.e, phi))
    apex = m.abs(phi) > HALF - NEAR
    rho = m.when(apex, 0.0, c.size * m.power(m.tan(math.pi / 4 - chi / 2), c.n))
    return rho * m.sin(c.n * lam), c.top - rho * m.cos(c.n * lam), (phi * c.n > 0) | (m.abs(phi) < HALF - NEAR)


def _lcc_inverse(m, c, x, y):
    sign = 1.0 if c.n > 0 else -1.0
    u, v = sign * x, sign * (c.top - y)
    rho = sign * m.sqrt(u * u + v * v)
    t = m.power(rho / c.size, 1 / c.n)
    return m.atan2(u, v) / c.n, from_conformal(m, c.e, HALF - 2 * m.atan(t))


register_projection("lcc", _lcc_setup, _lcc_forward, _lcc_inverse, ("lat_0", "lat_1", "lat_2", "k_0", "k"))


# Transverse Mercator, and its zones.
def _tmerc_setup(numbers, a, e):
    n = third_flattening(e)
    to = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    back = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    k_0 = _scale(numbers)
    return {"e": e, "size": k_0 * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64), "to": to, "back": back, "south": k_0 * float(meridian(NUMBERS, a, e, _radians(numbers, "lat_0")))}


def _bend(m, factors, xi, eta, sign):
    x, y = xi, eta
    for k, f in enumerate(factors, 1):
        if f:
            x = x + sign * f * m.sin(2 * k * xi) * m.cosh(2 * k * eta)
            y = y + sign * f * m.cos(2 * k * xi) * m.sinh(2 * k * eta)
    return x, y


def _tmerc_forward(m, c, lam, phi):
    t = conformal_tangent(m, c.e, phi)
    pole = m.abs(phi) > HALF - NEAR
    s = m.when(pole, 0.0, m.sin(lam) / m.sqrt(1 + t * t))
    xi = m.when(pole, phi, m.atan2(t, m.cos(lam)))
    xi, eta = _bend(m, c.to, xi, m.atanh(s), 1)
    return c.size * eta, c.size * xi - c.south, (m.abs(lam) < HALF) & (m.abs(s) < 1 - NEAR) | pole


def _tmerc_inverse(m, c, x, y):
    xi, eta = _bend(m, c.back, (y + c.south) / c.size, x / c.size, -1)
    chi = m.asin(m.sin(xi) / m.cosh(eta))
    return m.atan2(m.sinh(eta), m.cos(xi)), from_conformal(m, c.e, chi)


register_projection("tmerc", _tmerc_setup, _tmerc_forward, _tmerc_inverse, ("lat_0", "k_0", "k"))


def _utm_setup(numbers, a, e):
    zone = numbers.get("zone", math.floor((numbers.get("lon_0", 0.0) + 180) / 6) + 1)
    if zone != int(zone) or not 1 <= zone <= 60:
        raise ValueError(f"no zone {zone:g}; zones go from 1 to 60")
    return _tmerc_setup({"k_0": 0.9996}, a, e) | {"lon_0": zone * 6.0 - 183, "x_0": 500_000.0, "y_0": 10_000_000.0 if numbers.get("south") else 0.0}


register_projection("utm", _utm_setup, _tmerc_forward, _tmerc_inverse, ("zone", "south"))
