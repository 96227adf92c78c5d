"""Easing curves as column expressions of progress t in [0, 1] (ids 0 to 34; unknown ids are linear)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed constants of the overshooting and bouncing curves.
BACK = 1.70158
BACK_BOTH = 1.525 * BACK
BOUNCE_N, BOUNCE_D = 7.5625, 2.75
ELASTIC = 2 * math.pi / 3
ELASTIC_BOTH = 2 * math.pi / 4.5
EPSILON = 1e-9


def _near(t: Column, x: float) -> Column:
    return F.abs(t - x) <= EPSILON


def _halves(t: Column, low: Column, high: Column) -> Column:
    return F.when(t < 0.5, low).otherwise(high)


def _fixed_ends(t: Column, inner: Column) -> Column:
    return F.when(_near(t, 0.0), F.lit(0.0)).when(_near(t, 1.0), F.lit(1.0)).otherwise(inner)


def _exp2(x: Column) -> Column:
    return F.pow(F.lit(2.0), x)


def _power_family(t: Column, n: int) -> tuple[Column, Column, Column]:
    return (
        F.pow(t, F.lit(float(n))),
        1 - F.pow(1 - t, F.lit(float(n))),
        _halves(t, 2.0 ** (n - 1) * F.pow(t, F.lit(float(n))), 1 - F.pow(-2 * t + 2, F.lit(float(n))) / 2),
    )


def _root(x: Column) -> Column:
    return F.sqrt(F.greatest(x, F.lit(0.0)))


def bounce_out(t: Column) -> Column:
    def arc(shift: float, lift: float) -> Column:
        return BOUNCE_N * (t - shift / BOUNCE_D) * (t - shift / BOUNCE_D) + lift

    return F.when(t < 1 / BOUNCE_D, arc(0.0, 0.0)).when(t < 2 / BOUNCE_D, arc(1.5, 0.75)).when(t < 2.5 / BOUNCE_D, arc(2.25, 0.9375)).otherwise(arc(2.625, 0.984375))


def _elastic_out(t: Column, swing: float) -> Column:
    return _fixed_ends(t, swing * _exp2(-10 * t) * F.sin((10 * t - 0.75) * ELASTIC) + 1)


def curves(t: Column) -> dict[int, Column]:
    """The curve of each id."""
    out: dict[int, Column] = {0: t}
    quad = _power_family(t, 2)
    out |= {1: quad[1], 2: quad[0], 3: quad[0], 4: quad[1], 5: quad[2]}
    for first, n in ((6, 3), (9, 4), (12, 5)):
        out |= dict(zip(range(first, first + 3), _power_family(t, n), strict=True))
    out |= {15: 1 - F.cos(t * math.pi / 2), 16: F.sin(t * math.pi / 2), 17: -(F.cos(t * math.pi) - 1) / 2}
    out[18] = F.when(_near(t, 0.0), F.lit(0.0)).otherwise(_exp2(10 * t - 10))
    out[19] = F.when(_near(t, 1.0), F.lit(1.0)).otherwise(1 - _exp2(-10 * t))
    out[20] = _fixed_ends(t, _halves(t, _exp2(20 * t - 10) / 2, (2 - _exp2(-20 * t + 10)) / 2))
    out[21] = 1 - _root(1 - t * t)
    out[22] = _root(1 - (t - 1) * (t - 1))
    out[23] = _halves(t, (1 - _root(1 - 4 * t * t)) / 2, (_root(1 - (-2 * t + 2) * (-2 * t + 2)) + 1) / 2)
    out[24] = _fixed_ends(t, -_exp2(10 * t - 10) * F.sin((10 * t - 10.75) * ELASTIC))
    out |= {25: _elastic_out(t, 1.0), 26: _elastic_out(t, 0.5), 27: _elastic_out(t, 0.25)}
    wave = F.sin((20 * t - 11.125) * ELASTIC_BOTH)
    out[28] = _fixed_ends(t, _halves(t, -(_exp2(20 * t - 10) * wave) / 2, _exp2(-20 * t + 10) * wave / 2 + 1))
    s = t - 1
    out[29] = (BACK + 1) * t * t * t - BACK * t * t
    out[30] = 1 + (BACK + 1) * s * s * s + BACK * s * s
    u, v = 2 * t, 2 * t - 2
    out[31] = _halves(t, u * u * ((BACK_BOTH + 1) * u - BACK_BOTH) / 2, (v * v * ((BACK_BOTH + 1) * v + BACK_BOTH) + 2) / 2)
    out[32] = 1 - bounce_out(1 - t)
    out[33] = bounce_out(t)
    out[34] = _halves(t, (1 - bounce_out(1 - 2 * t)) / 2, (1 + bounce_out(2 * t - 1)) / 2)
    return out


def ease(easing: Column, t: Column) -> Column:
    """The curve ``easing`` names, at t."""

    def at(x: Column) -> Column:
        out = F
        for k, c in curves(x).items():
            out = out.when(easing == k, c)
        return out.otherwise(x)

    # bound to a variable, t is made once and not written out in every curve
    return F.get(F.transform(F.array(t.cast("double")), at), 0)
