"""Monotone piecewise cubic interpolation (Fritsch and Butland, 1984) as column arithmetic.

The knots are fixed, so slopes and values are plain expressions that stay inside generated code.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from preptrail import schemas as S

_STEPS = [float(b - a) for a, b in zip(S.KNOTS, S.KNOTS[1:])]
_LAST = len(S.KNOTS) - 1


def _interior_slope(k: int, left: Column, right: Column) -> Column:
    w_left = 2 * _STEPS[k] + _STEPS[k - 1]
    w_right = _STEPS[k] + 2 * _STEPS[k - 1]
    harmonic = F.lit(w_left + w_right) / (F.lit(w_left) / left + F.lit(w_right) / right)
    return F.when(left * right > 0, harmonic).otherwise(F.lit(0.0))


def _end_slope(h_near: float, h_far: float, near: Column, far: Column) -> Column:
    raw = ((2 * h_near + h_far) * near - h_near * far) / (h_near + h_far)
    return (
        F.when(F.signum(raw) != F.signum(near), F.lit(0.0))
        .when((F.signum(near) != F.signum(far)) & (F.abs(raw) > 3 * F.abs(near)), 3 * near)
        .otherwise(raw)
    )


def slopes(y: Column) -> Column:
    """Derivatives at the knots for the array ``y`` of values at the knots."""
    secants = F.array(*[(y[k + 1] - y[k]) / _STEPS[k] for k in range(_LAST)])

    def derive(s: Column) -> Column:
        ends = (
            _end_slope(_STEPS[0], _STEPS[1], s[0], s[1]),
            _end_slope(_STEPS[-1], _STEPS[-2], s[_LAST - 1], s[_LAST - 2]),
        )
        inner = [_interior_slope(k, s[k - 1], s[k]) for k in range(1, _LAST)]
        return F.array(ends[0], *inner, ends[1])

    return derive(secants)


def value(day: Column, y: Column, d: Column) -> Column:
    """Interpolated value at ``day`` (between the first and the last knot)."""

    def segment(k: int) -> Column:
        h = _STEPS[k]
        t = (day - S.KNOTS[k]) / h
        u = 1 - t
        return (
            y[k] * (1 + 2 * t) * u * u
            + d[k] * h * t * u * u
            + y[k + 1] * t * t * (3 - 2 * t)
            + d[k + 1] * h * t * t * (t - 1)
        )

    out = F.when(day <= S.KNOTS[1], segment(0))
    for k in range(1, _LAST - 1):
        out = out.when(day <= S.KNOTS[k + 1], segment(k))
    return out.otherwise(segment(_LAST - 1))
