"""Rounding as Spark's round has it: the shortest decimals that stand for a number, halves away from zero."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(v: np.ndarray, places: int) -> np.ndarray:
    """v with so many places.  Numbers near a half, and those whose places a product cannot tell, are rounded as decimals one by one."""
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.abs(v) * 10.0**places
        whole = np.floor(scaled + 0.5)
        out = np.copysign(whole / 10.0**places, v)
        near = np.abs(scaled - np.floor(scaled) - 0.5) <= 1e-6 + 4 * np.finfo(float).eps * scaled
    near &= np.isfinite(v)
    out[~np.isfinite(v)] = v[~np.isfinite(v)]
    unit = Decimal(1).scaleb(-places)
    for i in np.flatnonzero(near):
        exact = Decimal(repr(float(v[i])))
        out[i] = float(exact.quantize(unit, ROUND_HALF_UP)) if exact.as_tuple().exponent < -places else float(v[i])
    return out


def short(v: Column, places: int) -> Column:
    """``F.round``, which goes by way of decimals, where these may decide; else, as for nearly all numbers, by a product."""
    scaled = v * 10.0**places
    off = F.abs(scaled - F.floor(scaled) - 0.5)
    plain = (v >= 0) & (scaled < 2.0**50) & (off > 1e-6 + 4 * np.finfo(float).eps.item() * scaled)
    return F.when(plain, F.floor(scaled + 0.5) / F.lit(10.0**places)).otherwise(F.round(v, places))
