"""Distance on the WGS-84 ellipsoid: no built-in function has it, so it is a vectorised UDF."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563  # fixed values of WGS-84


def inverse(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Metres by Vincenty's inverse formula. Nearly antipodal pairs, where it does not settle, get the sphere's distance."""
    b = SEMI_MAJOR * (1 - FLATTENING)
    u1, u2 = (np.arctan((1 - FLATTENING) * np.tan(np.radians(x))) for x in (lat1, lat2))
    apart = np.radians((lon2 - lon1 + 180) % 360 - 180)
    lam = apart.copy()
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(60):
            sin_s = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
            cos_s = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s > 0, np.cos(u1) * np.cos(u2) * np.sin(lam) / sin_s, 0.0)
            cos2_a = 1 - sin_a**2
            mid = np.where(cos2_a > 1e-15, cos_s - 2 * np.sin(u1) * np.sin(u2) / cos2_a, 0.0)
            c = FLATTENING / 16 * cos2_a * (4 + FLATTENING * (4 - 3 * cos2_a))
            before, lam = lam, apart + (1 - c) * FLATTENING * sin_a * (sigma + c * sin_s * (mid + c * cos_s * (2 * mid**2 - 1)))
            if not (np.abs(lam - before) > 1e-13).any():
                break
        settled = np.abs(lam - before) <= 1e-10
        k = cos2_a * (SEMI_MAJOR**2 - b**2) / b**2
        big = 1 + k / 16384 * (4096 + k * (k * (320 - 175 * k) - 768))
        small = k / 1024 * (256 + k * (k * (74 - 47 * k) - 128))
        fix = small * sin_s * (mid + small / 4 * (cos_s * (2 * mid**2 - 1) - small / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)))
        found = b * big * (sigma - fix)
        half = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(apart / 2) ** 2
        return np.where(settled, found, 2 * 6371008.8 * np.arcsin(np.sqrt(np.minimum(1, half))))


@F.pandas_udf(DoubleType())
def geodesic(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    """Metres between two points on the ellipsoid; NULL where a coordinate is NULL."""
    known = lat1.notna() & lon1.notna() & lat2.notna() & lon2.notna()
    out = pd.Series(np.nan, index=lat1.index, dtype="float64")
    if known.any():
        out[known] = inverse(*(s[known].to_numpy(float) for s in (lat1, lon1, lat2, lon2)))
    return out.where(known, None)
