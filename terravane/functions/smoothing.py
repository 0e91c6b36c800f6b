"""Smoothing kernels as Columns, by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KERNELS = {
    "gaussian": lambda u: F.exp(u * -3.0),
    "quadratic": lambda u: F.greatest(1.0 - u, F.lit(0.0)),
}


def kernel(name: str, u: Column, truncate: bool = False) -> Column:
    """gau(ssian): exp(-3u); qua(dratic): max(1-u, 0), with u = (ds/bs)² + (dt/bt)²; truncated ones are 0 beyond u = 1."""
    found = [f for k, f in KERNELS.items() if k.startswith(name.lower()) and len(name) >= 3]
    if not found:
        raise ValueError(f"unknown kernel {name}")
    value = found[0](u)
    return F.when(u > 1, 0.0).otherwise(value) if truncate else value


def neighbour_kernel(name: str, d: Column, width: float) -> Column:
    """tricube (1-(d/w)³)³, bicube (1-(d/w)²)², exp exp(-d/w); the first two are 0 beyond the width."""
    r = d / width
    if name == "tricube":
        return F.when(r < 1, F.pow(1 - F.pow(r, 3.0), 3.0)).otherwise(0.0)
    if name == "bicube":
        return F.when(r < 1, F.pow(1 - F.pow(r, 2.0), 2.0)).otherwise(0.0)
    if name == "exp":
        return F.exp(-r)
    raise ValueError(f"unknown kernel {name}")


def local_kernel(name: str, d: Column, bandwidth: float | Column) -> Column:
    """Nadaraya-Watson weights: gaussian exp(-u²/2), epanechnikov max(1-u², 0), with u = d / bandwidth."""
    u2 = F.pow(d / bandwidth, 2.0)
    return F.exp(u2 * -0.5) if name.startswith("gau") else F.greatest(1 - u2, F.lit(0.0))
