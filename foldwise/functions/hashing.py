"""Reproducible pseudo-random numbers from a row id and a seed (md5, so any engine can repeat them)."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def hash_hex(key: Column, seed) -> Column:
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def hash_int(key: Column, seed) -> Column:
    """32-bit unsigned integer as long."""
    return F.conv(F.substring(hash_hex(key, seed), 1, 8), 16, 10).cast("long")


def hash_unit(key: Column, seed) -> Column:
    """Uniform number strictly inside (0, 1)."""
    return (hash_int(key, seed) + F.lit(0.5)) / F.lit(float(2**32))


def hash_normal(key: Column, seed) -> Column:
    """Standard normal number (Box-Muller on two uniforms)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(hash_unit(key, f"{seed}a")))
    return radius * F.cos(F.lit(2.0 * math.pi) * hash_unit(key, f"{seed}b"))
