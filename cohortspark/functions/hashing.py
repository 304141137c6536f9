"""Reproducible pseudo-random numbers from md5: the same in Spark and in any SQL engine with md5."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(value: Column) -> Column:
    """The first eight hex digits of md5 of the value as text, as a long from 0 to 2^32 - 1; null for null."""
    return F.conv(F.substring(F.md5(value.cast("string")), 1, 8), 16, 10).cast("long")


def bucket(entity: Column, salt: str = "", size: int = 10_000) -> Column:
    """A bucket from 0 to size - 1 that depends on the entity and the salt alone."""
    return F.pmod(hash32(F.concat(F.lit(salt), entity.cast("string"))), F.lit(size))


def uniform(value: Column) -> Column:
    """A double in [0, 1)."""
    return hash32(value) / F.lit(4294967296.0)


#: Cumulative probabilities of Poisson(1) up to 8; the rest of the mass counts as 9.
POISSON_STEPS = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(9)]


MIXER = 73244475  #: odd multiplier of the replicates' bit mixer; products stay under 2^63


def seeds(unit: Column) -> tuple[Column, Column]:
    """Two 32-bit numbers of a unit from its md5, the second one odd; null counts as an empty text."""
    hexed = F.md5(F.coalesce(unit.cast("string"), F.lit("")))
    at = lambda i: F.conv(F.substring(hexed, i, 8), 16, 10).cast("long")
    return at(1), at(9).bitwiseOR(F.lit(1))


def poisson_weights(one: np.ndarray, two: np.ndarray, reps: int) -> np.ndarray:
    """Poisson(1) weights [unit, replicate] from the units' seeds: a mixed walk from the first seed by steps of the second."""
    m, h, steps, out = np.uint32(MIXER), np.uint32(16), np.arange(reps, dtype=np.uint32), np.zeros((len(one), reps), np.uint8)
    one, two = one.astype(np.uint32), two.astype(np.uint32)
    for at in range(0, len(one), 512):  # small arrays stay in the cache; 32 bits wrap as the mixer wants
        x = one[at : at + 512, None] + steps * two[at : at + 512, None]
        for _ in range(2):
            x ^= x >> h
            x *= m
        x ^= x >> h
        for step in POISSON_STEPS:
            out[at : at + 512] += x >= np.uint32(math.ceil(step * 4294967296))
    return out
