"""Column expressions that the operators share. All are JVM-side; none is a UDF."""

from __future__ import annotations

import math

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Rounding of the grid snapper; everything else rounds half to even with ``rint``."""
    return F.floor(x + 0.5)


def null_if_nan(x: Column) -> Column:
    """NaN is greater than everything in Spark: missing scores are nulls inside the engine."""
    return F.when(~F.isnan(x), x)


def hamming(i: Column, n: int) -> Column:
    return F.lit(0.54) - 0.46 * F.cos(2 * math.pi * i / max(n - 1, 1))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def euclidean_distance(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(dot(d, d))


def l2_normalise(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / norm(a))


def power_normalise(samples: Column) -> Column:
    """Samples over their root mean square."""
    rms = F.sqrt(dot(samples, samples) / F.size(samples))
    return F.transform(samples, lambda x: x / (rms + 1e-8))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_softmax(x: Column, group: WindowSpec) -> Column:
    """Of a score among those of its group, taken from the highest so that nothing overflows."""
    top = F.max(x).over(group)
    return x - top - F.log(F.sum(F.exp(x - top)).over(group))


def uniform(seed: int, *key: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the key alone: the same on any partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 52)) / float(1 << 52)
