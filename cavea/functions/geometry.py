"""Geometry as column expressions; only eigenvectors need Python, in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import config

#: Half of the golden ratio: a point turns by two pi over the ratio from the last.
GOLDEN = (1 + 5**0.5) / 4


def fib_point(i: Column, n: Column, radius: Column) -> Column:
    """Point i of n of a golden spiral on a sphere, as struct dx, dy, dz."""
    phi = F.acos(1 - 2 * (i + 0.5) / n)
    theta = F.lit(math.pi) * i / F.lit(GOLDEN)
    return F.struct((F.cos(theta) * F.sin(phi) * radius).alias("dx"), (F.sin(theta) * F.sin(phi) * radius).alias("dy"), (F.cos(phi) * radius).alias("dz"))


def fib_sphere(radius: Column, n: Column) -> Column:
    """Array of the n points; empty for n <= 0."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: fib_point(i, n, radius))).otherwise(F.array().cast(POINTS))


def fib_sphere_table(spark: SparkSession, radius: float, n: int) -> DataFrame:
    """The points as a table."""
    return spark.range(1).select(F.posexplode(fib_sphere(F.lit(float(radius)), F.lit(n))).alias("i", "p")).select("i", "p.dx", "p.dy", "p.dz")


def sphere_samples(radius: float, size: float) -> int:
    """Points from 20, doubled until the first two lie within ``size``."""

    def first_two(n: int) -> float:
        ends = []
        for i in (0, 1):
            phi, theta = math.acos(1 - 2 * (i + 0.5) / n), math.pi * i / GOLDEN
            ends.append((math.cos(theta) * math.sin(phi) * radius, math.sin(theta) * math.sin(phi) * radius, math.cos(phi) * radius))
        return math.dist(*ends)

    n = 20
    while first_two(n) > size:
        n *= 2
    return n


def shell_radii(radius: float, size: float) -> list[float]:
    """The radius, and smaller ones a voxel apart, while the least is over a voxel."""
    out = [radius]
    while out[-1] > size:
        out.append(radius - size * len(out))
    return out


def shell_table(spark: SparkSession, size: float) -> DataFrame:
    """(element, radius, n) for every element with a radius, and the default ('')."""
    rows = [(e, r, sphere_samples(r, size)) for e, full in {**config.RADII, "": config.DEFAULT_RADIUS}.items() for r in shell_radii(full, size)]
    return spark.createDataFrame(rows, "shell_element string, radius double, n int")


POINTS = T.ArrayType(T.StructType([T.StructField(c, T.DoubleType()) for c in ("dx", "dy", "dz")]))
VECTORS = T.StructType([T.StructField("values", T.ArrayType(T.DoubleType())), T.StructField("vectors", T.ArrayType(T.DoubleType()))])


#: Eigenvalues within this share of the largest are equal, and components of a unit vector
#: within ``TIE``.
EQUAL, TIE = 1e-6, 1e-9


def _across(u: np.ndarray) -> np.ndarray:
    """A unit vector across each row of ``u``: the coordinate axis that ``u`` has least of
    (the first of equals), without its part along ``u``."""
    size = np.abs(u)
    k = (size <= size.min(1, keepdims=True) + TIE).argmax(1)
    out = np.eye(3)[k] - u * u[np.arange(len(u)), k][:, None]
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def axes3(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues in falling order, their vectors as rows) of symmetric 3x3 matrices.

    Where eigenvalues are equal, vectors follow the coordinate axes. Signs: the first
    vector's largest component (the first of equals) is negative, the second's positive,
    the third is their cross product."""
    w, v = np.linalg.eigh(a)
    w, v = w[:, ::-1], v[:, :, ::-1].transpose(0, 2, 1).copy()
    near = EQUAL * np.abs(w[:, :1])
    first, last = w[:, 0] - w[:, 1] <= near[:, 0], w[:, 1] - w[:, 2] <= near[:, 0]
    only = last & ~first
    v[only, 1] = _across(v[only, 0])
    only = first & ~last
    v[only, 0] = _across(v[only, 2])
    v[only, 1] = np.cross(v[only, 2], v[only, 0])
    v[first & last] = np.eye(3)
    row = np.arange(len(v))
    for k, sign in ((0, -1), (1, 1)):
        size = np.abs(v[:, k])
        lead = v[row, k, (size >= size.max(1, keepdims=True) - TIE).argmax(1)]
        v[:, k] *= np.where(np.sign(lead) == 0, 1, np.sign(lead) * sign)[:, None]
    v[:, 2] = np.cross(v[:, 0], v[:, 1])
    return w, v


@F.pandas_udf(VECTORS)
def eigh3(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
    """``axes3`` as a column: eigenvalues and their vectors, one after another."""
    a = np.empty((len(xx), 3, 3))
    for (i, j), v in zip(((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)), (xx, xy, xz, yy, yz, zz)):
        a[:, i, j] = a[:, j, i] = np.nan_to_num(v.to_numpy(float))
    w, v = axes3(a)
    return pd.DataFrame({"values": list(w), "vectors": list(v.reshape(len(v), 9))})


def scatter_matrix(points: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: mx, my, mz, n and centred cross products xx .. zz, in two passes so
    that nothing cancels."""
    mean = points.groupBy(*keys).agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"], F.count(F.lit(1)).alias("n"))
    near = points.join(mean, keys).withColumns({f"d{c}": F.col(c) - F.col(f"m{c}") for c in "xyz"})
    pairs = ["xx", "xy", "xz", "yy", "yz", "zz"]
    return near.groupBy(*keys, "mx", "my", "mz", "n").agg(*[F.sum(F.col(f"d{p[0]}") * F.col(f"d{p[1]}")).alias(p) for p in pairs])


def principal_axes(points: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the mean, the number of points, ``axes`` (nine numbers) and ``spread``, the
    sums of squares along them."""
    found = scatter_matrix(points, keys).withColumn("e", eigh3("xx", "xy", "xz", "yy", "yz", "zz"))
    return found.select(*keys, "mx", "my", "mz", "n", F.col("e.vectors").alias("axes"), F.col("e.values").alias("spread"))


def along(axis: int) -> Column:
    """Coordinate of (x, y, z) along a principal axis from the mean."""
    return sum((F.element_at("axes", 3 * axis + k + 2) * (F.col(c) - F.col(f"m{c}")) for k, c in enumerate("yz")), F.element_at("axes", 3 * axis + 1) * (F.col("x") - F.col("mx")))
