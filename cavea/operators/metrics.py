"""Sizes and shapes of components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.geometry import along, principal_axes
from .steps import settled
from .voxels import SID, voxel_center

KEYS = [SID, "comp"]


def component_centers(voxels: DataFrame, grids: DataFrame) -> DataFrame:
    """``voxels`` with the centre of each in x, y, z."""
    return voxels.join(grids.select(SID, "lo", "size"), SID).select(*voxels.columns, *[voxel_center(c).alias(c) for c in "xyz"])


def component_size(voxels: DataFrame, size: float) -> DataFrame:
    """num_voxels, volume and mean centre of each component."""
    return voxels.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("num_voxels"), (F.count(F.lit(1)) * F.lit(float(size) ** 3)).alias("volume"), F.struct(*[F.avg(c).alias(c) for c in "xyz"]).alias("center")
    )


def slice_count(low: Column, high: Column, width: Column) -> Column:
    return F.greatest(F.lit(3), F.bround((high - low) / width)).cast("int")


def slice_id(value: Column, low: Column, high: Column, bins: Column) -> Column:
    """Bin of a value; the right edge belongs to the last bin. A value within a billionth
    of a bin below an edge is on it, so that rounding in the last digit can't part equal
    values."""
    return F.least(bins - 1, F.floor((value - low) / (high - low) * bins + 1e-9)).cast("int")


def _spans(voxels: DataFrame, grids: DataFrame, slice_width: float | None) -> tuple[DataFrame, DataFrame]:
    """(voxels along their component's axes in a0 to a2, per component the ends of a0, the
    lengths and the width of slices)."""
    axes = principal_axes(voxels, KEYS)
    placed = voxels.join(axes, KEYS).withColumns({f"a{k}": along(k) for k in range(3)})
    placed = settled(placed.select(*KEYS, "n", "a0", "a1", "a2"))
    ends = placed.groupBy(*KEYS, "n").agg(F.min("a0").alias("low"), F.max("a0").alias("high"), *[F.bround(F.max(f"a{k}") - F.min(f"a{k}"), 3).alias(f"l{k}") for k in range(3)])
    width = F.lit(float(slice_width)) if slice_width else F.col("nx").cast("double")
    return placed, ends.join(grids.select(SID, "nx"), SID).withColumn("width", width).drop("nx")


def _sliced(placed: DataFrame, spans: DataFrame) -> DataFrame:
    real = spans.filter("n >= 3 and high - low >= 1e-9").select(*KEYS, "low", "high", slice_count(F.col("low"), F.col("high"), F.col("width")).alias("bins"))
    return placed.select(*KEYS, "a0", "a1", "a2").join(real, KEYS).withColumn("slice", slice_id(F.col("a0"), F.col("low"), F.col("high"), F.col("bins")))


def slices(voxels: DataFrame, grids: DataFrame, slice_width: float | None = None) -> DataFrame:
    """Voxels (x, y, z) of components of three or more, with their place along the axes (a0
    to a2), ``slice`` and the component's number of slices, ``bins``."""
    return _sliced(*_spans(voxels, grids, slice_width))


def shape_metrics(voxels: DataFrame, grids: DataFrame, slice_width: float | None = None) -> DataFrame:
    """KEYS, axial_lengths (falling, three decimals), circularity, uniformity.

    Under three voxels the lengths are 0 and the others null. ``voxels`` need x, y, z.
    """
    placed, spans = _spans(voxels, grids, slice_width)
    sliced = _sliced(placed, spans)
    per = sliced.groupBy(*KEYS, "slice").agg(F.count(F.lit(1)).alias("c"), F.var_pop("a1").alias("p"), F.var_pop("a2").alias("q"), F.covar_pop("a1", "a2").alias("r"))
    root = F.sqrt(F.pow((F.col("p") - F.col("q")) / 2, 2) + F.pow("r", F.lit(2.0)))
    mid = (F.col("p") + F.col("q")) / 2
    ratio = F.when(F.col("c") >= 3, F.when(mid + root > 1e-12, (mid - root) / (mid + root)).otherwise(1.0))
    even = F.when(F.count(F.lit(1)) >= 2, F.bround(F.greatest(F.lit(0.0), 1 - F.stddev_pop("c") / F.avg("c")), 4))
    shape = per.withColumn("ratio", ratio).groupBy(*KEYS).agg(F.bround(F.avg("ratio"), 4).alias("circ"), even.alias("even"))
    flat, few = F.col("high") - F.col("low") < 1e-9, F.col("n") < 3
    lengths = F.reverse(F.array_sort(F.array("l0", "l1", "l2")))
    return spans.join(shape, KEYS, "left").select(
        *KEYS, F.when(few, F.array(*[F.lit(0.0)] * 3)).otherwise(lengths).alias("axial_lengths"),
        F.when(few, None).when(flat, 1.0).otherwise(F.col("circ")).alias("circularity"), F.when(few, None).when(flat, 1.0).otherwise(F.col("even")).alias("uniformity"),
    )


def volume_summary(components: DataFrame, keys: list[str]) -> DataFrame:
    """Total, largest and mean volume, 0 where there is none."""
    return components.groupBy(*keys).agg(*[F.coalesce(f("volume"), F.lit(0.0)).alias(n) for f, n in ((F.sum, "total"), (F.max, "largest"), (F.avg, "mean"))])


def rank_volumes(components: DataFrame) -> DataFrame:
    """``components`` with ``id``, from 0 within a structure and final type: volume
    falling, ties by topology type and then by the least voxel."""
    topo = F.when(F.col("type") == "hub", 0).when(F.col("type") == "pore", 1).when(F.col("type") == "pocket", 2).otherwise(3)
    w = W.partitionBy(SID, "final_type").orderBy(F.desc("volume"), topo, "comp")
    return components.withColumn("id", (F.row_number().over(w) - 1).cast("int"))


def annotation_rollup(annotations: DataFrame) -> DataFrame:
    """Per structure: total, largest volume and number for each type, 0 if none."""
    kinds = ["cavity", "hub", "pocket", "pore"]
    out = annotations.groupBy(SID).pivot("type", kinds).agg(F.sum("volume").alias("total"), F.max("volume").alias("largest"), F.count(F.lit(1)).alias("num"))
    return out.fillna(0)


def annotation_maps(annotations: DataFrame) -> DataFrame:
    """Per structure and type: id to volume, id to lengths, id to shape."""
    def by_id(value: Column) -> Column:
        return F.map_from_entries(F.sort_array(F.collect_list(F.struct("id", value.alias("v")))))

    return annotations.groupBy(SID, "type").agg(by_id(F.col("volume")).alias("volumes"), by_id(F.array("x", "y", "z")).alias("dimensions"), by_id(F.array("circularity", "uniformity")).alias("shapes"))
