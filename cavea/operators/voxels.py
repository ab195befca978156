"""From points to occupied, buried and exposed voxels, over all structures at once.

A voxel is buried if its line along at least two axes has occupied voxels on both
sides. That is the rule "five or six of six rays blocked, or four with the open two
on one axis", so only what lies inside the occupied extents of lines is ever made;
the dense grid never is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SID = "structure_id"
STEPS = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def grid_bounds(points: DataFrame, size: float) -> DataFrame:
    """One regular grid a structure: nx, ny, nz, lo, size. The margin that whole
    voxels leave is split between both sides."""
    ends = points.groupBy(SID).agg(*[f(c).alias(f"{f.__name__}_{c}") for c in "xyz" for f in (F.min, F.max)])
    span = {c: F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"}
    dims = {c: (F.floor(span[c] / size) + 1).cast("long") for c in "xyz"}
    low = {c: F.col(f"min_{c}") - (dims[c] * size - span[c]) / 2 for c in "xyz"}
    return ends.select(
        SID, *[dims[c].alias(f"n{c}") for c in "xyz"], F.struct(*[low[c].alias(c) for c in "xyz"]).alias("lo"), F.lit(float(size)).alias("size")
    )


def flat_index(vx: str | Column = "vx", vy: str | Column = "vy", vz: str | Column = "vz") -> Column:
    vx, vy, vz = (F.col(c) if isinstance(c, str) else c for c in (vx, vy, vz))
    return (vx * F.col("ny") + vy) * F.col("nz") + vz


def voxel_center(axis: str) -> Column:
    """Centre of a voxel on an axis; needs the grid's lo and size."""
    return F.col(f"lo.{axis}") + (F.col(f"v{axis}") + 0.5) * F.col("size")


def dense_grid(grids: DataFrame) -> DataFrame:
    """Every voxel of every grid; for small grids and for checks."""
    cells = grids.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx") * F.col("ny") * F.col("nz") - 1)).alias("flat"))
    return cells.select(
        SID, F.expr("flat div (ny * nz)").alias("vx"), F.expr("(flat div nz) % ny").alias("vy"), F.expr("flat % nz").alias("vz"), "flat"
    )


def occupied_voxels(points: DataFrame, grids: DataFrame) -> DataFrame:
    """structure_id, vx, vy, vz, flat of each voxel that holds a point."""
    placed = points.join(grids, SID)
    bins = [F.least(F.greatest(F.floor((F.col(c) - F.col(f"lo.{c}")) / F.col("size")), F.lit(0)), F.col(f"n{c}") - 1).cast("long").alias(f"v{c}") for c in "xyz"]
    return placed.select(SID, *bins, "ny", "nz").withColumn("flat", flat_index()).select(SID, "vx", "vy", "vz", "flat").distinct()


def axis_extents(occupied: DataFrame) -> dict[str, DataFrame]:
    """Least and greatest occupied coordinate on each line along each axis."""
    other = {"x": ["vy", "vz"], "y": ["vx", "vz"], "z": ["vx", "vy"]}
    return {a: occupied.groupBy(SID, *other[a]).agg(F.min(f"v{a}").alias("low"), F.max(f"v{a}").alias("high")) for a in "xyz"}


def is_buried(xm: Column, xp: Column, ym: Column, yp: Column, zm: Column, zp: Column) -> Column:
    """The rule on six flags of blocked rays (minus and plus on each axis)."""
    rays = [xm, xp, ym, yp, zm, zp]
    blocked = sum((r.cast("int") for r in rays[1:]), rays[0].cast("int"))
    open_axis = (~xm & ~xp) | (~ym & ~yp) | (~zm & ~zp)
    return (blocked > 4) | ((blocked == 4) & open_axis)


def is_edge_voxel() -> Column:
    sides = [(F.col(f"v{a}") == 0) | (F.col(f"v{a}") == F.col(f"n{a}") - 1) for a in "xyz"]
    return sides[0] | sides[1] | sides[2]


def is_neighbor(a: str, b: str) -> Column:
    """Face neighbours: Manhattan distance one between structs of vx, vy, vz."""
    return sum((F.abs(F.col(f"{a}.v{c}") - F.col(f"{b}.v{c}")) for c in "yz"), F.abs(F.col(f"{a}.vx") - F.col(f"{b}.vx"))) == 1


def solvent_voxels(grids: DataFrame, occupied: DataFrame) -> DataFrame:
    """The rest of the dense grid; for small grids and for checks."""
    return dense_grid(grids).join(occupied, [SID, "flat"], "left_anti")


def buried_voxels(occupied: DataFrame, grids: DataFrame) -> DataFrame:
    """Solvent voxels strictly inside the occupied extents along two axes at least."""
    inside = None
    for axis, lines in axis_extents(occupied).items():
        run = lines.filter("high - low > 1").select("*", F.explode(F.sequence(F.col("low") + 1, F.col("high") - 1)).alias(f"v{axis}"))
        run = run.select(SID, "vx", "vy", "vz")
        inside = run if inside is None else inside.unionByName(run)
    twice = inside.groupBy(SID, "vx", "vy", "vz").agg(F.count(F.lit(1)).alias("axes")).filter("axes >= 2").drop("axes")
    flat = twice.join(grids.select(SID, "ny", "nz"), SID).withColumn("flat", flat_index()).drop("ny", "nz")
    return flat.join(occupied.select(SID, "flat"), [SID, "flat"], "left_anti").select(SID, "vx", "vy", "vz", "flat")


#: Side of a brick, a part of the grid that one task takes whole.
BRICK = 64


def brick(*axes: str | Column) -> Column:
    """The brick of a voxel, as text."""
    return F.concat_ws("/", *[F.floor((F.col(c) if isinstance(c, str) else c) / BRICK).cast("string") for c in axes or ("vx", "vy", "vz")])


def shifted(voxels: DataFrame, offsets: list[tuple[int, int, int]] = STEPS) -> DataFrame:
    """Each row for each offset, with the neighbour's place in ux, uy, uz. Neighbours
    then meet by equality."""
    table = F.array(*[F.struct(*[F.lit(d).cast("long").alias(n) for d, n in zip(o, ("dx", "dy", "dz"))]) for o in offsets])
    spread = voxels.withColumn("_o", F.explode(table))
    return spread.withColumns({f"u{c}": F.col(f"v{c}") + F.col(f"_o.d{c}") for c in "xyz"}).drop("_o")


def exposed_contacts(buried: DataFrame, occupied: DataFrame, grids: DataFrame) -> DataFrame:
    """(structure_id, flat, ux, uy, uz): buried voxels and their exposed neighbours,
    those in the grid that are neither occupied nor buried."""
    near = shifted(buried.select(SID, "flat", "vx", "vy", "vz")).join(grids.select(SID, "nx", "ny", "nz"), SID)
    near = near.filter(" and ".join(f"u{c} >= 0 and u{c} < n{c}" for c in "xyz"))
    taken = occupied.select(SID, "vx", "vy", "vz").unionByName(buried.select(SID, "vx", "vy", "vz")).withColumnsRenamed({f"v{c}": f"u{c}" for c in "xyz"})
    return near.join(taken, [SID, "ux", "uy", "uz"], "left_anti").select(SID, "flat", "ux", "uy", "uz")


def first_shell(buried: DataFrame, occupied: DataFrame, grids: DataFrame) -> DataFrame:
    """Exposed voxels with a buried face neighbour."""
    return exposed_contacts(buried, occupied, grids).select(SID, *[F.col(f"u{c}").alias(f"v{c}") for c in "xyz"]).distinct()


def face_links(voxels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b) of face neighbours among ``voxels``, each once."""
    ahead = shifted(voxels.select(*keys, F.col("flat").alias("a"), "vx", "vy", "vz"), [s for s in STEPS if sum(s) > 0]).drop("vx", "vy", "vz")
    there = voxels.select(*keys, F.col("flat").alias("b"), *[F.col(f"v{c}").alias(f"u{c}") for c in "xyz"])
    return ahead.join(there, [*keys, "ux", "uy", "uz"]).select(*keys, "a", "b")
