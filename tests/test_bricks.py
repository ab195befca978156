"""Components over bricks, layers by either way, and the orientation of axes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cavea.functions import geometry
from cavea.operators import graph, prep, topology, voxels
from cavea.operators.voxels import SID

STEPS = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
N = 200  # over three bricks a side


def flat(v):
    return (v[0] * N + v[1]) * N + v[2]


def naive_components(cells):
    left, out = set(cells), {}
    for start in sorted(cells):
        if start in left:
            left.discard(start)
            group, todo = [], [start]
            while todo:
                v = todo.pop()
                group.append(v)
                for s in STEPS:
                    u = tuple(a + b for a, b in zip(v, s))
                    if u in left:
                        left.discard(u)
                        todo.append(u)
            out |= {v: flat(start) for v in group}
    return out


def snake(rng, n):
    v, out = (100, 100, 100), []
    for _ in range(n):
        out.append(v)
        v = tuple(min(N - 1, max(0, a + b)) for a, b in zip(v, rng.choice(STEPS)))
    return out


def shapes():
    rng = random.Random(3)
    line = [(x, 70, 63) for x in range(N)] + [(190, y, 63) for y in range(70, 150)]
    blocks = [(x, y, z) for x in range(60, 68) for y in range(60, 68) for z in range(60, 68) if rng.random() < 0.4]
    walks = [v for _ in range(12) for v in snake(rng, 400)]
    return {1: set(line), 2: set(blocks), 3: set(walks), 4: {(63, 63, 63), (64, 64, 64)}, 5: {(0, 0, 63), (0, 1, 0)}}


def test_components_over_bricks(spark):
    made = shapes()
    rows = [(s, *v, flat(v)) for s, cells in made.items() for v in cells]
    table = spark.createDataFrame(rows, f"{SID} long, vx long, vy long, vz long, flat long")
    got = {(r[SID], r.flat): r.comp for r in topology.voxel_components(table).collect()}
    assert got == {(s, flat(v)): c for s, cells in made.items() for v, c in naive_components(cells).items()}
    assert topology.voxel_components(table.filter("false")).count() == 0
    links = voxels.face_links(table, [SID])
    bricks = table.select(SID, F.col("flat").alias("a"), voxels.brick().alias("ba")), table.select(SID, F.col("flat").alias("b"), voxels.brick().alias("bb"))
    links = links.join(bricks[0], [SID, "a"]).join(bricks[1], [SID, "b"]).withColumn("brick", F.when(F.col("ba") == F.col("bb"), F.col("ba")))
    for edges in (links, links.drop("brick")):  # by bricks, and by rounds alone
        again = {(r[SID], r.flat): r.comp for r in graph.components(table, edges, [SID]).collect()}
        assert again == got


def test_layers_by_either_way(spark):
    rng = random.Random(8)
    rows, ends = [], []
    for comp in range(6):
        cells = {(x, y, z) for x in range(12) for y in range(6) for z in range(5) if rng.random() < 0.85} | {(x, 0, 0) for x in range(12)}
        rows += [(1, comp, flat(v), *v) for v in cells]
        low, high = [v for v in cells if v[0] < 2], [v for v in cells if v[0] > (2 + comp)]
        for mouth, group in ((flat(min(low)), low), (flat(min(high)), high)):
            ends += [(1, comp, mouth, flat(v), *v) for v in group]
    table = spark.createDataFrame(rows, f"{SID} long, comp long, flat long, vx long, vy long, vz long")
    shells = spark.createDataFrame(ends, f"{SID} long, comp long, mouth long, flat long, vx long, vy long, vz long")
    rows_of = lambda df: sorted(map(tuple, df.collect()))
    one, other = (topology.layers_until_shell(topology.layer_widths(shells, table, walked), [SID, "comp", "mouth"]) for walked in (None, 0))
    columns = [SID, "comp", "mouth", "shell", "depth", "c"]
    assert rows_of(one.select(*columns)) == rows_of(other.select(*columns)) and one.count() > 12
    for gap in (0, 1, 3):
        found = [rows_of(topology.mouth_bridge(shells, table, gap, walked).select(SID, "comp", F.col("bridge").cast("string"))) for walked in (None, 0)]
        assert found[0] == found[1]
    assert found[0]


def test_equal_spreads_follow_the_coordinate_axes():
    square = np.diag([4.0, 4.0, 1.0])
    turn, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(3, 3)))
    tall = turn @ np.diag([9.0, 2.0, 2.0]) @ turn.T
    w, v = geometry.axes3(np.stack((square, np.eye(3), tall)))
    assert np.allclose(w, [[4, 4, 1], [1, 1, 1], [9, 2, 2]])
    assert np.allclose(np.abs(v[0]), np.eye(3)) and np.allclose(np.abs(v[1]), np.eye(3))
    assert np.allclose(v @ v.transpose(0, 2, 1), np.eye(3)) and np.allclose(np.linalg.det(v), 1)
    assert np.allclose(np.abs(v[2, 0]), np.abs(turn[:, 0])) and np.allclose(tall @ v[2, 1], 2 * v[2, 1])


def test_orientation_does_not_depend_on_pose_or_order(spark):
    rng = np.random.default_rng(5)
    points = rng.gamma(1.5, size=(400, 3)) * [9, 4, 2]
    rows = []
    for s in range(4):
        turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        turn[:, 0] *= np.sign(np.linalg.det(turn))
        moved = points @ turn.T + rng.normal(size=3) * 20
        rows += [(s, int(i), int(k), *map(float, moved[i])) for k, i in enumerate(rng.permutation(len(points)))]
    atoms = spark.createDataFrame(rows, f"{SID} long, name int, atom_seq int, x double, y double, z double")
    got = prep.align(atoms).toPandas().sort_values([SID, "name"])[["x", "y", "z"]].to_numpy().reshape(4, -1, 3)
    for s in range(1, 4):
        assert np.allclose(got[s], got[0], atol=1e-6)
    assert (got[0][:, 0] ** 3).sum() > 0 and (got[0][:, 2] ** 3).sum() > 0
    with pytest.raises(Exception, match="fewer than 3 atoms"):
        prep.align(atoms.filter("name < 2")).collect()
