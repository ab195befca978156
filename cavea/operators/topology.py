"""Typing of buried components by their mouths.

Every step is keyed by (structure_id, comp), so one plan types all volumes of all
structures.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .. import config
from ..config import VoidConfig
from .graph import components, contracted, layers, least_labels
from .steps import settled
from .voxels import BRICK, SID, brick, exposed_contacts, face_links, is_edge_voxel, shifted

KEYS = [SID, "comp"]
CELLS = [(d, sum(map(abs, d))) for d in product((-1, 0, 1), repeat=3)]


def offsets(mode: str) -> list[tuple[int, int, int]]:
    most = {"6": 1, "18": 2, "custom18": 2, "26": 3}[mode]
    return [d for d, n in CELLS if 0 < n <= most]


def direct_surface(voxels: DataFrame, contacts: DataFrame, grids: DataFrame) -> DataFrame:
    """Voxels of components on the grid's edge or with an exposed neighbour."""
    touched = contacts.select(SID, "flat").distinct().withColumn("_touched", F.lit(True))
    marked = voxels.join(grids.select(SID, "nx", "ny", "nz"), SID).join(touched, [SID, "flat"], "left")
    return marked.filter(is_edge_voxel() | F.col("_touched").isNotNull()).select(*KEYS, "flat", "vx", "vy", "vz")


def grown(voxels: DataFrame, within: DataFrame, keys: list[str]) -> DataFrame:
    """``voxels`` and their face neighbours among ``within`` (keyed by KEYS)."""
    near = shifted(voxels.select(*keys, "vx", "vy", "vz")).select(*keys, *[F.col(f"u{c}").alias(f"v{c}") for c in "xyz"]).distinct()
    near = near.join(within.select(*KEYS, "flat", "vx", "vy", "vz"), [*KEYS, "vx", "vy", "vz"])
    return voxels.select(*keys, "flat", "vx", "vy", "vz").unionByName(near.select(*keys, "flat", "vx", "vy", "vz")).distinct()


def neighbor_surface(direct: DataFrame, voxels: DataFrame) -> DataFrame:
    """One layer inward of the direct surface, in the same component."""
    return grown(direct, voxels, KEYS).join(direct.select(*KEYS, "flat"), [*KEYS, "flat"], "left_anti")


def surface_edges(direct: DataFrame, support: DataFrame, mode: str) -> DataFrame:
    """Adjacent direct voxels (keys, a, b) by mode, with the brick that both lie in (null
    if there are two). In custom18 an edge-diagonal needs one of its two intermediate
    voxels in ``support``."""
    near = shifted(direct.select(*KEYS, F.col("flat").alias("a"), "vx", "vy", "vz"), offsets(mode))
    here, there = brick("vx", "vy", "vz"), brick("ux", "uy", "uz")
    met = direct.select(*KEYS, F.col("flat").alias("b"), *[F.col(f"v{c}").alias(f"u{c}") for c in "xyz"])
    pairs = near.join(met, [*KEYS, "ux", "uy", "uz"]).filter("a < b").withColumn("brick", F.when(here == there, here))
    if mode != "custom18":
        return pairs.select(*KEYS, "a", "b", "brick")
    # each intermediate keeps one of the two moved coordinates
    moved = [F.col(f"u{c}") != F.col(f"v{c}") for c in "xyz"]
    steps = F.filter(
        F.array(*[F.struct(moved[i].alias("on"), *[F.col(f"{'u' if c == k else 'v'}{c}").alias(f"s{c}") for c in "xyz"]) for i, k in enumerate("xyz")]), lambda s: s["on"]
    )
    mids = pairs.withColumn("_steps", steps)
    straight = mids.filter(F.size("_steps") == 1).select(*KEYS, "a", "b", "brick")
    asked = mids.filter(F.size("_steps") == 2).select(*KEYS, "a", "b", "brick", F.explode("_steps").alias("s")).select(*KEYS, "a", "b", "brick", "s.sx", "s.sy", "s.sz")
    held = support.select(*KEYS, *[F.col(f"v{c}").alias(f"s{c}") for c in "xyz"]).distinct()
    return straight.unionByName(asked.join(held, [*KEYS, "sx", "sy", "sz"], "left_semi").select(*KEYS, "a", "b", "brick").distinct())


def mouths(direct: DataFrame, support: DataFrame, mode: str = "custom18") -> DataFrame:
    """``direct`` with ``mouth``, the least flat index of its connected patch."""
    return components(direct, surface_edges(direct, support, mode), KEYS, out="mouth")


def by_size(patches: DataFrame) -> DataFrame:
    """Each component's mouths in falling order of size: KEYS, mouth, size, place."""
    from pyspark.sql import Window as W

    sizes = patches.groupBy(*KEYS, "mouth").agg(F.count(F.lit(1)).alias("size"))
    return sizes.withColumn("place", F.row_number().over(W.partitionBy(*KEYS).orderBy(F.desc("size"), "mouth")))


def mouth_shells(patches: DataFrame, voxels: DataFrame) -> DataFrame:
    """Each mouth and one layer inside its component: KEYS, mouth, flat, vx, vy, vz."""
    return grown(patches, voxels, [*KEYS, "mouth"])


def direction_buckets(direct: DataFrame, voxels: DataFrame) -> DataFrame:
    """KEYS and ``buckets``: direct voxels by dominant signed axis from the centre, in
    falling order."""
    centre = voxels.groupBy(*KEYS).agg(*[F.avg(f"v{c}").alias(f"c{c}") for c in "xyz"])
    away = direct.join(centre, KEYS).withColumns({f"d{c}": F.col(f"v{c}") - F.col(f"c{c}") for c in "xyz"})
    top = F.greatest(*[F.abs(f"d{c}") for c in "xyz"])
    axis = F.when(F.abs("dx") == top, 0).when(F.abs("dy") == top, 1).otherwise(2)
    sign = F.when(axis == 0, F.col("dx")).when(axis == 1, F.col("dy")).otherwise(F.col("dz")) >= 0
    bucket = axis * 2 + sign.cast("int")
    counts = [F.count_if(bucket == k) for k in range(6)]
    return away.groupBy(*KEYS).agg(F.reverse(F.array_sort(F.array(*counts))).alias("buckets"))


#: Voxels up to which a component's layers are walked in one task.
WALKED_VOXELS = 1 << 20


class Walk:
    """One component's voxels, sorted, so that face neighbours are found by number."""

    def __init__(self, own: pd.DataFrame):
        place = own[["vx", "vy", "vz"]].to_numpy(np.int64)
        wide = place.max(0) - place.min(0) + 3  # a voxel of margin on every side
        code = np.ravel_multi_index((place - place.min(0) + 1).T, wide)
        order = np.argsort(code)  # also the order of flat indices
        self.code, self.flat = code[order], own["flat"].to_numpy()[order]
        step = np.array([wide[1] * wide[2], wide[2], 1])
        self.steps = np.concatenate((step, -step))

    def at(self, flat) -> np.ndarray:
        return np.searchsorted(self.flat, np.asarray(flat))

    def neighbors(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(from, to) of all face neighbours of ``at``."""
        near = (self.code[at][:, None] + self.steps).ravel()
        to = np.minimum(np.searchsorted(self.code, near), len(self.code) - 1)
        held = self.code[to] == near
        return np.repeat(at, 6)[held], to[held]

    def ahead(self, now: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """The next layer after ``now``, which is marked in ``seen``."""
        to = np.unique(self.neighbors(now)[1])
        to = to[~seen[to]]
        seen[to] = True
        return to


def _bridges_walked(shells: DataFrame, voxels: DataFrame, gap: int) -> DataFrame:
    """(KEYS, bridge) of components with two mouths, each walked in one task."""
    shape = ", ".join(f"`{c}` {t}" for c, t in voxels.select(*KEYS).dtypes)

    def walk(ends: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(ends) and len(own):
            w, one = Walk(own), ends["mouth"].min()
            other = w.at(np.sort(ends.loc[ends["mouth"] != one, "n"].to_numpy()))
            now = w.at(ends.loc[ends["mouth"] == one, "n"].to_numpy())
            seen = np.zeros(len(w.code), bool)
            seen[now] = True
            before = [now]
            while True:
                met = np.intersect1d(now, other)
                if len(met):
                    path, at = [], met[:1]
                    for layer in before[-2:0:-1]:  # the least voxel of each layer before
                        at = np.intersect1d(layer, w.neighbors(at)[1])[:1]
                        path.append(int(w.flat[at[0]]))
                    out.append((*own.iloc[0][KEYS], path))
                    break
                if len(before) > gap + 1:
                    break
                now = w.ahead(now, seen)
                before.append(now)
                if not len(now):
                    break
        return pd.DataFrame(out, columns=[*KEYS, "bridge"])

    return shells.select(*KEYS, "mouth", F.col("flat").alias("n")).groupBy(*KEYS).cogroup(voxels.select(*KEYS, "flat", "vx", "vy", "vz").groupBy(*KEYS)).applyInPandas(walk, f"{shape}, bridge array<long>")


def mouth_bridge(shells: DataFrame, voxels: DataFrame, gap: int, walked: int | None = None) -> DataFrame:
    """KEYS of components whose two mouths are one within ``gap`` voxels, with the
    intermediate voxels in ``bridge`` (an array, empty if the shells touch). Of several
    shortest ways, the least voxel of the second mouth ends it, and the least before it is
    taken at every step. Components of up to ``walked`` voxels take a task each."""
    two = shells.groupBy(*KEYS).agg(F.min("mouth").alias("m1"), F.max("mouth").alias("m2"), F.count_distinct("mouth").alias("m")).filter("m = 2").drop("m")
    if gap < 0:
        return two.select(*KEYS).filter("false").withColumn("bridge", F.array().cast("array<long>"))
    own = voxels.join(two.select(*KEYS), KEYS, "left_semi")
    ends = shells.join(two, KEYS)
    large = settled(own.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > (WALKED_VOXELS if walked is None else walked)).select(*KEYS))
    if large.isEmpty():
        return settled(_bridges_walked(ends, own, gap))
    small = _bridges_walked(ends.join(large, KEYS, "left_anti"), own.join(large, KEYS, "left_anti"), gap)
    return settled(small.unionByName(_bridges_by_layers(ends.join(large, KEYS, "left_semi"), own.join(large, KEYS, "left_semi"), gap)))


def _bridges_by_layers(ends: DataFrame, voxels: DataFrame, gap: int) -> DataFrame:
    """(KEYS, bridge) layer by layer over the whole table."""
    one = settled(ends.filter(F.col("mouth") == F.col("m1")).select(*KEYS, F.col("flat").alias("n")))
    other = settled(ends.filter(F.col("mouth") == F.col("m2")).select(*KEYS, F.col("flat").alias("n")))
    links = face_links(voxels, KEYS)
    links = settled(links.unionByName(links.select(*KEYS, F.col("b").alias("a"), F.col("a").alias("b"))))
    reached = layers(one, links, KEYS, most=gap + 1)
    hits = reached.join(other, [*KEYS, "n"]).groupBy(*KEYS).agg(F.min(F.struct("depth", "n", "pred")).alias("hit"))
    empty = F.array().cast("array<long>")
    path = settled(hits.select(*KEYS, F.col("hit.pred").alias("at"), (F.col("hit.depth") - 1).alias("left"), empty.alias("bridge")))
    for _ in range(gap):
        back = reached.select(*KEYS, F.col("n").alias("at"), "pred")
        path = path.join(back, [*KEYS, "at"], "left").select(
            *KEYS, F.when(F.col("left") > 0, F.array_append("bridge", F.col("at"))).otherwise(F.col("bridge")).alias("bridge"),
            F.when(F.col("left") > 0, F.col("pred")).alias("at"), (F.col("left") - 1).alias("left"),
        )
    return path.select(*KEYS, "bridge")


def topology_type(stats: DataFrame) -> DataFrame:
    """``stats`` (num_voxels, num_direct, num_mouths, buckets, bridged) with ``type``."""
    b = lambda k: F.coalesce(F.element_at("buckets", k + 1), F.lit(0))
    some = b(0) > 0
    return stats.withColumn(
        "type",
        F.when(F.col("num_voxels") <= config.OCCLUDED_VOXELS, "occluded")
        .when(F.col("num_direct") == 0, "cavity")
        .when(F.col("num_mouths") >= 3, "hub")
        .when((F.col("num_mouths") == 2) & some & (b(4) >= b(0) * config.HUB_RATIO), "hub")
        .when((F.col("num_mouths") == 2) & F.col("bridged"), "pocket")
        .when(F.col("num_mouths") == 2, "pore")
        .when(F.col("num_direct") < config.DIRECTIONAL_VOXELS, "pocket")
        .when(some & (b(2) >= b(0) * config.HUB_RATIO), "hub")
        .when(some & (b(1) >= b(0) * config.PORE_RATIO), "pore")
        .otherwise("pocket"),
    )


def _walked(shells: DataFrame, voxels: DataFrame) -> DataFrame:
    """(KEYS, mouth, shell, depth, c): voxels of each layer inward of each mouth's shell, up
    to the one by which they hold as many as the shell. A component is walked in one task."""
    shape = ", ".join(f"`{c}` {t}" for c, t in voxels.select(*KEYS).dtypes)

    def walk(starts: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(starts) and len(own):
            w = Walk(own)
            for mouth, group in starts.groupby("mouth"):
                seen = np.zeros(len(w.code), bool)
                now = w.at(group["n"].to_numpy())
                seen[now] = True
                total, depth = 0, 0
                while total < len(group) and len(now := w.ahead(now, seen)):
                    total, depth = total + len(now), depth + 1
                    out.append((*own.iloc[0][KEYS], mouth, len(group), depth, len(now)))
        return pd.DataFrame(out, columns=[*KEYS, "mouth", "shell", "depth", "c"])

    starts = shells.select(*KEYS, "mouth", F.col("flat").alias("n"))
    return starts.groupBy(*KEYS).cogroup(voxels.select(*KEYS, "flat", "vx", "vy", "vz").groupBy(*KEYS)).applyInPandas(walk, f"{shape}, mouth long, shell long, depth int, c long")


def layer_widths(shells: DataFrame, voxels: DataFrame, walked: int | None = None) -> DataFrame:
    """(KEYS, mouth, shell, depth, c): voxels of the layers inward of each mouth's shell, up
    to the one by which they hold as many as the shell.

    Components of up to ``walked`` voxels are walked in a task each; larger ones layer by
    layer over the whole table."""
    keys = [*KEYS, "mouth"]
    own = voxels.join(shells.select(*KEYS).distinct(), KEYS, "left_semi").select(*KEYS, "flat", "vx", "vy", "vz")
    large = settled(own.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > (WALKED_VOXELS if walked is None else walked)).select(*KEYS))
    if large.isEmpty():
        return _walked(shells, own)
    small = _walked(shells.join(large, KEYS, "left_anti"), own.join(large, KEYS, "left_anti"))
    width = shells.join(large, KEYS, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("shell"))
    links = face_links(own.join(large, KEYS, "left_semi"), KEYS)
    links = links.unionByName(links.select(*KEYS, F.col("b").alias("a"), F.col("a").alias("b")))
    links = settled(links.join(width.select(*keys), KEYS))
    starts = shells.join(width, keys).select(*keys, "shell", F.col("flat").alias("n"))
    depths = layers(starts, links, keys, until="shell").filter("depth > 0")
    return small.unionByName(depths.groupBy(*keys, "shell", "depth").agg(F.count(F.lit(1)).alias("c")))


def neck_widths(shells: DataFrame, voxels: DataFrame, walked: int | None = None) -> DataFrame:
    """KEYS, mouth, shell, neck: the narrowest of the first interior layers, up to the
    one by which they hold as many voxels as the shell; null without interior."""
    keys = [*KEYS, "mouth"]
    width = shells.groupBy(*keys).agg(F.count(F.lit(1)).alias("shell"))
    necks = layers_until_shell(layer_widths(shells, voxels, walked), keys).groupBy(*keys).agg(F.min("c").alias("neck"))
    return width.join(necks, keys, "left")


def layers_until_shell(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Layers (depth, c) up to the first by which their sum reaches ``shell``."""
    from pyspark.sql import Window as W

    so_far = F.sum("c").over(W.partitionBy(*keys).orderBy("depth"))
    return counts.withColumn("_sum", so_far).filter(F.col("_sum") - F.col("c") < F.col("shell")).drop("_sum")


def refine_type(types: DataFrame, shells: DataFrame, bridges: DataFrame, voxels: DataFrame, neck: bool = True) -> tuple[DataFrame, DataFrame]:
    """(``types`` with ``final_type``, the final surface as KEYS, flat).

    Two bridged mouths count as one effective mouth.
    """
    joined = shells.join(bridges.withColumn("_one", F.lit(True)), KEYS, "left")
    first = F.min("mouth").over(_per_component())
    joined = joined.withColumn("mouth", F.when(F.col("_one"), first).otherwise(F.col("mouth")))
    spans = joined.filter("_one").select(*KEYS, "mouth", F.explode("bridge").alias("flat")).distinct()
    spans = spans.join(voxels.select(*KEYS, "flat", "vx", "vy", "vz"), [*KEYS, "flat"])
    shape = [*KEYS, "mouth", "flat", "vx", "vy", "vz"]
    effective = settled(joined.select(*shape).unionByName(spans.select(*shape)).distinct())
    if not neck:
        return types.withColumn("final_type", F.col("type")), effective.join(types.filter("type <> 'occluded'"), KEYS, "left_semi").select(*KEYS, "flat").distinct()
    tried = types.filter(F.col("type").isin("pocket", "pore")).select(*KEYS, "type", "num_voxels")
    widths = settled(neck_widths(effective.join(tried, KEYS, "left_semi"), voxels)).join(tried, KEYS)
    core = F.col("num_voxels") - F.col("shell")
    narrow = F.coalesce(F.col("neck") <= config.NECK_WIDTH, F.lit(False))
    necked = narrow & (core > 0) & (core / F.col("shell") > config.CORE_TO_SHELL)
    flags = widths.withColumns({"narrow": narrow, "necked": necked})
    per = flags.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("mouths"), F.count_if(~F.col("narrow")).alias("wide"), F.bool_or("necked").alias("necked"))
    judged = types.join(per, KEYS, "left")
    one, two = F.coalesce("mouths", F.lit(0)) == 1, F.coalesce("mouths", F.lit(0)) >= 2
    final = (
        F.when((F.col("type") == "pocket") & one & F.col("necked"), "cavity")
        .when((F.col("type") == "pore") & F.col("mouths").isNull(), "cavity")
        .when((F.col("type") == "pore") & one, F.when(F.col("necked"), "cavity").otherwise("pocket"))
        .when((F.col("type") == "pore") & two, F.when(F.col("wide") == 0, "cavity").when(F.col("wide") == 1, "pocket").otherwise("pore"))
        .otherwise(F.col("type"))
    )
    judged = settled(judged.withColumn("final_type", final).drop("mouths", "wide", "necked"))
    lost = flags.join(judged.select(*KEYS, "final_type"), KEYS)
    several = lost.withColumn("_n", F.count(F.lit(1)).over(_per_component()))
    lost = several.filter((F.col("final_type") == "cavity") | ((F.col("type") == "pore") & (F.col("_n") >= 2) & F.col("narrow"))).select(*KEYS, "mouth")
    shown = effective.join(judged.filter("final_type <> 'occluded'"), KEYS, "left_semi").join(lost, [*KEYS, "mouth"], "left_anti")
    return judged, shown.select(*KEYS, "flat").distinct()


def _per_component():
    from pyspark.sql import Window as W

    return W.partitionBy(*KEYS)


def _in_brick(own: pd.DataFrame) -> pd.DataFrame:
    """``own`` (voxels of one brick) with l, the least flat index of the voxel's component
    in the brick. Runs along z are joined where they touch."""
    local = own[["vx", "vy", "vz"]].to_numpy(np.int64) % BRICK
    code = (local[:, 0] * BRICK + local[:, 1]) * BRICK + local[:, 2]
    order = np.argsort(code)  # also the order of flat indices
    code = code[order]
    head = np.ones(len(code), bool)
    head[1:] = (np.diff(code) != 1) | (code[1:] % BRICK == 0)
    run = np.cumsum(head) - 1
    ends = []
    for step, inner in ((BRICK, code // BRICK % BRICK < BRICK - 1), (BRICK * BRICK, np.ones(len(code), bool))):
        at = np.minimum(np.searchsorted(code, code + step), len(code) - 1)
        touch = inner & (code[at] == code + step)
        ends.append(np.stack((run[touch], run[at[touch]]), 1))
    a, b = np.unique(np.concatenate(ends), axis=0).T
    flat = own["flat"].to_numpy()[order]
    label = np.empty(len(code), np.int64)
    label[order] = flat[head][least_labels(int(run[-1]) + 1, a, b)][run]
    return own[[SID, "flat", "vx", "vy", "vz"]].assign(l=label)


def voxel_components(buried: DataFrame) -> DataFrame:
    """``buried`` with ``comp``, the least flat index of its 6-connected component.

    Bricks of the grid are joined by tasks; only voxels on the faces of bricks meet over
    the whole table, as one node a component of a brick."""
    columns = buried.columns
    cells = buried.select(SID, "flat", "vx", "vy", "vz").withColumn("_brick", brick())
    shape = ", ".join(f"`{c}` {t}" for c, t in cells.drop("_brick").dtypes)
    labels = settled(cells.groupBy(SID, "_brick").applyInPandas(lambda own: _in_brick(own), f"{shape}, l long"))
    faces = F.filter(F.array(*[F.struct((F.col(f"v{c}") % BRICK == BRICK - 1).alias("last"), *[(F.col(f"v{k}") + int(k == c)).alias(f"u{k}") for k in "xyz"]) for c in "xyz"]), lambda s: s["last"])
    ahead = labels.select(SID, F.col("l").alias("a"), F.explode(faces).alias("s")).select(SID, "a", "s.ux", "s.uy", "s.uz")
    behind = labels.filter(" or ".join(f"v{c} % {BRICK} = 0" for c in "xyz")).select(SID, F.col("l").alias("b"), *[F.col(f"v{c}").alias(f"u{c}") for c in "xyz"])
    whole = contracted(labels, ahead.join(behind, [SID, "ux", "uy", "uz"]).select(SID, "a", "b"), [SID])
    found = (whole if whole is labels else settled(whole)).withColumnRenamed("l", "comp")
    return found.select(*columns, "comp") if set(columns) <= set(found.columns) else buried.join(found.select(SID, "flat", "comp"), [SID, "flat"])


def typed_components(voxels: DataFrame, occupied: DataFrame, grids: DataFrame, cfg: VoidConfig, contacts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(components with topology ``type`` and ``final_type``, final surface voxels) of
    ``voxels`` (structure_id, comp, flat, vx, vy, vz). ``contacts`` may replace the
    exposed neighbours found from ``occupied``."""
    if contacts is None:
        contacts = exposed_contacts(voxels, occupied, grids)
    sizes = voxels.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("num_voxels"))
    typed = voxels.join(sizes.filter(F.col("num_voxels") > config.OCCLUDED_VOXELS), KEYS, "left_semi")
    direct = settled(direct_surface(typed, contacts, grids))
    support = direct.unionByName(neighbor_surface(direct, typed).select(*direct.columns))
    patches = settled(mouths(direct, support, cfg.connectivity))
    shells = settled(mouth_shells(patches, typed))
    bridges = mouth_bridge(shells, typed, cfg.merge_gap)  # few rows: components of two mouths
    per = patches.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("num_direct"), F.count_distinct("mouth").alias("num_mouths"))
    stats = (
        sizes.join(per, KEYS, "left").join(direction_buckets(direct, typed), KEYS, "left")
        .join(bridges.select(*KEYS, F.lit(True).alias("bridged")), KEYS, "left").fillna({"num_direct": 0, "num_mouths": 0, "bridged": False})
    )
    return refine_type(settled(topology_type(stats)), shells, bridges, typed, cfg.neck)
