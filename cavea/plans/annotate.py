"""From points to typed, measured and ranked volumes of all structures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import config
from ..config import VoidConfig
from ..operators import metrics, prep, topology, voxels
from ..operators.steps import settled
from ..operators.voxels import SID

KEYS = [SID, "comp"]
ROW = [SID, "id", "type", "volume", "x", "y", "z", "circularity", "uniformity", "num_voxels", "comp"]


def occupied_and_buried(points: DataFrame, cfg: VoidConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(grids, occupied, buried) of all structures."""
    grids = settled(voxels.grid_bounds(points, cfg.voxel_size))
    occupied = settled(voxels.occupied_voxels(points, grids))
    return grids, occupied, settled(voxels.buried_voxels(occupied, grids))


def annotate_volumes(points: DataFrame, cfg: VoidConfig = VoidConfig()) -> tuple[DataFrame, DataFrame]:
    """(annotations, component voxels). Annotations have a row a volume, occluded ones
    left out; x, y, z are its axial lengths, falling. Component voxels carry id, type
    and ``is_surface``. ``points``: structure_id, x, y, z, element."""
    if cfg.shells:
        points = prep.expand_shells(points, cfg.voxel_size)
    grids, occupied, buried = occupied_and_buried(points, cfg)
    parts = topology.voxel_components(buried)
    contacts = settled(voxels.exposed_contacts(buried, occupied, grids))
    types, surface = topology.typed_components(parts, occupied, grids, cfg, contacts)
    placed = metrics.component_centers(parts, grids)
    sizes = metrics.component_size(placed, cfg.voxel_size).drop("num_voxels")
    known = types.select(*KEYS, "type", "final_type", "num_voxels").join(sizes, KEYS)
    known = settled(filter_by_volume(known, cfg.min_volume, cfg.min_voxels))
    volumes = metrics.rank_volumes(known.filter("final_type <> 'occluded'"))
    shape = metrics.shape_metrics(placed.join(volumes.select(*KEYS), KEYS, "left_semi"), grids, cfg.slice_width)
    rows = volumes.join(shape, KEYS).select(*volumes.columns, *[F.element_at("axial_lengths", k + 1).alias(c) for k, c in enumerate("xyz")], "circularity", "uniformity")
    annotations = settled(rows.select(SID, "id", F.col("final_type").alias("type"), *ROW[3:]))
    shown = parts.join(annotations.select(*KEYS, "id", "type"), KEYS).join(surface.withColumn("is_surface", F.lit(True)), [*KEYS, "flat"], "left")
    return annotations, shown.fillna({"is_surface": False})


def filter_by_volume(components: DataFrame, min_volume: float | None = None, min_voxels: int | None = None) -> DataFrame:
    """Both bounds are inclusive."""
    if min_volume is not None:
        components = components.filter(F.col("volume") >= min_volume)
    if min_voxels is not None:
        components = components.filter(F.col("num_voxels") >= min_voxels)
    return components


def in_order(annotations: DataFrame) -> DataFrame:
    return annotations.orderBy(F.desc("volume"), "type", "id")


def volumize(atoms: DataFrame, cfg: VoidConfig = VoidConfig(), peptides: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Atoms to (annotations, component voxels)."""
    return annotate_volumes(prep.project_coords(settled(prep.prepare(atoms, cfg, peptides))), cfg)


def largest_volume(annotations: DataFrame, order: Sequence[Column | str] = ("type", "id")) -> DataFrame:
    """Per structure the type and volume of the largest; the first in ``order`` wins ties."""
    best = F.min_by(F.struct("type", "volume"), F.struct(-F.col("volume"), *order))
    return annotations.groupBy(SID).agg(F.count(F.lit(1)).alias("num_volumes"), best.alias("b")).select(SID, "num_volumes", F.col("b.type").alias("largest_type"), F.col("b.volume").alias("largest_volume"))


def drop_hubs(annotations: DataFrame, include_hubs: bool = False) -> DataFrame:
    return annotations if include_hubs else annotations.filter(F.lower("type") != "hub")


def residue_limit_gate(atoms: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(atoms of structures within the limit, skipped rows with reason)."""
    from ..functions.sequences import residue_counts

    counts = residue_counts(atoms)
    over = counts.filter(F.col("residues") > most)
    skipped = over.select(SID, F.lit("post_assembly_residue_limit").alias("reason"), F.col("residues").alias("actual_residues"), F.lit(most).alias("max_residues"))
    return atoms.join(over.select(SID), SID, "left_anti"), skipped


def bad_structures(atoms: DataFrame, kept: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(structure_id, error_type, error) of the structures that can't be annotated: with
    coordinates that are missing or not finite, with fewer than 3 of ``atoms`` in ``kept``
    (those that enter the calculation), or ``expected`` (structure_id) without any atom.
    The first of these that holds is told."""
    finite = F.lit(True)
    for c in "xyz":
        finite &= F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.isnan(c)
    known = atoms.select(SID).distinct().withColumn("_there", F.lit(True))
    if expected is not None:
        known = known.join(expected.select(SID).distinct(), SID, "full")
    sizes = kept.groupBy(SID).agg(F.count(F.lit(1)).alias("_n"), F.count_if(~finite).alias("_odd"))
    rows = known.join(sizes, SID, "left").fillna({"_there": False, "_n": 0, "_odd": 0})
    kind = F.when(~F.col("_there"), "no_atoms").when(F.col("_odd") > 0, "bad_coordinates").when(F.col("_n") < 3, "too_few_atoms")
    texts = F.when(~F.col("_there"), "no atoms were read").when(F.col("_odd") > 0, F.format_string("%d atoms without finite coordinates", "_odd")).otherwise(F.format_string("fewer than 3 atoms: %d", "_n"))
    return rows.select(SID, kind.alias("error_type"), texts.alias("error")).filter("error_type is not null")


def annotate_batch(
    atoms: DataFrame, cfg: VoidConfig = VoidConfig(), max_residues: int | None = None, include_hubs: bool = False, expected: DataFrame | None = None, peptides: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(annotations, results, skipped, errors). Structures over the residue limit are
    skipped; those of ``bad_structures`` are errors, and the others go on without them.
    Each structure is in one of results, skipped and errors."""
    skipped = atoms.sparkSession.createDataFrame([], atoms.select(SID).schema.add("reason", "string").add("actual_residues", "long").add("max_residues", "integer"))
    if max_residues is not None:
        atoms, skipped = residue_limit_gate(atoms, max_residues)
        expected = expected.join(skipped.select(SID), SID, "left_anti") if expected is not None else None
    clean = prep.drop_hydrogens(atoms if cfg.keep_non_protein else prep.keep_amino_acids(atoms, peptides))
    errors = settled(bad_structures(atoms, prep.select_models(clean, cfg.keep_all_models), expected))
    good = atoms.join(errors.select(SID), SID, "left_anti")
    annotations, _ = volumize(good, cfg, peptides)
    shown = drop_hubs(annotations, include_hubs)
    found = good.select(SID).distinct().join(largest_volume(shown), SID, "left").fillna({"num_volumes": 0})
    return shown, found, skipped, errors


def pseudo_atoms(annotations: DataFrame, component_voxels: DataFrame, grids: DataFrame) -> DataFrame:
    """A record for each voxel of a volume: res_id is the volume's id, the codes follow
    its type, b_factor is 50 on the surface and 0 elsewhere."""
    placed = metrics.component_centers(component_voxels, grids)
    code = F.element_at(F.create_map(*[F.lit(v) for pair in config.CODES.items() for v in pair]), F.col("type"))
    pick = lambda table: F.element_at(F.create_map(*[F.lit(v) for pair in table.items() for v in pair]), F.col("res_name"))
    return placed.withColumn("res_name", code).select(
        SID, F.lit(1).alias("model"), F.lit("ATOM").alias("group_pdb"), pick(config.ELEMENTS).alias("atom_name"), pick(config.ELEMENTS).alias("element"), "res_name",
        F.col("id").alias("res_id"), F.lit("").alias("ins_code"), pick(config.CHAINS).alias("chain_id"), "x", "y", "z", F.when(F.col("is_surface"), 50.0).otherwise(0.0).alias("b_factor"), "flat",
    )


def volumize_and_save(spark, paths: list[str], folder: str, cfg: VoidConfig = VoidConfig(), assembly: str = "auto") -> DataFrame:
    """Reads structures, writes atoms with volumes as PDB lines and as mmCIF (which keeps
    chain ids of several letters) and annotations as JSON columns under ``folder``, and
    returns the annotations."""
    from ..sources import sinks
    from ..sources.structures import load_structures, scan_peptides

    atoms = settled(prep.prepare(load_structures(spark, paths, assembly), cfg, scan_peptides(spark, paths)))
    points = prep.project_coords(atoms)
    annotations, shown = annotate_volumes(points, cfg)
    grids = voxels.grid_bounds(prep.expand_shells(points, cfg.voxel_size) if cfg.shells else points, cfg.voxel_size)
    extra = pseudo_atoms(annotations, shown, grids).withColumnRenamed("flat", "atom_seq").withColumn("part", F.lit(1))
    chains = prep.volume_chain_ids(atoms).withColumnsRenamed({"code": "res_name", "chain_id": "_chain"})
    extra = extra.join(chains, [SID, "res_name"]).withColumn("chain_id", F.col("_chain")).drop("_chain")
    whole = atoms.withColumn("part", F.lit(0)).unionByName(extra)
    sinks.write_annotated_pdb(whole, f"{folder}/pdb")
    sinks.write_annotated_cif(whole, f"{folder}/cif")
    sinks.write_annotation_columnar(annotations, f"{folder}/annotations")
    return annotations
