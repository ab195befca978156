"""Cleaning, aligning and assembling structures; extra points on atoms' shells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import config
from ..functions.geometry import along, fib_sphere, principal_axes, shell_table
from .voxels import SID

# Residue names of amino acids, the twenty and common modified forms. Other
# forms are known by the components that a structure's own file lists.
AMINO_ACIDS = (
    "ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL ASX GLX SEC PYL MSE UNK SEP TPO PTR CSO HYP MLY M3L KCX CME OCS PCA CSD ALY FME"
).split()


def keep_amino_acids(atoms: DataFrame, peptides: DataFrame | None = None) -> DataFrame:
    """Atoms of amino acids: of the names above and, by structure, of those in
    ``peptides`` (structure_id, res_name), see ``sources.structures.scan_peptides``."""
    name = F.upper(F.trim("res_name"))
    if peptides is None:
        return atoms.filter(name.isin(AMINO_ACIDS))
    own = peptides.select(SID, F.upper(F.trim("res_name")).alias("_name"), F.lit(True).alias("_own")).distinct()
    return atoms.withColumn("_name", name).join(own, [SID, "_name"], "left").filter(F.col("_name").isin(AMINO_ACIDS) | F.col("_own").isNotNull()).select(*atoms.columns)


def drop_hydrogens(atoms: DataFrame) -> DataFrame:
    return atoms.filter(~F.upper(F.coalesce("element", F.lit(""))).isin("H"))


def drop_hub_atoms(atoms: DataFrame, include_hubs: bool = False) -> DataFrame:
    """Atoms without the pseudo-atoms of hubs."""
    return atoms if include_hubs else atoms.filter(F.col("res_name") != "HUB")


def select_models(atoms: DataFrame, keep_all: bool = True) -> DataFrame:
    """The first model, or all with atoms renumbered over models."""
    if keep_all:
        return atoms.withColumn("atom_seq", F.row_number().over(W.partitionBy(SID).orderBy("model", "atom_seq")) - 1)
    return atoms.withColumn("_first", F.min("model").over(W.partitionBy(SID))).filter("model = _first").drop("_first")


def project_coords(atoms: DataFrame) -> DataFrame:
    return atoms.select(SID, "x", "y", "z", "element")


def align(atoms: DataFrame) -> DataFrame:
    """Centred and turned to right-handed principal axes. The first and the third point
    to their longer tails (the sum of cubes along them isn't negative), whatever the order
    of atoms. A structure of fewer than three atoms is an error."""
    axes = principal_axes(atoms, [SID])
    axes = axes.withColumn("axes", F.when(F.col("n") >= 3, F.col("axes")).otherwise(F.raise_error(F.concat(F.lit("fewer than 3 atoms in "), F.col(SID).cast("string")))))
    tails = atoms.join(axes, SID).groupBy(SID).agg(*[F.sum(F.pow(along(k), F.lit(3.0))).alias(f"_t{k}") for k in (0, 2)])
    side = {k: F.when(F.col(f"_t{k}") < 0, -1.0).otherwise(1.0) for k in (0, 2)}
    side[1] = side[0] * side[2]
    placed = atoms.join(axes.join(tails, SID), SID).withColumns({f"_{c}": side[k] * along(k) for k, c in enumerate("xyz")})
    return placed.withColumns({c: F.col(f"_{c}") for c in "xyz"}).select(*atoms.columns)


def prepare(atoms: DataFrame, cfg: config.VoidConfig, peptides: DataFrame | None = None) -> DataFrame:
    """Clean and align: models, residues (``peptides`` as ``keep_amino_acids`` takes
    them), hydrogens, principal axes."""
    atoms = select_models(atoms, cfg.keep_all_models)
    if not cfg.keep_non_protein:
        atoms = keep_amino_acids(atoms, peptides)
    return align(drop_hydrogens(atoms))


def expand_shells(points: DataFrame, size: float) -> DataFrame:
    """The points and, around each, points on its element's shells. The shell table
    has some thirty rows."""
    shells = shell_table(points.sparkSession, size)
    known = F.col("element").isin(list(config.RADII))
    keyed = points.withColumn("shell_element", F.when(known, F.col("element")).otherwise(""))
    near = keyed.join(F.broadcast(shells), "shell_element").select(SID, "x", "y", "z", "element", F.explode(fib_sphere(F.col("radius"), F.col("n"))).alias("p"))
    extra = near.select(SID, *[(F.col(c) + F.col(f"p.d{c}")).alias(c) for c in "xyz"], "element")
    return points.select(SID, "x", "y", "z", "element").unionByName(extra)


def with_radius(atoms: DataFrame) -> DataFrame:
    table = F.create_map(*[F.lit(v) for pair in config.RADII.items() for v in pair])
    return atoms.withColumn("radius", F.coalesce(F.element_at(table, F.col("element")), F.lit(config.DEFAULT_RADIUS)))


# assemblies

TURN = "matrix array<double>, shift array<double>"


def identity_assembly(gen: DataFrame, oper: DataFrame, atoms: DataFrame) -> DataFrame:
    """(structure_id, identity): the first assembly uses one operator, the identity,
    on exactly the structure's chains. ``gen``: structure_id, assembly_id, oper_id,
    chain_id; ``oper``: structure_id, oper_id, matrix (nine numbers), shift."""
    unit = F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)])
    same = F.forall(F.zip_with("matrix", unit, lambda a, b: F.abs(a - b) <= 1e-6), lambda x: x) & F.forall("shift", lambda v: F.abs(v) <= 1e-6)
    first = first_assembly(gen)
    used = first.join(oper.select(SID, "oper_id", same.alias("same")), [SID, "oper_id"], "left").groupBy(SID).agg(
        F.bool_and(F.coalesce("same", F.lit(False))).alias("same"), F.count_distinct("oper_id").alias("opers"), F.array_sort(F.collect_set("chain_id")).alias("chains")
    )
    whole = atoms.groupBy(SID).agg(F.array_sort(F.collect_set("chain_id")).alias("all"))
    return whole.join(used, SID, "left").select(SID, F.coalesce(F.col("same") & (F.col("opers") == 1) & (F.col("chains") == F.col("all")), F.lit(False)).alias("identity"))


def first_assembly(gen: DataFrame) -> DataFrame:
    """The rows of each structure's first assembly: by its place in the file (``place``)
    where ``gen`` has it, else by id."""
    first = F.min_by("assembly_id", "place") if "place" in gen.columns else F.min("assembly_id")
    return gen.withColumn("_first", first.over(W.partitionBy(SID))).filter("assembly_id = _first").drop("_first")


def expand_assembly(atoms: DataFrame, gen: DataFrame, oper: DataFrame) -> DataFrame:
    """Each chain once for each operator of the first assembly, moved by it, with
    ``copy`` counted in the order of operators in the file."""
    first = first_assembly(gen)
    place = F.min("place") if "place" in gen.columns else F.lit(0)
    turns = first.groupBy(SID, "chain_id", "oper_id").agg(place.alias("_place")).join(oper.select(SID, "oper_id", "matrix", "shift"), [SID, "oper_id"])
    turns = turns.withColumn("copy", F.row_number().over(W.partitionBy(SID, "chain_id").orderBy("_place", "oper_id")) - 1).drop("_place")
    moved = atoms.join(turns, [SID, "chain_id"])
    at = lambda k: sum((F.element_at("matrix", 3 * k + i + 2) * F.col(c) for i, c in enumerate("yz")), F.element_at("matrix", 3 * k + 1) * F.col("x")) + F.element_at("shift", k + 1)
    return moved.withColumns({f"_{c}": at(k) for k, c in enumerate("xyz")}).withColumns({c: F.col(f"_{c}") for c in "xyz"}).select(*atoms.columns, "copy")


def chain_blocks(atoms: DataFrame) -> DataFrame:
    """``atoms`` with ``block``, the number of the run of one chain id it lies in."""
    w = W.partitionBy(SID).orderBy("atom_seq")
    change = (F.lag("chain_id").over(w) != F.col("chain_id")).cast("int")
    return atoms.withColumn("block", F.sum(F.coalesce(change, F.lit(0))).over(w))


def copy_index(atoms: DataFrame) -> DataFrame:
    """``atoms`` (with block) with ``copy``: a new copy starts when a chain id comes
    again inside the present one. Folds over a structure's few blocks."""
    blocks = atoms.groupBy(SID, "block").agg(F.first("chain_id").alias("chain_id"))
    listed = blocks.groupBy(SID).agg(F.sort_array(F.collect_list(F.struct("block", "chain_id"))).alias("blocks"))
    zero = F.struct(F.lit(0).alias("copy"), F.array().cast("array<string>").alias("seen"), F.array().cast("array<struct<block:bigint,copy:int>>").alias("out"))

    def step(acc, b):
        again = F.array_contains(acc["seen"], b["chain_id"])
        copy = acc["copy"] + again.cast("int")
        seen = F.when(again, F.array(b["chain_id"])).otherwise(F.array_append(acc["seen"], b["chain_id"]))
        return F.struct(copy.alias("copy"), seen.alias("seen"), F.array_append(acc["out"], F.struct(b["block"].alias("block"), copy.alias("copy"))).alias("out"))

    folded = listed.select(SID, F.explode(F.aggregate("blocks", zero, step, lambda acc: acc["out"])).alias("e")).select(SID, "e.block", "e.copy")
    return atoms.join(folded, [SID, "block"])


def residue_reset_split(atoms: DataFrame, drop: int = 10) -> DataFrame:
    """For single-chain structures: a fall of res_id by over ``drop`` starts a copy."""
    w = W.partitionBy(SID).orderBy("atom_seq")
    fell = (F.col("res_id") - F.lag("res_id").over(w) < -drop).cast("int")
    return atoms.withColumn("copy", F.sum(F.coalesce(fell, F.lit(0))).over(w).cast("int"))


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


WIDEST = 4


def _ids_below(width: int) -> int:
    """How many ids are shorter than ``width`` letters."""
    return sum(len(LETTERS) ** w for w in range(1, width))


def id_place(name: Column) -> Column:
    """The place from 0 of an id in the order of all ids: shorter first, then by letters
    as in LETTERS; null for other texts."""
    digit = lambda i: F.nullif(F.position(F.substring(name, i, 1), F.lit(LETTERS)), F.lit(0)).cast("long") - 1
    out = F.lit(None).cast("long")
    for width in range(1, WIDEST + 1):
        place = sum((digit(i + 1) * len(LETTERS) ** (width - 1 - i) for i in range(width)), F.lit(_ids_below(width)))
        out = F.when(F.length(name) == width, place).otherwise(out)
    return out


def id_at(place: Column, width: int) -> Column:
    """The id at a place, null beyond ``width`` letters."""
    out = F.lit(None).cast("string")
    for w in range(width, 0, -1):
        rest = place - _ids_below(w)
        letter = lambda i: F.substring(F.lit(LETTERS), (F.floor(rest / len(LETTERS) ** i) % len(LETTERS) + 1).cast("int"), F.lit(1))  # noqa: E731,B023
        out = F.when(place < _ids_below(w + 1), F.concat(*[letter(i) for i in reversed(range(w))])).otherwise(out)
    return out


def nth_free_id(used: Column, n: Column, width: int) -> Column:
    """The n-th id from 1 that the set ``used`` lacks: each used place at or before it
    moves it on by one, so no list of ids is made."""
    taken = F.array_sort(F.array_compact(F.transform(used, id_place)))
    return id_at(F.aggregate(taken, n.cast("long") - 1, lambda at, u: F.when(u <= at, at + 1).otherwise(at)), width)


def assign_chain_ids(atoms: DataFrame, width: int = WIDEST) -> DataFrame:
    """``atoms`` (with copy) whose later copies have fresh ids: copy 0 keeps its ids,
    the others take the next unused in order of first atom."""
    pairs = atoms.groupBy(SID, "copy", "chain_id").agg(F.min("atom_seq").alias("at"))
    used = pairs.groupBy(SID).agg(F.collect_set(F.when(F.col("copy") == 0, F.col("chain_id"))).alias("used"))
    later = pairs.filter("copy > 0").withColumn("k", F.row_number().over(W.partitionBy(SID).orderBy("copy", "at")))
    nth = nth_free_id(F.col("used"), F.col("k"), width)
    renamed = later.join(used, SID).select(SID, "copy", "chain_id", F.coalesce(nth, F.raise_error(F.lit("chain ids ran out"))).alias("fresh"))
    return atoms.join(renamed, [SID, "copy", "chain_id"], "left").withColumn("chain_id", F.coalesce("fresh", "chain_id")).select(*atoms.columns)


def volume_chain_ids(atoms: DataFrame) -> DataFrame:
    """(structure_id, code, chain_id): a chain for each volume code, its usual letter
    where the structure leaves that free, else the next free id."""
    codes = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(x).alias("wish"), F.lit(k).alias("k")) for k, (c, x) in enumerate(config.CHAINS.items())])
    used = atoms.select(SID, "chain_id").distinct()
    wanted = atoms.select(SID).distinct().select(SID, F.explode(codes).alias("e")).select(SID, "e.*")
    taken = used.select(SID, F.col("chain_id").alias("wish"), F.lit(True).alias("_taken"))
    wanted = wanted.join(taken, [SID, "wish"], "left")
    kept = wanted.filter("_taken is null").select(SID, "code", F.col("wish").alias("chain_id"))
    held = used.unionByName(kept.select(SID, "chain_id")).groupBy(SID).agg(F.collect_set("chain_id").alias("held"))
    moved = wanted.filter("_taken").withColumn("n", F.row_number().over(W.partitionBy(SID).orderBy("k"))).join(held, SID)
    moved = moved.select(SID, "code", nth_free_id(F.col("held"), F.col("n"), WIDEST).alias("chain_id"))
    return kept.unionByName(moved)
