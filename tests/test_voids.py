"""Voxels, typing, refinement, shape and end-to-end volumes."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cavea import config
from cavea.config import VoidConfig
from cavea.functions import geometry
from cavea.operators import graph, metrics, prep, topology, voxels
from cavea.plans import annotate
from cavea.sources import structures

SID = "structure_id"


def grid_of(spark, nx, ny, nz, size=1.0):
    return spark.createDataFrame([("s", nx, ny, nz, (0.0, 0.0, 0.0), size)], f"{SID} string, nx long, ny long, nz long, lo struct<x:double,y:double,z:double>, size double")


def voxel_table(spark, points, dims, comp=0):
    _, ny, nz = dims
    rows = [("s", comp, (x * ny + y) * nz + z, x, y, z) for x, y, z in points]
    return spark.createDataFrame(rows, f"{SID} string, comp long, flat long, vx long, vy long, vz long")


def contacts_of(spark, points, exposed, dims):
    _, ny, nz = dims
    rows = [("s", (x * ny + y) * nz + z, *e) for x, y, z in points for e in exposed if abs(x - e[0]) + abs(y - e[1]) + abs(z - e[2]) == 1]
    return spark.createDataFrame(rows, f"{SID} string, flat long, ux long, uy long, uz long")


def typed(spark, points, exposed, dims, **settings):
    types, surface = topology.typed_components(voxel_table(spark, points, dims), None, grid_of(spark, *dims), VoidConfig(voxel_size=1.0, **settings), contacts_of(spark, points, exposed, dims))
    row = types.collect()[0]
    return row.type, row.final_type, surface.count()


def test_buried_rule(spark):
    rows = [(tuple(bool(i >> k & 1) for k in range(6)),) for i in range(64)]
    df = spark.createDataFrame([r[0] for r in rows], "a boolean, b boolean, c boolean, d boolean, e boolean, f boolean")
    got = {tuple(r)[:6]: r.buried for r in df.withColumn("buried", voxels.is_buried(*[F.col(c) for c in "abcdef"])).collect()}
    for flags, buried in got.items():
        full = sum(flags[2 * k] and flags[2 * k + 1] for k in range(3))
        assert buried == (full >= 2)


def test_shifted_pairs_are_face_neighbours(spark):
    v = voxel_table(spark, [(0, 0, 0), (0, 0, 1), (0, 1, 1), (2, 2, 2)], (4, 4, 4))
    pairs = {(r.a, r.b) for r in voxels.face_links(v, [SID, "comp"]).collect()}
    assert pairs == {(0, 1), (1, 5)}
    both = v.select(F.struct("vx", "vy", "vz").alias("a")).crossJoin(v.select(F.struct("vx", "vy", "vz").alias("b")))
    assert both.filter(voxels.is_neighbor("a", "b")).count() == 4


@pytest.mark.parametrize("mode,n", [("6", 2), ("18", 1), ("26", 1), ("custom18", 2)])
def test_mouth_modes(spark, mode, n):
    direct = voxel_table(spark, [(0, 0, 0), (1, 1, 0)], (3, 3, 3))
    assert topology.mouths(direct, direct, mode).select("mouth").distinct().count() == n


def test_supported_diagonal(spark):
    direct = voxel_table(spark, [(0, 0, 0), (1, 1, 0)], (3, 3, 3))
    support = voxel_table(spark, [(0, 0, 0), (1, 1, 0), (1, 0, 0)], (3, 3, 3))
    assert topology.mouths(direct, support, "custom18").select("mouth").distinct().count() == 1


@pytest.mark.parametrize("n,gap,want", [(4, -1, "pore"), (4, 0, "pocket"), (5, 0, "pore"), (5, 1, "pocket"), (6, 1, "pore"), (6, 2, "pocket")])
def test_mouths_merge_within_the_gap(spark, monkeypatch, n, gap, want):
    monkeypatch.setattr(config, "OCCLUDED_VOXELS", 0)
    tube = [(i, 1, 1) for i in range(1, n + 1)]
    assert typed(spark, tube, [(0, 1, 1), (n + 1, 1, 1)], (n + 3, 3, 3), merge_gap=gap, neck=False)[0] == want


@pytest.mark.parametrize("edge,want", [(13, "cavity"), (6, "pocket")])
def test_necked_pockets(spark, edge, want):
    shell, neck = [(i, 1, 1) for i in (1, 2, 3)], [(2, 1, z) for z in (2, 3, 4)]
    core = [(1 + x, 1 + y, 5 + z) for x in range(edge) for y in range(edge) for z in range(edge)]
    kind, final, shown = typed(spark, shell + neck + core, [(i, 0, 1) for i in (1, 2, 3)], (edge + 4, edge + 4, edge + 8))
    assert kind == "pocket" and final == want and (shown > 0) == (want == "pocket")


def test_two_narrow_mouths_make_a_cavity(spark):
    tube = [(i, 1, 1) for i in range(1, 7)]
    assert typed(spark, tube, [(0, 1, 1), (7, 1, 1)], (9, 3, 3)) == ("pore", "cavity", 0)


def test_layers_and_components(spark):
    links = spark.createDataFrame([("s", a, b) for a, b in [(0, 1), (1, 2), (2, 3), (3, 4)] for a, b in ((a, b), (b, a))], "k string, a long, b long")
    start = spark.createDataFrame([("s", 0, 2)], "k string, n long, want int")
    assert {(r.n, r.depth) for r in graph.layers(start, links, ["k"]).collect()} == {(i, i) for i in range(5)}
    assert {r.n for r in graph.layers(start, links, ["k"], until="want").collect()} == {0, 1, 2}
    nodes = spark.createDataFrame([("s", i) for i in range(7)], "k string, flat long")
    assert {r.flat: r.comp for r in graph.components(nodes, links, ["k"]).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5, 6: 6}


def test_sphere_points_and_shells(spark):
    got = geometry.fib_sphere_table(spark, 1.4, 5).orderBy("i").collect()
    assert [round(r.dx, 2) for r in got] == [0.84, -0.95, 0.12, 0.78, -0.83] and [round(r.dz, 2) for r in got] == [1.12, 0.56, 0.0, -0.56, -1.12]
    assert [geometry.sphere_samples(r, s) for r, s in ((1.4, 1.0), (1.4, 3.0), (1.8, 2.0))] == [40, 20, 20]
    assert geometry.shell_radii(1.7, 0.5) == pytest.approx([1.7, 1.2, 0.7, 0.2]) and geometry.shell_radii(1.5, 2.0) == [1.5]
    assert geometry.fib_sphere_table(spark, 1.0, 0).count() == 0


def shape(spark, points):
    rows = [("s", 0, *map(float, p)) for p in points]
    df = spark.createDataFrame(rows, f"{SID} string, comp long, x double, y double, z double")
    return metrics.shape_metrics(df, grid_of(spark, 9, 9, 9), slice_width=1.0).collect()[0]


def tube(a, b, length, taper=0.0):
    return [(x, y, z) for x in range(length) for y in range(-9, 10) for z in range(-9, 10) if (y / a) ** 2 + (z / b) ** 2 <= (1 - taper * x / length) ** 2]


def test_shapes(spark):
    round_, flat, cone = shape(spark, tube(5, 5, 40)), shape(spark, tube(8, 2, 40)), shape(spark, tube(8, 8, 40, 0.95))
    assert round_.circularity > 0.8 and round_.uniformity > 0.75
    assert flat.circularity < 0.5 and flat.uniformity > 0.75
    assert cone.circularity > 0.4 and cone.uniformity < 0.7
    few = shape(spark, [(0, 0, 0), (1, 0, 0)])
    assert few.axial_lengths == [0, 0, 0] and few.circularity is None and few.uniformity is None


def test_chain_ids(spark):
    def copies(ids):
        rows = [("s", i, c, i) for i, c in enumerate(ids)]
        atoms = spark.createDataFrame(rows, f"{SID} string, atom_seq long, chain_id string, res_id int")
        return prep.assign_chain_ids(prep.copy_index(prep.chain_blocks(atoms)), 1).orderBy("atom_seq").collect()

    twice = [r.chain_id for r in copies("AABBAABB")]
    assert twice[:4] == list("AABB") and len(set(twice)) == 4
    assert len({r.chain_id for r in copies("ABCD" * 3)}) == 12 and [r.chain_id for r in copies("AB")] == ["A", "B"]
    single = spark.createDataFrame([("s", i, "A", i % 100) for i in range(600)], f"{SID} string, atom_seq long, chain_id string, res_id int")
    assert prep.assign_chain_ids(prep.residue_reset_split(single), 1).select("chain_id").distinct().count() == 6


def test_free_ids(spark):
    """Against the list of all ids: places, ids of places, and the n-th unused."""
    letters = prep.LETTERS
    pool = [*letters, *[a + b for a in letters for b in letters], *["A" + a + b for a in letters for b in letters]]
    rows = spark.createDataFrame(list(enumerate(pool)), "i long, s string").select("i", "s", prep.id_place(F.col("s")).alias("p"), prep.id_at(F.col("i"), 4).alias("t"), prep.id_at(F.col("i"), 1).alias("one")).collect()
    assert all(r.p == r.i and r.t == r.s and r.one == (r.s if r.i < len(letters) else None) for r in rows)
    rng = random.Random(1)
    cases = [(rng.sample(pool[:300], rng.randint(0, 120)) + ["??", "abcde"], rng.randint(1, 200)) for _ in range(60)]
    got = spark.createDataFrame(cases, "used array<string>, n int").select("used", "n", prep.nth_free_id(F.col("used"), F.col("n"), 4).alias("free")).collect()
    assert all(r.free == [p for p in pool if p not in r.used][r.n - 1] for r in got)


def test_assembly(spark):
    atoms = spark.createDataFrame([("s", i, c, float(i), 0.0, 1.0) for i, c in enumerate("AB")], f"{SID} string, atom_seq long, chain_id string, x double, y double, z double")
    one, turn = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], [-1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, 1.0]
    oper = spark.createDataFrame([("s", "1", one, [0.0] * 3), ("s", "2", turn, [5.0, 0.0, 0.0])], f"{SID} string, oper_id string, matrix array<double>, shift array<double>")
    gen = spark.createDataFrame([("s", "1", o, c) for o in "12" for c in "AB"], f"{SID} string, assembly_id string, oper_id string, chain_id string")
    assert not prep.identity_assembly(gen, oper, atoms).first().identity and prep.identity_assembly(gen.filter("oper_id = 1"), oper, atoms).first().identity
    moved = {(r.chain_id, r.copy): (r.x, r.y, r.z) for r in prep.expand_assembly(atoms, gen, oper).collect()}
    assert moved == {("A", 0): (0, 0, 1), ("B", 0): (1, 0, 1), ("A", 1): (5, 0, 1), ("B", 1): (4, 0, 1)}


def ball(inside, reach=9, step=1.5):
    """Atoms of a solid ball from which ``inside`` (x, y, z) is left out."""
    at = [k * step for k in range(-reach, reach + 1)]
    return [(x, y, z) for x in at for y in at for z in at if x * x * 1.1 + y * y + z * z * 0.9 <= (reach * step) ** 2 and not inside(x, y, z)]


SHAPES = {
    "cavity": lambda x, y, z: x * x + y * y + z * z < 36,
    "pore": lambda x, y, z: x * x + y * y < 20,
    "pocket": lambda x, y, z: x * x + y * y < 20 and z > -4,
}


def pdb_file(folder, name, points):
    line = "ATOM  {:>5d}  CA  ALA A{:>4d}    {:8.3f}{:8.3f}{:8.3f}  1.00  0.00           C"
    path = folder / f"{name}.pdb"
    path.write_text("\n".join(line.format(i % 100000, i % 10000, *p) for i, p in enumerate(points)) + "\nEND\n")
    return str(path)


def test_structures_of_known_types(spark, tmp_path):
    """Hollowed balls, read from files: the largest volume is what was cut out."""
    cut = {name: ball(inside) for name, inside in SHAPES.items()}
    atoms = structures.load_structures(spark, [pdb_file(tmp_path, n, p) for n, p in cut.items()])
    assert {r[0]: r[1] for r in atoms.groupBy(SID).count().collect()} == {n: len(p) for n, p in cut.items()}
    found, shown = annotate.volumize(atoms, VoidConfig(voxel_size=2.0))
    largest = {r[SID]: (r.largest_type, r.largest_volume) for r in annotate.largest_volume(found).collect()}
    assert {n: t for n, (t, _) in largest.items()} == {n: n for n in SHAPES}
    assert 100 < largest["cavity"][1] < 900 and largest["pocket"][1] < largest["pore"][1]
    assert shown.filter("type = 'cavity' and is_surface").count() == 0
    assert found.filter("id = 0 and x < y or y < z").count() == 0


def assembly_file(folder, expression, opers, assemblies=("1",)):
    site = "\n".join(f"ATOM {i} C CA ALA {c} {i // 2} {float(i)} 0.0 1.0" for i, c in enumerate("AABB"))
    moves = "\n".join(f"{n} 1 0 0 0 1 0 0 0 1 {x} {y} 0" for n, (x, y) in opers.items())
    gen = "\n".join(f"{a} {expression} A,B" for a in assemblies)
    cells = "\n".join([f"_pdbx_struct_oper_list.matrix[{i}][{j}]" for i in (1, 2, 3) for j in (1, 2, 3)] + [f"_pdbx_struct_oper_list.vector[{i}]" for i in (1, 2, 3)])
    head = "\n".join(f"_atom_site.{c}" for c in ("group_PDB", "id", "type_symbol", "label_atom_id", "label_comp_id", "label_asym_id", "auth_seq_id", "Cartn_x", "Cartn_y", "Cartn_z"))
    path = folder / "s.cif"
    path.write_text(
        f"data_s\nloop_\n{head}\n{site}\nloop_\n_pdbx_struct_assembly_gen.assembly_id\n_pdbx_struct_assembly_gen.oper_expression\n_pdbx_struct_assembly_gen.asym_id_list\n{gen}\n"
        f"loop_\n_pdbx_struct_oper_list.id\n{cells}\n{moves}\n"
    )
    return str(path)


def test_operator_lists_and_products(spark, tmp_path):
    from cavea.functions.sequences import residue_counts

    opers = {"1": (0, 0), "2": (100, 0), "3": (0, 50)}
    atoms = structures.load_structures(spark, [assembly_file(tmp_path, "'(1,2)(3)'", opers)]).orderBy("atom_seq").collect()
    assert [(r.x, r.y) for r in atoms] == [(i + 100 * k, 50) for k in (0, 1) for i in range(4)]
    assert [r.chain_id for r in atoms[:4]] == list("AABB") and len({r.chain_id for r in atoms}) == 4 and [r.atom_seq for r in atoms] == list(range(8))
    again = structures.load_structures(spark, [assembly_file(tmp_path, "1,2", opers, ("2", "10"))])
    assert residue_counts(again).first().residues == 2 * 2 and again.count() == 8
    kept, skipped = annotate.residue_limit_gate(again, 3)
    assert kept.count() == 0 and skipped.first().actual_residues == 4
    three = structures.load_structures(spark, [assembly_file(tmp_path, "'(1,2)(3)(2-3)'", opers)]).collect()
    # the shifts of a product add up: four copies
    assert sorted({(r.x // 100, r.y) for r in three}) == [(0, 100), (1, 50), (1, 100), (2, 50)] and len(three) == 16
    assert structures.load_structures(spark, [assembly_file(tmp_path, "'(1)(9)'", opers)]).count() == 0


def test_products_turn_right_to_left(spark):
    quarter, half = [0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0], [-1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, 1.0]
    turns = [(quarter, [1.0, 2.0, 3.0]), (half, [5.0, 0.0, 0.0]), (quarter, [0.0, 0.0, 7.0])]
    want, shift = np.eye(3), np.zeros(3)
    for m, v in reversed(turns):
        m = np.array(m).reshape(3, 3)
        want, shift = m @ want, m @ shift + np.array(v)
    frame = spark.createDataFrame([(turns,)], "t array<struct<matrix:array<double>,shift:array<double>>>")
    start = F.struct(F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)]).alias("matrix"), F.array(*[F.lit(0.0)] * 3).alias("shift"))
    got = frame.select(F.aggregate("t", start, structures._then).alias("m")).first().m
    assert got.matrix == want.ravel().tolist() and got.shift == shift.tolist()


def test_modified_residues_by_the_file_s_components(spark, tmp_path):
    one, loop = tmp_path / "one.cif", tmp_path / "two.mmcif"
    one.write_text("data_a\n_chem_comp.id XYZ\n_chem_comp.type 'D-peptide linking'\n")
    loop.write_text("data_b\nloop_\n_chem_comp.id\n_chem_comp.type\nABA 'L-PEPTIDE LINKING'\nHOH NON-POLYMER\nXYZ 'peptide-like'\nQQQ .\n")
    peptides = structures.scan_peptides(spark, [str(one), str(loop), "/none.pdb"])
    assert {tuple(r) for r in peptides.collect()} == {("one", "XYZ"), ("two", "ABA")} and structures.scan_peptides(spark, ["/none.pdb"]) is None
    rows = [(s, n) for s in ("one", "two", "three") for n in ("ALA", "xyz ", "ABA", "HOH")]
    atoms = spark.createDataFrame([*rows, ("one", None), ("one", "XYZ")], f"{SID} string, res_name string")
    kept = sorted(map(tuple, prep.keep_amino_acids(atoms, peptides).collect()))
    assert kept == [("one", "ALA"), ("one", "XYZ"), ("one", "xyz "), ("three", "ALA"), ("two", "ABA"), ("two", "ALA")]
    assert prep.keep_amino_acids(atoms).count() == 3


def test_batch_goes_on_past_bad_structures(spark, tmp_path):
    good = structures.load_structures(spark, [pdb_file(tmp_path, "cavity", ball(SHAPES["cavity"]))])
    few = good.limit(2).withColumn(SID, F.lit("few"))
    holes = good.withColumns({SID: F.lit("holes"), "x": F.when(F.col("atom_seq") % 50 == 0, F.lit(None)).otherwise(F.col("x"))})
    odd = good.withColumns({SID: F.lit("odd"), "z": F.when(F.col("atom_seq") == F.lit(3), float("nan")).otherwise(F.col("z"))})
    expected = spark.createDataFrame([("cavity",), ("gone",)], f"{SID} string")
    cfg = VoidConfig(voxel_size=2.0)
    shown, results, skipped, errors = annotate.annotate_batch(good.unionByName(few).unionByName(holes).unionByName(odd), cfg, expected=expected)
    assert {r[SID]: r.error_type for r in errors.collect()} == {"few": "too_few_atoms", "holes": "bad_coordinates", "odd": "bad_coordinates", "gone": "no_atoms"}
    assert skipped.count() == 0 and [r[SID] for r in results.collect()] == ["cavity"]
    alone = annotate.volumize(good, cfg)[0]
    assert shown.drop("comp").exceptAll(annotate.drop_hubs(alone).drop("comp")).count() == 0 and shown.count() == results.first().num_volumes > 0
    _, results, skipped, errors = annotate.annotate_batch(good.unionByName(few), cfg, max_residues=0, expected=expected)
    assert {r[SID] for r in skipped.collect()} == {"cavity", "few"} and results.count() == 0 and [r[SID] for r in errors.collect()] == ["gone"]


def test_mmcif_tokens():
    text = "data_x\nloop_\n_a.id\n_a.txt\n1 'it''s'\n2\n;two\nlines\n;\n#\n_b.one 5\n_b.two \"q r\"\n_c.z 1\n"
    rows = list(structures.cif_rows(text, {"_a", "_b"}))
    assert rows == [("_a", 0, "id", "1"), ("_a", 0, "txt", "it''s"), ("_a", 1, "id", "2"), ("_a", 1, "txt", "two\nlines"), ("_b", 0, "one", "5"), ("_b", 0, "two", "q r")]


def test_errors():
    with pytest.raises(ValueError):
        VoidConfig(connectivity="7")
    assert math.isclose(VoidConfig().voxel_size, 3.0)


def test_saved_structures(spark, tmp_path):
    found = annotate.volumize_and_save(spark, [pdb_file(tmp_path, "cavity", ball(SHAPES["cavity"]))], str(tmp_path / "out"), VoidConfig(voxel_size=2.0))
    text = spark.read.text(f"{tmp_path}/out/pdb", wholetext=True).first().value
    codes = {line[17:20] for line in text.splitlines() if line.startswith("ATOM")}
    assert "CAV" in codes and "ALA" in codes and text.count("END") == 2
    assert spark.read.text(f"{tmp_path}/out/annotations").count() == 1 and found.count() >= 1
