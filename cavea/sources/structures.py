"""Structure files as atom rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..operators.voxels import SID

ATOMS = [SID, "model", "atom_seq", "group_pdb", "atom_name", "element", "res_name", "res_id", "ins_code", "chain_id", "x", "y", "z", "b_factor"]


def _stem(path) -> F.Column:
    return F.regexp_extract(path, r"([^/]+?)\.[^./]+$", 1)


def scan_pdb(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """ATOM and HETATM lines of fixed width, the first model of each file."""
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_extract("value", r"(?s)^(.*?)(?:\n(?:ENDMDL)|$)", 1).alias("value"))
    lines = whole.select(_stem("path").alias(SID), F.posexplode(F.split("value", "\n")).alias("atom_seq", "line")).filter(F.col("line").rlike("^(ATOM  |HETATM)"))
    cut = lambda start, end: F.trim(F.substring("line", start, end - start + 1))
    element = F.when(cut(77, 78) != "", cut(77, 78)).otherwise(F.regexp_extract(cut(13, 16), "[A-Za-z]", 0))
    return lines.select(
        SID, F.lit(1).alias("model"), F.col("atom_seq").cast("long").alias("atom_seq"), cut(1, 6).alias("group_pdb"), cut(13, 16).alias("atom_name"), F.initcap(element).alias("element"),
        cut(18, 20).alias("res_name"), cut(23, 26).try_cast("int").alias("res_id"), cut(27, 27).alias("ins_code"), cut(22, 22).alias("chain_id"),
        *[cut(s, s + 7).try_cast("double").alias(c) for s, c in ((31, "x"), (39, "y"), (47, "z"))], F.coalesce(cut(61, 66).try_cast("double"), F.lit(0.0)).alias("b_factor"),
    ).filter("x is not null and y is not null and z is not null")


_TOKEN = re.compile(r"""(?m)^;(.*?)\n;|'((?:[^']|'(?=\S))*)'(?=\s|$)|"((?:[^"]|"(?=\S))*)"(?=\s|$)|(\#[^\n]*)|(\S+)""", re.S)


def cif_rows(text: str, wanted: set[str]) -> Iterator[tuple[str, int, str, str]]:
    """(category, row, column, value) of the wanted categories, loops and single items."""
    loop, names, values = False, [], []

    def flush() -> Iterator[tuple[str, int, str, str]]:
        if names and values:
            category = names[0].split(".")[0]
            if category in wanted:
                for i, v in enumerate(values):
                    yield category, i // len(names), names[i % len(names)].partition(".")[2], v

    for m in _TOKEN.finditer(text):
        if m[4] is not None:
            continue
        bare = m[5]
        if bare is not None and (bare.lower() == "loop_" or bare.startswith("data_")):
            yield from flush()
            loop, names, values = bare.lower() == "loop_", [], []
        elif bare is not None and bare.startswith("_"):
            if names and (values if loop else bare.split(".")[0] != names[0].split(".")[0]):
                yield from flush()
                loop, names, values = False, [], []
            names.append(bare)
        else:
            values.append(next(g for g in m.groups() if g is not None).strip("\n"))
    yield from flush()


def scan_mmcif(spark: SparkSession, paths: str | list[str], categories: list[str]) -> DataFrame:
    """(structure_id, category, row, col, value) of the categories asked for."""
    wanted = set(categories)
    files = spark.read.text(paths, wholetext=True).select(_stem(F.col("_metadata.file_path")).alias(SID), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for sid, text in zip(b[SID], b["value"]):
                rows = list(cif_rows(text, wanted))
                for lo in range(0, len(rows), 50_000):
                    part = pd.DataFrame(rows[lo : lo + 50_000], columns=["category", "row", "col", "value"])
                    part.insert(0, SID, sid)
                    yield part

    return files.mapInPandas(run, f"{SID} string, category string, row long, col string, value string")


def cif_table(rows: DataFrame, category: str, columns: list[str]) -> DataFrame:
    """One category as a table (structure_id, row, columns)."""
    return rows.filter(F.col("category") == category).groupBy(SID, "row").pivot("col", columns).agg(F.first("value"))


def scan_cif_table(spark: SparkSession, paths: str | list[str], category: str, columns: list[str]) -> DataFrame:
    """(structure_id, row, columns) of one category, null where a file lacks a column. Rows
    leave the parser whole and with the columns asked for alone, so there is no exchange."""
    files = spark.read.text(paths, wholetext=True).select(_stem(F.col("_metadata.file_path")).alias(SID), "value")
    place = {c: k for k, c in enumerate(columns)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for sid, text in zip(b[SID], b["value"]):
                rows: list[list] = []
                for _, row, col, value in cif_rows(text, {category}):
                    if row == len(rows):
                        rows.append([sid, row, *[None] * len(columns)])
                    if (k := place.get(col)) is not None:
                        rows[row][k + 2] = value
                for lo in range(0, len(rows), 50_000):
                    yield pd.DataFrame(rows[lo : lo + 50_000], columns=[SID, "row", *columns])

    return files.mapInPandas(run, f"{SID} string, row long, " + ", ".join(f"`{c}` string" for c in columns))


ATOM_SITE = ["group_PDB", "type_symbol", "label_atom_id", "label_comp_id", "label_asym_id", "auth_seq_id", "pdbx_PDB_ins_code", "Cartn_x", "Cartn_y", "Cartn_z", "B_iso_or_equiv", "pdbx_PDB_model_num"]


def scan_cif_atoms(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The atoms of mmCIF files, all models."""
    return _named_atoms(scan_cif_table(spark, paths, "_atom_site", ATOM_SITE))


def atoms_of_cif(rows: DataFrame) -> DataFrame:
    return _named_atoms(cif_table(rows, "_atom_site", ATOM_SITE))


def _named_atoms(t: DataFrame) -> DataFrame:
    some = lambda c: F.when(~F.col(c).isin("?", "."), F.col(c))
    return t.select(
        SID, F.coalesce(F.col("pdbx_PDB_model_num").try_cast("int"), F.lit(1)).alias("model"), F.col("row").alias("atom_seq"), F.col("group_PDB").alias("group_pdb"),
        F.col("label_atom_id").alias("atom_name"), F.initcap("type_symbol").alias("element"), F.col("label_comp_id").alias("res_name"), F.col("auth_seq_id").try_cast("int").alias("res_id"),
        F.coalesce(some("pdbx_PDB_ins_code"), F.lit("")).alias("ins_code"), F.col("label_asym_id").alias("chain_id"),
        *[F.col(f"Cartn_{c}").try_cast("double").alias(c) for c in "xyz"], F.coalesce(F.col("B_iso_or_equiv").try_cast("double"), F.lit(0.0)).alias("b_factor"),
    )


def scan_peptides(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """(structure_id, res_name) of the components that the mmCIF files among ``paths``
    list as linking in peptides; None where no file is mmCIF. Such files name every
    residue's type, so modified amino acids need no list of names."""
    cif = [p for p in paths if p.lower().endswith((".cif", ".mmcif"))]
    if not cif:
        return None
    kind = F.lower("type")
    listed = scan_cif_table(spark, cif, "_chem_comp", ["id", "type"])
    return listed.filter(kind.contains("peptide") & ~kind.contains("peptide-like")).select(SID, F.col("id").alias("res_name")).distinct()


def assembly_tables(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gen, oper) as prep.expand_assembly takes them, gen with ``place`` in the file.
    Operator lists such as 1,2 and (1-60) are read, and products of lists such as
    (1,2)(3)(4-6): the one on the right moves first. A product with an operator that
    the file doesn't have moves nothing."""
    gen = cif_table(rows, "_pdbx_struct_assembly_gen", ["assembly_id", "oper_expression", "asym_id_list"])
    bare = F.regexp_replace("oper_expression", r"\s", "")
    factors = F.filter(F.split(bare, r"[()]+"), lambda f: ~f.isin("", ","))
    # a list of lists, (1,2),(3), is a sum; brackets side by side are a product
    product = bare.contains(")(")

    def listed(part):
        first, last = F.regexp_extract(part, r"^(\d+)-(\d+)$", 1), F.regexp_extract(part, r"^(\d+)-(\d+)$", 2)
        return F.when(first != "", F.transform(F.sequence(first.try_cast("int"), last.try_cast("int")), lambda i: i.cast("string"))).otherwise(F.array(part))

    def ids(factor):
        return F.flatten(F.transform(F.filter(F.split(factor, ","), lambda p: p != ""), listed))

    def times(some, more):
        return F.flatten(F.transform(some, lambda a: F.transform(more, lambda b: F.concat(a, F.lit("*"), b))))

    lists = F.transform(factors, ids)
    products = F.aggregate(F.slice(lists, 2, F.greatest(F.size(lists) - 1, F.lit(0))), F.get(lists, F.lit(0)), times)
    opers = F.when(product, products).otherwise(F.flatten(lists))
    each = gen.select(SID, "assembly_id", "row", F.posexplode(opers).alias("nth", "oper_id"), "asym_id_list").withColumn("place", F.struct("row", "nth"))
    each = each.select(SID, "assembly_id", "oper_id", "place", F.explode(F.split(F.regexp_replace("asym_id_list", r"\s", ""), ",")).alias("chain_id"))
    cells = [f"matrix[{i}][{j}]" for i in (1, 2, 3) for j in (1, 2, 3)]
    moves = [f"vector[{i}]" for i in (1, 2, 3)]
    oper = cif_table(rows, "_pdbx_struct_oper_list", ["id", *cells, *moves])
    number = lambda names: F.array(*[F.col(f"`{n}`").try_cast("double") for n in names])
    single = oper.select(SID, F.col("id").alias("oper_id"), number(cells).alias("matrix"), number(moves).alias("shift"))
    both = each.filter(F.col("oper_id").contains("*")).select(SID, F.col("oper_id").alias("_all")).distinct()
    steps = both.select(SID, "_all", F.posexplode(F.split("_all", r"\*")).alias("nth", "oper_id"), F.size(F.split("_all", r"\*")).alias("of")).join(single, [SID, "oper_id"])
    turns = steps.groupBy(SID, "_all", "of").agg(F.sort_array(F.collect_list(F.struct("nth", "matrix", "shift"))).alias("t")).filter("size(t) = of")
    start = F.struct(F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)]).alias("matrix"), F.array(*[F.lit(0.0)] * 3).alias("shift"))
    both = turns.select(SID, F.col("_all").alias("oper_id"), F.aggregate("t", start, _then).alias("m")).select(SID, "oper_id", "m.matrix", "m.shift")
    return each, single.unionByName(both)


def _then(acc: Column, turn: Column) -> Column:
    """The motion that moves by ``turn`` first and then by ``acc`` (matrix, shift)."""
    three = lambda f: f(0) + f(1) + f(2)
    matrix = [three(lambda k, i=i, j=j: F.get(acc["matrix"], F.lit(3 * i + k)) * F.get(turn["matrix"], F.lit(3 * k + j))) for i in range(3) for j in range(3)]
    shift = [three(lambda k, i=i: F.get(acc["matrix"], F.lit(3 * i + k)) * F.get(turn["shift"], F.lit(k))) + F.get(acc["shift"], F.lit(i)) for i in range(3)]
    return F.struct(F.array(*matrix).alias("matrix"), F.array(*shift).alias("shift"))


def load_structures(spark: SparkSession, paths: list[str], assembly: str = "auto") -> DataFrame:
    """Atoms of .pdb, .ent, .cif and .mmcif files. Policy ``biological`` and ``auto``
    build the first assembly of mmCIF files, unless it is the identity; ``asymmetric``
    takes the atoms as they are. Other suffixes are an error."""
    from ..operators import prep

    if assembly not in ("auto", "biological", "asymmetric"):
        raise ValueError("assembly must be auto, biological or asymmetric")
    kind = lambda p: p.lower().rsplit(".", 1)[-1]
    if odd := [p for p in paths if kind(p) not in ("pdb", "ent", "cif", "mmcif")]:
        raise ValueError(f"unsupported structure files: {odd}")
    pdb, cif = [p for p in paths if kind(p) in ("pdb", "ent")], [p for p in paths if kind(p) in ("cif", "mmcif")]
    parts = [scan_pdb(spark, pdb)] if pdb else []
    if cif:
        atoms = prep.select_models(scan_cif_atoms(spark, cif), keep_all=False)
        if assembly != "asymmetric":
            rows = scan_mmcif(spark, cif, ["_pdbx_struct_assembly_gen", "_pdbx_struct_oper_list"])
            gen, oper = assembly_tables(rows)
            plain = prep.identity_assembly(gen, oper, atoms).join(gen.select(SID).distinct().withColumn("_has", F.lit(True)), SID, "left").filter("identity or _has is null").select(SID)
            moved = prep.expand_assembly(atoms.join(plain, SID, "left_anti"), gen, oper)
            # copies have chains of their own and follow each other
            moved = prep.assign_chain_ids(moved)
            nth = F.row_number().over(W.partitionBy(SID).orderBy("copy", "atom_seq")) - 1
            moved = moved.withColumn("atom_seq", nth.cast("long")).drop("copy")
            atoms = atoms.join(plain, SID, "left_semi").unionByName(moved)
        parts.append(atoms)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*ATOMS)
