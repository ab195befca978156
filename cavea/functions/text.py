"""Identifiers, labels, paths and numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Method aliases and the labels each stands for.
METHOD_ALIASES = {"x-ray": "xray", "xray": "xray", "em": "em", "cryo-em": "em", "cryoem": "em", "electron-microscopy": "em", "nmr": "nmr", "neutron": "neutron"}
METHOD_LABELS = {
    "xray": ["X-RAY DIFFRACTION"], "em": ["ELECTRON MICROSCOPY"], "nmr": ["SOLUTION NMR", "SOLID-STATE NMR"], "neutron": ["NEUTRON DIFFRACTION"],
}
DEFAULT_METHODS = ["xray", "em"]
TERMINAL_STATUS = [400, 401, 403, 404]
FORMATS = {"cif": "mmcif", "mmcif": "mmcif", "bcif": "bcif", "pdb": "pdb", "ent": "pdb"}


def is_entry_id(s: Column) -> Column:
    return F.coalesce(s.rlike("^[A-Za-z0-9]{4}$"), F.lit(False))


def normalize_id(s: Column) -> Column:
    """Trimmed upper-case id of four letters or digits, else null."""
    t = F.upper(F.trim(s))
    return F.when(t.rlike("^[A-Z0-9]{4}$"), t)


def entity_to_entry(token: Column) -> Column:
    """What precedes the first underscore, in upper case."""
    return F.upper(F.substring_index(F.trim(token), "_", 1))


def infer_id(direct: Column, label: Column, stem: Column) -> Column:
    return F.coalesce(normalize_id(direct), normalize_id(label), normalize_id(stem))


def member_ids(ids: Column) -> Column:
    """Valid ids, normalised, in order of first sight."""
    return F.array_distinct(F.filter(F.transform(ids, normalize_id), lambda x: x.isNotNull()))


def _literal_map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def method_alias(s: Column) -> Column:
    """Canonical method name, null if unknown."""
    return F.element_at(_literal_map(METHOD_ALIASES), F.lower(F.replace(F.trim(s), F.lit("_"), F.lit("-"))))


def expand_methods(names: list[str] | None = None) -> list[str]:
    """Labels of the methods named; None takes the default."""
    out: list[str] = []
    for n in DEFAULT_METHODS if names is None else names:
        key = METHOD_ALIASES.get(n.strip().lower().replace("_", "-"))
        if key is None:
            raise ValueError(f"unknown method {n!r}; known: {sorted(METHOD_LABELS)}")
        out += [x for x in METHOD_LABELS[key] if x not in out]
    return out


def methods(exptl: Column) -> Column:
    """Distinct upper-case methods of an array of structs."""
    named = F.transform(exptl, lambda e: F.upper(F.trim(e["method"])))
    return F.coalesce(F.array_distinct(F.filter(named, lambda m: m.isNotNull() & (m != ""))), F.array().cast("array<string>"))


def best_resolution(values: Column) -> Column:
    """Least of the numbers in an array of strings, others ignored."""
    return F.array_min(F.transform(values, lambda v: v.try_cast("double")))


def sanitize_label(s: Column, default: str = "structure") -> Column:
    """Runs of other than letters, digits, - and _ become _, outer _ go, lower case."""
    clean = F.lower(F.btrim(F.regexp_replace(F.coalesce(s, F.lit("")), r"[^A-Za-z0-9_\-]+", "_"), F.lit("_")))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit(default))


def derive_run_id(path: Column, default: str = "run") -> Column:
    parent = F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)
    return sanitize_label(parent, default)


def output_paths(label: Column, folder: str) -> Column:
    return F.struct(F.concat(F.lit(f"{folder}/"), label, F.lit(".annotated.cif")).alias("structure_output"), F.concat(F.lit(f"{folder}/"), label, F.lit(".annotation.json")).alias("annotation_output"))


def status_code(message: Column) -> Column:
    return F.regexp_extract(message, r"\b([1-5][0-9]{2})\b", 1).try_cast("int")


def negative_record(pdb_id: Column, message: Column) -> Column:
    code = status_code(message)
    return F.struct(pdb_id.alias("pdb_id"), message.alias("error"), code.alias("status_code"), F.coalesce(code.isin(TERMINAL_STATUS), F.lit(False)).alias("permanent"))


def eta_text(seconds: Column) -> Column:
    total = F.bround(seconds).cast("long")
    h, m, s = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    return (
        F.when(seconds.isNull() | (seconds < 0), "unknown").when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%02d:%02d", m, s))
    )


def style_hash(options: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a map's canonical JSON."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(options)))
    return F.substring(F.sha2(F.to_json(ordered), 256), 1, 16)


def structure_format(path: Column) -> Column:
    return F.element_at(_literal_map(FORMATS), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def atom_name4(name: Column) -> Column:
    return F.when(F.length(name) >= 4, name).otherwise(F.rpad(F.concat(F.lit(" "), name), 4, " "))


def atom_line(index: Column) -> Column:
    """A fixed-width ATOM line of the columns of an atom row."""
    return F.format_string(
        "ATOM  %5d %4s %3s %1s%4d%1s   %8.3f%8.3f%8.3f%6.2f%6.2f          %2s", (index % 100000).cast("int"), atom_name4(F.col("atom_name")), F.col("res_name"),
        F.substring("chain_id", 1, 1), (F.col("res_id") % 10000).cast("int"), F.col("ins_code"), "x", "y", "z", F.lit(1.0), F.col("b_factor"), F.col("element"),
    )


def first_existing(candidates: Column, listing: Column) -> Column:
    """The first candidate in ``listing`` (an array), else the first."""
    return F.coalesce(F.try_element_at(F.filter(candidates, lambda c: F.array_contains(listing, c)), F.lit(1)), F.try_element_at(candidates, F.lit(1)))


def control_byte(content: Column) -> Column:
    """Reason why bytes are corrupt, else null: empty, or a control byte other than
    tab, line feed and carriage return."""
    byte = F.regexp_extract(F.decode(content, "ISO-8859-1"), "([\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f])", 1)
    return F.when(F.length(content) == 0, "empty file").when(byte != "", F.concat(F.lit("contains control byte 0x"), F.lpad(F.hex(F.encode(byte, "ISO-8859-1")), 2, "0")))
