"""Settings of the volume analysis, passed to every operator."""

from __future__ import annotations

from dataclasses import dataclass

# Van der Waals radii by element, in angstrom; others have DEFAULT_RADIUS.
DEFAULT_RADIUS = 2.0
RADII = {
    "H": 1.11, "He": 1.40, "Li": 1.82, "Be": 1.53, "B": 1.92, "C": 1.70, "N": 1.55, "O": 1.52, "F": 1.47, "Na": 2.27, "Mg": 1.73, "Al": 1.84, "Si": 2.10,
    "P": 1.80, "S": 1.80, "Cl": 1.75, "K": 2.75, "Ca": 2.31, "Ni": 1.63, "Cu": 1.40, "Zn": 1.39, "Se": 1.90, "Br": 1.85, "I": 1.98, "X": 2.0,
}

# Thresholds of the typing rules.
OCCLUDED_VOXELS = 4
DIRECTIONAL_VOXELS = 24
PORE_RATIO = 0.7
HUB_RATIO = 0.4
NECK_WIDTH = 1
CORE_TO_SHELL = 500.0

# Residue, chain and element codes of volume pseudo-atoms.
CODES = {"hub": "HUB", "pore": "POR", "pocket": "POK", "cavity": "CAV", "occluded": "OCC"}
CHAINS = {"HUB": "A", "POR": "B", "POK": "C", "CAV": "D", "OCC": "E"}
ELEMENTS = {"HUB": "F", "POR": "O", "POK": "N", "CAV": "S", "OCC": "H"}
#: Type of a topology code, and the order in which refined volumes are counted.
TYPES = ["occluded", "cavity", "pocket", "pore", "hub"]
REFINED_ORDER = ["hub", "pore", "pocket", "cavity"]

MODES = ("6", "18", "26", "custom18")


@dataclass(frozen=True)
class VoidConfig:
    voxel_size: float = 3.0
    connectivity: str = "custom18"
    merge_gap: int = 1
    min_voxels: int = 4
    min_volume: float | None = None
    neck: bool = True
    keep_non_protein: bool = False
    keep_all_models: bool = False
    shells: bool = True
    #: Bin width of cross-section slices; None takes the grid's x dimension.
    slice_width: float | None = None

    def __post_init__(self):
        if self.connectivity not in MODES:
            raise ValueError(f"connectivity must be one of {MODES}")
        if self.voxel_size <= 0:
            raise ValueError("voxel_size must be positive")
