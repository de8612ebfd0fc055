"""Experiment configuration: a YAML mapping checked once on the driver."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    """Parameters with a meaning for the computation; defaults where the file names none."""

    min_scan_intensity: float = 0.0
    window_size_sec: float = 60.0
    mass_tol_ppm: float = 40.0
    avg_peak_fwhm_sec: float = 12.0
    min_points: int = 5
    last_cycle_sec: float = 0.1
    parafac_init: str = "random"
    parafac_max_iter: int = 2000
    parafac_min_comp: int = 2
    parafac_max_comp: int = 20
    parafac_tolerance: float = 1e-7
    parafac_seed: int = 123
    #: Cells of a dense slice beyond which it is decomposed in blocks.
    parafac_large_cells: int = 20_000_000
    intensity_lower_percentage_cutoff: int = 0
    align_cycles: bool = False
    sequencer: str = "novor"

    def __post_init__(self) -> None:
        if self.parafac_init not in ("random", "svd"):
            raise ValueError(f"parafac_init: {self.parafac_init}")
        if self.sequencer not in ("novor", "deepnovo"):
            raise ValueError(f"sequencer: {self.sequencer}")
        if not 1 <= self.parafac_min_comp <= self.parafac_max_comp:
            raise ValueError("parafac_min_comp must be between 1 and parafac_max_comp")
        if self.window_size_sec <= 0 or self.mass_tol_ppm <= 0:
            raise ValueError("window_size_sec and mass_tol_ppm must be positive")


def from_mapping(values: dict) -> Config:
    """Keys without a meaning here are left out; a pipeline that has no implementation is refused."""
    if values.get("analysis_pipeline") == "tpp":
        raise ValueError("analysis_pipeline tpp is not supported")
    known = {f.name: f.type for f in fields(Config)}
    kinds = {"float": float, "int": int, "str": str, "bool": bool}
    return Config(**{k: kinds[known[k]](v) for k, v in values.items() if k in known})


def from_yaml(path: str) -> Config:
    import yaml

    with open(path) as f:
        return from_mapping(yaml.safe_load(f) or {})


def upsert_value(path: str, key: str, value) -> dict:
    """Set one value of a small YAML file of computed values and return all of them."""
    import os

    import yaml

    values = {}
    if os.path.exists(path):
        with open(path) as f:
            values = yaml.safe_load(f) or {}
    values[key] = value
    with open(path, "w") as f:
        yaml.safe_dump(values, f)
    return values
