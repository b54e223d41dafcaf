"""Thresholds of the operators, overridable by a dict of the same shape."""

from __future__ import annotations

import copy

# Defaults of the analysis.
DEFAULTS: dict = {
    "matching": {"floor": 0.10, "min_var": 0.01, "ppt_ratio": (0.2, 5.0), "vap_ratio": (0.5, 3.0), "pet_ratio": (0.5, 3.0), "srad_ratio": (0.8, 1.25), "sites": 5, "sep_km": {"na": 150.0, "world": 300.0}, "agree_km": 500.0, "agree_km_world": 1000.0, "worldwide_sigma": 2.0},
    "grid": {"land_fraction": 0.25, "min_lat": -60.0, "native_per_degree": 24},
    "extremes": {"year_stride": 2, "wet_bulb": 28.0, "dry_mm": 1.0},
    "sensitivity": {"moderate": 0.5, "high": 1.0, "moved_km": 500.0, "overlap_models": 6},
    "release": {"moved_share": 0.10, "median_change": 0.25, "self_check": 0.5, "recent_change": 3.0, "dataset_check": 1.5},
    "agreement": {"fair": 2.0, "poor": 3.5, "land_fraction": 0.5, "land_km": 50.0},
    "gates": {"records": 100, "low_records": 300, "narrow_records": 500, "narrow_km2": 67_500.0, "auc_ok": 0.7, "auc_floor": 0.5, "novel": 0.15, "omission": 0.40, "commission": 0.30, "recall": 0.8, "unrecorded_warn": 0.5, "check_gap_pp": 25.0, "publish": ((0.70, 0.50), (0.60, 0.80))},
    "fit": {"max_correlation": 0.7, "max_predictors": 5, "folds": 5, "max_presences": 20_000},
    "hindcast": {"noise_se": 2.0, "min_years": 10, "min_detections": 3, "complete": 0.85, "min_interval": 15, "min_plots": 8, "plot_cap": 30, "well_sampled": 20},
    "climatology": {"coverage": 0.95},
    "dispersal_km": {"tree": 15.0, "plant": 15.0, "wild_plant": 15.0, "crop": 10.0, "bird": 100.0, "mammal": 50.0, "insect_arachnid": 40.0, "reptile": 10.0, "amphibian": 5.0, "fish": 50.0},
    "dispersal_default": 20.0,
    "expansion": {"per_country": 3, "spacing_km": 10.0, "duplicate_km": 6.0},
}


def config(overrides: dict | None = None) -> dict:
    out = copy.deepcopy(DEFAULTS)
    for section, values in (overrides or {}).items():
        out[section] = {**out[section], **values} if isinstance(values, dict) and isinstance(out.get(section), dict) else values
    return out
