"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lexgrain.llm import canonical, encoding, leakage, near_duplicates, nearest_vectors, packing, rank_fusion, repetition, scan_noise, splitting

MODULES = [encoding, scan_noise, canonical, near_duplicates, splitting, nearest_vectors, rank_fusion, packing, leakage, repetition]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
