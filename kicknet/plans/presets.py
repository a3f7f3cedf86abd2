"""The two calculators: which records, gears and ranks each of them uses."""

from __future__ import annotations

from dataclasses import dataclass

from kicknet.operators.selection import ColumnRoles
from kicknet.operators.taxa import (
    CLASS, FAMILY, GENUS, GROUP, ORDER, OVERRIDES, PHYLUM, TRIBE, Override,
)


@dataclass(frozen=True)
class Preset:
    gears: tuple[str, ...]
    rank_chain: tuple[str, ...]
    overrides: tuple[Override, ...] = OVERRIDES
    # the file's own tolerance column, if semi-aquatic records are told by it and not by the master
    tolerance_col: str | None = None


# Accepted gears and rank order
CURRENT = Preset(
    gears=("20-jab", "Net Jab + Dredge", "Multiplate"),
    rank_chain=(GENUS, GROUP, TRIBE, FAMILY, ORDER, CLASS, PHYLUM),
)
LEGACY = Preset(
    gears=("20-jab",),
    rank_chain=(GENUS, TRIBE, FAMILY, ORDER, CLASS, PHYLUM),
    tolerance_col="Tolerance Value",
)

# Column names of the earlier export
LEGACY_ROLES = ColumnRoles(
    mlid="Monitoring Location ID",
    start_date="Activity Start Date",
    start_time="Activity Start Time",
    equip_id="Equipment ID",
    bio_id="Biological Individual ID",
    taxon_name="Taxonomic Name",
    result_val="Result Value",
)
