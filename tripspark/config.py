"""Parameters shared by all jobs. Every operator takes them as arguments with these defaults."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

# The study calendar and the cleaning thresholds that results depend on.
POLICY_DATE = date(2025, 1, 5)
FIRST_WEEK = date(2024, 1, 7)
LAST_DAY = date(2025, 12, 27)
SEED = 20250105


@dataclass(frozen=True)
class CleaningRules:
    """Bounds of the seven quality rules."""

    min_miles: float = 0.0
    max_miles: float = 100.0
    min_time_s: float = 60.0
    max_time_s: float = 14400.0
    max_speed_mph: float = 80.0
    min_fare: float = 0.0
    max_fare: float = 1000.0
    max_wait_min: float = 120.0
    first_zone: int = 1
    last_zone: int = 263
    pay_required: tuple[str, ...] = ("hvfhv",)


@dataclass(frozen=True)
class ZoneRules:
    """Thresholds of the zone classifier."""

    unknown_zones: tuple[int, ...] = (264, 265)
    airport_zones: tuple[int, ...] = (1, 132, 138)
    unknown_boroughs: tuple[str, ...] = ("Unknown", "N/A")
    core_borough: str = "Manhattan"
    full_share: float = 0.90
    partial_share: float = 0.10


@dataclass(frozen=True)
class Groups:
    """Zone group names used in flow types, panels and treatment indicators."""

    treated: str = "CRZ"
    partial: str = "CRZ_PARTIAL"
    near: str = "MN_NORTH"
    far: str = "OUTER"
    airport: str = "AIRPORT"
    panel: tuple[str, ...] = field(default=("CRZ", "MN_NORTH", "OUTER"))


CLEANING = CleaningRules()
ZONES = ZoneRules()
GROUPS = Groups()
