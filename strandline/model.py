"""Settings and enumerations of a boundary study; immutable, checked when they are made."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from enum import Enum


class TransectType(Enum):
    MAX_ELEVATION_LINE = 1
    STEEPEST_LINE = 2
    FLOW_PATH = 3
    HOMOGENEOUS_ASPECT = 4


class Migration(Enum):
    ALL = "AllMigration"
    GOOD = "OnlyGoodMigration"


@dataclass(frozen=True)
class GridGeometry:
    """Georeference of a grid of square cells."""

    crs: str = "local"
    res_m: float = 30.0
    longlat: bool = False
    origin: tuple[float, float] = (0.0, 0.0)
    rotation: bool = False

    def __post_init__(self):
        if not self.res_m > 0:
            raise ValueError("cells need a positive size")


@dataclass(frozen=True)
class VegType:
    """A vegetation type: class ids of a field of the attribute table, and the side on which it ends."""

    ids: tuple[int, ...]
    field: str = "veg_class"
    end_to_left: bool = False


@dataclass(frozen=True)
class Settings:
    transect_type: TransectType = TransectType.HOMOGENEOUS_ASPECT
    density_low: float = 0.05
    density_high: float = 0.75
    density_extended_min: float = 0.5
    aspect_sd_max: float = math.radians(90)
    aspect_deviation_max: float = math.radians(60)
    band_width_cells: int = 200
    subcells: int = 8
    min_slope: float = math.radians(2)
    transect_azimuth: float = 1.5 * math.pi
    candidate_lines: int = 20
    seed: int = 123
    searchpoints: int = 6
    transects: int = 6
    inhibit: bool = False
    neighborhoods: tuple[int, ...] = (1667, 999)
    hull_steps: tuple[int, ...] = (1, 3)
    patch_area_classes_m2: tuple[float, float] = (1e4, 1e6)
    veg1: VegType = field(default_factory=lambda: VegType((1,)))
    veg2: VegType = field(default_factory=lambda: VegType((2,), end_to_left=True))
    excluded: VegType = field(default_factory=lambda: VegType((3,)))
    geometry: GridGeometry = field(default_factory=GridGeometry)

    def __post_init__(self):
        if not 0 < self.density_low < self.density_extended_min < self.density_high < 1:
            raise ValueError("densities must rise: 0 < low < extended_min < high < 1")
        if self.band_width_cells < 200:
            raise ValueError("a band is at least 200 cells wide")
        for name in ("aspect_sd_max", "aspect_deviation_max", "subcells", "min_slope", "candidate_lines", "seed", "searchpoints", "transects"):
            if not getattr(self, name) > 0:
                raise ValueError(f"{name} must be positive")
        if self.transects > self.searchpoints:
            raise ValueError("there can't be more transects than search points")
        if any(n <= 0 or n % 2 == 0 for n in self.neighborhoods):
            raise ValueError("neighborhoods must be odd and positive")
        a, b = self.patch_area_classes_m2
        if not 0 < a < b:
            raise ValueError("two rising patch areas are needed")
        object.__setattr__(self, "hull_steps", tuple(sorted(set(self.hull_steps))))
        object.__setattr__(self, "transect_azimuth", self.transect_azimuth % (2 * math.pi))

    def but(self, **changes) -> Settings:
        return replace(self, **changes)

    @property
    def inhibit_distance_m(self) -> float | None:
        return math.floor(self.geometry.res_m * max(self.neighborhoods) / 3) if self.inhibit else None

    @property
    def location_calls(self) -> int:
        return self.transects * len(self.neighborhoods)

    @property
    def measure_calls(self) -> int:
        return self.location_calls * len(Migration)


def to_json(settings: Settings) -> str:
    """Settings as text, for the project's state."""
    import json
    from dataclasses import asdict

    return json.dumps(asdict(settings) | {"transect_type": settings.transect_type.name})


def from_json(text: str) -> Settings:
    import json

    raw = json.loads(text)
    for name in ("veg1", "veg2", "excluded"):
        raw[name] = VegType(**raw[name] | {"ids": tuple(raw[name]["ids"])})
    raw["geometry"] = GridGeometry(**raw["geometry"] | {"origin": tuple(raw["geometry"]["origin"])})
    for name in ("neighborhoods", "hull_steps", "patch_area_classes_m2"):
        raw[name] = tuple(raw[name])
    return Settings(**raw | {"transect_type": TransectType[raw["transect_type"]]})
