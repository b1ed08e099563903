"""Every parameter of the engine, immutable; the defaults are those of a fresh session."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace


@dataclass(frozen=True)
class Params:
    sensitivity: int = 62
    dark_weight: int = 20
    ridge_weight: int = 55
    color_weight: int = 25
    dendrite_weight: int = 20
    min_component: int = 24
    centerline_nms: bool = True
    local_enabled: bool = True
    local_strength: float = 0.7
    local_window: int = 320
    tolerance: int = 2
    review_radius: int = 18
    frame_guard: int = 1
    gap_apply_max_distance: float = 3.25
    gap_max_distance: float = 4.25
    extended_gap_max_distance: float = 8.0
    max_gap_angle_deg: float = 40.0
    min_gap_score: float = 0.78
    extended_min_gap_score: float = 0.58
    min_path_evidence: float = 0.34
    negative_guard_radius: int = 1
    fill_safety: int = 3
    fill_max_area: float = 0.35
    fill_border_max_area: float = 0.12
    fill_max_sides: int = 2
    fill_min_contact: int = 8
    fill_min_pixels: int = 12
    core_erosion: int = 2
    min_core_pixels: int = 12
    max_leak_ratio: float = 2.0
    closure_radii: tuple[int, ...] = (0, 1, 2, 3)

    def weights(self) -> dict[str, int]:
        return {"dark": self.dark_weight, "ridge": self.ridge_weight, "color": self.color_weight, "dendrite": self.dendrite_weight}

    def with_(self, **changes: object) -> Params:
        return replace(self, **changes)

    def to_settings(self) -> dict[str, object]:
        """The settings of a project document."""
        return asdict(self) | {"closure_radii": list(self.closure_radii)}

    @staticmethod
    def from_settings(found: dict[str, object]) -> Params:
        """Settings of a document, older ones included: a strength of 1 or less is a share, a tolerance without a brush is half of one."""
        known = {k: v for k, v in found.items() if k in Params.__dataclass_fields__ and v is not None}
        if "localStrength" in found:
            v = float(found["localStrength"])
            known["local_strength"] = v if v <= 1 else v / 100
        if "brush" in found:
            known["tolerance"] = int(found["brush"]) // 2
        if "closure_radii" in known:
            known["closure_radii"] = tuple(known["closure_radii"])
        return Params(**known)


#: Smallest distance from the frame at which each channel exists.
MARGINS = {"dark": 0, "ridge": 5, "color": 7, "dendrite": 14}
EDGE_LEFT, EDGE_TOP, EDGE_RIGHT, EDGE_BOTTOM = 1, 2, 4, 8
