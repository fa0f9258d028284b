"""Parameters, checked when made."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    train: int = 24
    hold: int = 3
    cutoffs: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8)
    match: float = 2.0
    gap_open: float = -1.0
    gap_extend: float = -0.4
    band: int = 5
    k_min: int = 2
    k_max: int = 6
    k_divisor: int = 3
    min_cluster: int = 3
    cap_floor: float = 0.10
    cap_factor: float = 1.5
    tilt: float = 0.25
    cost_bps: float = 10.0
    costs: tuple[float, ...] = (0.0, 5.0, 10.0, 15.0, 20.0, 25.0)
    periods: int = 12
    tune_fraction: float = 0.7
    gate_percentile: float = 95.0
    allocator: str = "risk_parity"
    within: str = "inverse_vol"
    scope: str = "per_stock"
    confidence: float = 0.95
    resamples: int = 5000
    block: int = 20

    def __post_init__(self):
        if len(self.cutoffs) != 4 or list(self.cutoffs) != sorted(self.cutoffs) or not all(0 < c < 1 for c in self.cutoffs):
            raise ValueError("cutoffs must be four increasing numbers between 0 and 1")
        if self.k_min < 2 or self.k_max < self.k_min or self.k_divisor < 1 or self.min_cluster < 2:
            raise ValueError("bad limits for clusters")
        if self.band < 0 or self.train < 2 or self.hold < 1 or self.cost_bps < 0 or any(c < 0 for c in self.costs):
            raise ValueError("band, windows and costs must not be negative")
        if not 0 < self.tune_fraction < 1 or not 0 < self.gate_percentile < 100 or not 0 < self.confidence < 1:
            raise ValueError("fractions must be inside 0 and 1, percentiles inside 0 and 100")
        for name, allowed in (("allocator", ("equal", "risk_parity", "forecast_tilt")), ("within", ("equal", "inverse_vol")), ("scope", ("per_stock", "pooled"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")
        if self.resamples < 1 or self.block < 1 or self.cap_floor <= 0 or self.cap_factor <= 0:
            raise ValueError("resamples, blocks and caps must be positive")

    def k_cap(self, n: int) -> int:
        return min(self.k_max, n // self.k_divisor)

    def cap(self, n: int) -> float:
        return max(self.cap_floor, self.cap_factor / n)


def load(path: str) -> Settings:
    """Settings from a YAML file: one mapping of names to values, all of them known; what is missing has its default."""
    import yaml

    with open(path, encoding="utf-8") as f:
        given = yaml.safe_load(f) or {}
    if not isinstance(given, dict):
        raise ValueError("settings must be a mapping")
    if unknown := given.keys() - {f.name for f in fields(Settings)}:
        raise KeyError(f"unknown settings: {', '.join(sorted(map(str, unknown)))}")
    return Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def checked_sectors(groups: dict[str, list[str]]) -> dict[str, tuple[str, ...]]:
    """A map of groups to assets, as loaded: 3 to 6 groups of at least 3 assets, no asset in two."""
    out = {str(k): tuple(v) for k, v in groups.items()}
    if not 3 <= len(out) <= 6 or any(len(v) < 3 for v in out.values()):
        raise ValueError("3 to 6 groups of at least 3 assets are needed")
    if len({a for v in out.values() for a in v}) < sum(map(len, out.values())):
        raise ValueError("an asset is in two groups")
    return out
