"""Configuration: frozen sections with their checks, loaded from YAML."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from datetime import date, timedelta
from typing import Any


@dataclass(frozen=True)
class Quality:
    max_nan_ratio: float = 0.0
    max_abs_logret: float = 0.30
    stale_bars: int = 5
    zscore_cap: float = 8.0
    max_last_bar_age_days: int = 7


@dataclass(frozen=True)
class Labelling:
    vol_span: int = 20
    cusum_threshold: float = 0.02
    pt: float = 1.0
    sl: float = 1.0
    vertical_bars: int = 10


@dataclass(frozen=True)
class FracDiff:
    d: float = 0.40
    thresh: float = 1e-4


@dataclass(frozen=True)
class Windows:
    """Lengths of the base indicators, in bars."""

    volatility: int = 20
    momentum: int = 20
    average: int = 20
    rsi: int = 14
    fast: int = 12
    slow: int = 26
    signal: int = 9
    atr: int = 14
    zscore: int = 20


@dataclass(frozen=True)
class Trading:
    max_position: float | None = None
    max_gross: float | None = None


@dataclass(frozen=True)
class Research:
    horizon: int = 5
    embargo: int = 5
    seed: int = 42
    train_end: date = date(2022, 12, 30)
    test_start: date = date(2023, 1, 10)
    rounds: int = 100
    learning_rate: float = 0.05
    max_depth: int = 5  # at most 32 leaves
    min_leaf: int = 20
    feature_fraction: float = 0.8
    bagging_fraction: float = 0.8
    ic_threshold: float = 0.02
    min_breadth: int = 30

    def __post_init__(self) -> None:
        if self.embargo < self.horizon:
            raise ValueError("embargo must not be shorter than the horizon")
        if self.test_start <= self.train_end:
            raise ValueError("test_start must be after train_end")
        if (self.test_start - self.train_end).days < self.embargo:
            raise ValueError("calendar gap is shorter than the embargo")


@dataclass(frozen=True)
class Settings:
    symbols: tuple[str, ...] = ()
    start: date = date(2015, 1, 1)
    end: date = date(2026, 1, 1)
    quality: Quality = field(default_factory=Quality)
    labels: Labelling = field(default_factory=Labelling)
    fracdiff: FracDiff = field(default_factory=FracDiff)
    trading: Trading = field(default_factory=Trading)
    research: Research = field(default_factory=Research)

    def __post_init__(self) -> None:
        if self.end <= self.start:
            raise ValueError("end must be after start")
        if len(set(self.symbols)) != len(self.symbols):
            raise ValueError("symbols must be unique")
        if not (self.start <= self.research.train_end and self.research.test_start <= self.end):
            raise ValueError("split dates must lie inside [start, end]")


def build(cls: type, data: dict[str, Any]):
    """A section from a mapping; unknown keys are errors."""
    known = {f.name: f for f in fields(cls)}
    unknown = set(data) - set(known)
    if unknown:
        raise ValueError(f"unknown keys for {cls.__name__}: {sorted(unknown)}")
    out = {}
    sections = {"quality": Quality, "labels": Labelling, "fracdiff": FracDiff, "trading": Trading, "research": Research}
    for k, v in data.items():
        if cls is Settings and k in sections and isinstance(v, dict):
            out[k] = build(sections[k], v)
        elif k == "symbols":
            out[k] = tuple(v)
        elif k in ("start", "end", "train_end", "test_start") and isinstance(v, str):
            out[k] = date.fromisoformat(v)
        else:
            out[k] = v
    return cls(**out)


def load_settings(path: str) -> Settings:
    """Settings of a YAML file."""
    import yaml

    with open(path) as f:
        return build(Settings, yaml.safe_load(f) or {})


def business_day(start: date, n: int) -> date:
    """The n-th Monday-to-Friday day after ``start``."""
    d = start
    while n > 0:
        d += timedelta(days=1)
        n -= d.weekday() < 5
    return d


def as_dict(section: Any) -> dict[str, Any]:
    return {f.name: as_dict(v) if is_dataclass(v := getattr(section, f.name)) else v for f in fields(section)}
