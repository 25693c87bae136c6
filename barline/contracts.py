"""Driver-side messages of the trading and data flow, checked on construction."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from enum import StrEnum
from typing import Any, Protocol

from barline.bus import Command, Event
from barline.schema import SYMBOL_PATTERN


def _symbol(s: str) -> None:
    if not re.fullmatch(SYMBOL_PATTERN, s):
        raise ValueError(f"bad symbol {s!r}")


class Side(StrEnum):
    BUY = "buy"
    SELL = "sell"


class OrderType(StrEnum):
    MARKET = "market"
    LIMIT = "limit"


@dataclass(frozen=True)
class Signal(Event):
    symbol: str
    strength: float

    def __post_init__(self) -> None:
        super().__post_init__()
        _symbol(self.symbol)
        if not abs(self.strength) < float("inf"):
            raise ValueError("strength must be finite")


@dataclass(frozen=True)
class Order(Command):
    symbol: str
    side: Side
    type: OrderType
    quantity: Decimal
    limit_price: Decimal | None = None

    def __post_init__(self) -> None:
        super().__post_init__()
        _symbol(self.symbol)
        if self.quantity <= 0:
            raise ValueError("quantity must be positive")
        if (self.type is OrderType.LIMIT) != (self.limit_price is not None):
            raise ValueError("a limit price goes with limit orders only")
        if self.limit_price is not None and self.limit_price <= 0:
            raise ValueError("limit price must be positive")


@dataclass(frozen=True)
class Fill(Event):
    order_id: str
    symbol: str
    quantity: Decimal
    price: Decimal

    def __post_init__(self) -> None:
        super().__post_init__()
        _symbol(self.symbol)
        if self.quantity <= 0 or self.price <= 0:
            raise ValueError("quantity and price must be positive")


@dataclass(frozen=True)
class RiskCheck(Event):
    order_id: str
    passed: bool
    violations: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.passed == bool(self.violations):
            raise ValueError("passed means no violations")


@dataclass(frozen=True)
class Position:
    symbol: str
    quantity: Decimal
    average_price: Decimal


@dataclass(frozen=True)
class MarketDataRequest:
    symbols: tuple[str, ...]
    start: date
    end: date
    frequency: str = "1d"

    def __post_init__(self) -> None:
        if not self.symbols or len(set(self.symbols)) != len(self.symbols):
            raise ValueError("symbols must be given once each")
        for s in self.symbols:
            _symbol(s)
        if self.end <= self.start:
            raise ValueError("end must be after start")
        if self.frequency != "1d":
            raise ValueError("daily bars only")


@dataclass(frozen=True)
class FeatureVector:
    symbol: str
    at: datetime
    values: tuple[tuple[str, float], ...]

    def __post_init__(self) -> None:
        names = [n for n, _ in self.values]
        if not names or len(set(names)) != len(names):
            raise ValueError("names must be unique and present")


@dataclass(frozen=True)
class DataIngested(Event):
    symbols: tuple[str, ...]


@dataclass(frozen=True)
class QualityReported(Event):
    symbol: str
    passed: bool
    reason: str | None = None


@dataclass(frozen=True)
class ExtremeReturnFlagged(Event):
    symbol: str
    timestamp: datetime
    log_return: float


@dataclass(frozen=True)
class FeaturesComputed(Event):
    names: tuple[str, ...]


@dataclass(frozen=True)
class LabelsComputed(Event):
    horizon: int


class DataVendor(Protocol):
    def get_bars(self, request: MarketDataRequest) -> Any: ...


class Broker(Protocol):
    def submit(self, order: Order) -> Fill: ...


class ModelStore(Protocol):
    def save(self, model: Any, meta: Any) -> str: ...
    def load(self, loader: Any, model_hash: str) -> Any: ...
