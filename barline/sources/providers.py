"""Provider chain: ordered readers with bounded attempts; the first complete result wins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from barline.operators.quality import completeness

Reader = Callable[[Sequence[str]], DataFrame]


class DataUnavailable(RuntimeError):
    """No provider gave complete data."""


def secondary_stub(symbols: Sequence[str]) -> DataFrame:
    """A place for a second vendor; always fails."""
    raise DataUnavailable("no secondary provider is configured")


def first_complete(readers: Sequence[tuple[str, Reader]], symbols: Sequence[str], attempts: int = 1) -> DataFrame:
    """Ask each reader up to ``attempts`` times; incomplete results count as failures.  The error names
    every failure in order."""
    if attempts < 1 or not readers:
        raise ValueError("need a reader and an attempt")
    failures = []
    for name, read in readers:
        for k in range(attempts):
            try:
                bars = read(symbols)
                spark = bars.sparkSession
                faults = completeness(bars, spark.createDataFrame([(s,) for s in symbols], "symbol string")).collect()
                if not faults:
                    return bars
                failures.append(f"{name} #{k + 1}: " + ", ".join(f"{f.symbol} {f.fault}" for f in faults))
            except Exception as e:  # noqa: BLE001  every failure of a provider is reported
                failures.append(f"{name} #{k + 1}: {e}")
    raise DataUnavailable("; ".join(failures))
