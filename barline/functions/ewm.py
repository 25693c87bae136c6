"""Exponentially weighted mean and deviation as window sums, for series of any length.

With q = 1 - alpha the recursive mean is a sum of c_i x_i q**(k - i), c_0 = 1 and c_i = alpha.
Bars are cut into blocks of N = 45 / alpha, alpha being the least of the columns that are made
together: the value at k is the running sum of its own block, scaled from the block's start, plus
the whole previous block; what lies before weighs less than q**N, about 3e-20.  Columns share their
blocks, and so one sort, as long as scaled terms stay below e**LIMIT.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.windows import cum


@dataclass(frozen=True)
class Ewm:
    """One output column.  NULLs of ``source`` are allowed at the start of a symbol only; after a NaN all is NaN."""

    name: str
    source: str
    alpha: float
    min_periods: int
    std: bool = False

    @staticmethod
    def span(name: str, source: str, span: int, min_periods: int, std: bool = False) -> Ewm:
        return Ewm(name, source, 2.0 / (span + 1), min_periods, std)

    @staticmethod
    def wilder(name: str, source: str, period: int) -> Ewm:
        return Ewm(name, source, 1.0 / period, period)


LIMIT = 300.0


def _block(specs: list[Ewm]) -> int:
    return math.ceil(45.0 / min(s.alpha for s in specs))


def _shared(specs: list[Ewm]) -> list[list[Ewm]]:
    """Specs whose blocks may have one length: what the fastest forgets in it stays in range."""
    out: list[list[Ewm]] = []
    for s in sorted(specs, key=lambda s: s.alpha):
        if out and -_block([*out[-1], s]) * math.log(1.0 - s.alpha) <= LIMIT:
            out[-1].append(s)
        else:
            out.append([s])
    return out


def with_ewm(df: DataFrame, specs: list[Ewm]) -> DataFrame:
    """``df`` with the columns of ``specs``; all windows share the partitioning by symbol."""
    keep = df.columns
    index = {s.source: f"__k_{s.source}" for s in specs}
    # NULLs stand at the start only: the bar's number differs from the observation's by a constant
    counts = {k: F.when(F.col(c).isNotNull(), F.count(c).over(cum()) - 1) for c, k in index.items()}
    # a NaN stays for ever, in the blocks it would be gone after two
    spoilt = {f"__nan_{c}": F.max(F.isnan(c)).over(cum()) for c in index}
    df = df.withColumns({**counts, **spoilt, "__row": F.count(F.lit(1)).over(cum()) - 1})
    terms, sums, out = {}, {}, {}
    for g, group in enumerate(_shared(specs)):
        n, block = _block(group), f"__b{g}"
        terms[block] = F.floor(F.col("__row") / n)
        rest = (F.col("__row") - F.floor(F.col("__row") / n) * n).cast("double")
        own = Window.partitionBy("symbol", block).orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0)
        before = Window.partitionBy("symbol").orderBy(block).rangeBetween(-1, -1)
        for s in group:
            q, k = 1.0 - s.alpha, F.col(index[s.source])
            weight = F.when(k == 0, 1.0).otherwise(s.alpha) * F.pow(F.lit(q), -rest)
            for p in (1, 2) if s.std else (1,):
                x = f"__x_{s.name}_{p}"
                terms[x] = weight * F.pow(F.col(s.source), F.lit(float(p)))
                sums[f"__m_{s.name}_{p}"] = F.pow(F.lit(q), rest) * (F.sum(x).over(own) + F.coalesce(F.sum(x).over(before), F.lit(0.0)) * (q**n))
            mean = F.col(f"__m_{s.name}_1")
            value = mean
            if s.std:
                w2 = F.pow(F.lit(q), 2.0 * k)
                squares = w2 + s.alpha**2 * (1.0 - w2) / (1.0 - q * q)
                # the denominator is 0 at the first observation only
                value = F.sqrt(F.try_divide(F.greatest(F.col(f"__m_{s.name}_2") - mean * mean, F.lit(0.0)), 1.0 - squares))
                value = F.when(k > 0, value)
            out[s.name] = F.when(k >= s.min_periods - 1, F.when(F.col(f"__nan_{s.source}"), float("nan")).otherwise(value))
    return df.withColumns(terms).withColumns(sums).withColumns(out).select(*keep, *[s.name for s in specs])
