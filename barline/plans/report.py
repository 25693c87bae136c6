"""Text tables of results, provenance of a run, and settings derived for an experiment."""

from __future__ import annotations

import platform
import subprocess
from dataclasses import replace
from importlib import metadata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.config import Research, Settings


def results_table(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One text line for each result row; missing values read ``n/a``."""
    cells = [F.rpad(F.col(k).cast("string"), 16, " ") for k in keys]
    cells += [F.lpad(F.when(F.col(v).isNull(), "n/a").otherwise(F.format_string("%.6f", F.col(v).cast("double"))), 14, " ") for v in values]
    return rows.select(F.rtrim(F.concat(*cells)).alias("line"))


def library_versions(names: tuple[str, ...] = ("pyspark", "numpy", "pandas", "pyarrow")) -> dict[str, str]:
    out = {"python": platform.python_version()}
    for n in names:
        try:
            out[n] = metadata.version(n)
        except metadata.PackageNotFoundError:
            out[n] = "absent"
    return out


def git_commit(folder: str = ".") -> str:
    """Commit of the working tree; an error outside a repository."""
    return subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True, check=True).stdout.strip()


def for_horizon(settings: Settings, horizon: int, symbols: tuple[str, ...] | None = None) -> Settings:
    """The same settings with another horizon, its embargo, and if given another universe."""
    research: Research = replace(settings.research, horizon=horizon, embargo=horizon)
    return replace(settings, research=research, symbols=settings.symbols if symbols is None else tuple(symbols))
