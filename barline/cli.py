"""Run a registered query or pipeline on a folder of tables: ``python -m barline.cli NAME FOLDER [--out PATH]``."""

from __future__ import annotations

import argparse

from barline.plans import registry
from barline.session import session


def main(argv: list[str] | None = None) -> None:
    known = registry.queries()
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("name", choices=sorted(known))
    p.add_argument("folder")
    p.add_argument("--out", help="write Parquet here instead of showing rows")
    p.add_argument("--rows", type=int, default=20)
    a = p.parse_args(argv)
    df = known[a.name](session(a.name), a.folder)
    if a.out:
        df.write.parquet(a.out)
    else:
        df.show(a.rows, truncate=False)


if __name__ == "__main__":
    main()
