"""python -m corpusloom list | run QUERY SF_DIR [OUT]: lists the catalogue, or runs a query and shows or writes its rows."""

from __future__ import annotations

import sys

from corpusloom.plans.catalogue import ORACLE, QUERIES
from corpusloom.session import session


def main(args: list[str]) -> int:
    if args[:1] == ["list"]:
        print("\n".join(f"{n}{'' if n in ORACLE else '  (no SQL)'}" for n in sorted(QUERIES)))
        return 0
    if args[:1] == ["run"] and len(args) in (3, 4) and args[1] in QUERIES:
        df = QUERIES[args[1]](session(), args[2])
        df.write.parquet(args[3]) if len(args) == 4 else df.show(50, truncate=80)
        return 0
    print(__doc__)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
