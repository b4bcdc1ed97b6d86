"""Print the formatted physical plan of registered queries.

Usage: python -m tonality.plans.explain [--sf DIR] name [name ...]
"""
from __future__ import annotations

import argparse

from tonality.plans import load_all
from tonality.session import get_session


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="+")
    args = ap.parse_args()
    spark = get_session("local[8]")
    reg = load_all()
    for name in args.names:
        print(f"==== {name}: {reg[name].doc.strip().splitlines()[0] if reg[name].doc else ''}")
        reg[name].build(spark, args.sf).explain("formatted")


if __name__ == "__main__":
    main()
