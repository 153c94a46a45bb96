"""List plan features worth a look: cartesian and nested-loop joins, windows
without a partition, exchanges to one partition, Python stages.

usage: python tools/plans.py [--sf DIR] [name-prefix ...]
"""
from __future__ import annotations

import argparse
import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from agree import entry, session  # noqa: E402

MARKS = ["CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas"]


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.001")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = session()
    for name, fn in entry.queries().items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            fn(spark, args.sf).explain()
        text = out.getvalue()
        marks = {m: len(re.findall(m, text)) for m in MARKS}
        found = {m: n for m, n in marks.items() if n}
        if found:
            print(name, found)
    spark.stop()


if __name__ == "__main__":
    main()
