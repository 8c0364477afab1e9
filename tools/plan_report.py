"""Plan census of registered queries: shuffles, join strategies, scans and
notable operators in the physical plan (before AQE re-planning).

Usage: python tools/plan_report.py [sf_dir] [name-prefix ...]
Prints a markdown table.
"""

from __future__ import annotations

import contextlib
import io
import sys

sys.path.insert(0, ".")

from tidemark.registry import QUERIES  # noqa: E402
from tidemark.session import get_session  # noqa: E402

NOTABLE = ["LeftAnti", "LeftSemi", "WindowGroupLimit", "Window", "Expand", "CartesianProduct",
           "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"]


def census(df) -> dict:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("simple")
    p = buf.getvalue()
    notes = [n for n in NOTABLE if n in p]
    if "WindowGroupLimit" in notes and p.count("Window ") <= p.count("WindowGroupLimit"):
        notes.remove("Window")
    return {"shuffles": sum(p.count(f"Exchange {k}") for k in ("hashpartitioning", "rangepartitioning",
                                                                "SinglePartition")),
            "smj": p.count("SortMergeJoin"), "bhj": p.count("BroadcastHashJoin"),
            "scans": p.count("FileScan"), "notes": ", ".join(notes)}


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    prefixes = [a for a in args if not a.startswith("/")]
    spark = get_session("local[8]", 16)
    print("| query | shuffles | sort-merge joins | broadcast joins | scans | notes |")
    print("| --- | --- | --- | --- | --- | --- |")
    for name, fn in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        c = census(fn(spark, sf_dir))
        print(f"| `{name}` | {c['shuffles']} | {c['smj']} | {c['bhj']} | {c['scans']} | {c['notes']} |")


if __name__ == "__main__":
    main()
