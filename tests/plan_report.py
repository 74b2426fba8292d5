"""Physical-plan summary of every registered query (for the scale review in PLANS.md).

    python tests/plan_report.py [sf_dir] > PLANS.md

Counts, from ``explain(mode="formatted")`` of the initial adaptive plan: shuffle exchanges,
broadcast exchanges, sort-merge and broadcast-hash joins, windows, bucketed scans, and scans
with pushed filters; and flags cartesian / nested-loop joins. AQE may still turn a sort-merge
join into a broadcast join at run time when a side turns out small.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def summarize(text: str) -> dict:
    tree = text.split("\n\n")[0]
    return {
        "shuffles": len(re.findall(r"(?<![A-Za-z])Exchange \(\d+\)", tree)),
        "broadcasts": len(re.findall(r"BroadcastExchange \(\d+\)", tree)),
        "smj": len(re.findall(r"SortMergeJoin", tree)),
        "bhj": len(re.findall(r"BroadcastHashJoin", tree)),
        "windows": len(re.findall(r"(?<![A-Za-z])Window \(\d+\)", tree)),
        "bucketed_scans": len(re.findall(r"Bucketed: true", text)),
        "pushed_scans": len([m for m in re.findall(r"PushedFilters: \[(.*?)\]", text) if m.strip()]),
        "bad": bool(re.search(r"CartesianProduct|BroadcastNestedLoopJoin", text)),
    }


def main() -> None:
    from mercato.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session(extra={"spark.ui.showConsoleProgress": "false"})
    import __spark_entry__ as entry
    rows = []
    for name, fn in entry.queries().items():
        s = summarize(plan_text(fn(spark, sf)))
        rows.append((name, s))
    print(f"# Plan summary ({os.path.basename(sf)}, Spark {spark.version}, initial adaptive plans)\n")
    print("| query | shuffles | broadcasts | SMJ | BHJ | windows | bucketed scans | scans with pushed filters | cartesian |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- | --- |")
    for name, s in rows:
        print(f"| {name} | {s['shuffles']} | {s['broadcasts']} | {s['smj']} | {s['bhj']} | {s['windows']} | "
              f"{s['bucketed_scans']} | {s['pushed_scans']} | {'YES' if s['bad'] else 'no'} |")
    spark.stop()


if __name__ == "__main__":
    main()
