"""Summarise the physical plans of registered queries: exchanges, broadcasts,
join strategies, windows, partial group limits, Python operators, pushed and
partition filters. A quick check that a change kept the plan shape.

    python tools/plan_summary.py [--sf /root/testdata/sf0.1] [name-substring ...]
"""

from __future__ import annotations

import argparse
import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

PATTERNS = {
    "exchanges": r"Exchange (hash|range|single|round)",
    "broadcasts": r"BroadcastExchange",
    "smj": r"SortMergeJoin",
    "bhj": r"BroadcastHashJoin",
    "windows": r"\bWindow \[",
    "group_limits": r"WindowGroupLimit",
    "python": r"ArrowEvalPython|MapInPandas|BatchEvalPython|FlatMapGroupsInPandas",
}


def summarise(df) -> dict:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    plan = buf.getvalue()
    out = {k: len(re.findall(p, plan)) for k, p in PATTERNS.items()}
    out["pushed"] = [x for x in re.findall(r"PushedFilters: \[([^\]]*)\]", plan) if x]
    out["partition_filters"] = [x for x in re.findall(r"PartitionFilters: \[([^\]]*)\]", plan) if x]
    return out


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    from tidemark.session import get_session
    spark = get_session("local[8]", app="tidemark-plans", shuffle_partitions=16)
    import suite
    suite.load_all()
    for name in sorted(suite.QUERIES):
        if args.names and not any(n in name for n in args.names):
            continue
        try:
            s = summarise(suite.QUERIES[name](spark, args.sf))
            print(name, {k: v for k, v in s.items() if v}, flush=True)
        except Exception as e:  # a query that needs an action to build its plan
            print(name, "error:", type(e).__name__, str(e)[:200], flush=True)


if __name__ == "__main__":
    main()
