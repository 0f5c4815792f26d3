"""Print the physical plans of registered queries as markdown.

usage: python tools/explain.py SF_DIR [name ...] > PLANS.md
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

HEADLINE = ["build_dictionary", "vectors", "serving_vectors", "score_writeback", "assign_cluster",
            "lemmatise", "trend_words", "source_filter"]


def main() -> None:
    sf = sys.argv[1]
    names = sys.argv[2:] or HEADLINE
    from polarity.queries import load_all
    from polarity.session import build_session
    spark = build_session()
    q, _ = load_all()
    print(f"# Physical plans ({sf}, before adaptive re-planning)\n")
    print("Generated by `python tools/explain.py`. Scan lines are shortened. Queries that build the "
          "dictionary start from its written id table (the statistics job has already run when the "
          "plan is printed); the shape of that job is pinned in `tests/test_plans.py`.\n")
    for name in names:
        p = q[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        lines = [line if len(line) < 220 else line[:217] + "..." for line in p.splitlines()]
        print(f"## {name}\n\n```\n" + "\n".join(lines) + "\n```\n")


if __name__ == "__main__":
    main()
