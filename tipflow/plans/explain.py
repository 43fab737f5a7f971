"""Write the final (post-AQE) physical plan of every registered query to a markdown file.

    python -m tipflow.plans.explain /root/testdata/sf0.01 PLANS.md

Each query is executed once (small test data, so the action is cheap) so the
adaptive plan is final (runtime join choices, coalesced partitions); only the
operator tree is kept.
"""

from __future__ import annotations

import re
import sys

from tipflow.plans.registry import queries
from tipflow.session import build, checkpoint_dir


def plan_tree(df) -> str:
    df.collect()  # runs this DataFrame's own query execution, so the adaptive plan is final
    text = df._jdf.queryExecution().executedPlan().toString()
    lines = []
    for line in text.splitlines():
        if "== Initial Plan ==" in line:  # keep the final plan only
            break
        line = re.sub(r"#\d+L?", "", line)                 # expression ids
        line = re.sub(r"\[plan_id=\d+\]", "", line)
        if len(line) > 160:
            line = line[:157] + "..."
        lines.append(line)
    return "\n".join(lines)


def main(sf_dir: str, out: str) -> None:
    spark = build(partitions=8)
    checkpoint_dir(spark)
    parts = ["# PLANS", "",
             f"Final adaptive physical plans of every registered query on `{sf_dir}` (local mode, 8 shuffle",
             "partitions), written by `python -m tipflow.plans.explain`. Expression ids are removed.", ""]
    for key, fn in sorted(queries().items()):
        parts += [f"## {key}", "", "```", plan_tree(fn(spark, sf_dir)), "```", ""]
    with open(out, "w") as fh:
        fh.write("\n".join(parts))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2] if len(sys.argv) > 2 else "PLANS.md")
