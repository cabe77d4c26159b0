"""Print the formatted physical plan of catalogue queries (plan review).

usage: python tools/explain_plans.py [sf_dir] [name ...]
"""
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fleetlens.plans.catalog import QUERIES  # noqa: E402
from fleetlens.session import get_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:] or ["snapshot_diff", "line_rules", "copied_blocks", "core_edges", "sessions"]
spark = get_session("local[8]", 8)
for name in names:
    df = QUERIES[name](spark, sf)
    df.write.format("noop").mode("overwrite").save()  # final (adaptive) plan
    print(f"===== {name}")
    df.explain("formatted")
