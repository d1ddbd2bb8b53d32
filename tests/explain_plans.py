"""CLI: print the formatted physical plan of registered queries.

    python tests/explain_plans.py [name ...]      (default: the bench's headline queries)

Queries that materialise intermediate results while they are built (exact
quantiles, prefix sums, checkpoints) run those steps first; the plan printed
is the one of the returned DataFrame. ``ORACLE_SF_DIR`` picks the data.
"""
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402

from equiscope.plans.registry import load_all  # noqa: E402
from equiscope.session import local_session  # noqa: E402

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def main(names):
    spark = local_session()
    qs = load_all()
    for n in names or list(HEADLINE.values()):
        print(f"===== {n} =====", flush=True)
        qs[n].build(spark, SF).explain("formatted")


if __name__ == "__main__":
    main(sys.argv[1:])
