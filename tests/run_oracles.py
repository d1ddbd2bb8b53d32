"""CLI: compare registered queries with their oracles at sf0.01.

    python tests/run_oracles.py [name ...]
"""
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import compare, duck  # noqa: E402

from equiscope.plans.registry import load_all  # noqa: E402
from equiscope.session import local_session  # noqa: E402

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def main(names):
    spark = local_session()
    con = duck(SF)
    qs = load_all()
    names = names or list(qs)
    fails = 0
    for n in names:
        q = qs[n]
        t = time.time()
        try:
            df = q.build(spark, SF)
            if q.sql is None:
                cnt = df.count()
                print(f"ROWS  {n}: {cnt} rows ({time.time()-t:.1f}s)")
                continue
            probs = compare(df, con, q.sql)
        except Exception as e:  # report and continue
            probs = [f"{type(e).__name__}: {str(e)[:1500]}"]
        status = "OK  " if not probs else "FAIL"
        fails += bool(probs)
        print(f"{status}  {n} ({time.time()-t:.1f}s)")
        for p in probs:
            print("      " + p)
    print(f"{len(names) - fails}/{len(names)} ok")
    return fails


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
