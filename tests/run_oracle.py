"""Run registered queries against their DuckDB oracle: python tests/run_oracle.py SF_DIR [names...]"""
import os, sys, time
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from harness import duck, compare
import __spark_entry__ as E
from mise.session import get_spark

sf = sys.argv[1]
only = sys.argv[2:]
spark = get_spark("local[8]", 8)
con = duck(sf)
Q, S = E.queries(), E.oracle_sql()
bad = 0
for name in sorted(Q):
    if only and not any(name.startswith(o) for o in only):
        continue
    t = time.time()
    try:
        df = Q[name](spark, sf)
        if name in S:
            p = compare(df, con, S[name])
        else:
            p = []; df.count()
    except Exception as e:
        p = [f"ERROR {type(e).__name__}: {str(e)[:800]}"]
    dt = time.time() - t
    tag = "OK " if not p else "BAD"
    bad += bool(p)
    print(f"{tag} {name:40s} {dt:6.2f}s {'' if name in S else '(no oracle)'}", flush=True)
    for x in p:
        print("    ", x, flush=True)
print("FAILED", bad, "of", len([n for n in Q if not only or any(n.startswith(o) for o in only)]))
