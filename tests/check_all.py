"""Runs registered queries against their SQL checks: ``check_all.py SF_DIR [KEY | conf=value ...]``."""

import sys

sys.path[:0] = [__file__.rsplit("/tests/", 1)[0], __file__.rsplit("/", 1)[0]]

from compare import compare, connect  # noqa: E402

from __spark_entry__ import queries  # noqa: E402
from stewardspark.session import local_session  # noqa: E402

sf = sys.argv[1]
keys = [a for a in sys.argv[2:] if "=" not in a]
conf = dict(a.split("=", 1) for a in sys.argv[2:] if "=" in a)
spark = local_session(8, **conf)
spark.sparkContext.setLogLevel("ERROR")
con = connect(sf)
bad = 0
for key in keys or list(queries()):
    try:
        r = compare(spark, con, key, sf)
    except Exception as e:  # noqa: BLE001
        r = {"key": key, "ok": False, "problems": [str(e)[:1500]], "rows": -1, "sec": -1,
             "checked": True}
    bad += not r["ok"]
    state = "ok" if r["ok"] else "FAIL"
    print(f"{state:4} {key:36} rows={r['rows']:<7} spark={r['sec']}s duck={r.get('duck_sec')} "
          f"{'' if r['checked'] else '(no sql)'}", flush=True)
    for p in r.get("problems", []):
        print("      ", p[:1500], flush=True)
print("failures:", bad)
