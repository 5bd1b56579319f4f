"""Run catalogue queries against DuckDB: ``python tests/check_catalog.py SF_DIR [name ...]``."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from packetlens.plans.all_queries import CATALOG  # noqa: E402
from packetlens.session import local_session  # noqa: E402
from tests.compare import connect, difference  # noqa: E402


def main(sf_dir, wanted):
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, q in CATALOG.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = q.plan(spark, sf_dir)
            if q.sql is None:
                result = f"no sql, {df.count()} rows"
            else:
                result = difference(df, con, q.sql)
        except Exception as e:
            result = f"{type(e).__name__}: {str(e)[:1500]}"
        ok = result is None or result.startswith("no sql")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - start:.1f}s {result or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1], set(sys.argv[2:]))
