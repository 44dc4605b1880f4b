"""Compare every registered query with its SQL: python -m tests.run_compare [sf_dir] [name ...]."""

import sys
import time

import __spark_entry__ as entry
from ledgermill.session import local_session

from .compare import connect, difference


def main(sf_dir="/root/testdata/sf0.01", *names):
    spark = local_session(8)
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if names and not any(n in name for n in names):
            continue
        print(f"@@ {name}", file=sys.stderr, flush=True)
        start = time.perf_counter()
        try:
            df = query(spark, sf_dir)
            if name in oracles:
                problem = difference(df, con, oracles[name])
            else:
                problem = None if df.count() >= 0 else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        took = time.perf_counter() - start
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name:28s} {took:6.2f}s "
              f"{'' if name in oracles else '(rows only) '}{problem or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(*sys.argv[1:])
