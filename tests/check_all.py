"""python tests/check_all.py [sf dir] [name part ...]: every registered query against its SQL."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from weekwatch.session import get_session  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark, con = get_session(cores="8"), oracle.connect(sf)
    sqls, failed = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if parts and not any(p == name or (p.endswith("*") and name.startswith(p[:-1])) for p in parts):
            continue
        try:
            problems, n, a, b = oracle.compare(spark, con, name, fn, sqls.get(name), sf)
        except Exception as exc:  # noqa: BLE001
            problems, n, a, b = [f"{type(exc).__name__}: {str(exc)[:700]}"], 0, 0, 0
        mark = "FAIL" if problems else ("rows" if name not in sqls else "ok")
        failed += bool(problems)
        print(f"{mark:5}{name:40}{n:8} rows  spark {a:6.2f}s  sql {b:6.2f}s", flush=True)
        for p in problems:
            print("      ", p[:900], flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
