"""Command line: check registered queries against their SQL. Usage: check_queries.py [sf_dir] [name part]..."""

import logging
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry  # noqa: E402
from citescope.session import build_session  # noqa: E402
from oracle import compare, connect  # noqa: E402


def main() -> None:
    logging.disable(logging.CRITICAL)
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, function in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in sqls:
                problems = compare(spark, con, function, sqls[name], sf_dir)
                state = "ok" if not problems else "DIFF"
            else:
                n = len(function(spark, sf_dir).collect())
                problems, state = ([] if n else ["no rows"]), f"rows={n}"
        except Exception as error:  # noqa: BLE001
            problems, state = [str(error)[:400]], "FAIL"
        bad += bool(problems)
        print(f"{state:8} {time.time() - start:6.2f}s {name}", flush=True)
        for p in problems:
            print("         ", p[:700], flush=True)
    print(f"{bad} with problems")


main()
