"""python tests/run_oracle.py [--large] <folder> [query ...] - compares queries with their SQL.

--large sends the small tables through the paths for hot keys and unbroadcast joins.
"""

import sys
import time
import traceback

sys.path.insert(0, __file__.rsplit("/", 2)[0])

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from careflow.session import get_session  # noqa: E402
from tests import large_paths  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402


def main(folder, names, large=False):
    settings = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    settings["spark.ui.showConsoleProgress"] = "false"
    if large:
        large_paths.force()
        settings["spark.sql.autoBroadcastJoinThreshold"] = "-1"
    spark = get_session(master="local[8]", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(folder), oracle_sql(), []
    for name, fn in queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, folder, fn, sqls[name])
            else:
                problem = None if fn(spark, folder).count() else "no rows"
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
            if names:
                traceback.print_exc()
        print(f"{'ok ' if problem is None else 'BAD'} {time.time() - started:6.2f}s {name} {problem or ''}", flush=True)
        if problem:
            bad.append(name)
    print(f"{len(bad)} bad: {bad}")


if __name__ == "__main__":
    args = [a for a in sys.argv[1:] if a != "--large"]
    main(args[0], set(args[1:]), "--large" in sys.argv)
