"""python tests/check.py [name-prefix ...]: compare queries with SQL on one scale and print one line each."""

import os
import sys
import traceback
from concurrent.futures import ThreadPoolExecutor

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import __spark_entry__ as entry_module
from harness import compare, connect
from ramplake.config import session

if __name__ == "__main__":
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf), 0
    queries, oracle = entry_module.queries(), entry_module.oracle_sql()
    wanted = [n for n in queries if not sys.argv[1:] or any(n.startswith(p) for p in sys.argv[1:])]
    def one(name):
        try:
            return name, *compare(spark, con.cursor(), queries[name], oracle.get(name), sf)
        except Exception as error:
            if os.environ.get("TRACE"):
                traceback.print_exc()
            return name, "ERROR " + str(error)[:260], 0.0, 0

    with ThreadPoolExecutor(int(os.environ.get("THREADS", "1"))) as pool:
        for name, verdict, took, rows in pool.map(one, wanted):
            bad += verdict not in ("ok", "rows")
            print(f"{name:40s} {took:6.2f}s {rows:7d} {verdict}", flush=True)
    print(f"{len(wanted)} queries, {bad} bad")
