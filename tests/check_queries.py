"""Command line check: ``python tests/check_queries.py FOLDER [name ...]``."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry  # noqa: E402
from compare import connect, differences  # noqa: E402
from plumbline.plans.session import get_session  # noqa: E402

folder, names = sys.argv[1], sys.argv[2:]
spark = get_session(
    master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g", spark__ui__enabled="false"
)
spark.sparkContext.setLogLevel("ERROR")
con = connect(folder)
sql = entry.oracle_sql()
for name, query in entry.queries().items():
    if names and name not in names:
        continue
    began = time.time()
    try:
        result = differences(query(spark, folder), con, sql[name]) if name in sql else [f"rows {query(spark, folder).count()}"]
    except Exception as problem:  # report and go on
        result = [f"{type(problem).__name__}: {str(problem)[:1500]}"]
    print(f"{'ok  ' if not result else 'FAIL'} {name} {time.time() - began:.1f}s", *result, sep="\n     " if result else " ", flush=True)
