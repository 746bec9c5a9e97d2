"""Run every registered query against its twin: ``python tests/check_all.py [sf_dir] [name …]``."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle import connect, duck_result, spark_result  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


def main(sf_dir: str, names: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, twins, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            cols, rows = spark_result(fn(spark, sf_dir))
            verdict = f"{len(rows)} rows"
            if name in twins:
                dcols, drows = duck_result(con, twins[name])
                same = cols == dcols and rows == drows
                verdict += " ok" if same else " DIFFERENT"
                bad += not same
                if not same:
                    print(cols, dcols, len(drows))
                    print([r for r in rows if r not in set(drows)][:3])
                    print([r for r in drows if r not in set(rows)][:3])
            else:
                verdict += " (no twin)"
        except Exception as exc:  # report and go on
            bad += 1
            verdict = f"FAILED {type(exc).__name__}: {str(exc)[:600]}"
        print(f"{name:32s} {time.time() - start:6.2f}s  {verdict}", flush=True)
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    sys.exit(main(args[0] if args else "/root/testdata/sf0.01", args[1:]))
