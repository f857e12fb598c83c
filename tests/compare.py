"""Run queries and their SQL side by side; prints what differs. ``python tests/compare.py DIR [NAME...]``"""

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "item"):
        x = x.item()
    return float(round(x, 9)) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in data), key=repr)


def differences(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    other = rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} / {sorted(rel.columns)}", len(mine)
    if mine != other:
        bad = next(((a, b) for a, b in zip(mine, other) if a != b), None)
        return f"{len(mine)} / {len(other)} rows, first difference {str(bad)[:400]}", len(mine)
    return "", len(mine)


if __name__ == "__main__":
    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    qs, sqls, con = entry.queries(), entry.oracle_sql(), connect(sys.argv[1])
    for name in sys.argv[2:] or [n for n in sqls if not n.startswith("op")]:
        t = time.time()
        try:
            said, n = differences(spark, con, qs[name], sqls[name], sys.argv[1])
        except Exception as e:  # the report goes on
            said, n = f"{type(e).__name__}: {str(e)[:300]}", -1
        print(f"{name}: {said or 'equal'} ({n} rows, {time.time() - t:.1f} s)", flush=True)
