"""Run a query and its SQL and compare the results as multisets."""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return ("num", float(value))
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, (int, float)):
        return ("num", float(value)) if isinstance(value, float) else ("int", value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return str(value)


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, sf_dir):
    """None when equal, else a short description of the difference."""
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf_dir)
    mine = rows_of(df.collect(), df.columns)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if mine else "no rows"
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    theirs = rows_of(cur.fetchall(), columns)
    if mine == theirs:
        return None if mine else "no rows on either side"
    extra, missing = list((mine - theirs).items()), list((theirs - mine).items())
    return (f"{sum(mine.values())} vs {sum(theirs.values())} rows; sorted {sorted(columns)}; "
            f"only here {extra[:2]}; only there {missing[:2]}")


def main(sf_dir: str, names: list[str]) -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connection(sf_dir)
    for name in names or entry.queries():
        start = time.time()
        try:
            verdict = compare(spark, con, name, sf_dir)
        except Exception as error:
            verdict = f"{type(error).__name__}: {str(error)[:1500]}"
        kind = "" if name in entry.oracle_sql() else " (rows only)"
        print(f"{'ok  ' if verdict is None else 'FAIL'} {name}{kind} {time.time() - start:.1f}s"
              f" {verdict or ''}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
