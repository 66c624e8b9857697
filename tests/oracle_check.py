"""Run every registered query against its SQL: ``python tests/oracle_check.py SF_DIR [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry_points  # noqa: E402


def normal(value: object) -> object:
    return round(value, 9) if isinstance(value, float) else value


def sorted_rows(rows: list[tuple], order: list[int]) -> list[tuple]:
    return sorted((tuple(normal(row[i]) for i in order) for row in rows), key=repr)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def differences(result: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Empty when names and rows agree, row order aside."""
    relation = con.sql(sql)
    if sorted(result.columns) != sorted(relation.columns):
        return [f"columns {sorted(result.columns)} / {sorted(relation.columns)}"]
    names = sorted(result.columns)
    got = sorted_rows([tuple(r) for r in result.collect()], [result.columns.index(n) for n in names])
    want = sorted_rows(relation.fetchall(), [relation.columns.index(n) for n in names])
    if got == want:
        return [] if got else ["no rows"]
    found = [f"rows {len(got)} / {len(want)}"]
    found += [f"  got  {g!r:.600}\n  want {w!r:.600}" for g, w in zip(got, want, strict=False) if g != w][:2]
    return found


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = entry_points.queries(), entry_points.oracle_sql()
    failed = 0
    for name in names or oracle:
        start = time.time()
        try:
            problems = differences(queries[name](spark, sf_dir), con, oracle[name])
        except Exception as problem:  # keep going: report every query
            problems = [f"{type(problem).__name__}: {str(problem)[:600]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.2f}s", *problems, sep="\n", flush=True)
    print(f"{failed} of {len(names or oracle)} queries differ")
    return failed


if __name__ == "__main__":
    sys.exit(main())
