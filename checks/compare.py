"""Runs queries against their SQL: ``python -m checks.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

from .queries import REGISTRY


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return db


def _cell(value):
    return repr(float(value)) if isinstance(value, float) else value


def rows_of(df: DataFrame) -> list[tuple]:
    names = sorted(df.columns)
    return sorted(
        (tuple(_cell(v) for v in row) for row in df.select(*names).toArrow().to_pandas().itertuples(index=False)),
        key=repr,
    )


def sql_rows(db, sql: str) -> tuple[list[str], list[tuple]]:
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    rows = result.fetchall()
    return [names[i] for i in order], sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark: SparkSession, db, sf_dir: str, name: str) -> tuple[bool, str]:
    q = REGISTRY[name]
    started = time.time()
    df = q.run(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(_cell(r[n]) for n in names) for r in df.collect()), key=repr)
    spark_seconds = time.time() - started
    if q.sql is None:
        return True, f"{len(got)} rows (no SQL), {spark_seconds:.1f} s"
    started = time.time()
    want_names, want = sql_rows(db, q.sql)
    note = f"{len(got)} rows, Spark {spark_seconds:.1f} s, SQL {time.time() - started:.1f} s"
    if names != want_names:
        return False, f"columns {names} != {want_names}"
    if got != want:
        extra, missing = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
        return False, f"{note}; {len(want)} expected\n   only Spark: {extra}\n   only SQL: {missing}"
    return True, note


if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    session = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    connection, failed = tables(sf_dir), []
    for key in sys.argv[2:] or REGISTRY:
        try:
            ok, message = compare(session, connection, sf_dir, key)
        except Exception as exc:  # noqa: BLE001 - report and go on
            ok, message = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        failed += [] if ok else [key]
        print("ok  " if ok else "FAIL", key, message, flush=True)
    print(f"{len(failed)} failed: {failed}")
