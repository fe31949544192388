"""Compare every query with its SQL counterpart: names, rows and values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')"
        )
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value + 0.0:.6f}")
    return value


def rows_by_name(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    table = [tuple(plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(table, key=lambda r: tuple(map(str, r)))


def spark_result(df):
    return rows_by_name(df.columns, [tuple(r) for r in df.collect()])


def oracle_result(connection, sql):
    cursor = connection.execute(sql)
    return rows_by_name([d[0] for d in cursor.description], cursor.fetchall())


def kinds(table):
    """Types of the values per column, nulls aside."""
    return [{type(v).__name__ for v in column if v is not None} for column in zip(*table)]


def difference(ours, theirs) -> str | None:
    if ours[0] != theirs[0]:
        return f"columns {sorted(set(ours[0]) ^ set(theirs[0]))[:6]}"
    if len(ours[1]) != len(theirs[1]):
        return f"rows {len(ours[1])} != {len(theirs[1])}"
    for mine, other in zip(ours[1], theirs[1]):
        if mine != other:
            cells = [(n, a, b) for n, a, b in zip(ours[0], mine, other) if a != b]
            return f"values {cells[:4]} in {mine[:3]}"
    for name, mine, other in zip(ours[0], kinds(ours[1]), kinds(theirs[1])):
        if mine != other:
            return f"types of {name}: {mine} != {other}"
    return None


def main() -> None:
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from phasewise.session import build_session

    sf_dir = sys.argv[1]
    chosen = sys.argv[2:]
    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("OFF")
    oracles = entry.oracle_sql()
    connection = connect(sf_dir)
    for name, run in entry.queries().items():
        if chosen and name not in chosen:
            continue
        begin = time.time()
        try:
            ours = spark_result(run(spark, sf_dir))
        except Exception as error:
            print(f"ERROR {name}: {str(error)[:600]}", flush=True)
            continue
        seconds = time.time() - begin
        if name not in oracles:
            print(f"rows  {name} {len(ours[1])} {seconds:.1f}s {ours[1][:1]}", flush=True)
            continue
        try:
            problem = difference(ours, oracle_result(connection, oracles[name]))
        except Exception as error:
            problem = f"oracle error {str(error)[:600]}"
        print(f"{'ok   ' if problem is None else 'DIFF '} {name} {len(ours[1])} {seconds:.1f}s {problem or ''}", flush=True)


if __name__ == "__main__":
    main()
