"""Compare Spark results with the SQL counterparts: ``python -m checks.compare <folder> [query ...]``."""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

from checks.oracles import ORACLES
from checks.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

TYPES = {
    "VARCHAR": ("string",),
    "BIGINT": ("bigint",),
    "INTEGER": ("int",),
    "BOOLEAN": ("boolean",),
    "DOUBLE": ("double",),
    "TIMESTAMP": ("timestamp_ntz", "timestamp"),
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def difference(spark, connection, folder: str, name: str) -> str | None:
    """What differs, or None; columns are taken by name, rows in any order."""
    frame = QUERIES[name](spark, folder)
    columns = sorted(frame.columns)
    mine = Counter(tuple(r) for r in frame.select(*columns).collect())
    result = connection.execute(ORACLES[name])
    theirs_columns = [d[0] for d in result.description]
    if sorted(theirs_columns) != columns:
        return f"columns {columns} / {sorted(theirs_columns)}"
    order = [theirs_columns.index(c) for c in columns]
    types = {f.name: f.dataType.simpleString() for f in frame.schema}
    for column, theirs_type in ((d[0], str(d[1])) for d in result.description):
        if types[column] not in TYPES.get(theirs_type, (theirs_type,)):
            return f"type of {column}: {types[column]} / {theirs_type}"
    theirs = Counter(tuple(r[i] for i in order) for r in result.fetchall())
    if mine == theirs:
        return None
    only_mine, only_theirs = mine - theirs, theirs - mine
    return (
        f"{sum(mine.values())} / {sum(theirs.values())} rows over {columns}; only Spark "
        f"{sum(only_mine.values())}: {list(only_mine)[:2]}; only SQL {sum(only_theirs.values())}: {list(only_theirs)[:2]}"
    )


def main() -> None:
    from fleetwright.session import local_session

    folder, *names = sys.argv[1:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    for name in names or QUERIES:
        if name not in ORACLES:
            print(f"{name}: no SQL")
            continue
        started = time.time()
        try:
            problem = difference(spark, connection, folder, name)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{name}: {problem or 'ok'} ({time.time() - started:.1f} s)", flush=True)


if __name__ == "__main__":
    main()
