"""Idempotent upserts: the last row of each key of a micro-batch replaces the key's row in a table."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from contextlib import closing
from functools import partial
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_per_key(batch: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, by partial aggregation; no sort."""
    rest = [c for c in batch.columns if c != key]
    return batch.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def database_writer(connect: Callable, table: str, mark: str = "?", conflict: str = "ON CONFLICT({key}) DO UPDATE SET {sets}", new: str = "excluded.{0}", rows: int = 1000) -> Callable[[Iterable[tuple], list[str]], None]:
    """Writes rows to a table whose primary key is the first column, ``rows`` at a time and a partition a transaction.

    ``connect()`` runs in the executors and gives any DB-API connection. The defaults are the SQL of SQLite, PostgreSQL and
    DuckDB; MySQL takes ``mark="%s"``, ``conflict="ON DUPLICATE KEY UPDATE {sets}"`` and ``new="VALUES({0})"``.
    """

    def write(it: Iterable[tuple], columns: list[str]) -> None:
        sets = ", ".join(f"{c} = {new.format(c)}" for c in columns[1:])
        sql = f"INSERT INTO {table} ({', '.join(columns)}) VALUES ({', '.join([mark] * len(columns))}) {conflict.format(key=columns[0], sets=sets)}"
        it, db = iter(it), connect()
        try:
            cursor = db.cursor()
            while some := list(islice(it, rows)):
                cursor.executemany(sql, some)
            db.commit()
        finally:
            db.close()

    return write


def sqlite_writer(path: str, table: str) -> Callable[[Iterable[tuple], list[str]], None]:
    """Writes rows to a SQLite file, in a table that is made if it isn't there; the first column is the key."""
    import sqlite3

    upsert = database_writer(partial(sqlite3.connect, path, timeout=60), table)

    def write(rows: Iterable[tuple], columns: list[str]) -> None:
        with closing(sqlite3.connect(path, timeout=60)) as db, db:
            db.execute(f"CREATE TABLE IF NOT EXISTS {table} ({columns[0]} PRIMARY KEY, {', '.join(columns[1:])})")
        upsert(rows, columns)

    return write


def upsert_sink(key: str, order: str, writer: Callable, columns: list[str]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: executors write their partitions through ``writer``; a replay writes the same rows again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = last_per_key(batch, key, order).select(*columns)
        rows.foreachPartition(lambda it: writer((tuple(r) for r in it), columns))

    return write


def write_ahead(folder: str) -> Callable[[DataFrame, int], None]:
    """Append each micro-batch as a whole once it is complete; at least once, and once if replays overwrite ``batch``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return write
