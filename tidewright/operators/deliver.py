"""Delivery of outbound changes over an injected transport: ``send(action, key, row) -> status code``."""

from __future__ import annotations

import hashlib
import sqlite3
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.errors import DataError
from tidewright.operators import keyed
from tidewright.session import scratch


def dispatch_id(name: str, key: str, content: str) -> str:
    return hashlib.sha256("\x1f".join((name, key, content)).encode()).hexdigest()[:32]


class Ledger:
    """What was delivered: written only after a success."""

    def __init__(self, path: str):
        self.con = sqlite3.connect(path, isolation_level=None)
        self.con.execute("CREATE TABLE IF NOT EXISTS sent(key TEXT PRIMARY KEY, hash TEXT, attempts INTEGER DEFAULT 0, dead INTEGER DEFAULT 0, error TEXT)")

    def frame(self, spark: SparkSession) -> DataFrame:
        """The ledger as a table: written as Parquet by a bounded number of rows at a time, in the folder that is shared."""
        schema, where = "key string, hash string, dead boolean", scratch(spark, "ledger")
        rows = self.con.execute("SELECT key, hash, dead FROM sent WHERE hash IS NOT NULL OR dead = 1")
        spark.createDataFrame([], schema).write.parquet(where)
        while part := rows.fetchmany(200_000):
            spark.createDataFrame([(k, h, bool(d)) for k, h, d in part], schema).coalesce(1).write.mode("append").parquet(where)
        return spark.read.schema(schema).parquet(where)

    def size(self) -> int:
        return self.con.execute("SELECT count(*) FROM sent WHERE hash IS NOT NULL").fetchone()[0]

    def sent(self, key: str, action: str, content: str) -> None:
        if action == "delete":
            self.con.execute("DELETE FROM sent WHERE key=?", (key,))
        else:
            self.con.execute("INSERT INTO sent(key,hash) VALUES(?,?) ON CONFLICT(key) DO UPDATE SET hash=excluded.hash, attempts=0, error=NULL, dead=0", (key, content))

    def failed(self, key: str, error: str, most: int, park: bool) -> None:
        self.con.execute("INSERT INTO sent(key,attempts,error) VALUES(?,1,?) ON CONFLICT(key) DO UPDATE SET attempts=attempts+1, error=excluded.error", (key, error))
        self.con.execute("UPDATE sent SET dead=1 WHERE key=? AND (attempts>=? OR ?)", (key, most, park))

    def revive(self) -> int:
        return self.con.execute("UPDATE sent SET dead=0, attempts=0 WHERE dead=1").rowcount


def deliver(spark: SparkSession, name: str, source: DataFrame, key: str, ledger: Ledger, send: Callable, mode: str = "upsert", attempts: int = 3, park_after: int = 5, most_failures: int = 5, sleep: Callable = time.sleep, first_limit: int = 1000, delete_share: float = 0.5) -> dict:
    """Sends inserts, updates and (mode mirror) deletes. 401 and 403 stop the run, other 4xx park the row at once, 5xx and
    lost connections are tried again with doubling waits; a delete of what is gone is a success."""
    actions = keyed.changes(source, ledger.frame(spark), key, mode).filter("action <> 'unchanged'").persist()
    try:
        keyed.safe_to_send(actions, ledger.size(), first_limit, delete_share)
        rows = actions.join(source.withColumn("_k", source[key].cast("string")), actions["key"] == F.col("_k"), "left").drop("_k")
        done, in_a_row = {"sent": 0, "failed": 0}, 0
        for r in rows.toLocalIterator():
            d = r.asDict(recursive=True)
            k, action, content = d["key"], d["action"], d["hash"]
            body = {c: d[c] for c in source.columns}
            status, wait = 0, 0.5
            for i in range(attempts):
                try:
                    status = send(action, k, body, dispatch_id(name, k, content))
                except ConnectionError as e:
                    status, error = 599, str(e)
                else:
                    error = f"status {status}"
                if status < 500:
                    break
                if i + 1 < attempts:
                    sleep(wait)
                    wait *= 2
            if status in (401, 403):
                raise DataError(f"refused: status {status}")
            if status < 300 or (action == "delete" and status == 404):
                ledger.sent(k, action, content)
                done["sent"] += 1
                in_a_row = 0
                continue
            ledger.failed(k, error, park_after, 400 <= status < 500)
            done["failed"] += 1
            in_a_row += 1
            if in_a_row >= most_failures:
                raise DataError(f"{in_a_row} failures in a row; the last: {error}")
        return done
    finally:
        actions.unpersist()

