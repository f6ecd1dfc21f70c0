"""Run state on the driver: units, cursors, leases with fences, stream checkpoints and batches, in one SQLite file."""

from __future__ import annotations

import contextlib
import hashlib
import json
import sqlite3
import time
from collections.abc import Callable, Iterator

from tidewright.errors import ConflictError

#: What each version of the file adds to the one before; a step is never changed once it was released.
STEPS = {
    1: (
        "CREATE TABLE IF NOT EXISTS units(unit_id TEXT PRIMARY KEY, pipeline TEXT, unit_key TEXT, status TEXT, rows INTEGER, bytes INTEGER, ms INTEGER, error TEXT, attempts INTEGER DEFAULT 0, at REAL)",
        "CREATE TABLE IF NOT EXISTS cursors(pipeline TEXT PRIMARY KEY, value TEXT)",
        "CREATE TABLE IF NOT EXISTS schemas(pipeline TEXT, at REAL, columns TEXT)",
        "CREATE TABLE IF NOT EXISTS lineage(pipeline TEXT, upstream TEXT, downstream TEXT, at REAL)",
        "CREATE TABLE IF NOT EXISTS leases(name TEXT PRIMARY KEY, holder TEXT, fence INTEGER, until REAL)",
        "CREATE TABLE IF NOT EXISTS checkpoints(stream TEXT PRIMARY KEY, position TEXT, generation INTEGER, watermark REAL)",
        "CREATE TABLE IF NOT EXISTS batches(batch_id TEXT PRIMARY KEY, stream TEXT, status TEXT, rows INTEGER, late INTEGER, error TEXT, at REAL)",
        "CREATE TABLE IF NOT EXISTS inputs(plan TEXT, path TEXT, signature TEXT, PRIMARY KEY(plan, path))",
        "CREATE TABLE IF NOT EXISTS meta(key TEXT PRIMARY KEY, value TEXT)",
    ),
    2: (
        "CREATE TABLE submissions(run_id TEXT PRIMARY KEY, manifest TEXT, status TEXT, token TEXT, attempt INTEGER DEFAULT 0, handle TEXT, error TEXT, at REAL)",
        "CREATE INDEX units_by_pipeline ON units(pipeline, status)",
        "CREATE INDEX batches_by_stream ON batches(stream, at)",
    ),
}
VERSION = max(STEPS)


def migrated(con: sqlite3.Connection, path: str, dry_run: bool = False) -> list[int]:
    """Brings a state file to this code's version, step by step, each in a transaction of its own; the steps it took, or would take.
    A file with data is copied beside itself first. A newer file is refused."""
    known = con.execute("SELECT name FROM sqlite_master WHERE type='table' AND name='meta'").fetchone()
    row = con.execute("SELECT value FROM meta WHERE key='version'").fetchone() if known else None
    now = int(row[0]) if row else 0
    if now > VERSION:
        raise ConflictError(f"state has version {now}; this code knows {VERSION}")
    steps = [v for v in sorted(STEPS) if v > now]
    if dry_run or not steps:
        return steps
    if now and path != ":memory:":
        with contextlib.closing(sqlite3.connect(f"{path}.v{now}.bak")) as copy:
            con.backup(copy)
    for v in steps:
        con.execute("BEGIN IMMEDIATE")
        try:
            # another process may have taken the step while this one waited
            row = con.execute("SELECT value FROM meta WHERE key='version'").fetchone() if v > 1 or known else None
            if not row or int(row[0]) < v:
                for statement in STEPS[v]:
                    con.execute(statement)
                con.execute("INSERT OR REPLACE INTO meta VALUES('version', ?)", (str(v),))
        except BaseException:
            con.execute("ROLLBACK")
            raise
        con.execute("COMMIT")
    return steps


def unit_id(pipeline: str, source: str, key: str) -> str:
    return hashlib.sha256("\x1f".join((pipeline, source, key)).encode()).hexdigest()[:16]


class Store:
    def __init__(self, path: str, clock: Callable[[], float] = time.time):
        self.con = sqlite3.connect(path, timeout=30, isolation_level=None)
        self.con.row_factory = sqlite3.Row
        self.clock = clock
        migrated(self.con, path)

    @contextlib.contextmanager
    def transaction(self) -> Iterator[sqlite3.Connection]:
        self.con.execute("BEGIN IMMEDIATE")
        try:
            yield self.con
        except BaseException:
            self.con.execute("ROLLBACK")
            raise
        self.con.execute("COMMIT")

    def meta(self, key: str, value: str | None = None) -> str | None:
        if value is not None:
            self.con.execute("INSERT OR REPLACE INTO meta VALUES(?,?)", (key, value))
        row = self.con.execute("SELECT value FROM meta WHERE key=?", (key,)).fetchone()
        return row and row[0]

    # units
    def begin(self, uid: str, pipeline: str, key: str) -> bool:
        """False if the unit is done already."""
        with self.transaction() as con:
            row = con.execute("SELECT status FROM units WHERE unit_id=?", (uid,)).fetchone()
            if row and row[0] == "done":
                return False
            con.execute("INSERT INTO units(unit_id,pipeline,unit_key,status,attempts,at) VALUES(?,?,?,'running',1,?) ON CONFLICT(unit_id) DO UPDATE SET status='running', attempts=attempts+1, at=excluded.at", (uid, pipeline, key, self.clock()))
            return True

    def finish(self, uid: str, status: str, rows: int = 0, size: int = 0, ms: int = 0, error: str | None = None, cursor: tuple[str, object] | None = None) -> None:
        """Status and cursor change together."""
        with self.transaction() as con:
            con.execute("UPDATE units SET status=?, rows=?, bytes=?, ms=?, error=?, at=? WHERE unit_id=?", (status, rows, size, ms, error, self.clock(), uid))
            if cursor:
                con.execute("INSERT OR REPLACE INTO cursors VALUES(?,?)", (cursor[0], json.dumps(cursor[1])))

    def cursor(self, pipeline: str):
        row = self.con.execute("SELECT value FROM cursors WHERE pipeline=?", (pipeline,)).fetchone()
        return row and json.loads(row[0])

    def loaded(self, uid: str) -> int:
        """Rows that a unit that is done has loaded."""
        row = self.con.execute("SELECT rows FROM units WHERE unit_id=? AND status='done'", (uid,)).fetchone()
        return (row and row[0]) or 0

    def units(self, pipeline: str) -> list[dict]:
        return [dict(r) for r in self.con.execute("SELECT * FROM units WHERE pipeline=? ORDER BY unit_key", (pipeline,))]

    def metrics(self, pipeline: str) -> dict:
        counts = dict(self.con.execute("SELECT status, count(*) FROM units WHERE pipeline=? GROUP BY status", (pipeline,)).fetchall())
        rows, size, ms = self.con.execute("SELECT coalesce(sum(rows),0), coalesce(sum(bytes),0), coalesce(sum(ms),0) FROM units WHERE pipeline=? AND status='done'", (pipeline,)).fetchone()
        edge = self.con.execute("SELECT upstream, downstream FROM lineage WHERE pipeline=? ORDER BY at DESC, rowid DESC LIMIT 1", (pipeline,)).fetchone()
        retries, mean = self.con.execute("SELECT coalesce(sum(attempts - 1),0), avg(CASE WHEN status='done' THEN ms END) FROM units WHERE pipeline=?", (pipeline,)).fetchone()
        return {"counts": counts, "rows": rows, "bytes": size, "ms": ms, "retries": retries, "mean_ms": mean, "edge": tuple(edge) if edge else None}

    def edge(self, pipeline: str, upstream: str, downstream: str) -> None:
        self.con.execute("INSERT INTO lineage VALUES(?,?,?,?)", (pipeline, upstream, downstream, self.clock()))

    def schema(self, pipeline: str, columns: list[dict] | None = None) -> list[dict] | None:
        """The last recorded schema; a new one is added only if it differs."""
        row = self.con.execute("SELECT columns FROM schemas WHERE pipeline=? ORDER BY at DESC, rowid DESC LIMIT 1", (pipeline,)).fetchone()
        last = row and json.loads(row[0])
        if columns is not None and columns != last:
            self.con.execute("INSERT INTO schemas VALUES(?,?,?)", (pipeline, self.clock(), json.dumps(columns)))
        return last

    # leases
    def acquire(self, name: str, holder: str, ttl: float = 60.0) -> int:
        """The fence of the lease; a lease that ran out is taken over with a higher one."""
        with self.transaction() as con:
            row = con.execute("SELECT holder, fence, until FROM leases WHERE name=?", (name,)).fetchone()
            now = self.clock()
            if row and row["holder"] and row["holder"] != holder and row["until"] > now:
                raise ConflictError(f"{name} is held by {row['holder']}")
            fence = (row["fence"] if row else 0) + (not row or row["holder"] != holder or row["until"] <= now)
            con.execute("INSERT OR REPLACE INTO leases VALUES(?,?,?,?)", (name, holder, fence, now + ttl))
            return fence

    def assert_fence(self, name: str, holder: str, fence: int) -> None:
        row = self.con.execute("SELECT holder, fence FROM leases WHERE name=?", (name,)).fetchone()
        if not row or row["holder"] != holder or row["fence"] != fence:
            raise ConflictError(f"the lease on {name} was lost")

    def release(self, name: str, holder: str) -> None:
        self.con.execute("UPDATE leases SET holder='', until=0 WHERE name=? AND holder=?", (name, holder))

    # streams
    def checkpoint(self, stream: str) -> dict:
        row = self.con.execute("SELECT position, generation, watermark FROM checkpoints WHERE stream=?", (stream,)).fetchone()
        return {"position": json.loads(row[0]), "generation": row[1], "watermark": row[2]} if row else {"position": None, "generation": 0, "watermark": None}

    def plan_batch(self, batch_id: str, stream: str) -> bool:
        """False if the batch is committed already."""
        self.con.execute("INSERT OR IGNORE INTO batches(batch_id,stream,status,at) VALUES(?,?,'planned',?)", (batch_id, stream, self.clock()))
        return self.con.execute("SELECT status FROM batches WHERE batch_id=?", (batch_id,)).fetchone()[0] != "committed"

    def fail_batch(self, batch_id: str, error: str) -> None:
        self.con.execute("UPDATE batches SET status='failed', error=? WHERE batch_id=?", (error, batch_id))

    def commit_batch(self, batch_id: str, stream: str, position, watermark: float | None, rows: int, late: int, lease: tuple[str, str, int]) -> None:
        """Ledger and checkpoint move together, and only under the lease's fence."""
        with self.transaction() as con:
            self.assert_fence(*lease)
            con.execute("UPDATE batches SET status='committed', rows=?, late=?, at=?, error=NULL WHERE batch_id=?", (rows, late, self.clock(), batch_id))
            generation = self.checkpoint(stream)["generation"]
            con.execute("INSERT OR REPLACE INTO checkpoints VALUES(?,?,?,?)", (stream, json.dumps(position, sort_keys=True), generation, watermark))

    def reset(self, stream: str, position=None, confirm: bool = False) -> dict:
        """Begins a new generation at ``position``; the ledger stays. Refused while the stream is leased; a dry run unless confirmed."""
        with self.transaction() as con:
            row = con.execute("SELECT holder, until FROM leases WHERE name=?", (stream,)).fetchone()
            if row and row["holder"] and row["until"] > self.clock():
                raise ConflictError(f"{stream} is running")
            now = self.checkpoint(stream)
            after = {"position": position, "generation": now["generation"] + 1, "watermark": None}
            if confirm:
                con.execute("INSERT OR REPLACE INTO checkpoints VALUES(?,?,?,?)", (stream, json.dumps(position), after["generation"], None))
            return after

    def batches(self, stream: str) -> list[dict]:
        return [dict(r) for r in self.con.execute("SELECT * FROM batches WHERE stream=? ORDER BY at, rowid", (stream,))]
