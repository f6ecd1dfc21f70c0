"""A catalogue of data sets from specs: edges, contracts, schema history, search, tags and warnings, in SQLite."""

from __future__ import annotations

import glob
import json
import os
import re
import sqlite3
import time

from pyspark.sql import SparkSession

from tidewright.errors import SpecError
from tidewright.operators import gate
from tidewright.operators.maintain import normal_uri

_TABLES = """
CREATE TABLE IF NOT EXISTS datasets(uri TEXT PRIMARY KEY, description TEXT DEFAULT '', tags TEXT DEFAULT '[]', deprecated TEXT, contract TEXT);
CREATE TABLE IF NOT EXISTS edges(upstream TEXT, downstream TEXT, via TEXT, PRIMARY KEY(upstream, downstream, via));
CREATE TABLE IF NOT EXISTS versions(uri TEXT, at REAL, columns TEXT);
CREATE TABLE IF NOT EXISTS promises(uri TEXT PRIMARY KEY, within REAL, latest REAL);
CREATE INDEX IF NOT EXISTS versions_by_uri ON versions(uri, at);
CREATE VIRTUAL TABLE IF NOT EXISTS found USING fts5(uri UNINDEXED, body, tokenize='trigram');
"""
#: Shorter terms are not in the index of three letters each; they are looked for in what it gives for the others.
_LETTERS = 3


def kind_of(spec: dict) -> str:
    """What a spec describes, by its shape."""
    if "poll" in spec or "stream" in spec:
        return "stream"
    if "destination" in spec:
        return "dispatch"
    if "steps" in spec or "map" in spec:
        return "transform"
    if "source" in spec:
        return "pipeline"
    raise SpecError(f"not a known kind of spec: {sorted(spec)}")


def ends(spec: dict) -> tuple[str, str]:
    kind = kind_of(spec)
    if kind == "transform":
        return normal_uri(spec["input"]), normal_uri(spec["output"])
    source, sink = spec.get("source") or spec.get("stream"), spec.get("sink") or spec.get("destination") or spec.get("output")
    place = lambda x: normal_uri(x if isinstance(x, str) else x.get("path") or x.get("uri") or x.get("url") or x.get("table") or "")
    return place(source), place(sink)


class Catalog:
    def __init__(self, path: str):
        self.con = sqlite3.connect(path, isolation_level=None)
        self.con.executescript(_TABLES)

    def scan(self, folder: str) -> dict:
        """Reads all specs below a folder. Edges of specs that are gone go; scanning again changes nothing."""
        found, bad, uris = set(), [], set()
        self.con.execute("BEGIN")
        for f in sorted(glob.glob(os.path.join(folder, "**", "*.json"), recursive=True) + glob.glob(os.path.join(folder, "**", "*.y*ml"), recursive=True)):
            try:
                text = open(f, encoding="utf-8").read()
                if f.endswith(".json"):
                    spec = json.loads(text)
                else:
                    import yaml

                    spec = yaml.safe_load(text)
                a, b = ends(spec)
            except (SpecError, ValueError, KeyError, AttributeError, TypeError) as e:
                bad.append((f, str(e)))
                continue
            found.add((a, b, os.path.relpath(f, folder)))
            uris |= {a, b}
            for uri in (a, b):
                self.con.execute("INSERT OR IGNORE INTO datasets(uri) VALUES(?)", (uri,))
            if spec.get("contract"):
                self.con.execute("UPDATE datasets SET contract=? WHERE uri=?", (json.dumps(spec["contract"], sort_keys=True), b))
            if spec.get("description"):
                self.con.execute("UPDATE datasets SET description=? WHERE uri=?", (spec["description"], b))
            if spec.get("fresh_within_s"):
                self.con.execute("INSERT INTO promises(uri, within) VALUES(?,?) ON CONFLICT(uri) DO UPDATE SET within=excluded.within", (b, float(spec["fresh_within_s"])))
        self.con.execute("DELETE FROM edges")
        self.con.executemany("INSERT INTO edges VALUES(?,?,?)", sorted(found))
        # what no spec names any more leaves the search; what is known about it stays
        self.con.execute("DELETE FROM found")
        for uri in sorted(uris):
            self._index(uri, new=True)
        self.con.execute("COMMIT")
        return {"specs": len(found), "skipped": bad}

    def _index(self, uri: str, new: bool = False) -> None:
        """Puts what can be searched of a data set into the index, in place of what was there."""
        if not new:
            row = self.con.execute("SELECT rowid FROM found WHERE uri=?", (uri,)).fetchone()
            if row:
                self.con.execute("DELETE FROM found WHERE rowid=?", row)
        description, tags = self.con.execute("SELECT description, tags FROM datasets WHERE uri=?", (uri,)).fetchone()
        row = self.con.execute("SELECT columns FROM versions WHERE uri=? ORDER BY at DESC, rowid DESC LIMIT 1", (uri,)).fetchone()
        columns = " ".join(c["name"] for c in json.loads(row[0])) if row else ""
        self.con.execute("INSERT INTO found(uri, body) VALUES(?,?)", (uri, f"{uri} {description} {tags} {columns}".lower()))

    def edges(self) -> list[tuple[str, str]]:
        return [(a, b) for a, b in self.con.execute("SELECT DISTINCT upstream, downstream FROM edges ORDER BY 1, 2")]

    def observe(self, spark: SparkSession, uri: str) -> dict | None:
        """Records the schema of a Parquet data set if it changed; returns what changed."""
        now = gate.schema_of(spark.read.parquet(uri))
        row = self.con.execute("SELECT columns FROM versions WHERE uri=? ORDER BY at DESC, rowid DESC LIMIT 1", (normal_uri(uri),)).fetchone()
        last = json.loads(row[0]) if row else None
        if now == last:
            return None
        self.con.execute("INSERT INTO versions VALUES(?,?,?)", (normal_uri(uri), time.time(), json.dumps(now)))
        self.con.execute("INSERT OR IGNORE INTO datasets(uri) VALUES(?)", (normal_uri(uri),))
        self._index(normal_uri(uri))
        return gate.drift(last or [], now)

    def tag(self, uri: str, *tags: str, deprecated: str | None = None) -> None:
        row = self.con.execute("SELECT tags FROM datasets WHERE uri=?", (uri,)).fetchone()
        if row is None:
            raise SpecError(f"unknown data set {uri}")
        self.con.execute("UPDATE datasets SET tags=?, deprecated=coalesce(?, deprecated) WHERE uri=?", (json.dumps(sorted({*json.loads(row[0]), *tags})), deprecated, uri))
        self._index(uri)

    def search(self, text: str) -> list[str]:
        """Data sets of which name, description, tags or columns hold every term, by an index of their letters."""
        terms = re.findall(r"\w+", text.lower())
        long, short = [t for t in terms if len(t) >= _LETTERS], [t for t in terms if len(t) < _LETTERS]
        where = ["found MATCH ?"] * bool(long) + ["instr(body, ?) > 0"] * len(short)
        asked = [" AND ".join(f'"{t}"' for t in long)] * bool(long) + short
        sql = "SELECT uri FROM found" + (" WHERE " + " AND ".join(where) if where else "")
        return sorted(r[0] for r in self.con.execute(sql, asked))

    def seen(self, uri: str, latest: float) -> None:
        """Records the time of the latest row or run of a data set."""
        self.con.execute("INSERT INTO promises(uri, latest) VALUES(?,?) ON CONFLICT(uri) DO UPDATE SET latest=excluded.latest", (normal_uri(uri), latest))

    def findings(self, now: float | None = None) -> list[tuple[str, str, str]]:
        """(kind, data set, what) of all that breaks a promise: contracts against the schema last seen, freshness, several writers,
        readers of what is deprecated."""
        now, out = time.time() if now is None else now, []
        for uri, contract in self.con.execute("SELECT uri, contract FROM datasets WHERE contract IS NOT NULL").fetchall():
            row = self.con.execute("SELECT columns FROM versions WHERE uri=? ORDER BY at DESC, rowid DESC LIMIT 1", (uri,)).fetchone()
            if row is None:
                out.append(("contract", uri, "no schema was seen"))
                continue
            have = {c["name"]: c["type"] for c in json.loads(row[0])}
            for name, kind in json.loads(contract).items():
                kind = kind[0] if isinstance(kind, list) else kind
                if name not in have:
                    out.append(("contract", uri, f"{name} is missing"))
                elif have[name] != kind:
                    out.append(("contract", uri, f"{name} is {have[name]}, not {kind}"))
        for uri, within, latest in self.con.execute("SELECT uri, within, latest FROM promises WHERE within IS NOT NULL"):
            if latest is None:
                out.append(("freshness", uri, "unknown"))
            elif now - latest > within:
                out.append(("freshness", uri, f"{now - latest:.0f} s old; {within:.0f} s were promised"))
        return sorted(out + [("lineage", w.split(" ")[0], w) for w in self.warnings()])

    def warnings(self) -> list[str]:
        out = [f"{b} has {n} writers" for b, n in self.con.execute("SELECT downstream, count(DISTINCT via) FROM edges GROUP BY 1 HAVING count(DISTINCT via) > 1 ORDER BY 1")]
        out += [f"{b} reads {a}, which is deprecated: {why}" for a, b, why in self.con.execute("SELECT e.upstream, e.downstream, d.deprecated FROM edges e JOIN datasets d ON d.uri = e.upstream WHERE d.deprecated IS NOT NULL ORDER BY 1, 2")]
        return out
