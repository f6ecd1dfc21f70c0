"""Upkeep of directories, task graphs, lineage, freshness and health: metadata on the driver, rows in Spark."""

from __future__ import annotations

import json
import os
import re
import shutil
import time
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.errors import SpecError
from tidewright.sources.union import read_parquet


def compaction_plan(path: str, target: int, least: int = 2, most: int | None = None) -> list[str]:
    """Files smaller than ``target``; none if they are fewer than ``least`` or too much in all."""
    small = sorted(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet") and not f.startswith(("_", ".")) and os.path.getsize(os.path.join(d, f)) < target)
    total = sum(map(os.path.getsize, small))
    return small if len(small) >= least and (most is None or total <= most) else []


def _compacted(spark: SparkSession, files: list[str], to: str, target: int) -> int:
    """Writes the files of one folder anew; returns their rows. Their columns are checked against what was written."""
    df = read_parquet(spark, os.path.dirname(files[0]), files)
    df.coalesce(max(1, -(-sum(map(os.path.getsize, files)) // target))).write.mode("append").option("compression", "zstd").parquet(to)
    got = spark.read.schema(df.schema).parquet(to)
    written = spark.read.parquet(to).schema
    if [(f.name, f.dataType) for f in written] != [(f.name, f.dataType) for f in df.schema]:
        raise RuntimeError(f"compaction changed columns: {written.simpleString()}")
    rows = df.count()
    if got.count() != rows:
        raise RuntimeError("compaction lost rows")
    return rows


def compact(spark: SparkSession, path: str, target: int = 128 << 20, least: int = 2, most: int | None = None, dry_run: bool = False) -> dict:
    """Small files become files of about ``target`` bytes, folder by folder, so that folders ``k=v`` keep their rows; the others
    stay, linked where the file system can. The old directory comes back if a step fails."""
    files = compaction_plan(path, target, least, most)
    size = sum(map(os.path.getsize, files))
    done = {"files": len(files), "bytes": size, "dry_run": dry_run}
    if not files or dry_run:
        return done
    path = path.rstrip("/")
    new, old = f"{path}.new-{uuid.uuid4().hex[:8]}", f"{path}.old-{uuid.uuid4().hex[:8]}"
    folders: dict[str, list[str]] = defaultdict(list)
    for f in files:
        folders[os.path.dirname(f)].append(f)
    gone = set(files)
    try:
        with ThreadPoolExecutor(8) as pool:
            before = sum(pool.map(lambda d: _compacted(spark, folders[d], os.path.normpath(os.path.join(new, os.path.relpath(d, path))), target), folders))
        for d, _, fs in os.walk(path):
            for f in fs:
                full = os.path.join(d, f)
                if f.endswith(".parquet") and full not in gone:
                    to = os.path.join(new, os.path.relpath(full, path))
                    os.makedirs(os.path.dirname(to), exist_ok=True)
                    try:
                        os.link(full, to)
                    except OSError:
                        shutil.copy2(full, to)
    except BaseException:
        shutil.rmtree(new, ignore_errors=True)
        raise
    os.replace(path, old)
    try:
        os.replace(new, path)
    except OSError:
        os.replace(old, path)
        raise
    shutil.rmtree(old)
    with open(f"{path}.compaction.jsonl", "a", encoding="utf-8") as f:
        f.write(json.dumps(done | {"rows": before, "at": time.time()}) + "\n")
    return done


class Backfill:
    """A copy is changed and checked aside; nothing is seen until it is promoted."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.stage, self.ready = spark, path.rstrip("/"), f"{path.rstrip('/')}.backfill", False

    def run(self, change: Callable[[DataFrame], DataFrame]) -> int:
        shutil.rmtree(self.stage, ignore_errors=True)
        folders = [d.split("=")[0] for d in self._folders()]
        change(read_parquet(self.spark, self.path)).write.partitionBy(*folders).option("compression", "zstd").parquet(self.stage)
        self.ready = True
        return self.spark.read.parquet(self.stage).count()

    def _folders(self) -> list[str]:
        """The folders ``k=v`` above the first file, outermost first."""
        first = next((d for d, _, fs in sorted(os.walk(self.path)) if any(f.endswith(".parquet") for f in fs)), self.path)
        return [x for x in os.path.relpath(first, self.path).split(os.sep) if "=" in x]

    def promote(self) -> None:
        if not self.ready:
            raise SpecError("nothing is ready")
        old = f"{self.path}.old-{uuid.uuid4().hex[:8]}"
        os.replace(self.path, old)
        try:
            os.replace(self.stage, self.path)
        except OSError:
            os.replace(old, self.path)
            raise
        shutil.rmtree(old)


# task graphs
def ordered(tasks: dict[str, dict]) -> list[str]:
    """Names so that all come after what they need; then by priority (low first) and name."""
    for n, spec in tasks.items():
        if unknown := set(spec.get("needs", [])) - set(tasks):
            raise SpecError(f"{n} needs unknown tasks {sorted(unknown)}")
    left, out = dict(tasks), []
    while left:
        free = [n for n, s in left.items() if not set(s.get("needs", [])) & set(left)]
        if not free:
            raise SpecError(f"a cycle among {sorted(left)}")
        n = min(free, key=lambda n: (left[n].get("priority", 0), n))
        out.append(n)
        del left[n]
    return out


def runnable(tasks: dict[str, dict], done: set[str], signals: set[str], hour: float) -> list[str]:
    """Tasks whose needs are done, whose signals are there, and whose window [start, end) holds the hour."""
    out = []
    for n in ordered(tasks):
        s = tasks[n]
        start, end = s.get("window", (0, 24))
        inside = start <= hour < end if start <= end else hour >= start or hour < end
        if n not in done and set(s.get("needs", [])) <= done and set(s.get("signals", [])) <= signals and inside:
            out.append(n)
    return out


# lineage
def walk(edges: Iterable[tuple[str, str]], start: str, direction: str = "down", depth: int | None = None) -> dict[str, int]:
    """Nodes reached from ``start`` and how far they are."""
    nxt: dict[str, set[str]] = {}
    for a, b in edges:
        if direction in ("down", "both"):
            nxt.setdefault(a, set()).add(b)
        if direction in ("up", "both"):
            nxt.setdefault(b, set()).add(a)
    seen, front, far = {start: 0}, [start], 0
    while front and (depth is None or far < depth):
        far += 1
        front = sorted({m for n in front for m in nxt.get(n, ()) if m not in seen})
        seen |= dict.fromkeys(front, far)
    del seen[start]
    return seen


def cycles(edges: Iterable[tuple[str, str]]) -> list[list[str]]:
    """Groups of nodes that reach each other, single nodes with an edge to themselves included. One pass in depth, in time of nodes
    and edges: a node is the head of a group if nothing below it leads further up than itself."""
    nxt: dict[str, list[str]] = {}
    for a, b in sorted(set(edges)):
        nxt.setdefault(a, []).append(b)
        nxt.setdefault(b, [])
    number, low, place, path, on_path, out = {}, {}, {}, [], set(), []
    for root in nxt:
        if root in number:
            continue
        todo = [(root, iter(nxt[root]))]
        number[root] = low[root] = len(number)
        place[root] = len(path)
        path.append(root)
        on_path.add(root)
        while todo:
            node, rest = todo[-1]
            step = next(rest, None)
            if step is not None:
                if step not in number:
                    number[step] = low[step] = len(number)
                    place[step] = len(path)
                    path.append(step)
                    on_path.add(step)
                    todo.append((step, iter(nxt[step])))
                elif step in on_path:
                    low[node] = min(low[node], number[step])
                continue
            todo.pop()
            if todo:
                low[todo[-1][0]] = min(low[todo[-1][0]], low[node])
            if low[node] == number[node]:
                group = path[place[node] :]
                del path[place[node] :]
                on_path.difference_update(group)
                if len(group) > 1 or node in nxt[node]:
                    out.append(sorted(group))
    return sorted(out)


def mermaid(edges: Iterable[tuple[str, str]]) -> str:
    nodes = {n: f"n{i}" for i, n in enumerate(sorted({n for e in edges for n in e}))}
    return "\n".join(["graph LR", *(f'    {i}["{n}"]' for n, i in nodes.items()), *(f"    {nodes[a]} --> {nodes[b]}" for a, b in sorted(set(edges)))])


def normal_uri(uri: str) -> str:
    """Without credentials, query, fragment and glob parts."""
    uri = re.sub(r"[?#].*$", "", re.sub(r"//[^/@]*@", "//", uri))
    parts = uri.split("/")
    for i, p in enumerate(parts):
        if any(c in p for c in "*?["):
            parts = parts[:i]
            break
    return "/".join(parts).rstrip("/")


def redacted(text: str) -> str:
    """Passwords in URLs and secret-looking values masked."""
    text = re.sub(r"(://[^:/@\s]*):[^@/\s]*@", r"\1:***@", text)
    return re.sub(r"(?i)\b(password|passwd|pwd|token|secret|api_?key|access_key)(=)[^&\s;]+", r"\1\2***", text)


# freshness and health
def freshness(latest: datetime | None, within: timedelta, now: datetime | None = None) -> str:
    if latest is None:
        return "unknown"
    now = now or datetime.now(timezone.utc)
    return "fresh" if now - latest <= within else "stale"


def latest(df: DataFrame, field: str):
    return df.agg(F.max(field)).first()[0]


_RANK = ["healthy", "unknown", "lagging", "stalled", "failing"]


def health(batches: list[dict], now: float, stalled_after: float, lag: float | None = None, most_lag: float | None = None) -> tuple[str, list[str]]:
    """The worst of failing, stalled, lagging, unknown and healthy, with reasons."""
    found = []
    if not batches:
        found.append(("unknown", "no batches yet"))
    else:
        if batches[-1]["status"] == "failed":
            found.append(("failing", str(batches[-1].get("error"))))
        if now - batches[-1]["at"] > stalled_after:
            found.append(("stalled", f"no batch for {now - batches[-1]['at']:.0f} s"))
        if lag is not None and most_lag is not None and lag > most_lag:
            found.append(("lagging", f"{lag:.0f} s behind"))
    return (max((s for s, _ in found), key=_RANK.index, default="healthy"), [r for _, r in found])
