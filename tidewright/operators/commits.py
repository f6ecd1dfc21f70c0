"""What a sink can do, what a run has done, and commits of whole tables that are safe to repeat."""

from __future__ import annotations

import contextlib
import json
import os
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from tidewright.errors import ConflictError, SpecError
from tidewright.operators import gate, publish
from tidewright.operators.state import Store
from tidewright.plans.ir import canonical_hash


@dataclass(frozen=True)
class Abilities:
    idempotent_batch_write: bool = False
    atomic_publish: bool = False
    delete_apply: bool = False
    concurrent_writers: bool = False
    input_versioning: bool = False

    def require(self, **needed: bool) -> None:
        if missing := [k for k, v in needed.items() if v and not getattr(self, k)]:
            raise SpecError(f"the sink lacks {missing}")


#: What the sinks here can do.
SINKS = {
    "units": Abilities(idempotent_batch_write=True, atomic_publish=True),
    "versions": Abilities(idempotent_batch_write=True, atomic_publish=True, delete_apply=True),
    "commits": Abilities(idempotent_batch_write=True, atomic_publish=True, delete_apply=True, input_versioning=True),
}


@dataclass(frozen=True)
class Proof:
    run: str
    plan: str
    rows: int
    schema: str
    version: str
    created: float


def fingerprint(files: Iterable[tuple[str, int, int]]) -> str:
    """Of an input's listing (path, size, time)."""
    return canonical_hash(sorted(map(list, files)))


def listing(path: str) -> list[tuple[str, int, int]]:
    out = []
    for d, _, fs in os.walk(path):
        for f in fs:
            if f.endswith(".parquet") and f[:1] not in "._":
                s = os.stat(os.path.join(d, f))
                out.append((os.path.join(d, f), s.st_size, s.st_mtime_ns))
    return sorted(out)


def read_as_planned(spark: SparkSession, path: str, planned: str) -> DataFrame:
    """Refuses an input whose files changed since the plan was made."""
    if fingerprint(listing(path)) != planned:
        raise ConflictError(f"{path} changed since it was planned")
    return spark.read.parquet(path)


def commit(df: DataFrame, path: str, run: str, plan: str, created: float) -> Proof:
    """Replaces the table in one step. The same run again gives its first proof; the same run with another plan, and a run
    older than what is published, are refused."""
    log = os.path.join(path, "_commits")
    os.makedirs(log, exist_ok=True)
    with publish.FileLock(os.path.join(path, "_lock")):
        mine = os.path.join(log, f"{run}.json")
        if os.path.exists(mine):
            with open(mine, encoding="utf-8") as f:
                old = Proof(**json.load(f))
            if old.plan != plan:
                raise ConflictError(f"run {run} was committed for another plan")
            return old
        times = []
        for name in os.listdir(log):
            with open(os.path.join(log, name), encoding="utf-8") as f:
                times.append(json.load(f)["created"])
        if times and created < max(times):
            raise ConflictError(f"run {run} is older than what is published")
        version = publish.publish(df, path)
        proof = Proof(run, plan, df.sparkSession.read.parquet(version).count(), canonical_hash(gate.schema_of(df)), os.path.basename(version), created)
        tmp = f"{mine}.{uuid.uuid4().hex}"
        with open(tmp, "w", encoding="utf-8") as f:
            json.dump(asdict(proof), f)
        os.replace(tmp, mine)
        return proof


@contextlib.contextmanager
def exclusive(stores: dict[str, Store], holder: str, ttl: float = 600.0):
    """Holds the lease of every writer of a data set; refused while one of them has a batch planned."""
    held = []
    try:
        for name in sorted(stores):
            stores[name].acquire(name, holder, ttl)
            held.append(name)
            if any(b["status"] == "planned" for b in stores[name].batches(name)):
                raise ConflictError(f"{name} has a batch that is not committed")
        yield
    finally:
        for name in held:
            stores[name].release(name, holder)


def run_project(stages: dict[str, list]) -> dict:
    """Pipelines, then streams, then transforms; each a (name, callable). The first failure stops what comes after it."""
    done: dict = {"ok": [], "failed": None}
    for kind in ("pipelines", "streams", "transforms", "distributed"):
        for name, action in stages.get(kind, []):
            try:
                action()
            except Exception as e:
                done["failed"] = (kind, name, str(e)[:300])
                return done
            done["ok"].append(f"{kind}:{name}")
    return done
