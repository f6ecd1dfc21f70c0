"""Commands: lay down a project, run and compile a transform, query, compact, scan a catalogue, walk its lineage, tell the status."""

from __future__ import annotations

import argparse
import glob
import json
import os
import sys
import time

from tidewright.errors import ConflictError, DataError, SpecError


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("tidewright")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="run a transform spec")
    run.add_argument("spec")
    run.add_argument("--state", default=".tidewright.db")
    comp = sub.add_parser("compile", help="print the plan of a transform spec; nothing runs")
    comp.add_argument("spec")
    comp.add_argument("--physical", action="store_true")
    q = sub.add_parser("query", help="run one SELECT over files")
    q.add_argument("sql")
    q.add_argument("--format", choices=["table", "csv", "jsonl"], default="table")
    q.add_argument("--limit", type=int)
    c = sub.add_parser("compact", help="merge small files")
    c.add_argument("path")
    c.add_argument("--target", type=int, default=128 << 20)
    c.add_argument("--dry-run", action="store_true")
    s = sub.add_parser("scan", help="read all specs of a folder into a catalogue")
    s.add_argument("folder")
    s.add_argument("--catalog", default=".tidewright-catalog.db")
    w = sub.add_parser("lineage", help="what a data set feeds, or is fed by")
    w.add_argument("uri")
    w.add_argument("--catalog", default=".tidewright-catalog.db")
    w.add_argument("--direction", choices=["up", "down", "both"], default="down")
    w.add_argument("--depth", type=int)
    i = sub.add_parser("init", help="lay down a project: a folder for specs, one for state, and a first transform")
    i.add_argument("folder")
    t = sub.add_parser("status", help="what pipelines and streams of a state folder have done, as JSON; 1 if one needs attention")
    t.add_argument("state")
    t.add_argument("--stalled-after", type=float, default=3600.0)
    a = p.parse_args(args)
    try:
        return _do(a)
    except (SpecError, DataError, ConflictError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


_FIRST = {"name": "first", "input": "data/in", "output": "data/out", "steps": [{"filter": "true"}]}


def _init(folder: str) -> int:
    """Writes nothing over what is there."""
    for d in ("specs", "state", "data/in"):
        os.makedirs(os.path.join(folder, d), exist_ok=True)
    place = os.path.join(folder, "specs", "first.json")
    try:
        with open(place, "x", encoding="utf-8") as f:
            json.dump(_FIRST, f, indent=2)
    except FileExistsError:
        raise ConflictError(f"{place} is there already") from None
    print(place)
    return 0


def status(folder: str, stalled_after: float, now: float | None = None) -> dict:
    """Pipelines with their units, streams with health and checkpoint, and whether any needs attention."""
    from tidewright.operators.maintain import health
    from tidewright.operators.state import Store

    now, out = time.time() if now is None else now, {"pipelines": {}, "streams": {}, "alert": False}
    for f in sorted(glob.glob(os.path.join(folder, "*.db"))):
        store = Store(f)
        for (name,) in store.con.execute("SELECT DISTINCT pipeline FROM units ORDER BY 1").fetchall():
            found = out["pipelines"][name] = store.metrics(name)
            out["alert"] |= any(found["counts"].get(s) for s in ("failed", "quarantined"))
        for (name,) in store.con.execute("SELECT DISTINCT stream FROM batches ORDER BY 1").fetchall():
            at = store.checkpoint(name)
            exhausted = bool((at["position"] or {}).get("_exhausted"))
            state, why = health(store.batches(name), now, float("inf") if exhausted else stalled_after)
            out["streams"][name] = {"health": state, "why": why, **at}
            out["alert"] |= state not in ("healthy", "unknown")
        store.con.close()
    return out


def _do(a: argparse.Namespace) -> int:
    if a.command == "init":
        return _init(a.folder)
    if a.command == "status":
        found = status(a.state, a.stalled_after)
        print(json.dumps(found, sort_keys=True, default=str))
        return int(found["alert"])
    if a.command in ("scan", "lineage"):
        from tidewright.operators.catalog import Catalog
        from tidewright.operators.maintain import walk

        cat = Catalog(a.catalog)
        if a.command == "scan":
            print(cat.scan(a.folder))
            print("\n".join(cat.warnings()))
        else:
            for uri, far in walk(cat.edges(), a.uri, a.direction, a.depth).items():
                print(far, uri)
        return 0
    from tidewright.plans.ir import load

    if a.command == "compile" and not a.physical:
        plan = load(a.spec)
        print(plan.explain())
        print("placement:", *plan.placement())
        return 0
    from tidewright.session import session

    spark = session()
    if a.command == "compile":
        from tidewright.plans.compile import build
        from tidewright.sources.union import read_parquet

        plan = load(a.spec)
        build(read_parquet(spark, plan.input), plan).explain("formatted")
    elif a.command == "run":
        from tidewright.operators import transform
        from tidewright.operators.state import Store

        print(transform.run(spark, load(a.spec), Store(a.state)))
    elif a.command == "query":
        from tidewright.operators import query

        print(query.rendered(query.run(spark, a.sql), a.format, a.limit))
    elif a.command == "compact":
        from tidewright.operators.maintain import compact

        print(compact(spark, a.path, a.target, dry_run=a.dry_run))
    return 0


if __name__ == "__main__":
    sys.exit(main())
