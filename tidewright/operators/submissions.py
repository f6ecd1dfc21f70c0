"""Runs on another cluster whose records survive the driver: a run is written down before it is submitted, under a token the
cluster is given with it, so that a driver which dies in between finds out afterwards what became of it.

``submit(manifest, token)`` gives a handle, ``probe(token)`` a handle, ``ABSENT`` where the cluster is sure that it never took the
token, or None where it cannot tell; ``state(handle)`` gives one of ``STATES``; ``cancel(handle)`` ends a run."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from tidewright.errors import ConflictError, SpecError
from tidewright.operators.state import Store
from tidewright.plans.ir import canonical_hash

ABSENT = "absent"
STATES = ("running", "succeeded", "failed", "cancelled")


@dataclass
class Submissions:
    store: Store
    submit: Callable[[dict, str], str]
    probe: Callable[[str], str | None]
    state: Callable[[str], str]
    cancel_at: Callable[[str], None] = lambda _: None
    holder: str = "driver"
    after: Callable[[str], None] = lambda _: None

    def start(self, run: str, manifest: dict) -> dict:
        """Submits a run once. The same run with the same manifest goes on from where it stands; with another one it is refused."""
        fence = self.store.acquire(f"run:{run}", self.holder)
        try:
            body = json.dumps({"hash": canonical_hash(manifest), "manifest": manifest}, sort_keys=True)
            row = self._row(run)
            if row is None:
                self.store.con.execute("INSERT INTO submissions(run_id, manifest, status, at) VALUES(?,?,'planned',?)", (run, body, self.store.clock()))
            elif row["manifest"] != body:
                raise ConflictError(f"run {run} was written down with another manifest")
            self.after("planned")
            return self._forward(run, fence)
        finally:
            self.store.release(f"run:{run}", self.holder)

    def reconcile(self, run: str) -> dict:
        """What became of a run: one that may have been submitted is asked for by its token, and submitted again only where the
        cluster is sure that it was not."""
        fence = self.store.acquire(f"run:{run}", self.holder)
        try:
            if self._row(run) is None:
                raise SpecError(f"unknown run {run}")
            return self._forward(run, fence)
        finally:
            self.store.release(f"run:{run}", self.holder)

    def cancel(self, run: str) -> dict:
        """Ends a run; one that was never submitted is only marked."""
        row = self.reconcile(run) if self._row(run) and self._row(run)["status"] == "submitting" else self._row(run)
        if row is None:
            raise SpecError(f"unknown run {run}")
        if row["handle"] and row["status"] not in STATES[1:]:
            self.cancel_at(row["handle"])
        if row["status"] in ("planned", "submitted", "running"):
            self._put(run, status="cancelled")
        return self._row(run)

    def _forward(self, run: str, fence: int) -> dict:
        row = self._row(run)
        if row["status"] == "submitting":
            found = self.probe(row["token"])
            if found is None:
                return row  # it may run: nothing is done until the cluster can tell
            if found != ABSENT:
                self._put(run, status="submitted", handle=found)
            else:
                self._put(run, status="planned")
            row = self._row(run)
        if row["status"] == "planned":
            token = f"{run}-{row['attempt'] + 1}-{uuid.uuid4().hex[:8]}"
            self.store.assert_fence(f"run:{run}", self.holder, fence)
            self._put(run, status="submitting", token=token, attempt=row["attempt"] + 1)
            self.after("submitting")
            handle = self.submit(json.loads(row["manifest"])["manifest"], token)
            self.after("submitted")
            self._put(run, status="submitted", handle=handle)
        elif row["status"] in ("submitted", "running"):
            now = self.state(row["handle"])
            if now not in STATES:
                raise SpecError(f"unknown state {now}")
            self._put(run, status=now)
        return self._row(run)

    def _row(self, run: str) -> dict | None:
        row = self.store.con.execute("SELECT * FROM submissions WHERE run_id=?", (run,)).fetchone()
        return row and dict(row)

    def _put(self, run: str, **values) -> None:
        self.store.con.execute(f"UPDATE submissions SET {', '.join(f'{k}=?' for k in values)}, at=? WHERE run_id=?", (*values.values(), self.store.clock(), run))
