"""The transform plan: a linear chain of steps from one input to one output, checked, serialised and hashed."""

from __future__ import annotations

import hashlib
import json
import os
import re
from dataclasses import dataclass
from typing import Any

from tidewright.errors import SpecError
from tidewright.functions.expressions import portability, single_statement

#: Type names a cast may take (fixed values), as Spark types. Bare decimal is DECIMAL(38, 9).
CAST_TYPES = {"bigint": "bigint", "integer": "int", "double": "double", "varchar": "string", "boolean": "boolean", "date": "date", "timestamp": "timestamp_ntz", "decimal": "decimal(38,9)"}

STEPS = ("map", "filter", "rename", "cast", "derive", "dedup", "select", "sql", "python")
_NAME = re.compile(r"^[A-Za-z0-9][A-Za-z0-9_.-]*$")


@dataclass(frozen=True)
class Step:
    kind: str
    body: Any

    def check(self) -> None:
        kind, body = self.kind, self.body
        if kind in ("map", "derive", "rename", "cast"):
            if not isinstance(body, dict) or not body or not all(isinstance(k, str) and isinstance(v, str) for k, v in body.items()):
                raise SpecError(f"{kind}: a non-empty mapping of names is needed")
            if kind in ("map", "derive"):
                for e in body.values():
                    single_statement(e, kind)
            if kind == "cast":
                for t in body.values():
                    if t.lower() not in CAST_TYPES:
                        raise SpecError(f"cast: unknown type {t}")
            if kind == "rename" and len(set(body.values())) != len(body):
                raise SpecError("rename: two columns get one name")
        elif kind == "filter":
            if not isinstance(body, str) or not body.strip():
                raise SpecError("filter: a predicate is needed")
            single_statement(body, kind)
        elif kind in ("dedup", "select"):
            keys = body["keys"] if kind == "dedup" and isinstance(body, dict) else body
            if not isinstance(keys, list) or not keys or len(set(keys)) != len(keys):
                raise SpecError(f"{kind}: a list of distinct columns is needed")
        elif kind == "sql":
            single_statement(body, kind)
            if body.count("{input}") != 1:
                raise SpecError("sql: {input} must stand exactly once")
        elif kind == "python":
            if not isinstance(body, dict) or set(body) - {"python", "args", "output", "arg_types", "return_type"} or not re.match(r"^[\w.]+:\w+$", body.get("python", "")) or not body.get("output"):
                raise SpecError("python: 'module:function', args and output are needed")
            for t in [body.get("return_type", "varchar"), *body.get("arg_types", [])]:
                if t.lower() not in CAST_TYPES:
                    raise SpecError(f"python: unknown type {t}")
            if body.get("arg_types") and len(body["arg_types"]) != len(body.get("args", [])):
                raise SpecError("python: as many arg_types as args are needed")
        else:
            raise SpecError(f"unknown step {kind}")


@dataclass(frozen=True)
class Plan:
    name: str
    input: str
    output: str
    steps: tuple[Step, ...] = ()
    incremental: tuple[str, tuple[str, ...]] | None = None
    version: int = 1

    def to_mapping(self) -> dict:
        out = {"version": self.version, "name": self.name, "input": self.input, "output": self.output, "steps": [{s.kind: s.body} for s in self.steps]}
        return out | ({"incremental": {"mode": self.incremental[0], "key": list(self.incremental[1])}} if self.incremental else {})

    @property
    def hash(self) -> str:
        return canonical_hash(self.to_mapping())

    def explain(self) -> str:
        lines = [f"Read {self.input}", *(f"{s.kind} {json.dumps(s.body, ensure_ascii=False)}" for s in self.steps), f"Write {self.output}"]
        return "\n".join(f"{'  ' * i}{line}" for i, line in enumerate(reversed(lines)))

    def placement(self) -> tuple[str, list[str]]:
        """``neutral`` if any SQL engine gives the same, ``engine`` if it takes this one, ``local`` if it takes this code."""
        why = []
        for s in self.steps:
            texts = list(s.body.values()) if s.kind in ("map", "derive") else [s.body] if s.kind == "filter" else []
            why += [f"{s.kind}: {w}" for t in texts for w in portability(t)]
            if s.kind == "sql":
                why.append("sql step")
        if any(s.kind == "python" for s in self.steps):
            return "local", ["python step", *why]
        return ("engine", why) if why else ("neutral", [])


def canonical_hash(value: Any) -> str:
    """sha256 of sorted, compact JSON; NaN and values JSON lacks are refused."""
    try:
        text = json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False, ensure_ascii=False)
    except (TypeError, ValueError) as e:
        raise SpecError(f"cannot be hashed: {e}") from e
    return hashlib.sha256(text.encode()).hexdigest()


def from_mapping(spec: dict) -> Plan:
    known = {"version", "name", "input", "output", "map", "steps", "incremental"}
    if not isinstance(spec, dict) or set(spec) - known:
        raise SpecError(f"unknown keys: {sorted(set(spec) - known) if isinstance(spec, dict) else spec}")
    for k in ("name", "input", "output"):
        if not isinstance(spec.get(k), str) or not spec[k]:
            raise SpecError(f"{k} is missing")
    if not _NAME.match(spec["name"]):
        raise SpecError("name: letters, digits, '_', '-' and '.' only")
    if spec.get("version", 1) != 1:
        raise SpecError("only version 1 is known")
    steps = [Step("map", spec["map"])] if spec.get("map") else []
    for item in spec.get("steps") or []:
        if isinstance(item, dict) and "python" in item and len(item) > 1:
            item = {"python": item}
        if not isinstance(item, dict) or len(item) != 1 or next(iter(item)) not in STEPS:
            raise SpecError(f"a step has one of {STEPS}: {item}")
        steps.append(Step(*next(iter(item.items()))))
    for s in steps:
        s.check()
    inc = spec.get("incremental")
    mode = None
    if inc:
        key = inc.get("key", [])
        key = [key] if isinstance(key, str) else key
        if inc.get("mode") not in ("by_unit", "by_key") or (inc["mode"] == "by_key") != bool(key):
            raise SpecError("incremental: by_unit, or by_key with a key")
        mode = (inc["mode"], tuple(key))
    return Plan(spec["name"], spec["input"], spec["output"], tuple(steps), mode)


def substituted(text: str, environment: dict | None = None) -> str:
    """``${NAME}`` replaced before parsing; an unset name is an error."""
    env = os.environ if environment is None else environment

    def value(m: re.Match) -> str:
        if m[1] not in env:
            raise SpecError(f"environment variable {m[1]} is not set")
        return env[m[1]]

    return re.sub(r"\$\{(\w+)\}", value, text)


def load(path: str, environment: dict | None = None) -> Plan:
    """A plan from a YAML or JSON file."""
    text = substituted(open(path, encoding="utf-8").read(), environment)
    if path.endswith(".json"):
        return from_mapping(json.loads(text))
    import yaml

    return from_mapping(yaml.safe_load(text))


