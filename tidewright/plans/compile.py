"""A plan becomes one lazy DataFrame; Catalyst does the rest. Columns are resolved as it is built, before any output."""

from __future__ import annotations

import importlib
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.errors import SpecError
from tidewright.functions.expressions import to_spark
from tidewright.functions.udf import null_skipping
from tidewright.plans.ir import CAST_TYPES, Plan, Step

_WHOLE = ("bigint", "int")


def q(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def free(taken: set[str], *names: str) -> list[str]:
    """Names for inner columns that meet none of ``taken``, however those are called."""
    low = {t.lower() for t in taken}
    mark = "\x00"
    while any(t.startswith(mark) for t in low):
        mark += "\x00"
    return [mark + n for n in names]


def known(df: DataFrame, names) -> None:
    have = {c.lower() for c in df.columns}
    if missing := [n for n in names if n.lower() not in have]:
        raise SpecError(f"unknown columns {missing}; there are {df.columns}")


def rounding_cast(df: DataFrame, name: str, target: str) -> Column:
    """A cast as SQL engines round: doubles half to even, decimals half away from zero, numbers in text by their value."""
    kind, to = df.schema[name].dataType, CAST_TYPES[target.lower()]
    c = q(name)
    if to in _WHOLE:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            c = F.bround(c, 0)
        elif isinstance(kind, T.DecimalType):
            c = F.round(c, 0)
        elif isinstance(kind, T.StringType):
            c = F.round(c.cast("decimal(38,9)"), 0)
    if to == "string" and isinstance(kind, (T.DoubleType, T.FloatType)):
        return plain_double(c).cast("string")
    return c.cast(to)


def plain_double(c: Column) -> Column:
    """Doubles as text without an exponent for everyday sizes."""
    usual = (F.abs(c) >= 1e-3) & (F.abs(c) < 1e7) | (c == F.floor(c)) & (F.abs(c) < 1e15)
    short = F.when(c == F.floor(c), F.concat(c.cast("decimal(38,0)").cast("string"), F.lit(".0"))).otherwise(c.cast("string"))
    return F.when(usual, short).otherwise(F.lower(c.cast("string")))


def fresh(name: str, taken: set[str]) -> str:
    """``name``, or with ``_1``, ``_2`` behind if it is taken."""
    out, k = name, 1
    while out.lower() in taken:
        out, k = f"{name}_{k}", k + 1
    taken.add(out.lower())
    return out


def ordering(text: str) -> Column:
    """``expression [ASC|DESC] [NULLS FIRST|LAST]``; nulls come last unless said."""
    m = re.fullmatch(r"(?is)(.*?)(?:\s+(asc|desc))?(?:\s+nulls\s+(first|last))?", text.strip())
    c, down, first = F.expr(to_spark(m[1])), (m[2] or "").lower() == "desc", (m[3] or "last").lower() == "first"
    return (c.desc_nulls_first() if first else c.desc_nulls_last()) if down else (c.asc_nulls_first() if first else c.asc_nulls_last())


def first_of(df: DataFrame, window) -> DataFrame:
    """The first row of each partition of the window."""
    (rank,) = free({*df.columns}, "rank")
    return df.select("*", F.row_number().over(window).alias(rank)).filter(q(rank) == 1).drop(rank)


def apply_step(df: DataFrame, step: Step, carry: tuple = ()) -> DataFrame:
    """``carry`` names columns that go through the step beside its own; rows that differ in them are no duplicates."""
    kind, body = step.kind, step.body
    if kind == "map":
        return df.select(*[F.expr(to_spark(e)).alias(n) for n, e in body.items()], *map(q, carry))
    if kind == "filter":
        return df.filter(F.expr(f"({to_spark(body)})"))
    if kind == "rename":
        known(df, body)
        gone = {k.lower() for k in body}
        kept = [c for c in df.columns if c.lower() not in gone]
        taken = {c.lower() for c in kept}
        return df.select(*map(q, kept), *[q(old).alias(fresh(new, taken)) for old, new in body.items()])
    if kind == "cast":
        known(df, body)
        to = {k.lower(): v for k, v in body.items()}
        return df.select(*[rounding_cast(df, c, to[c.lower()]).alias(c) if c.lower() in to else q(c) for c in df.columns])
    if kind == "derive":
        taken = {c.lower() for c in df.columns}
        if all(n.lower() not in taken for n in body):
            return df.select("*", *[F.expr(to_spark(e)).alias(n) for n, e in body.items()])
        # a name that is there already stays; the new column gets a free name
        return df.select("*", *[F.expr(to_spark(e)).alias(fresh(n, taken)) for n, e in body.items()])
    if kind == "dedup":
        keys = body["keys"] if isinstance(body, dict) else body
        known(df, keys)
        keys = [*keys, *carry]
        order = body.get("order_by") if isinstance(body, dict) else None
        if not order:
            return df.dropDuplicates(keys)
        return first_of(df, Window.partitionBy(*map(q, keys)).orderBy(*map(ordering, order)))
    if kind == "select":
        known(df, body)
        return df.select(*map(q, body), *map(q, carry))
    if kind == "sql":
        if carry:
            raise SpecError("a statement over all rows cannot carry columns")
        return df.sparkSession.sql(to_spark(body).replace("{input}", "{_input}"), _input=df)
    if kind == "python":
        known(df, body.get("args", []))
        module, _, name = body["python"].partition(":")
        try:
            fn = getattr(importlib.import_module(module), name)
        except (ImportError, AttributeError) as e:
            raise SpecError(f"python: {body['python']} cannot be loaded") from e
        args = [q(a) for a in body.get("args", [])]
        if body.get("arg_types"):
            args = [a.cast(CAST_TYPES[t.lower()]) for a, t in zip(args, body["arg_types"], strict=True)]
        out = null_skipping(fn, CAST_TYPES[body.get("return_type", "varchar").lower()])(*args)
        return df.select("*", out.alias(fresh(body["output"], {c.lower() for c in df.columns})))
    raise SpecError(f"unknown step {kind}")


def build(df: DataFrame, plan: Plan | list, carry: tuple = ()) -> DataFrame:
    """The transformed DataFrame. Nothing runs until it is used."""
    for step in plan.steps if isinstance(plan, Plan) else plan:
        if not isinstance(step, Step):
            step = Step(*next(iter(step.items())))
            step.check()
        df = apply_step(df, step, carry)
    return df
