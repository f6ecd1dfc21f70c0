"""Validation: rules, contracts and drift. All counts of a unit are one aggregation; splitting adds one filter."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.errors import DataError, SpecError

POLICIES = ("block", "quarantine", "split", "warn")


@dataclass(frozen=True)
class Rule:
    field: str
    kind: str
    limit: float | None = None

    def check(self, df: DataFrame) -> None:
        if self.kind not in ("not_null", "unique", "min", "max"):
            raise SpecError(f"unknown rule {self.kind}")
        if self.field not in df.columns:
            raise DataError(f"rule {self.kind}: no column {self.field}")
        if self.kind in ("min", "max") and not isinstance(df.schema[self.field].dataType, T.NumericType):
            raise DataError(f"rule {self.kind}: {self.field} is not numeric")

    @property
    def name(self) -> str:
        return f"{self.kind}:{self.field}"

    def row(self, df: DataFrame) -> Column:
        """True for rows that break the rule, false for nulls where the rule ignores them."""
        c = F.col(f"`{self.field}`")
        if self.kind == "not_null":
            return c.isNull()
        if self.kind == "unique":
            return F.coalesce(F.col(f"`{_copies(self.field)}`"), F.lit(False))
        beyond = c < F.lit(self.limit) if self.kind == "min" else c > F.lit(self.limit)
        if isinstance(df.schema[self.field].dataType, (T.FloatType, T.DoubleType)):
            beyond = beyond & ~F.isnan(c)
        return F.coalesce(beyond, F.lit(False))

    def count(self, df: DataFrame) -> Column:
        c = F.col(f"`{self.field}`")
        if self.kind == "unique":
            return F.count(c) - F.count_distinct(c)
        return F.count_if(self.row(df))


def _copies(field: str) -> str:
    """An inner column; no file or stream has a column whose name begins like this."""
    return f"\x00copies {field}"


def counts(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row: the number of breaches of each rule."""
    for r in rules:
        r.check(df)
    return df.agg(*[r.count(df).cast("long").alias(r.name) for r in rules])


def with_copies(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """``df`` with a mark on values that must be unique and are not. The values are counted with a partial aggregation and only
    those seen twice are joined; nulls, which the rule leaves alone, are dealt by row instead of meeting in one task."""
    value, number, salt, side = ("\x00value", "\x00n", "\x00salt", "\x00side")
    for name in dict.fromkeys(r.field for r in rules if r.kind == "unique"):
        c, inner = F.col(f"`{name}`"), lambda x: F.col(f"`{x}`")
        twice = df.filter(c.isNotNull()).groupBy(c.alias(value)).agg(F.count(F.lit(1)).alias(number)).filter(inner(number) > 1).select(inner(value), F.lit(0).alias(side), F.lit(True).alias(_copies(name)))
        salted = df.withColumn(salt, F.when(c.isNotNull(), 0).otherwise((F.monotonically_increasing_id() % 1024).cast("int") + 1))
        df = salted.join(twice, (c == inner(value)) & (inner(salt) == inner(side)), "left").drop(value, side, salt)
    return df


def split(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and rows that break any; every copy of a value that must be unique breaks it."""
    for r in rules:
        r.check(df)
    breaks = reduce(lambda a, b: a | b, [r.row(df) for r in rules], F.lit(False))
    marked = with_copies(df, rules).select(*[F.col(f"`{c}`") for c in df.columns], breaks.alias("\x00breaks"))
    broken = F.col("`\x00breaks`")
    return marked.filter(~broken).drop("\x00breaks"), marked.filter(broken).drop("\x00breaks")


def watched(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, Callable[[], tuple[int, dict[str, int]]]]:
    """``df`` with its rows and the breaches of its rules counted by the job that writes it, and a function that tells both once it
    has run. Rules of unique values need a grouping of their own and are not among them."""
    for r in rules:
        r.check(df)
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[r.count(df).cast("long").alias(r.name) for r in rules if r.kind != "unique"])

    def told() -> tuple[int, dict[str, int]]:
        got = dict(seen.get)
        return got.pop("rows"), got

    return out, told


#: Names of Spark types as contracts write them (fixed values).
ARROW = {"bigint": "int64", "int": "int32", "smallint": "int16", "tinyint": "int8", "double": "double", "float": "float", "boolean": "bool", "string": "string", "binary": "binary", "date": "date32[day]", "timestamp_ntz": "timestamp[us]", "timestamp": "timestamp[us, tz=UTC]", "void": "null"}


def arrow_name(t: T.DataType) -> str:
    s = t.simpleString()
    if isinstance(t, T.DecimalType):
        return f"decimal128({t.precision}, {t.scale})"
    if isinstance(t, T.ArrayType):
        return f"list<item: {arrow_name(t.elementType)}>"
    if isinstance(t, T.StructType):
        return f"struct<{', '.join(f'{f.name}: {arrow_name(f.dataType)}' for f in t)}>"
    if isinstance(t, T.MapType):
        return f"map<{arrow_name(t.keyType)}, {arrow_name(t.valueType)}>"
    return ARROW[s]


def contract_breaches(df: DataFrame, columns: dict[str, tuple[str, bool]], extra: bool = True) -> list[str]:
    """``columns``: name → (type name, nullable). Real nulls count, not declared ones."""
    have = {f.name: f for f in df.schema}
    out = [f"missing: {c}" for c in columns if c not in have]
    out += [f"type: {c} is {arrow_name(have[c].dataType)}, not {t}" for c, (t, _) in columns.items() if c in have and arrow_name(have[c].dataType) != t]
    strict = [c for c, (_, nullable) in columns.items() if c in have and not nullable]
    if strict:
        got = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in strict]).first()
        out += [f"null: {c} has {got[c]} nulls" for c in strict if got[c]]
    if not extra:
        out += [f"unexpected: {c}" for c in have if c not in columns]
    return out


def schema_of(df: DataFrame) -> list[dict]:
    return [{"name": f.name, "type": arrow_name(f.dataType), "nullable": f.nullable} for f in df.schema]


def drift(old: list[dict], new: list[dict]) -> dict[str, list[str]]:
    a, b = {c["name"]: c for c in old}, {c["name"]: c for c in new}
    return {"added": sorted(set(b) - set(a)), "removed": sorted(set(a) - set(b)), "changed": sorted(n for n in set(a) & set(b) if a[n] != b[n])}


_DDL = {"bigint": "bigint", "int": "integer", "smallint": "smallint", "tinyint": "tinyint", "double": "double", "float": "real", "boolean": "boolean", "string": "varchar", "binary": "varbinary", "date": "date", "timestamp_ntz": "timestamp(6)", "timestamp": "timestamp(6) with time zone", "void": "varchar"}


def external_table_ddl(df: DataFrame, table: str, location: str) -> str:
    """CREATE TABLE text for an external Parquet table; nested types are refused."""
    if not re.match(r"^[A-Za-z_]\w*(\.[A-Za-z_]\w*){0,2}$", table):
        raise SpecError(f"not a table name: {table}")
    cols = []
    for f in df.schema:
        s = f.dataType.simpleString()
        if not isinstance(f.dataType, T.DecimalType) and s not in _DDL:
            raise SpecError(f"{f.name}: no type for {s}")
        cols.append(f'    "{f.name}" {_DDL.get(s, s.replace(",", ", "))}')
    place = location.replace("'", "''")
    return f"CREATE TABLE {table} (\n" + ",\n".join(cols) + f"\n)\nWITH (external_location = '{place}', format = 'PARQUET')"
