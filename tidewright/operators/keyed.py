"""Keyed tables: last row per key, upsert, and change events applied as sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.errors import DataError
from tidewright.plans.compile import first_of, free, q
from tidewright.sources.union import union_by_name


def last_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by ``order``; null keys are one key."""
    return first_of(df, Window.partitionBy(*map(q, keys)).orderBy(q(order).desc_nulls_last()))


def settled(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key, the greatest by all other columns in their order (nulls last), so that runs agree. Maps count by
    their JSON form."""
    others = [F.to_json(F.col(f"`{f.name}`")) if "map" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema if f.name not in keys]
    order = [c.desc_nulls_last() for c in others] or [F.lit(1)]
    return first_of(df, Window.partitionBy(*map(q, keys)).orderBy(*order))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``old`` without the keys of ``new``, and ``new``; in ``new`` the last row of a key by ``order`` wins."""
    if order:
        new = last_per_key(new, keys, order)
    inner = free({*old.columns}, *[f"k{i}" for i in range(len(keys))])
    fresh = new.select(*[q(k).alias(n) for k, n in zip(keys, inner, strict=True)]).distinct()
    on = reduce(lambda a, b: a & b, [q(k).eqNullSafe(q(n)) for k, n in zip(keys, inner, strict=True)])
    return union_by_name([old.join(fresh, on, "left_anti"), new])


def check_events(events: DataFrame) -> None:
    """Event ids are unique, sequences distinct, operations known."""
    bad = events.agg((F.count(F.lit(1)) - F.count_distinct("event_id")).alias("ids"), (F.count(F.lit(1)) - F.count_distinct("sequence")).alias("seqs"), F.count_if(~F.coalesce(F.col("op").isin("I", "U", "D"), F.lit(False))).alias("ops")).first()
    if bad["ids"] or bad["seqs"] or bad["ops"]:
        raise DataError(f"bad events: {bad.asDict()}")


def event_hash(events: DataFrame):
    return F.sha2(F.to_json(F.struct("sequence", "op", "key", "payload"), {"ignoreNullFields": "false"}), 256)


def applied(table: DataFrame | None, ledger: DataFrame | None, events: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """New table and ledger after events (event_id, sequence, op, key struct, payload struct).

    Known events with the same content are skipped; with other content they stop the batch. Of each key the event with the
    highest sequence decides: I and U put the payload in place of the row, D takes the row away."""
    events = events.withColumn("hash", event_hash(events))
    if ledger is not None:
        seen = ledger.select(F.col("event_id").alias("_id"), F.col("hash").alias("_hash"))
        joined = events.join(seen, F.col("event_id") == F.col("_id"), "left")
        if not joined.filter(F.col("_id").isNotNull() & (F.col("hash") != F.col("_hash"))).isEmpty():
            raise DataError("an event id came again with other content")
        events = joined.filter("_id is null").drop("_id", "_hash")
    marks = events.select("event_id", "sequence", "hash")
    top = events.groupBy(*[F.col(f"key.{k}").alias(k) for k in keys]).agg(F.max_by(F.struct("op", "payload"), "sequence").alias("_e"))
    rows = top.filter("_e.op <> 'D'").select("_e.payload.*")
    if table is not None:
        inner = free({*table.columns}, *[f"k{i}" for i in range(len(keys))])
        touched = top.select(*[q(k).alias(n) for k, n in zip(keys, inner, strict=True)])
        cond = reduce(lambda a, b: a & b, [q(k).eqNullSafe(q(n)) for k, n in zip(keys, inner, strict=True)])
        rows = union_by_name([table.join(touched, cond, "left_anti"), rows])
    return rows, (marks if ledger is None else ledger.unionByName(marks))


def changes(source: DataFrame, ledger: DataFrame, key: str, mode: str = "upsert") -> DataFrame:
    """(key, action, hash) of an outbound run: insert, update, delete (mode mirror) or unchanged.

    ``ledger`` has (key, hash, dead); dead keys are left out. Mode insert leaves known keys alone."""
    now = source.select(F.col(key).cast("string").alias("key"), F.sha2(F.to_json(F.struct(*sorted(source.columns)), {"ignoreNullFields": "false"}), 256).alias("hash"))
    # one pass finds null and repeated keys where the key is grouped for the join anyway; such a key stops the run that reads it
    once = F.when(F.col("key").isNull(), F.raise_error(F.lit("keys must not be null"))).when(F.count(F.lit(1)) > 1, F.raise_error(F.concat(F.lit("keys must be unique: "), F.col("key")))).otherwise(F.max("hash"))
    now = now.groupBy("key").agg(once.cast("string").alias("hash"))
    old = ledger.select(F.col("key").alias("_key"), F.col("hash").alias("_hash"), "dead")
    both = now.join(old, F.col("key") == F.col("_key"), "full")
    changed = F.lit("unchanged") if mode == "insert" else F.when(F.col("hash") == F.col("_hash"), "unchanged").otherwise("update")
    # the hash is asked for, so that it is worked out, and with it the check, whatever columns are read
    action = F.when(F.col("key").isNull(), "delete").when(F.col("_key").isNull() & F.col("hash").isNotNull(), "insert").otherwise(changed)
    out = both.filter(~F.coalesce("dead", F.lit(False))).select(F.coalesce("key", "_key").alias("key"), action.alias("action"), F.coalesce("hash", "_hash").alias("hash"))
    return out if mode == "mirror" else out.filter("action <> 'delete'")


def safe_to_send(actions: DataFrame, known: int, first_limit: int = 1000, delete_share: float = 0.5) -> None:
    """Refuses a first dispatch that is too large, and deletes of too many known keys."""
    n = {r["action"]: r["count"] for r in actions.groupBy("action").count().collect()}
    if not known and n.get("insert", 0) > first_limit:
        raise DataError(f"first dispatch of {n['insert']} rows; the limit is {first_limit}")
    if known and n.get("delete", 0) > delete_share * known:
        raise DataError(f"{n['delete']} of {known} rows would be deleted")
