"""Python scalar functions: Arrow-batched, and never called with a null."""

from __future__ import annotations

from pyspark.sql import functions as F


def null_skipping(fn, return_type: str):
    """A null argument gives null without a call."""

    def call(*args):
        return None if any(a is None for a in args) else fn(*args)

    return F.udf(call, return_type, useArrow=True)
