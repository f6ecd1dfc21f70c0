"""Sources by name, as users bring them."""

import json
import os


class Numbers:
    """``units`` partitions of ``size`` numbers each."""

    schema = "id bigint, unit int, note string"

    def __init__(self, units="3", size="4"):
        self.n, self.size = int(units), int(size)

    def units(self):
        return list(range(self.n))

    def records(self, unit):
        for i in range(self.size):
            yield {"id": unit * self.size + i, "unit": unit} if i % 2 else (unit * self.size + i, unit, "even")


class Growing:
    """A stream whose end is said by a file; offsets are numbers of rows."""

    schema = "id bigint"

    def __init__(self, where):
        self.where = where

    def first(self):
        return {"at": 0}

    def latest(self):
        with open(self.where, encoding="utf-8") as f:
            return json.load(f)

    def between(self, start, end):
        middle = (start["at"] + end["at"]) // 2
        return [[a, b] for a, b in ((start["at"], middle), (middle, end["at"])) if a < b]

    def records(self, unit):
        return ((i,) for i in range(*unit))

    def done(self, end):
        with open(os.path.join(os.path.dirname(self.where), "done"), "w", encoding="utf-8") as f:
            json.dump(end, f)


class Nothing:
    """No source at all."""
