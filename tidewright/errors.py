"""Errors with a reason a caller can act on."""


class SpecError(ValueError):
    """A specification that cannot be right."""


class DataError(ValueError):
    """Data that breaks a rule that stops a run."""


class ConflictError(RuntimeError):
    """Another writer, or another version of the same thing, is in the way."""
