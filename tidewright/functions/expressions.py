"""Expressions: one dialect for specs (Spark SQL) with a small layer of names and operators users bring along.

The rewriter works on tokens, so string literals and quoted identifiers stay as they are."""

from __future__ import annotations

import re

from tidewright.errors import SpecError

_TOKEN = re.compile(r"""(?P<string>'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*"|`[^`]*`)|(?P<comment>--[^\n]*|/\*.*?\*/)|(?P<word>[A-Za-z_][A-Za-z_0-9]*)|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<space>\s+)|(?P<op>//|\|\||->>|->|::|~~\*?|!~~\*?|<>|!=|<=|>=|.)""", re.S)

#: Scalar functions that mean the same in other engines (fixed values).
PORTABLE_FUNCTIONS = frozenset("abs cast ceil ceiling char_length coalesce current_date current_time current_timestamp extract floor length lower mod nullif position power replace sqrt substring translate trim upper".split())
#: Words that look like calls when a parenthesis follows.
_KEYWORDS = frozenset("and or not in is between like case when then else end from as distinct exists interval".split())
_FOREIGN_OPERATORS = frozenset(["::", "->>", "->", "~~", "!~~", "~~*", "!~~*", "//"])
_FORMATS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%%": "%"}


def tokens(text: str) -> list[tuple[str, str]]:
    return [(m.lastgroup, m.group()) for m in _TOKEN.finditer(text)]


def single_statement(text: str, what: str = "expression") -> str:
    """Refuses a statement separator outside literals and quotes."""
    if any(kind == "op" and t == ";" for kind, t in tokens(text)):
        raise SpecError(f"{what}: ';' is not allowed")
    return text


def _arguments(items: list[tuple[str, str]], at: int) -> tuple[list[str], int]:
    """Texts of the arguments of the call whose '(' is at ``at``, and the place behind its ')'."""
    depth, parts, now = 0, [], []
    for i in range(at, len(items)):
        t = items[i][1]
        if items[i][0] == "op" and t in "([{":
            depth += 1
            if depth == 1:
                continue
        elif items[i][0] == "op" and t in ")]}":
            depth -= 1
            if depth == 0:
                return [*parts, "".join(now).strip()] if now or parts else [], i + 1
        elif depth == 1 and t == ",":
            parts.append("".join(now).strip())
            now = []
            continue
        now.append(t)
    raise SpecError("unbalanced parenthesis")


def _date_format(literal: str) -> str:
    inner = literal[1:-1]
    out = re.sub(r"%.", lambda m: _FORMATS[m.group()] if m.group() in _FORMATS else _bad_format(m.group()), inner)
    return f"'{out}'"


def _bad_format(code: str) -> str:
    raise SpecError(f"date format {code} has no counterpart")


_RENAMED = {"starts_with": "startswith", "ends_with": "endswith", "list_contains": "array_contains", "json_extract_string": "get_json_object", "len": "length", "list_distinct": "array_distinct", "list_sort": "array_sort", "list_sum": "aggregate_sum", "quantile_cont": "percentile"}


def to_spark(text: str) -> str:
    """The expression in Spark SQL."""
    items = tokens(text)
    out: list[str] = []
    i = 0
    while i < len(items):
        kind, t = items[i]
        low = t.lower()
        call = kind == "word" and i + 1 < len(items) and items[i + 1][1] == "("
        if call and low in ("strftime", "date_diff", "datediff", "sha256", "regexp_replace", "list_sum", "concat"):
            args, after = _arguments(items, i + 1)
            done = _call(low, [to_spark(a) for a in args])
            if done is not None:
                out.append(done)
                i = after
                continue
        if kind == "word" and low == "varchar" and not call:
            t = "STRING"
        elif call and low in _RENAMED:
            t = _RENAMED[low]
        elif kind == "op" and t == "//":
            t = " div "
        elif kind == "op" and t == "~~":
            t = " LIKE "
        elif kind == "op" and t == "!~~":
            t = " NOT LIKE "
        out.append(t)
        i += 1
    return "".join(out)


def _call(name: str, args: list[str]) -> str | None:
    if name == "strftime" and len(args) == 2:
        value, pattern = (args[1], args[0]) if args[0].startswith("'") else args
        if not pattern.startswith("'"):
            raise SpecError("strftime: the format must be a literal")
        return f"date_format({value}, {_date_format(pattern)})"
    if name in ("date_diff", "datediff") and len(args) == 3:
        unit = args[0].strip("'").upper()
        # boundaries crossed, not whole units elapsed
        return f"timestampdiff({unit}, date_trunc('{unit}', {args[1]}), date_trunc('{unit}', {args[2]}))"
    if name == "concat" and args:
        # nulls are skipped, as the operator || does not
        return f"concat_ws('', {', '.join(f'CAST({a} AS STRING)' for a in args)})"
    if name == "sha256" and len(args) == 1:
        return f"sha2({args[0]}, 256)"
    if name == "list_sum" and len(args) == 1:
        return f"aggregate({args[0]}, CAST(0 AS DOUBLE), (a, x) -> a + x)"
    if name == "regexp_replace" and len(args) == 3:
        # the first match only, unless the flag 'g' is given; a negated look-ahead cannot say this, groups can
        pattern = args[1]
        if pattern.startswith("'"):
            return f"regexp_replace({args[0]}, concat('(?s)^(.*?)(?:', {pattern}, ')'), concat('$1', {args[2]}))"
    if name == "regexp_replace" and len(args) == 4 and args[3].strip("'").lower() == "g":
        return f"regexp_replace({args[0]}, {args[1]}, {args[2]})"
    return None


def portability(text: str) -> list[str]:
    """Why the expression is not engine-neutral; nothing if it is."""
    why, items = [], [(k, t) for k, t in tokens(text) if k not in ("space", "comment")]
    for i, (kind, t) in enumerate(items):
        if kind == "op" and t in _FOREIGN_OPERATORS:
            why.append(f"operator {t}")
        if kind == "op" and t in "[{":
            why.append("list or struct literal")
        if kind == "word" and i + 1 < len(items) and items[i + 1][1] == "(":
            low = t.lower()
            if low not in PORTABLE_FUNCTIONS and low not in _KEYWORDS and not (i and items[i - 1][1].lower() == "as"):
                why.append(f"function {low}")
        if kind == "word" and t.lower() in ("select", "over", "qualify", "exclude", "lambda"):
            why.append(f"word {t.lower()}")
    return why
