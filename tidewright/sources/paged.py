"""Paged record sources over an injected transport: ``transport(params[, body]) -> (records envelope, headers[, status])``.

With a ``body`` requests are POSTs. A status of 429 or 503 is tried again after the time that Retry-After names."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime

from tidewright.errors import SpecError

EXHAUSTED = "__exhausted__"


def at_path(value, path: str | None):
    """Dot-path look-up in nested mappings; None where it leads nowhere."""
    for part in path.split(".") if path else []:
        value = value.get(part) if isinstance(value, dict) else None
    return value


def next_link(headers: dict) -> str | None:
    link = next((v for k, v in headers.items() if k.lower() == "link"), "")
    m = re.search(r'<([^>]+)>\s*;[^,]*rel="?next"?', link)
    return m[1] if m else None


def retry_after(headers: dict, default: float = 1.0) -> float:
    """Seconds that a Retry-After header names, as a number or a date."""
    text = next((v for k, v in headers.items() if k.lower() == "retry-after"), None)
    if text is None:
        return default
    try:
        return max(0.0, float(text))
    except ValueError:
        pass
    try:
        return max(0.0, (parsedate_to_datetime(text) - datetime.now(timezone.utc)).total_seconds())
    except ValueError:
        return default


class TokenBucket:
    """At most ``rate`` calls a second, ``burst`` at once; ``penalty`` waits out a Retry-After."""

    def __init__(self, rate: float, burst: int = 1, clock: Callable = time.monotonic, sleep: Callable = time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.tokens, self.at = float(burst), clock()

    def take(self) -> None:
        now = self.clock()
        self.tokens = min(self.burst, self.tokens + (now - self.at) * self.rate)
        self.at = now
        if self.tokens < 1:
            self.sleep((1 - self.tokens) / self.rate)
            self.tokens, self.at = 1.0, self.clock()
        self.tokens -= 1

    def penalty(self, seconds: float) -> None:
        self.sleep(seconds)
        self.at = self.clock()


class Paged:
    """Units and records of one endpoint in mode offset, page, cursor or link."""

    def __init__(self, transport: Callable, mode: str, size: int = 100, start: int = 1, record_path: str | None = None, cursor_path: str | None = None, stop_on: str = "short_page", query: dict | None = None, bucket: TokenBucket | None = None, body: dict | None = None, tries: int = 5, sleep: Callable = time.sleep):
        if mode not in ("offset", "page", "cursor", "link") or stop_on not in ("short_page", "empty_page"):
            raise SpecError(f"unknown mode {mode} or rule {stop_on}")
        if mode == "cursor" and not cursor_path:
            raise SpecError("cursor: a cursor_path is needed")
        if clash := set(query or {}) & {"offset", "limit", "page", "per_page", "cursor"}:
            raise SpecError(f"query may not set {sorted(clash)}")
        self.transport, self.mode, self.size, self.start, self.record_path, self.cursor_path, self.stop_on, self.query, self.bucket = transport, mode, size, start, record_path, cursor_path, stop_on, query or {}, bucket
        self.body, self.tries, self.sleep = body, tries, sleep

    def ask(self, params: dict) -> tuple:
        for k in range(self.tries):
            if self.bucket:
                self.bucket.take()
            body, headers, *status = self.transport(params) if self.body is None else self.transport(params, self.body)
            if not status or status[0] not in (429, 503):
                if status and status[0] >= 400:
                    raise ConnectionError(f"status {status[0]}")
                return body, headers
            if k + 1 < self.tries:
                (self.bucket.penalty if self.bucket else self.sleep)(retry_after(headers))
        raise ConnectionError(f"status {status[0]}")

    def pages(self, cursor=None) -> Iterator[tuple[str, list[dict], object]]:
        """(unit key, records, next cursor); the cursor is EXHAUSTED behind the last page."""
        if cursor == EXHAUSTED:
            return
        k, url = 0, None
        while True:
            if self.mode == "offset":
                params, key = {"offset": k * self.size, "limit": self.size}, f"offset={k * self.size}:limit={self.size}"
            elif self.mode == "page":
                params, key = {"page": self.start + k, "per_page": self.size}, f"page={self.start + k}:per_page={self.size}"
            elif self.mode == "cursor":
                params, key = ({} if cursor is None else {"cursor": cursor}), f"cursor={'' if cursor is None else cursor}"
            else:
                params, key = ({"url": url} if url else {}), f"link={url or 'first'}"
            body, headers = self.ask({**self.query, **params})
            records = at_path(body, self.record_path) if self.record_path else body
            if not isinstance(records, list):
                raise SpecError(f"no list of records at {self.record_path!r}")
            if self.mode == "cursor":
                cursor = at_path(body, self.cursor_path)
                last = cursor is None or cursor == ""
            elif self.mode == "link":
                url = next_link(headers)
                last = url is None
            else:
                last = len(records) < (self.size if self.stop_on == "short_page" else 1)
            if records or not last:
                yield key, records, EXHAUSTED if last else cursor
            if last:
                return
            k += 1


def batches(records: Iterable[dict], size: int) -> Iterator[tuple[str, list[dict], bool]]:
    """(``batch=i``, records, last) from any iterable, one record ahead to know the last."""
    it, k = iter(records), 0
    ahead = next(it, None)
    while ahead is not None:
        part = [ahead]
        ahead = None
        for r in it:
            if len(part) == size:
                ahead = r
                break
            part.append(r)
        yield f"batch={k}", part, ahead is None
        k += 1
