"""Retry rules of remote services, free of any clock or network."""

from __future__ import annotations

import random
from dataclasses import dataclass
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime


@dataclass
class ServiceError(Exception):
    status: int
    code: str = ""
    kind: str = ""
    retry_after: float = 0.0

    @property
    def retryable(self) -> bool:
        if self.status in (408, 429):
            return "insufficient_quota" not in (self.code, self.kind)
        return self.status in (500, 502, 503, 504)

    @property
    def overloaded(self) -> bool:
        return self.kind == "overloaded_error" or (self.status == 503 and self.code == "overloaded")


def parse_retry_after(header: str, now: datetime) -> float:
    """Seconds of a Retry-After header: a number, or an HTTP date; 0 if it is neither or past."""
    header = header.strip()
    try:
        return max(0.0, float(header)) if header else 0.0
    except ValueError:
        pass
    try:
        when = parsedate_to_datetime(header)
    except (TypeError, ValueError):
        return 0.0
    return max(0.0, ((when if when.tzinfo else when.replace(tzinfo=timezone.utc)) - now).total_seconds())


def rate_limit_wait(status: int, headers: dict[str, str], now: datetime) -> float | None:
    """Seconds to wait before the one retry of a rate-limited request; None if it is not to be retried."""
    if status not in (403, 429):
        return None
    headers = {k.lower(): v.strip() for k, v in headers.items()}
    if headers.get("retry-after", "").isdigit() and int(headers["retry-after"]) > 0:
        return float(headers["retry-after"])
    if headers.get("x-ratelimit-remaining") != "0" or not headers.get("x-ratelimit-reset", "").isdigit():
        return None
    wait = int(headers["x-ratelimit-reset"]) - now.timestamp()
    return wait if wait > 0 else 1.0


@dataclass(frozen=True)
class Backoff:
    """Attempts with doubled waits: base (overload_base if overloaded), at most most, jitter either way, budget in all."""

    attempts: int = 6
    base: float = 1.0
    overload_base: float = 15.0
    most: float = 60.0
    budget: float = 300.0
    jitter: float = 0.2

    def wait(self, attempt: int, error: ServiceError, rng: random.Random) -> float:
        own = (self.overload_base if error.overloaded else self.base) * 2**attempt
        own = min(self.most, max(own, error.retry_after))
        return own * (1 + self.jitter * (2 * rng.random() - 1))
