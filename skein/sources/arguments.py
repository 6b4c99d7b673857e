"""Arguments of queries as people write them."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

# Units of relative times, months before minutes.
UNITS = (("mo", timedelta(days=30)), ("w", timedelta(weeks=1)), ("d", timedelta(days=1)), ("h", timedelta(hours=1)), ("m", timedelta(minutes=1)), ("s", timedelta(seconds=1)))


def rfc3339(at: datetime) -> str:
    """UTC with trimmed fractions."""
    at = at.astimezone(timezone.utc)
    fraction = f".{at.microsecond:06d}".rstrip("0").rstrip(".")
    return f"{at:%Y-%m-%dT%H:%M:%S}{fraction}Z"


def parse_since(value: str, now: datetime) -> str:
    """An RFC 3339 time, or how long ago as 15m, 2h, 7d, 1mo."""
    value = value.strip()
    if not value:
        return ""
    if "T" in value:
        return rfc3339(datetime.fromisoformat(value.replace("Z", "+00:00")))
    for suffix, unit in UNITS:
        if value.endswith(suffix):
            amount = value.removesuffix(suffix)
            if re.fullmatch(r"[+]?\d+", amount) and int(amount) > 0:
                return rfc3339(now - int(amount) * unit)
            break
    raise ValueError(f"invalid since {value!r}")


def parse_max_age(value: str) -> timedelta:
    """Seconds as a whole number, or durations such as 1h30m; more than 0."""
    value = value.strip()
    if value.isdigit():
        out = timedelta(seconds=int(value))
    elif re.fullmatch(r"(?:\d+(?:\.\d+)?(?:h|ms|m|s))+", value):
        scale = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 0.001}
        out = timedelta(seconds=sum(float(n) * scale[u] for n, u in re.findall(r"(\d+(?:\.\d+)?)(h|ms|m|s)", value)))
    else:
        raise ValueError(f"invalid duration {value!r}")
    if out <= timedelta(0):
        raise ValueError("the duration must be positive")
    return out


def is_stale(last_sync: str, max_age: timedelta, now: datetime) -> bool:
    return not last_sync or now - datetime.fromisoformat(last_sync.replace("Z", "+00:00")) > max_age


def parse_query(query: str) -> dict[str, str]:
    """text, repo and state of a search with qualifiers; is:issue and is:pr are taken out and mean nothing."""
    out, words = {"text": "", "repo": "", "state": ""}, []
    for word in query.split():
        key, _, value = word.partition(":")
        if key == "repo" and value:
            out["repo"] = value
        elif key == "state" and value:
            out["state"] = value
        elif word in ("is:open", "is:closed"):
            out["state"] = value
        elif word not in ("is:issue", "is:pr"):
            words.append(word)
    return out | {"text": " ".join(words)}


def parse_repository(value: str) -> tuple[str, str]:
    owner, _, name = value.strip().partition("/")
    if not owner.strip() or not name.strip() or "/" in name:
        raise ValueError(f"expected owner/repo, not {value!r}")
    return owner.strip(), name.strip()


def positive(value: str) -> int:
    if not value.strip().isdigit() or int(value) <= 0:
        raise ValueError(f"expected a positive number, not {value!r}")
    return int(value)


def numbers(value: str) -> list[int]:
    return list(dict.fromkeys(positive(p) for p in value.split(",") if p.strip()))


def one_of(value: str, allowed: tuple[str, ...]) -> str:
    if value not in allowed:
        raise ValueError(f"expected one of {', '.join(allowed)}, not {value!r}")
    return value


# Sizes through which a minimum cycles.
MIN_SIZES = (1, 2, 5, 10, 20, 50)


def next_min_size(size: int) -> int:
    return next((s for s in MIN_SIZES if s > size), MIN_SIZES[0])
