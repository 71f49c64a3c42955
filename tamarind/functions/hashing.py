"""Stable identities: hashes of joined values, canonical JSON and seeds."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed_id(*parts: Column) -> Column:
    """32 hex digits of the SHA-256 of the parts joined by bars."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def stable_json(value) -> str:
    """JSON with sorted keys and no spaces: equal values give equal texts."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def seed_of(text: str) -> int:
    """32-bit FNV-1a over UTF-16 code units: a seed that a text alone decides."""
    value, units = 2166136261, text.encode("utf-16-le")
    for low, high in zip(units[::2], units[1::2], strict=True):
        value = (value ^ (low + 256 * high)) * 16777619 & 0xFFFFFFFF
    return value


def job_signature(kind: str, payload: dict) -> str:
    """What makes two jobs the same: kind and payload, at most 400 characters."""
    return f"{kind}:{stable_json(payload)}"[:400]


def fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals, for explanations."""
    return F.format_string(f"%.{digits}f", x.cast("double"))


def percent(x: Column, digits: int = 1) -> Column:
    return F.concat(fixed(x * 100, digits), F.lit("%"))
