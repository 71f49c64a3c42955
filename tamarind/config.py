"""Settings from an environment, checked all at once."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields


def _flag(text: str) -> bool:
    if text.lower() not in ("true", "false", "1", "0"):
        raise ValueError("must be true or false")
    return text.lower() in ("true", "1")


def _number(low: float, high: float, kind=int):
    def read(text: str):
        value = kind(text)
        if not low <= value <= high:
            raise ValueError(f"must be from {low} to {high}")
        return value

    return read


@dataclass(frozen=True)
class Config:
    seed: int = 20260101
    operator: str = "operator"
    retention_days: int = 540
    signup_url: str = ""
    customers_csv: str | None = None
    rate_per_second: float = 0.5
    concurrency_per_domain: int = 1
    max_bytes: int = 2_000_000
    budget_serper: int = 0
    budget_brave: int = 100
    budget_google_cse: int = 100
    budget_google_places: int = 100
    daily_cap: int = 40
    hourly_cap: int = 8
    enable_meta_ads: bool = False
    enable_demo: bool = True


READERS = {
    "seed": _number(0, 2**53), "retention_days": _number(30, 3650), "rate_per_second": _number(0.01, 10, float), "concurrency_per_domain": _number(1, 8), "max_bytes": _number(1000, 20_000_000),
    "budget_serper": _number(0, 10**6), "budget_brave": _number(0, 10**6), "budget_google_cse": _number(0, 10**6), "budget_google_places": _number(0, 10**6),
    "daily_cap": _number(1, 200), "hourly_cap": _number(1, 50), "enable_meta_ads": _flag, "enable_demo": _flag,
}


def load_config(env: Mapping[str, str], prefix: str = "TAMARIND_") -> Config:
    """Settings named ``PREFIX_NAME``; what isn't set keeps its default. Raises once, naming every wrong one."""
    found, wrong = {}, []
    for f in fields(Config):
        text = env.get(prefix + f.name.upper())
        if text is None or text == "":
            continue
        try:
            found[f.name] = READERS.get(f.name, str)(text)
        except ValueError as bad:
            wrong.append(f"{prefix}{f.name.upper()}: {bad}")
    if wrong:
        raise ValueError("wrong settings: " + "; ".join(wrong))
    return Config(**found)
