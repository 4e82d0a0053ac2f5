"""Settings that are worked out on the driver: page ranges, quotas, backoff."""

from __future__ import annotations


def parse_pages(spec: str, n_pages: int) -> list[int]:
    """``"1-2,5"`` as sorted distinct numbers from 0; pages past the end are dropped, anything else is an error."""
    pages: set[int] = set()
    for part in (spec or "").split(","):
        if not (part := part.strip()):
            continue
        low, dash, high = part.partition("-")
        if not low.strip().isdigit() or (dash and not high.strip().isdigit()):
            raise ValueError(f"not a page range: {part!r}")
        a, b = int(low), int(high) if dash else int(low)
        if a < 1 or b < a:
            raise ValueError(f"not a page range: {part!r}")
        pages |= set(range(a - 1, min(b, n_pages)))
    return sorted(pages)


def backoff(base: float, attempt: int, cap: float) -> float:
    return min(base * 2 ** (attempt - 1), cap)


def quota(rpm: float, tpm: float) -> tuple[float, int]:
    """Seconds between calls and characters of a batch that use a quota up: 3.2 characters a token, a fifth in reserve."""
    return round(60 / rpm, 2), max(400, min(12000, int(tpm / rpm * 3.2 * 0.8)))
