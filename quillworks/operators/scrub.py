"""Secrets out of messages, whole or cut off at either end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

HIDDEN = "[key hidden]"
LEAST_SECRET, LEAST_FRAGMENT = 8, 16


def fragments(secret: str) -> list[str]:
    """Heads, then tails, of a secret that are long enough to give it away, longest first."""
    n = len(secret)
    if n < LEAST_SECRET:
        return []
    least = min(n, LEAST_FRAGMENT)
    return [secret[:k] for k in range(n, least - 1, -1)] + [secret[n - k :] for k in range(n - 1, least - 1, -1)]


def scrub(text: str, secrets: Sequence[str]) -> str:
    for secret in secrets:
        for part in fragments(secret):
            text = text.replace(part, HIDDEN)
    return text


def scrub_column(text: Column, secrets: Sequence[str]) -> Column:
    for secret in secrets:
        for part in fragments(secret):
            text = F.replace(text, F.lit(part), F.lit(HIDDEN))
    return text
