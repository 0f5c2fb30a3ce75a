"""Repeatable sampling: a key is in or out by the hash of its own text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_DIGITS = 8


def hash_threshold(fraction: float) -> str:
    """The hex text below which ``fraction`` of all hashes lie."""
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must lie between 0 and 1")
    full = 16**_DIGITS
    bound = round(fraction * full)
    return "g" if bound >= full else f"{bound:0{_DIGITS}x}"


def in_sample(key: Column | str, fraction: float, seed: str = "") -> Column:
    """True when the key's hash falls in the sampled share. Null keys are never in."""
    c = F.col(key) if isinstance(key, str) else key
    digest = F.substring(F.md5(F.concat(F.lit(seed), c.cast("string"))), 1, _DIGITS)
    return F.coalesce(digest < F.lit(hash_threshold(fraction)), F.lit(False))
