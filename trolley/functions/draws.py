"""Reproducible pseudo-random draws.

A draw hashes a tag and the row's own keys, so it does not depend on partitioning, task order or
retries, and a SQL engine can repeat it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, functions as F

try:  # Python's own, a third of the time of OpenSSL's on short texts
    from _md5 import md5
except ImportError:
    from hashlib import md5

HEX_DIGITS = 15
DRAW_SPAN = 1 << (4 * HEX_DIGITS)


def draw(tag: str, *keys: Column) -> Column:
    """Uniform BIGINT in [0, 2^60) for a tag and integer keys."""
    text = F.concat_ws("|", F.lit(tag), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, HEX_DIGITS), 16, 10).cast("bigint")


@lru_cache(64)
def _texts(numbers: range) -> list[bytes]:
    return [b"%d" % n for n in numbers]


def draws(tag: str, firsts: Sequence, seconds: Sequence, thirds: Sequence[range]) -> np.ndarray:
    """`draw` inside a task: for each pair of keys (null: left out of the text), one draw for each of its third keys."""
    out = []
    for first, second, numbers in zip(firsts, seconds, thirds):
        head = "".join(f"{k}|" for k in (tag, first, second) if k is not None).encode()
        out += [md5(head + n).digest() for n in _texts(numbers)]
    return (np.frombuffer(b"".join(out), ">u8")[::2] >> (64 - 4 * HEX_DIGITS)).astype(np.int64)


def threshold(fraction: float) -> int:
    """The draw value below which a row is kept at the given fraction."""
    return int(fraction * DRAW_SPAN)


def keep(tag: str, fraction: float, *keys: Column) -> Column:
    """True for about `fraction` of the keys, always the same ones."""
    return draw(tag, *keys) < F.lit(threshold(fraction)).cast("bigint")


def enough(rows: int, most: int) -> int:
    """A draw value below which `most` of `rows` draws lie but for a chance of about 1e-9, and not many more.

    A filter ahead of a sort and limit: tasks then send about `most` rows together, not each.
    """
    return threshold(min(1.0, (most + 6 * most**0.5 + 36) / max(1, rows)))
