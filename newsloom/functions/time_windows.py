"""Window lengths written as text."""

from __future__ import annotations

import re

#: Microseconds of a unit.
UNITS = {"h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}


def parse_window(text: str) -> int:
    """``4h``, ``1d`` or ``1w`` (any number, either case) in microseconds. Other texts and zero lengths raise ValueError."""
    found = re.fullmatch(r"([0-9]+)([hdw])", text.lower())
    if not found or not int(found[1]):
        raise ValueError(f"not a window length: {text!r}; use a number and h, d or w, such as 1h, 4h, 1d, 1w")
    return int(found[1]) * UNITS[found[2]]
