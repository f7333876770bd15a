"""Row-wise conversions; they agree with exprs.py, and serve payloads and multi-line entries."""

from __future__ import annotations

import re

_INT = re.compile(r"[+-]?[0-9]+\Z", re.ASCII)
_FLOAT = re.compile(r"[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|inf|infinity|nan)\Z", re.ASCII | re.IGNORECASE)
_HEX = re.compile(r"[+-]?0x[0-9a-f]*\.?[0-9a-f]*p[+-]?[0-9]+\Z", re.ASCII | re.IGNORECASE)


def to_int(s: str) -> int | None:
    if not _INT.match(s):
        return None
    v = int(s)
    return v if -(2**63) <= v < 2**63 else None


def to_float(s: str) -> float | None:
    try:
        if _HEX.match(s):
            return float.fromhex(s)
        if not _FLOAT.match(s):
            return None
        v = float(s)
    except (ValueError, OverflowError):
        return None
    if v in (float("inf"), float("-inf")) and "inf" not in s.lower():
        return None
    return v
