"""Minimal perfect hash over byte-string digests (hash and displace).

Keys are 32-byte digests, already uniform, so the hashes are read straight from their bytes.
A bucket's keys try pilots until all land on free slots; the slot count equals the key count.
"""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _parts(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = np.ascontiguousarray(digests).view("<u8").reshape(-1, 4)
    return w[:, 1], w[:, 2]


def build(digests: np.ndarray) -> np.ndarray:
    """Pilots of a minimal perfect hash for distinct digests (n x 32 uint8)."""
    n = len(digests)
    n_buckets = max(1, n // 4)
    pilots = np.zeros(n_buckets, dtype=np.uint32)
    if n == 0:
        return pilots
    g, h = _parts(digests)
    bucket = (g % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=n_buckets)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    taken = np.zeros(n, dtype=bool)
    with np.errstate(over="ignore"):
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] == 0:
                break
            keys = h[order[starts[b] : starts[b + 1]]]
            base = 0
            while True:
                # 64 pilots at a time
                p = np.arange(base, base + 64, dtype=np.uint64)
                slots = (_mix(keys[None, :] ^ _mix(p + np.uint64(1))[:, None]) % np.uint64(n)).astype(np.int64)
                ok = ~taken[slots].any(axis=1)
                if sizes[b] > 1:
                    s = np.sort(slots, axis=1)
                    ok &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                hit = np.flatnonzero(ok)
                if len(hit):
                    pilots[b] = base + hit[0]
                    taken[slots[hit[0]]] = True
                    break
                base += 64
    return pilots


def slots(pilots: np.ndarray, n: int, digests: np.ndarray) -> np.ndarray:
    """Slot of each digest; a digest that was not among the keys gets some slot, so callers compare bytes."""
    if n == 0 or len(digests) == 0:
        return np.zeros(len(digests), dtype=np.int64)
    g, h = _parts(digests)
    with np.errstate(over="ignore"):
        p = pilots[(g % np.uint64(len(pilots))).astype(np.int64)].astype(np.uint64)
        return (_mix(h ^ _mix(p + np.uint64(1))) % np.uint64(n)).astype(np.int64)
