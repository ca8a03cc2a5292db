"""MinHash signatures in bands, and how many bands a target recall takes."""

from __future__ import annotations

import math

import numpy as np

from tickerpulse.llm.textio import mix


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """The smallest number of bands of ``rows`` values by which a pair at the threshold meets with chance ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def band_hashes(values: np.ndarray, offsets: np.ndarray, bands: int, rows: int, seed: int = 41) -> np.ndarray:
    """One hash per set and band; the sets are not empty. ``values`` are 64-bit hashes, set i is
    ``values[offsets[i]:offsets[i + 1]]``."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 2**63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    terms = rng.integers(0, 2**63, (bands, rows), dtype=np.uint64)
    out = np.zeros((len(offsets) - 1, bands), np.uint64)
    if len(out):
        for b in range(bands):
            for r in range(rows):
                least = np.minimum.reduceat(values * factors[b, r] + terms[b, r], offsets[:-1])
                out[:, b] = mix(out[:, b] * np.uint64(31) + least)
    return out.view(np.int64)
