"""Word and word-window hashes of whole texts, vectorised inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

MIX = np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: str | None, lower: bool) -> list[bytes]:
    """Runs of anything but ASCII white space, as UTF-8; with lower, A-Z alone are lower-cased."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    own = xxhash.xxh3_64_intdigest
    return np.fromiter((own(w, seed) for w in words) if seed else map(own, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX
    return h ^ (h >> np.uint64(31))


def window_hashes(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """A 64-bit hash for each run of width consecutive hashes: a polynomial put together from runs of powers of two."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        size, have, out, done = 1, h, None, 0
        while True:
            if width & size:
                out = have if out is None else out[: len(have) - done] * pow_mod(base, size) + have[done:]
                done += size
            size *= 2
            if size > width:
                return mix(out)
            have = have[: max(0, len(have) - size // 2)] * pow_mod(base, size // 2) + have[size // 2 :]


def pow_mod(base: int, n: int) -> np.uint64:
    return np.uint64(pow(base, n, 1 << 64))
