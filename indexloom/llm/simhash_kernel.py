"""Fingerprints of texts, in plain Python and numpy."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from xxhash import xxh64_intdigest

SEED = 42
#: Shingles hashed and counted at a time; bounds the memory that a very long text takes.
BLOCK = 1 << 16


def shingle_hashes(text: str | None, width: int = 3):
    """Blocks of the XXH64 of each shingle; a text of fewer words than ``width`` is one shingle, of none has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    if len(words) < width:
        yield np.array([xxh64_intdigest(joined, SEED)], dtype=np.uint64)
        return
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    last = ends[width - 1 :]
    for at in range(0, len(last), BLOCK):
        upto = last[at : at + BLOCK]
        yield np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at:], upto)), np.uint64, len(upto))


def fingerprint(text: str | None, width: int = 3) -> int:
    """64 bits, signed; a bit is 1 if it is set in over half the shingles' hashes; 0 for a text without words."""
    votes, total = np.zeros(64, dtype=np.int64), 0
    for h in shingle_hashes(text, width):
        votes += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(h)
    bits = np.packbits(2 * votes > total, bitorder="little") if total else np.zeros(8, np.uint8)
    return int(bits.view("<i8")[0])
