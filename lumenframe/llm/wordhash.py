"""Words of many texts at once as 64-bit hashes, in numpy.

A word is what stands between ASCII white space, A-Z lower-cased, as UTF-8 bytes. Its hash is a sum over
its bytes times a random odd multiplier per position, mixed with its length; equal words have equal hashes, and different
ones differ but for one chance in 2**64 or so.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Bytes of text handled at once; a longer text is handled alone.
GROUP_BYTES = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Words(NamedTuple):
    """Words of a group of texts in order: their hashes, and for each text the number of words before it."""

    hashes: np.ndarray  # uint64
    offsets: np.ndarray  # one more than texts
    starts: np.ndarray  # byte position of each word in ``data``
    ends: np.ndarray
    data: np.ndarray  # lower-cased bytes of all texts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    start = np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start)


def groups(texts: list, limit: int = GROUP_BYTES):
    """(index of the first, texts as bytes) of consecutive texts of about ``limit`` bytes together."""
    held, size, first = [], 0, 0
    for i, text in enumerate(texts):
        data = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if held and size + len(data) > limit:
            yield first, held
            held, size, first = [], 0, i
        held.append(data)
        size += len(data) + 1
    if held:
        yield first, held


def words(texts: list[bytes], salt: int = 0) -> Words:
    """All words of the texts. Another ``salt`` gives other hashes."""
    data = np.frombuffer(b"".join(t.lower() + b" " for t in texts), dtype=np.uint8)
    space = _SPACE[data]
    before = np.empty_like(space)
    before[:1] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(space & ~before)
    limits = np.cumsum([0] + [len(t) + 1 for t in texts])
    offsets = np.searchsorted(starts, limits)
    if not len(starts):
        return Words(np.zeros(0, dtype=np.uint64), offsets, starts, ends, data)
    body = data[~space]
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(body), dtype=np.int32) - np.repeat(first.astype(np.int32), lengths)
    factors = seeds(int(lengths.max()), 11 + 1000 * salt) | np.uint64(1)
    terms = (body.astype(np.uint64) + np.uint64(1)) * factors[place]
    hashes = mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return Words(hashes, offsets, starts, ends, data)


def shingles(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and the offsets of the texts.

    A shingle is ``width`` consecutive words; a text of fewer words is one shingle, one without words has none.
    """
    n = np.diff(w.offsets)
    factors = seeds(width, 23) | np.uint64(1)
    rolled = np.zeros(max(0, len(w.hashes) - width + 1), dtype=np.uint64)
    for k in range(width):
        rolled += w.hashes[k : k + len(rolled)] * factors[k]
    rolled = mix(rolled)
    out, sizes = [], np.zeros(len(n), dtype=np.int64)
    for i, (start, count) in enumerate(zip(w.offsets[:-1].tolist(), n.tolist())):
        if count >= width:
            own = np.unique(rolled[start : start + count - width + 1])
        elif count:
            short = w.hashes[start : start + count]
            own = mix(np.array([(short * factors[:count]).sum(dtype=np.uint64) + np.uint64(count)], dtype=np.uint64))
        else:
            continue
        out.append(own)
        sizes[i] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)), np.concatenate(([0], np.cumsum(sizes)))
