"""Word shingles of whole texts as sets of 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

#: Fixed odd constants of the mixing steps.
A, B, C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_S31, _S29, _S32 = np.uint64(31), np.uint64(29), np.uint64(32)

_spaces = np.zeros(256, bool)
_spaces[[32, *range(9, 14)]] = True
_value = (np.arange(256, dtype=np.uint64) + C) * A
_value[65:91] = _value[97:123]
_value = (_value ^ (_value >> _S31)) * B
#: A hash of each byte, A-Z as a-z; 0 for white space.
BYTE = np.where(_spaces, np.uint64(0), _value ^ (_value >> _S29))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S31)) * A
    x = (x ^ (x >> _S29)) * B
    return x ^ (x >> _S32)


_powers: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, for at least n places."""
    if not _powers or len(_powers[0][0]) < n:
        odd = 0xD6E8FEB86659FD93
        pair = []
        for factor in (odd, pow(odd, -1, 1 << 64)):
            run = np.full(max(n, 1 << 20), factor, np.uint64)
            run[0] = 1
            pair.append(np.cumprod(run, dtype=np.uint64))
        _powers[:] = [tuple(pair)]
    return _powers[0]


def span_hashes(values: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans, equal for equal spans wherever they stand: differences of a prefix sum, scaled back."""
    n = len(values)
    base, inverse = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * base[:n], out=total[1:])
    return mix((total[stops] - total[begins]) * inverse[begins] + (stops - begins).astype(np.uint64) * C)


#: Bytes whose words are hashed at once; a longer word is hashed alone.
SEGMENT = 1 << 20


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of each run without white space, segment by segment, so that long texts need little more than their words."""
    hashes, places = [], []
    low, n = 0, len(data)
    while low < n:
        high = min(n, low + SEGMENT)
        while high < n and not _spaces[data[high]]:
            # To the next white space: in steps, as a word is rarely long.
            step = np.flatnonzero(_spaces[data[high : high + 4096]])
            high = high + int(step[0]) if len(step) else min(n, high + 4096)
        part = data[low:high]
        solid = ~_spaces[part]
        change = np.flatnonzero(solid[1:] != solid[:-1]) + 1
        if solid[0]:
            change = np.concatenate([[0], change])
        if solid[-1]:
            change = np.concatenate([change, [len(part)]])
        begins, stops = change[::2], change[1::2]
        hashes.append(span_hashes(BYTE[part], begins, stops))
        places.append(begins + low)
        low = high
    return (np.concatenate(hashes), np.concatenate(places)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def shingle_sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct shingles of text i, sorted, are hashes[bounds[i] : bounds[i + 1]].

    Words are runs without ASCII white space, A-Z lower-cased. A text with fewer than ``words`` words has its whole
    sequence as one shingle; one without words, or null, the empty set.
    """
    n = len(texts)
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum(np.fromiter(map(len, raws), np.int64, n) + 1)
    word, begins = words_of(np.frombuffer(b"\n".join(raws) + b"\n", np.uint8))
    owner = np.searchsorted(ends, begins, side="right")
    count = np.bincount(owner, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    out, sizes = [], np.zeros(n, np.int64)
    if len(word) >= words:
        many = word[: len(word) - words + 1].copy()
        for k in range(1, words):
            many = mix(many * C + word[k : len(word) - words + 1 + k])
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b - a >= words:
            own = np.sort(many[a : b - words + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif b > a:
            short = word[a:a + 1].copy()
            for k in range(a + 1, b):
                short = mix(short * C + word[k : k + 1])
            own = mix(short + np.array([b - a], np.uint64) * B)
        else:
            continue
        sizes[i] = len(own)
        out.append(own)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])
