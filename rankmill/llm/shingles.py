"""Sets of word shingles as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit integers whose high and low bits all depend on every bit of the input."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All texts' words as bytes, A-Z in lower case, cut at ASCII white space, and the texts' offsets."""
    words, at = [], [0]
    for text in texts.to_pylist():
        own = (text or "").encode("utf-8", "surrogatepass").lower().split()
        words += own
        at.append(len(words))
    return pa.array(words, pa.binary()), np.array(at, np.int64)


def rolled(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash for every run of n words, wherever it begins; a hash for every word; and the texts' offsets among words."""
    words, at = word_lists(texts)
    coded = words.dictionary_encode()
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h = known[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
    runs = np.zeros(max(0, len(h) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            runs = mix(runs * _ODD + h[k : k + len(runs)])
    return runs, h, at


def occurrences(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All n-word shingles of the texts, as often as they occur, flat; and how many each text has."""
    runs, h, at = rolled(texts, n)
    document = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return runs[document[: len(runs)] == document[n - 1 :][: len(runs)]], np.maximum(np.diff(at) - n + 1, np.minimum(np.diff(at), 1))


def sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct n-word shingles, flat and sorted within a text, and the texts' offsets.

    A text with fewer words has its whole sequence as one; without words its set is empty.
    """
    runs, h, at = rolled(texts, n)
    count = np.diff(at)
    found, ends = [], np.zeros(len(count) + 1, np.int64)
    for d, (a, m) in enumerate(zip(at[:-1].tolist(), count.tolist(), strict=True)):
        if m >= n:
            own = np.sort(runs[a : a + m - n + 1])
            if len(own) > 1:
                new = own[1:] != own[:-1]
                own = own if new.all() else own[np.r_[True, new]]
            found.append(own)
        elif m:
            x = np.full(1, m, np.uint64)
            for w in h[a : a + m]:
                with np.errstate(over="ignore"):
                    x = mix(x * _ODD + w)
            found.append(x)
        else:
            found.append(np.zeros(0, np.uint64))
        ends[d + 1] = ends[d] + len(found[-1])
    return np.concatenate(found) if found else np.zeros(0, np.uint64), ends
