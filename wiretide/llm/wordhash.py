"""Hashes of words and word n-grams of many texts at once, in numpy."""

from __future__ import annotations

from functools import cache

import numpy as np
import xxhash

#: Bytes hashed at once.
PIECE = 2_000_000
BASE, STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
#: The step of a second hash of n-grams, and the key of the hash of a word; words of more bytes than LONG are hashed one by one.
CHECK_STEP, KEY, LONG = 0xAEF17502108EF2D9, 0x632BE59BD9B4E019, 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@cache
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64 for i below 2 ** bits."""
    n = 1 << bits
    return tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)))) for b in (base, pow(base, -1, 1 << 64)))


def _upto(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(base, max(12, (n + 1).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that lets every bit depend on every other."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a run of bytes. The length and then eight bytes at a time are mixed in, with a key, for all words
    together; words of at most eight bytes and equal length can't collide. Long words are hashed by XXH3."""
    word = ~_SPACE[data]
    edge = np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = ends - starts
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    h = mix(size.astype(np.uint64) * np.uint64(BASE) ^ np.uint64(KEY))
    at, done = np.flatnonzero(size <= LONG), 0
    while at.size:
        left = size[at] - done
        h[at] = mix(h[at] ^ (eight[starts[at] + done] & _MASKS[np.minimum(left, 8)]))
        at, done = at[left > 8], done + 8
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), KEY)
    return h, starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after another, and where each text's begin; one more entry is the end.

    Texts are taken together up to PIECE bytes; a longer one is cut at white space (or, for a word of that length, taken whole).
    """
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    group: list[int] = []

    def flush() -> None:
        if not group:
            return
        found, at = _words(np.frombuffer(b"\n".join(texts[i] for i in group), np.uint8))
        bounds = np.cumsum([len(texts[i]) + 1 for i in group])
        hashes.append(found)
        counts[group] += np.bincount(np.searchsorted(bounds, at, side="right"), minlength=len(group))
        group.clear()

    size = 0
    for i, text in enumerate(texts):
        if size + len(text) > PIECE:
            flush()
            size = 0
        if len(text) <= PIECE:
            group.append(i)
            size += len(text) + 1
            continue
        data, at = np.frombuffer(text, np.uint8), 0
        while at < len(data):
            to = min(len(data), at + PIECE)
            if to < len(data):
                gaps = np.flatnonzero(_SPACE[data[at:to]])
                if gaps.size:
                    to = at + int(gaps[-1]) + 1
                else:
                    later = np.flatnonzero(_SPACE[data[to:]])
                    to = to + int(later[0]) if later.size else len(data)
            found, _ = _words(data[at:to])
            hashes.append(found)
            counts[i] += len(found)
            at = to
    flush()
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum(counts)))


def ngrams(words: np.ndarray, n: int, step: int = STEP) -> np.ndarray:
    """Hash of the n words from each place on, for all places but the last n - 1."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    power, inverse = _upto(step, len(words))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * power[: len(words)])))
    m = len(words) - n + 1
    return mix((total[n:] - total[:m]) * inverse[:m])


def starts_within(offsets: np.ndarray, n: int) -> np.ndarray:
    """For each place of ngrams(): whether its n words are of one text."""
    total = int(offsets[-1])
    if total < n:
        return np.zeros(0, bool)
    out = np.zeros(total + 1, np.int32)
    sizes = np.diff(offsets)
    has = sizes >= n
    np.add.at(out, offsets[:-1][has], 1)
    np.add.at(out, offsets[1:][has] - n + 1, -1)
    return np.cumsum(out)[: total - n + 1] > 0
