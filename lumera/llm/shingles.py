"""Hashes of words and word shingles, by numpy over whole batches of texts.

A word is a maximal run of bytes other than space and 09 to 0D. Its hash is a
polynomial over its bytes, taken as a difference of prefix sums, then mixed; a
shingle's hash is a mix of its words' hashes in order. All are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
BASE, TURN = U(0x9E3779B97F4A7C55), U(0xD6E8FEB86659FD93)
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes hashed at a time; a text is cut between words.
WINDOW = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for later."""
    global _kept
    if len(_kept[0]) < n:
        inverse = U(pow(int(BASE), -1, 1 << 64))
        _kept = tuple(np.concatenate([[U(1)], np.full(n - 1, b, U)]).cumprod(dtype=U) for b in (BASE, inverse))
    return _kept[0][:n], _kept[1][:n]


_kept: tuple[np.ndarray, np.ndarray] = (np.zeros(0, U), np.zeros(0, U))


def _hash_window(data: np.ndarray, word: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of one window; ``begins`` marks first bytes of texts."""
    before = np.concatenate([[False], word[:-1]]) & ~begins
    after = np.concatenate([(word & ~begins)[1:], [False]])
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * power[:-1], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * inverse[starts] ^ (ends - starts).astype(U) * TURN)


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts``, and the number of words before each text (one more entry than texts)."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    data = LOWER[data] if lower else data
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    word, at, found, places = IS_WORD[data], 0, [], []
    while at < len(data):
        stop = min(at + WINDOW, len(data))
        while stop < len(data):  # back to a gap, or on to one if the window is one word
            gaps = np.flatnonzero(~word[at:stop] | begins[at:stop])
            gaps = gaps[gaps > 0]
            if len(gaps):
                stop = at + int(gaps[-1])
                break
            stop = min(stop + WINDOW, len(data))
        starts, hashes = _hash_window(data[at:stop], word[at:stop], begins[at:stop])
        found.append(hashes)
        places.append(starts + at)
        at = stop
    hashes = np.concatenate(found) if found else np.zeros(0, U)
    places = np.concatenate(places) if places else np.zeros(0, np.int64)
    return hashes, np.searchsorted(places, offsets)


def shingle_hashes(texts: list[bytes], k: int, lower: bool = True) -> Iterator[np.ndarray]:
    """Hashes of the ``k``-word shingles of each text, in order and with repeats.

    A text of fewer words has its whole sequence as one shingle; a text without
    words has none.
    """
    words, counts = word_hashes(texts, lower)
    n = max(0, len(words) - k + 1)
    whole = np.full(n, k, U) * BASE
    for i in range(k):
        whole = mix(whole * TURN + words[i : i + n])
    for a, b in zip(counts[:-1].tolist(), counts[1:].tolist(), strict=True):
        if b - a >= k:
            yield whole[a : b - k + 1]
        elif b > a:
            one = np.full(1, b - a, U) * BASE
            for w in words[a:b]:
                one = mix(one * TURN + w)
            yield one
        else:
            yield np.zeros(0, U)


def text_slices(sizes: list[int], most: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` bytes, or a single text each."""
    begin = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield begin, len(sizes)
