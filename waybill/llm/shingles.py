"""Weighted word shingles of texts, their ProbMinHash signatures and their exact similarity."""

from __future__ import annotations

import numpy as np

#: Words of a shingle. A shorter text with words has one shingle, all its words.
WORDS = 5
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _ODD[1]
        x = (x ^ (x >> np.uint64(27))) * _ODD[2]
        return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of some texts: text, 48-bit hash, weight (1 + ln of how often it occurs).

    Ordered by text, then hash. At most 65536 texts at once.
    """
    split = [r.split() for r in rows]
    length = np.fromiter(map(len, split), np.int64, len(rows))
    hashes = word_hashes([w for words in split for w in words])
    text = np.repeat(np.arange(len(rows)), length)
    with np.errstate(over="ignore"):
        last = len(hashes) - WORDS + 1
        inside = np.flatnonzero(text[:last] == text[WORDS - 1:]) if last > 0 else np.zeros(0, np.int64)
        key = np.zeros(len(inside), np.uint64)
        for k in range(WORDS):
            key = mix(key * _ODD[0] + hashes[inside + k])
        start = np.cumsum(length) - length
        few = np.flatnonzero((length > 0) & (length < WORDS))
        short = length[few].astype(np.uint64)
        for k in range(WORDS - 1):
            more = length[few] > k
            short[more] = mix(short[more] * _ODD[0] + hashes[start[few[more]] + k])
    packed = np.concatenate([(text[inside].astype(np.uint64) << np.uint64(48)) | (key >> np.uint64(16)),
                             (few.astype(np.uint64) << np.uint64(48)) | (short >> np.uint64(16))])
    packed.sort()
    first = np.flatnonzero(np.append(True, packed[1:] != packed[:-1])[:len(packed)])
    count = np.diff(np.append(first, len(packed)))
    packed = packed[first]
    return ((packed >> np.uint64(48)).astype(np.int64), packed & np.uint64((1 << 48) - 1), 1 + np.log(count))


def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """ProbMinHash: for each text the elements that came first to its registers (0 in a text without any).

    An element arrives as a Poisson process whose rate is its weight, at a random register each time, all
    drawn from the element alone. A register keeps its first arrival. A text's elements stop as soon as their next
    arrival is later than the last of its registers. The chance that a register of two texts holds the same
    element is their probability Jaccard.
    """
    best = np.full(n * registers, np.inf)
    held = np.zeros(n * registers, np.uint64)
    now = np.zeros(len(element))
    text, element, weight = text.copy(), element.copy(), weight.copy()
    arrival = 0
    while len(element):
        arrival += 1
        with np.errstate(over="ignore"):
            draw = mix(element * _ODD[0] + np.uint64(arrival) * _ODD[2])
        now = now - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 2 ** 53) / weight
        place = text * registers + (mix(draw) % np.uint64(registers)).astype(np.int64)
        early = now < best[place]
        at = place[early]
        np.minimum.at(best, at, now[early])
        first = now[early] == best[at]
        held[at[first]] = element[early][first]
        stop = best.reshape(n, registers).max(axis=1)
        goes_on = now < stop[text]
        now, text, element, weight = now[goes_on], text[goes_on], element[goes_on], weight[goes_on]
    return held.reshape(n, registers)


def similarity(a: np.ndarray, a_weight: np.ndarray, b: np.ndarray, b_weight: np.ndarray) -> float:
    """Probability Jaccard of two weighted sets (sorted elements, weights).

    For each common x it adds 1 / sum over y of max(a_y / a_x, b_y / b_x). In the order of a_y / b_y the maximum is the
    first term from x on and the second before it, so running sums give all of them.
    """
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = b[at] == a
    x, y = a_weight[both], b_weight[at[both]]
    only_a, only_b = a_weight.sum() - x.sum(), b_weight.sum() - y.sum()
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    from_here = np.cumsum(x[::-1])[::-1] + only_a
    before = np.cumsum(y) - y + only_b
    return float((1 / (from_here / x + before / y)).sum())
