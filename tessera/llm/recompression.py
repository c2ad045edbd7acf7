"""Rounds of recompression over token streams.

Each round names runs of equal symbols and then pairs of adjacent symbols: a name is a 64-bit hash of what it stands
for, so that equal content gets an equal name in every document and partition without a global dictionary.  A pair is
named where its first symbol falls, by a bit of its own name, into the left half of the alphabet and its second symbol
into the right half.

Each symbol carries the interval of words that decided it (``lo`` to ``hi``): the words it stands for and the neighbours
that were looked at.  If this interval lies in a window of words, every other occurrence of the window has the same
symbol at the same offset.  The *anchor* of a window is chosen among such symbols, those of high levels first, so
equal windows have equal anchors, without exception.
"""

from __future__ import annotations

import numpy as np

from tessera.llm.common import mix

OUTSIDE = 1 << 40
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Rounds that name runs before they name pairs.
RUN_ROUNDS = (0, 4)
ROUNDS = 7


def rounds(tokens: np.ndarray, document: np.ndarray, width: int) -> list[tuple[np.ndarray, ...]]:
    """(names, lo, hi, words stood for) of each level, the words themselves first, of symbols decided by ``width`` words at most.

    ``document`` is a non-decreasing number for each word; no symbol goes over its changes.
    """
    place = np.arange(len(tokens), dtype=np.int64)
    name, lo, hi, doc, begin = tokens, place, place, document, place
    levels = [(name, lo, hi, np.ones(len(name), np.int64))]
    for t in range(ROUNDS):
        if len(name) < 2:
            break
        salt = np.uint64((2 * t + 1) * int(BASE) & (1 << 64) - 1)
        if t in RUN_ROUNDS:
            new = np.ones(len(name), bool)
            new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(name)))
            last = first + count - 1
            before, after = np.maximum(first - 1, 0), np.minimum(last + 1, len(name) - 1)
            left = np.where((first > 0) & (doc[before] == doc[first]), lo[before], -OUTSIDE)
            right = np.where((last + 1 < len(name)) & (doc[after] == doc[last]), hi[after], OUTSIDE)
            name = np.where(count > 1, mix(name[first] ^ mix(count.astype(np.uint64) + salt)), name[first])
            lo, hi, doc, begin = np.minimum(left, lo[first]), np.maximum(right, hi[last]), doc[first], begin[first]
        side = (mix(name + salt) >> np.uint64(17)) & np.uint64(1)
        n = len(name)
        inner = np.empty(n, bool)  # the next symbol is of the same document
        inner[-1] = False
        inner[:-1] = doc[1:] == doc[:-1]
        right = side == 1
        opens = np.zeros(n, bool)
        opens[:-1] = ~right[:-1] & right[1:] & inner[:-1]
        closes = np.zeros(n, bool)
        closes[1:] = opens[:-1]
        # an unpaired left symbol looked at the next, an unpaired right symbol at the one before
        new_lo, new_hi = lo.copy(), hi.copy()
        alone = np.flatnonzero(right & ~closes)
        new_lo[alone] = np.where((alone > 0) & inner[alone - 1], np.minimum(lo[alone], lo[alone - 1]), -OUTSIDE)
        alone = np.flatnonzero(~right & ~opens)
        follow = np.minimum(alone + 1, n - 1)
        new_hi[alone] = np.where(inner[alone], np.maximum(hi[alone], hi[follow]), OUTSIDE)
        head = np.flatnonzero(opens)
        new_hi[head] = np.maximum(hi[head], hi[head + 1])
        new_lo[head] = np.minimum(lo[head], lo[head + 1])
        name = name.copy()
        name[head] = mix(mix(name[head] + salt) * BASE ^ name[head + 1])
        keep = ~closes
        name, lo, hi, doc, begin = name[keep], new_lo[keep], new_hi[keep], doc[keep], begin[keep]
        span = np.diff(np.append(begin, len(tokens)))
        fits = hi - lo < width
        if not fits.any():
            break
        levels.append((name[fits], lo[fits], hi[fits], span[fits]))
    return levels


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by running minima from both ends of blocks of that width."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    from_left = np.minimum.accumulate(blocks, axis=1).ravel()
    from_right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(from_right[: n - width + 1], from_left[width - 1 : n])


def anchors(tokens: np.ndarray, document: np.ndarray, width: int) -> np.ndarray:
    """The anchor of each window of ``width`` words, by the place where the window begins.

    Symbols count whose interval has ``reach`` words at most and begins where it surely ends inside the window; those
    that stand for more words go before others, and among them the least name is taken.
    """
    reach = max(1, 2 * width // 5)
    best = np.full(len(tokens), np.iinfo(np.uint64).max, np.uint64)
    for name, lo, hi, span in rounds(tokens, document, reach):
        rank = np.where(span >= reach // 3, 0, np.where(span >= max(2, reach // 6), 1, 2)).astype(np.uint64)
        np.minimum.at(best, lo, rank << np.uint64(62) | mix(name + span.astype(np.uint64)) >> np.uint64(2))
    return sliding_minimum(best, width - reach + 1) if len(tokens) >= width else np.zeros(0, np.uint64)


def prefix_sums(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and inverse powers from which ``span_hash`` takes the hash of any stretch of words."""
    power = np.full(len(tokens) + 1, BASE, np.uint64)
    power[0] = 1
    inverse = np.full(len(tokens) + 1, INVERSE, np.uint64)
    inverse[0] = 1
    np.multiply.accumulate(power, out=power)
    np.multiply.accumulate(inverse, out=inverse)
    sums = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(mix(tokens) * power[:-1], out=sums[1:])
    return sums, inverse


def span_hash(sums: np.ndarray, inverse: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words from ``begin`` to before ``end``, the same wherever they stand."""
    return mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
