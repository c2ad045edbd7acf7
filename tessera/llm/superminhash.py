"""SuperMinHash signatures of sets of 64-bit hashes, for many sets at once.

Each element walks through its own random permutation of the slots; at step j it offers the value j + r to the slot that
the permutation names, and a slot keeps the least value.  All elements take step j before any takes step j + 1, so a set
whose slots are all filled is finished: a later offer is larger than all that it has (the early stop).
"""

from __future__ import annotations

import numpy as np

from tessera.llm.common import mix

EMPTY = np.uint32(0xFFFFFFFF)
#: Steps whose slots are found by looking back through the swaps; later ones keep the permutations.
LOOK_BACK = 12


def signatures(elements: np.ndarray, counts: np.ndarray, slots: int) -> np.ndarray:
    """One row of ``slots`` (255 at most) values for each set.  ``elements``: distinct hashes, set after set; ``counts``: sizes, none 0."""
    sets = len(counts)
    out = np.full(sets * slots, EMPTY, np.uint32)
    owner = np.repeat(np.arange(sets, dtype=np.int64), counts)
    left = np.arange(len(elements))
    swaps: list[np.ndarray] = []
    order = None
    for j in range(slots):
        drawn = mix(elements[left] + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        k = (j + ((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)).astype(np.uint8)
        if j < LOOK_BACK:
            slot = k.copy()
            for t in range(j - 1, -1, -1):
                slot[slot == swaps[t]] = t
            swaps.append(k)
        else:
            if order is None:
                order = np.tile(np.arange(slots, dtype=np.uint8), (len(left), 1))
                rows = np.arange(len(left))
                for t, by in enumerate(swaps):
                    order[rows, t], order[rows, by] = order[rows, by], order[rows, t].copy()
            rows = np.arange(len(left))
            slot = order[rows, k]
            order[rows, k] = order[rows, j]
            order[rows, j] = slot
        np.minimum.at(out, owner[left] * slots + slot, np.uint32(j << 24) | (drawn >> np.uint64(40)).astype(np.uint32))
        unfilled = (out.reshape(sets, slots) == EMPTY).any(axis=1)
        if not unfilled.any():
            break
        stay = unfilled[owner[left]]
        if not stay.all():
            left = left[stay]
            swaps = [x[stay] for x in swaps] if order is None else swaps
            order = order[stay] if order is not None else None
    return out.reshape(sets, slots)
