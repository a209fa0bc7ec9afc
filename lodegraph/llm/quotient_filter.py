"""A counting quotient filter in numpy.

A fingerprint of `width` bits splits into a quotient (its high `bits` bits, the home slot) and a remainder (the rest).
Remainders of one quotient form a run, in rising order; runs that push each other on form clusters. Each slot has three
bits: `OCCUPIED` (some fingerprint has this slot's number as its quotient), `CONTINUATION` (the slot goes on with the run
of the slot before) and `SHIFTED` (the slot's content is not at home). A slot holds a remainder or, with its top bit set,
one less than the count of the remainder before it; remainders that occur once have no such slot.

Quotient and remainder together are the fingerprint, so a filter gives back all its fingerprints and counts, and filters
of any sizes merge without loss.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

OCCUPIED, CONTINUATION, SHIFTED = 1, 2, 4
COUNT = np.uint64(1 << 63)
LOAD = 0.75


def summed(fps: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different fingerprints in rising order, and the sums of their counts."""
    order = np.argsort(fps, kind="stable")  # merges sorted stretches
    fps, counts = fps[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], fps[1:] != fps[:-1]])) if len(fps) else np.zeros(0, np.int64)
    return fps[new], np.add.reduceat(counts, new) if len(new) else counts


class QuotientFilter:
    def __init__(self, width: int, bits: int, slots: np.ndarray, marks: np.ndarray):
        self.width, self.bits, self.slots, self.marks = width, bits, slots, marks

    @staticmethod
    def build(fps: np.ndarray, counts: np.ndarray, width: int) -> QuotientFilter:
        """Of different fingerprints in rising order, in one pass."""
        n = len(fps) + int((counts > 1).sum())
        bits = min(width - 1, max(3, int(np.ceil(np.log2(max(n, 1) / LOAD)))))
        low = np.uint64(width - bits)
        quotient = (fps >> low).astype(np.int64)
        # a slot for each remainder, and one for each count over one
        many = counts > 1
        at = np.arange(len(fps)) + np.cumsum(many) - many
        values, home = np.zeros(n, np.uint64), np.zeros(n, np.int64)
        values[at], home[at] = fps & np.uint64((1 << int(low)) - 1), quotient
        values[at[many] + 1], home[at[many] + 1] = (counts[many] - 1).astype(np.uint64) | COUNT, quotient[many]
        # every slot's content lies at home, or after what came before it
        place = np.arange(n) + np.maximum.accumulate(home - np.arange(n)) if n else home
        slots = np.zeros(max(1 << bits, int(place[-1]) + 1 if n else 0), np.uint64)
        marks = np.zeros(len(slots), np.uint8)
        slots[place] = values
        marks[place] |= np.where(np.concatenate([[False], home[1:] == home[:-1]]), CONTINUATION, 0).astype(np.uint8) if n else 0
        marks[place] |= np.where(place != home, SHIFTED, 0).astype(np.uint8)
        marks[home] |= OCCUPIED
        return QuotientFilter(width, bits, slots, marks)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """All fingerprints, in rising order, and their counts."""
        used = np.flatnonzero(self.marks)
        # the runs come in the order of the quotients that are occupied
        run = np.cumsum(self.marks[used] & CONTINUATION == 0) - 1
        quotient = np.flatnonzero(self.marks & OCCUPIED)[run].astype(np.uint64)
        values = self.slots[used]
        count = values >= COUNT
        counts = np.ones(len(used), np.int64)
        if count.any():
            counts[np.flatnonzero(count) - 1] += (values[count] & ~COUNT).astype(np.int64)
        fps = quotient << np.uint64(self.width - self.bits) | values
        return fps[~count], counts[~count]

    def count(self, fp: int) -> int:
        """How often a fingerprint was put in: from its run alone."""
        low = self.width - self.bits
        quotient, rest = fp >> low, fp & ((1 << low) - 1)
        if not self.marks[quotient] & OCCUPIED:
            return 0
        start = quotient
        while self.marks[start] & SHIFTED:  # to the start of the cluster
            start -= 1
        runs = int(np.count_nonzero(self.marks[start : quotient + 1] & OCCUPIED))
        at = start - 1
        while runs:  # to the start of the run
            at += 1
            runs -= not self.marks[at] & CONTINUATION
        while True:
            if int(self.slots[at]) == rest:
                more = at + 1 < len(self.slots) and self.slots[at + 1] >= COUNT and self.marks[at + 1] & CONTINUATION
                return 1 + int(self.slots[at + 1] & ~COUNT) if more else 1
            at += 1
            if at >= len(self.slots) or not self.marks[at] & CONTINUATION:
                return 0

    @staticmethod
    def merge(filters: Iterable[QuotientFilter], width: int) -> QuotientFilter:
        """The filter of all their fingerprints: sorted remainders side by side, counts added."""
        both = [f.items() for f in filters]
        fps = np.concatenate([np.zeros(0, np.uint64), *(f for f, _ in both)])
        return QuotientFilter.build(*summed(fps, np.concatenate([np.zeros(0, np.int64), *(c for _, c in both)])), width)
