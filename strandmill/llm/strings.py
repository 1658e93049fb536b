"""Gap-weighted subsequence kernel between short strings, and its Nystroem map."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

#: Length of the common subsequences, decay per letter and gap, longest unit taken whole.
ORDER, DECAY, UNIT = 4, 0.6, 24
#: The normalised kernel is raised to this power, which keeps it a kernel and sets
#: strings with a part of a landmark farther apart from those with all of it.
POWER = 2
#: Bits of a landmark's field in the packed comparison; one is a guard.
FIELD = 16


def codes(strings: Sequence[str]) -> np.ndarray:
    """Code points by row, 0 where a string has ended; at most UNIT each."""
    width = min(max(map(len, strings), default=1), UNIT) or 1
    flat = "".join(s[:width].ljust(width, "\0") for s in strings)
    return np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(strings), width)


def subsequence_kernel(s: np.ndarray, t: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Kernel of each pair of rows: the sum over common subsequences of ``order``
    letters of decay to the power of the two spans they cover."""
    rows, n, m = len(s), s.shape[1], t.shape[1]
    # before[q][j]: weight of common subsequences of q letters in s[:i], t[:j], up to the ends of both.
    before = [np.ones((rows, m + 1))] + [np.zeros((rows, m + 1)) for _ in range(order - 1)]
    total = np.zeros(rows)
    for i in range(n):
        equal = (s[:, i : i + 1] == t) & (t != 0)
        if not equal.any():
            for q in range(1, order):
                before[q] = before[q] * decay
            continue
        total += (decay * decay * before[order - 1][:, :m] * equal).sum(axis=1)
        after = [before[0]]
        for q in range(1, order):
            gain = decay * decay * before[q - 1][:, :m] * equal
            run = np.zeros(rows)
            new = before[q] * decay
            for j in range(m):
                run = decay * run + gain[:, j]
                new[:, j + 1] += run
            after.append(new)
        before = after
    return total


@dataclass
class LandmarkKernel:
    """Kernel values of strings against fixed landmarks.

    A packed bit-vector pass finds the longest common subsequence with every
    landmark at once; where it is shorter than the kernel's order, the kernel is 0.
    Landmarks hold from ORDER to FIELD - 1 letters.
    """

    landmarks: list[str]
    own: np.ndarray = field(init=False)
    root: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        if not all(ORDER <= len(mark) < FIELD for mark in self.landmarks):
            raise ValueError(f"landmarks need {ORDER} to {FIELD - 1} letters")
        marks = codes(self.landmarks)
        n = len(self.landmarks)
        left, right = np.repeat(np.arange(n), n), np.tile(np.arange(n), n)
        gram = subsequence_kernel(marks[left], marks[right]).reshape(n, n)
        self.own = np.maximum(np.diag(gram), 1e-12)
        gram = (gram / np.sqrt(self.own[:, None] * self.own[None])) ** POWER
        values, vectors = np.linalg.eigh(gram)
        kept = values > 1e-6
        self.root = (vectors[:, kept] / np.sqrt(values[kept])) @ vectors[:, kept].T
        self._marks = marks
        self._lengths = np.array(list(map(len, self.landmarks)))
        per = 64 // FIELD
        columns = -(-n // per)
        self._alphabet = np.unique(marks[marks > 0])
        self._masks = np.zeros((len(self._alphabet) + 1, columns), np.uint64)
        self._full = np.zeros(columns, np.uint64)
        for k, mark in enumerate(self.landmarks):
            for j, letter in enumerate(mark):
                bit = np.uint64(1) << np.uint64(FIELD * (k % per) + j)
                self._full[k // per] |= bit
                self._masks[np.searchsorted(self._alphabet, ord(letter)) + 1, k // per] |= bit

    def common(self, s: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of each row with each landmark."""
        at = np.searchsorted(self._alphabet, s)
        at = np.where(self._alphabet[np.minimum(at, len(self._alphabet) - 1)] == s, at + 1, 0)
        left = np.broadcast_to(self._full, (len(s), len(self._full))).copy()
        for i in range(s.shape[1]):
            hit = left & self._masks[at[:, i]]
            left = ((left + hit) | (left - hit)) & self._full
        per, out = 64 // FIELD, np.empty((len(s), len(self.landmarks)), np.int64)
        for k in range(len(self.landmarks)):
            bits = (left[:, k // per] >> np.uint64(FIELD * (k % per))) & np.uint64((1 << int(self._lengths[k])) - 1)
            out[:, k] = self._lengths[k] - np.bitwise_count(bits)
        return out

    def values(self, strings: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the strings with a value that is not zero, and their values."""
        s = codes(strings)
        near = self.common(s) >= ORDER
        rows, marks = np.nonzero(near)
        if not len(rows):
            return np.zeros(0, np.int64), np.zeros((0, len(self.landmarks)))
        kernel = np.concatenate([subsequence_kernel(s[rows[a : a + 4000]], self._marks[marks[a : a + 4000]]) for a in range(0, len(rows), 4000)])
        hit, place = np.unique(rows, return_inverse=True)
        out = np.zeros((len(hit), len(self.landmarks)))
        out[place, marks] = np.minimum(kernel / self.own[marks], 1.0) ** POWER
        return hit, out
