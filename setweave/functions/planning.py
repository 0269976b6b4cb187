"""Sizes that are known before any data is read: sketch shapes, payloads, bytes, capacities."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

#: Cells per key at which peeling succeeds, for 3 to 7 repetitions.
CELLS_PER_KEY = {3: 1.222, 4: 1.295, 5: 1.425, 6: 1.570, 7: 1.721}


class OptionError(ValueError):
    """An option is out of its range."""


class IncompatibleError(ValueError):
    """Two sketches differ in shape or seeds."""


class UnpeelableError(ValueError):
    """A difference is too large for its sketch."""


@dataclass(frozen=True)
class IbltSpec:
    """Shape of an invertible Bloom lookup table for keys of ``length`` bases.

    ``n`` is the number of keys it must be able to list, ``r`` the number of rows, ``epsilon`` the spare room, ``seed`` that of the
    first row's hash. ``check`` adds a checksum word to each cell, which keeps false pure cells from being listed.
    """

    length: int
    n: int
    r: int = 3
    epsilon: float = 0.0
    seed: int = 42
    check: bool = False

    def __post_init__(self):
        if not 3 <= self.r <= 7:
            raise OptionError("r must be 3 to 7")
        if self.n <= 0:
            raise OptionError("n must be positive")
        if self.epsilon < 0:
            raise OptionError("epsilon must not be negative")
        if not 1 <= self.length <= 255:
            raise OptionError("keys have 1 to 255 bases")

    @property
    def chunk(self) -> int:
        """Cells of one row, in single precision."""
        f = np.float32
        return int(math.ceil(f(f(f(CELLS_PER_KEY[self.r]) + f(self.epsilon)) * f(self.n) / f(self.r)) + f(1)))

    @property
    def wsize(self) -> int:
        return (2 * self.length + 7) // 8

    @property
    def words(self) -> list[str]:
        """Columns of a packed key: one long for each eight of its bytes, the first the highest."""
        return ["key", *(f"key{i}" for i in range(1, (self.wsize + 7) // 8))]

    @property
    def seeds(self) -> list[int]:
        return [self.seed + i for i in range(self.r)]

    @property
    def sketch_bytes(self) -> int:
        return self.r * (self.chunk * (self.wsize + 8) + 4) + 1 + 4 + 8 + 1

    def compatible(self, other: IbltSpec) -> bool:
        return (self.r, self.chunk, self.seeds, self.check) == (other.r, other.chunk, other.seeds, other.check)


def payload_length(mode: str, k: int, m: int = 0) -> int:
    """Bases of a stored key, by what the tokens are."""
    lengths = {"kmers": k, "syncmers": k, "minimizers": 2 * k - m, "segmentation": 2 * k}
    if mode not in lengths:
        raise OptionError(f"unknown mode {mode}")
    return lengths[mode]


def capacity_for_bytes(size: int, length: int, r: int = 3, epsilon: float = 0.0) -> int:
    """Keys that a sketch of at most ``size`` bytes can list."""
    cell = (2 * length + 7) // 8 + 8
    chunk = (size - 14 - 4 * r) / r / cell
    return max(0, int((chunk - 1) * r / (CELLS_PER_KEY[r] + epsilon)))


def sampled_size(n: float, k: int, z: int, rate: float) -> float:
    """Expected syncmers of n k-mers after sampling one in ``rate``."""
    return n / ((k - z + 1) / 2 * rate)


def expected_difference(substitutions: int, insertions: int, deletions: int, indel_length: int, k: int) -> int:
    """At most so many k-mers differ between a sequence and its mutant."""
    return 2 * k * (substitutions + insertions + deletions) + abs(indel_length)


def minhash_size_for_bytes(size: int, width: int = 8) -> int:
    return max(0, (size - 13) // width)
