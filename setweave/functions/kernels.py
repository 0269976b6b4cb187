"""Positions of minimizers and syncmers in one sequence, by array arithmetic."""

from __future__ import annotations

import numpy as np

U = np.uint64
_CODE = np.full(256, 4, np.uint8)
for _bases, _value in ((b"Aa", 0), (b"Cc", 1), (b"Gg", 2), (b"TtUu", 3)):
    _CODE[list(_bases)] = _value


def codes(seq: bytes) -> np.ndarray:
    """0 to 3 for a base, 4 for anything else."""
    return _CODE[np.frombuffer(seq, np.uint8)]


def runs(code: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal stretches of at least ``least`` bases."""
    good = np.concatenate(([0], (code < 4).astype(np.int8), [0]))
    edge = np.diff(good)
    return [(a, b) for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True) if b - a >= least]


def mix(x: np.ndarray, bases: int, seed: int) -> np.ndarray:
    m = U((1 << 2 * bases) - 1)
    x = (x + U(seed)) & m
    x = (~x + (x << U(21))) & m
    x ^= x >> U(24)
    x = (x + (x << U(3)) + (x << U(8))) & m
    x ^= x >> U(14)
    x = (x + (x << U(2)) + (x << U(4))) & m
    x ^= x >> U(28)
    return (x + (x << U(31))) & m


def hashes(code: np.ndarray, m: int, seed: int) -> np.ndarray:
    """Hashes of the canonical m-mers of a stretch of bases."""
    n = len(code) - m + 1
    forward, backward = np.zeros(n, U), np.zeros(n, U)
    for i in range(m):
        c = code[i : i + n].astype(U)
        forward = (forward << U(2)) | c
        backward |= (U(3) - c) << U(2 * i)
    return mix(np.minimum(forward, backward), m, seed)


def packed(code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The packed window of k bases at each place of a stretch, and that of its reverse complement, by doubling; what crosses other than bases is void."""
    if not 1 <= k <= 31:
        raise ValueError("a packed window has 1 to 31 bases")
    n = len(code)
    unit = (code & 3).astype(U)
    forward, backward, done = np.zeros(n, U), np.zeros(n, U), 0
    piece, mirror, size = unit, U(3) - unit, 1
    while True:
        if k & size:  # windows of ``done`` bases are followed by one of ``size``
            m = n - done - size + 1
            if m <= 0:
                return np.zeros(0, U), np.zeros(0, U)
            after, mirrored = piece[done : done + m], mirror[done : done + m]
            forward, backward = (forward[:m] << U(2 * size)) | after, backward[:m] | (mirrored << U(2 * done))
            done += size
        if done == k:
            return forward, backward
        m = len(piece) - size
        if m <= 0:
            return np.zeros(0, U), np.zeros(0, U)
        piece, mirror = (piece[:m] << U(2 * size)) | piece[size:], mirror[:m] | (mirror[size:] << U(2 * size))
        size *= 2


def letters(code: np.ndarray, k: int) -> np.ndarray:
    """Packed windows as rows of k letters."""
    shifts = U(2) * np.arange(k - 1, -1, -1, dtype=U)
    return np.frombuffer(b"ACGT", np.uint8)[((code.astype(U)[:, None] >> shifts) & U(3)).astype(np.uint8)]


def sliding(values: np.ndarray, w: int, f: np.ufunc, fill) -> np.ndarray:
    """Minimum or maximum of each w consecutive values, in linear time."""
    n = len(values)
    size = -(-n // w) * w
    blocks = np.concatenate((values, np.full(size - n, fill, values.dtype))).reshape(-1, w)
    left = f.accumulate(blocks, axis=1).ravel()
    right = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(right[: n - w + 1], left[w - 1 : n])


def minimizer_positions(seq: bytes, m: int, w: int, seed: int = 42) -> np.ndarray:
    """Every position with the smallest hash of some window of w m-mers, ties included; of a run too short for a window, its last smallest."""
    if not (1 <= m <= 31 and 1 <= w <= 256):
        raise ValueError("m is 1 to 31 and w 1 to 256")
    code, out = codes(seq), []
    for a, b in runs(code, m):
        h = hashes(code[a:b], m, seed)
        if len(h) < w:
            out.append([a + len(h) - 1 - int(np.argmin(h[::-1]))])
            continue
        least = sliding(h, w, np.minimum, ~U(0))
        around = np.concatenate((np.zeros(w - 1, U), least, np.zeros(w - 1, U)))
        out.append(a + np.flatnonzero(sliding(around, w, np.maximum, U(0))[: len(h)] == h))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def syncmer_positions(seq: bytes, k: int, s: int, seed: int = 42) -> np.ndarray:
    """k-mers whose smallest s-mer hash, ties included, is at their first or last offset: judged on each k-mer alone."""
    code, out = codes(seq), []
    for a, b in runs(code, k):
        h = hashes(code[a:b], s, seed)
        w = k - s + 1
        least = sliding(h, w, np.minimum, ~U(0))
        n = len(least)
        out.append(a + np.flatnonzero((h[:n] == least) | (h[w - 1 : w - 1 + n] == least)))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def syncmer_positions_streamed(seq: bytes, k: int, s: int, seed: int = 42) -> np.ndarray:
    """The same by a scan that remembers one smallest s-mer: of equal hashes a scan afresh prefers the newest, then the oldest; a newcomer replaces its equal."""
    code, out = codes(seq), []
    w = k - s + 1
    for a, b in runs(code, k):
        h = hashes(code[a:b], s, seed).tolist()
        best = -1
        for end in range(w - 1, len(h)):
            first = end - w + 1
            if best < first:
                best = end
                for j in range(first, end):
                    if h[j] < h[best]:
                        best = j
            elif h[end] <= h[best]:
                best = end
            if best == first or best == end:
                out.append(a + first)
    return np.array(out, np.int64)
