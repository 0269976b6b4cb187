"""Murmur3 hashes of strings and packed keys, vectorised over rows.

Spark has no such functions with a free seed, and 64-bit products wrap, which ANSI arithmetic refuses; so these run in
Arrow-batched functions over numpy. Strings of one length are hashed together, as the rows of a byte matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setweave.functions.kernels import letters

U = np.uint64
#: Fixed values of the algorithm.
C1_64, C2_64 = U(0x87C37B91114253D5), U(0x4CF5AD432745937F)
F1_64, F2_64 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)
C_86 = (0x239B961B, 0xAB0E9789, 0x38B34AE5, 0xA1E38B93)
N_86 = (0x561CCD1B, 0x0BCAA747, 0x96CD1C35, 0x32AC3B17)
C1_32, C2_32 = 0xCC9E2D51, 0x1B873593


def _rot64(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def _final64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * F1_64
    x = (x ^ (x >> U(33))) * F2_64
    return x ^ (x >> U(33))


def _words(rows: np.ndarray, size: int) -> np.ndarray:
    """Rows of bytes as little-endian words, the last filled with zeros."""
    n, length = rows.shape
    full = -(-max(length, 1) // size) * size
    padded = np.zeros((n, full), np.uint8)
    padded[:, :length] = rows
    return padded.view(f"<u{size}").astype(U)


def murmur_x64(rows: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Both 64-bit halves for each row of bytes."""
    n, length = rows.shape
    words = _words(rows, 8)
    a, b = np.full(n, seed, U), np.full(n, seed, U)
    blocks = length // 16
    for i in range(blocks):
        a ^= _rot64(words[:, 2 * i] * C1_64, 31) * C2_64
        a = (_rot64(a, 27) + b) * U(5) + U(0x52DCE729)
        b ^= _rot64(words[:, 2 * i + 1] * C2_64, 33) * C1_64
        b = (_rot64(b, 31) + a) * U(5) + U(0x38495AB5)
    rest = length - 16 * blocks
    if rest > 8:
        b ^= _rot64(words[:, 2 * blocks + 1] * C2_64, 33) * C1_64
    if rest:
        a ^= _rot64(words[:, 2 * blocks] * C1_64, 31) * C2_64
    a ^= U(length)
    b ^= U(length)
    a = a + b
    b = b + a
    a, b = _final64(a), _final64(b)
    a = a + b
    return a, b + a


_M = U(0xFFFFFFFF)


def _rot32(x: np.ndarray, r: int) -> np.ndarray:
    return ((x << U(r)) | (x >> U(32 - r))) & _M


def _final32(x: np.ndarray) -> np.ndarray:
    x = ((x ^ (x >> U(16))) * U(0x85EBCA6B)) & _M
    x = ((x ^ (x >> U(13))) * U(0xC2B2AE35)) & _M
    return x ^ (x >> U(16))


def murmur_x86(rows: np.ndarray, seed: int | np.ndarray) -> list[np.ndarray]:
    """The four 32-bit lanes, in unsigned 64-bit arrays, for each row of bytes; one seed, or one for each row."""
    n, length = rows.shape
    words = _words(rows, 4)
    h = [np.broadcast_to(np.asarray(seed, U), n).copy() for _ in range(4)]
    inner, outer, turn = (15, 16, 17, 18), (19, 17, 15, 13), (0, 1, 2, 3)
    blocks = length // 16
    for i in range(blocks):
        for lane in turn:
            k = (words[:, 4 * i + lane] * U(C_86[lane])) & _M
            h[lane] = h[lane] ^ ((_rot32(k, inner[lane]) * U(C_86[(lane + 1) % 4])) & _M)
            h[lane] = ((_rot32(h[lane], outer[lane]) + h[(lane + 1) % 4]) * U(5) + U(N_86[lane])) & _M
    rest = length - 16 * blocks
    for lane in turn:
        if rest > 4 * lane:
            k = (words[:, 4 * blocks + lane] * U(C_86[lane])) & _M
            h[lane] = h[lane] ^ ((_rot32(k, inner[lane]) * U(C_86[(lane + 1) % 4])) & _M)
    h = [x ^ U(length) for x in h]
    h[0] = (h[0] + h[1] + h[2] + h[3]) & _M
    h[1:] = [(x + h[0]) & _M for x in h[1:]]
    h = [_final32(x) for x in h]
    h[0] = (h[0] + h[1] + h[2] + h[3]) & _M
    h[1:] = [(x + h[0]) & _M for x in h[1:]]
    return h


def murmur_32(rows: np.ndarray, seed: int) -> np.ndarray:
    n, length = rows.shape
    words = _words(rows, 4)
    h = np.full(n, seed, U)
    for i in range(length // 4):
        h = h ^ ((_rot32((words[:, i] * U(C1_32)) & _M, 15) * U(C2_32)) & _M)
        h = (_rot32(h, 13) * U(5) + U(0xE6546B64)) & _M
    if length % 4:
        h = h ^ ((_rot32((words[:, length // 4] * U(C1_32)) & _M, 15) * U(C2_32)) & _M)
    return _final32(h ^ U(length))


def by_length(values: pa.Array, f: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], outputs: int, bases: int = 0) -> list[np.ndarray]:
    """Apply ``f``, on a matrix of bytes and the places of its rows, to the strings of each length; nulls count as empty."""
    if pa.types.is_integer(values.type):  # packed tokens of ``bases`` bases, hashed as their letters
        code = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U)
        return f(letters(code, bases), np.arange(len(code))) if len(code) else [np.zeros(0, U)] * outputs
    values = pa.concat_arrays([values.cast(pa.binary()).fill_null(b"")])
    n = len(values)
    out = [np.zeros(n, U) for _ in range(outputs)]
    if not n:
        return out
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int32, n + 1)[: n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    sizes = np.diff(at)
    for length in np.unique(sizes).tolist():
        some = np.flatnonzero(sizes == length)
        rows = raw[at[some][:, None] + np.arange(length)[None, :]] if length else np.zeros((len(some), 0), np.uint8)
        for target, result in zip(out, f(rows, some), strict=True):
            target[some] = result
    return out


def murmur128(token: Column, seed: int = 42, bases: int = 0) -> Column:
    """struct<lo, hi> of the x64 variant, as signed longs; of packed tokens with their number of bases."""

    @F.arrow_udf("struct<lo: bigint, hi: bigint>")
    def run(values: pa.Array) -> pa.Array:
        lo, hi = by_length(values, lambda rows, _: list(murmur_x64(rows, seed)), 2, bases)
        return pa.StructArray.from_arrays([pa.array(lo.view(np.int64)), pa.array(hi.view(np.int64))], names=["lo", "hi"])

    return run(token)


def murmur128_x86(token: Column, seed: int = 0, bases: int = 0) -> Column:
    """struct<lo, hi> of the x86 variant: lanes 1 and 2, and lanes 3 and 4, the second of each in the high half."""

    @F.arrow_udf("struct<lo: bigint, hi: bigint>")
    def run(values: pa.Array) -> pa.Array:
        a, b, c, d = by_length(values, lambda rows, _: murmur_x86(rows, seed), 4, bases)
        return pa.StructArray.from_arrays([pa.array((a | (b << U(32))).view(np.int64)), pa.array((c | (d << U(32))).view(np.int64))], names=["lo", "hi"])

    return run(token)


def murmur32(token: Column, seed: int = 0) -> Column:
    @F.arrow_udf("bigint")
    def run(values: pa.Array) -> pa.Array:
        return pa.array(by_length(values, lambda rows, _: [murmur_32(rows, seed)], 1)[0].astype(np.int64))

    return run(token)


def counted_hashes(counts: DataFrame, limit: int, by: tuple[str, ...] = (), bases: int = 0) -> DataFrame:
    """(by..., lo, hi) of counted tokens (by..., token, cnt): of their x86 hashes over the seeds 0 to cnt - 1 the ``limit`` smallest different, in unsigned order, of each group
    in each stretch of a batch. Packed tokens have ``bases`` bases."""
    names = [f"__{i}" for i in range(len(by))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.maximum(b.column("cnt").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), 0)
            upto = np.concatenate(([0], np.cumsum(n)))
            own = np.zeros(b.num_rows, np.int64)
            for c in names:
                coded = b.column(c).dictionary_encode("encode")
                own = own * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False)
            for at in range(0, int(upto[-1]), 1 << 18):  # all pairs of token and seed, some at a time
                place = np.arange(at, min(at + (1 << 18), int(upto[-1])))
                row = np.searchsorted(upto, place, side="right") - 1
                seed = (place - upto[row]).astype(U)
                h1, h2, h3, h4 = by_length(b.column("token").take(pa.array(row)), lambda r, some, seed=seed: murmur_x86(r, seed[some]), 4, bases)
                lo, hi = h1 | (h2 << U(32)), h3 | (h4 << U(32))
                group = own[row]
                order = np.lexsort((hi, lo, group))
                group, a, c = group[order], lo[order], hi[order]
                order = order[np.concatenate(([True], (group[1:] != group[:-1]) | (a[1:] != a[:-1]) | (c[1:] != c[:-1])))]
                group = own[row[order]]
                order = order[np.arange(len(order)) - np.searchsorted(group, group) < limit]
                take = pa.array(row[order])
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in names), pa.array(lo[order].view(np.int64)), pa.array(hi[order].view(np.int64))], names=[*names, "lo", "hi"])

    shape = T.StructType([*(T.StructField(n, counts.schema[c].dataType) for n, c in zip(names, by, strict=True)), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())])
    least = counts.select(*(F.col(c).alias(n) for c, n in zip(by, names, strict=True)), "token", "cnt").mapInArrow(run, shape)
    return least.select(*(F.col(n).alias(c) for c, n in zip(by, names, strict=True)), "lo", "hi")


def unsigned_modulo(h: Column, n: int) -> Column:
    """h mod n of a long read as unsigned, for 1 <= n < 2^31."""
    high, low = F.shiftrightunsigned(h, 1) % n, h.bitwiseAND(F.lit(1))
    return (2 * high + low) % n


def little_endian(h: Column, width: int = 8) -> Column:
    """The first ``width`` bytes of a long's little-endian image; as binary they sort bytewise."""
    bytes_ = [F.substring(F.unhex(F.lpad(F.hex(h), 16, "0")), 8 - i, 1) for i in range(width)]
    return F.concat(*bytes_)


def unsigned_order(h: Column) -> Column:
    """A long that sorts, signed, as ``h`` does unsigned."""
    return h.bitwiseXOR(F.lit(-(1 << 63)))
