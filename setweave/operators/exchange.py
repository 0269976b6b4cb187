"""Exchanges of packed tokens as sorted, compressed arrays: equal tokens of all batches meet, at one to three bytes each instead of a row each.

A batch's tokens are mixed by an odd factor, which spreads them evenly and can be undone, sorted, made distinct with what belongs to each of
them, cut into cells by their highest bits, and sent as one row for each cell. What is received is merged a cell at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setweave.functions.kernels import codes, packed
from setweave.functions.session import checkpointed

U, U8 = np.uint64, np.uint8
FACTOR = 0x9E3779B97F4A7C15
BACK = pow(FACTOR, -1, 1 << 64)
#: Bases of a stretch and of a batch; tokens that a cell gathers before it merges them.
STRETCH, BATCH, GATHERED = 1 << 21, 1 << 22, 1 << 22
ROW = "cell int, source long, data binary"


def mixed(token: np.ndarray, bits: int) -> np.ndarray:
    return (token * U(FACTOR)) & U((1 << bits) - 1)


def unmixed(x: np.ndarray, bits: int) -> np.ndarray:
    return (x * U(BACK)) & U((1 << bits) - 1)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def cell_bits(df: DataFrame) -> int:
    """Bits of a token that name its cell: at least four cells for each partition of a shuffle."""
    return (4 * partitions(df) - 1).bit_length()


def folded(x: np.ndarray, values: list[np.ndarray], how: np.ufunc) -> tuple[np.ndarray, list[np.ndarray]]:
    """The different x, ascending, with the values of each folded by ``how``."""
    if not len(x):
        return x, values
    order = np.argsort(x)
    x = x[order]
    first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    return x[first], [how.reduceat(v[order], first) for v in values]


def _planes(v: np.ndarray) -> bytes:
    """Bytes of equal weight together, without those that are zero everywhere."""
    size = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
    return bytes([size]) + np.ascontiguousarray(v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _unplaned(raw: memoryview, at: int, n: int) -> tuple[np.ndarray, int]:
    size = raw[at]
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8, size * n, at + 1).reshape(size, n).T
    return out.reshape(-1).view("<u8").astype(U, copy=False), at + 1 + size * n


def written(arrays: list[np.ndarray]) -> bytes:
    raw = b"".join(_planes(a) for a in arrays)
    return len(raw).to_bytes(8, "little") + len(arrays[0]).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def read(data: bytes, count: int) -> list[np.ndarray]:
    size, n = int.from_bytes(data[:8], "little"), int.from_bytes(data[8:16], "little")
    raw, at, out = memoryview(pa.Codec("zstd").decompress(data[16:], size, asbytes=True)), 0, []
    for _ in range(count):
        a, at = _unplaned(raw, at, n)
        out.append(a)
    return out


def cut(x: np.ndarray, values: list[np.ndarray], bits: int, fine: int) -> Iterator[tuple[int, bytes]]:
    """(cell, data) of sorted different x; a cell is named by the ``fine`` highest bits."""
    cell = (x >> U(max(0, bits - fine))).astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(x) else np.zeros(0, np.int64)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(x)], strict=False):
        own = x[a:b].copy()
        own[1:] -= x[a : b - 1]
        yield int(cell[a]), written([own, *(v[a:b] for v in values)])


def rows_of(cells: Iterator[tuple[int, bytes]], source: int) -> pa.RecordBatch:
    found = list(cells)
    return pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int32()), pa.array([source] * len(found), pa.int64()), pa.array([d for _, d in found], pa.binary())], names=["cell", "source", "data"])


def slices(batches: Iterator[pa.RecordBatch], most: int = BATCH, column: str = "__seq") -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``most`` bytes of ``column``, a longer row by itself."""
    held, size = [], 0
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        begin = 0
        while begin < b.num_rows:
            n = max(0 if held else 1, int(np.cumsum(sizes[begin:]).searchsorted(most - size, side="right")))
            if n:
                held.append(b.slice(begin, n))
                size += int(sizes[begin : begin + n].sum())
                begin += n
            if begin < b.num_rows or size >= most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def windows_of(raws: list[bytes], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, pos, token) of all windows of k bases, in order, in stretches of bounded size."""
    whole = codes(b"\n".join(raws))
    ends = np.cumsum([len(r) + 1 for r in raws])
    for begin in range(0, len(whole) - k + 1, STRETCH):
        code = whole[begin : begin + STRETCH + k - 1]
        bad = np.concatenate(([0], np.cumsum(code > 3)))
        at = np.flatnonzero(bad[k:] == bad[: len(bad) - k])
        token = packed(code, k)[0][at]
        at += begin
        row = np.searchsorted(ends, at, side="right")
        yield row, at - np.where(row > 0, ends[row - 1], 0), token


def sent(rows: DataFrame, make: Callable[[pa.RecordBatch], tuple[np.ndarray, list[np.ndarray]]], bits: int, how: np.ufunc) -> DataFrame:
    """(cell, source, data) of rows with a text ``__seq``; ``make`` gives the tokens of a batch and their values."""

    fine = cell_bits(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            token, values = make(b)
            yield rows_of(cut(*folded(mixed(token, bits), values, how), bits, fine), 0)

    return rows.mapInArrow(run, ROW)


def dealt(parts: DataFrame) -> DataFrame:
    """The parts of a cell together, cells in order."""
    return parts.repartition(partitions(parts), "cell").sortWithinPartitions("cell")


def merged(batches: Iterator[pa.RecordBatch], count: int, bits: int, how: np.ufunc) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(token, values) of each cell of ``dealt`` rows, every token once."""
    now, held, size = None, [], 0

    def together() -> tuple[np.ndarray, list[np.ndarray]]:
        return folded(np.concatenate([h[0] for h in held]), [np.concatenate([h[i + 1] for h in held]) for i in range(count)], how)

    for b in batches:
        for cell, data in zip(b.column("cell").to_pylist(), b.column("data").to_pylist(), strict=True):
            if cell != now and held:
                x, values = together()
                yield unmixed(x, bits), values
                held, size = [], 0
            elif size > GATHERED:
                x, values = together()
                held, size = [[x, *values]], 0
            now = cell
            x, *values = read(data, count + 1)
            held.append([np.cumsum(x, dtype=U), *values])
            size += len(x)
    if held:
        x, values = together()
        yield unmixed(x, bits), values


def side_counts(rows: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(token, ci, cj) of rows with flags ``in_i`` and ``in_j``: how often each k-mer of up to 31 bases is in each side, each k-mer once."""

    def make(b: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
        flags = [b.column(c).fill_null(False).to_numpy(zero_copy_only=False).astype(U) for c in ("in_i", "in_j")]
        found = list(windows_of(b.column("__seq").cast(pa.binary()).fill_null(b"").to_pylist(), k))
        row = np.concatenate([r for r, _, _ in found]) if found else np.zeros(0, np.int64)
        return np.concatenate([t for _, _, t in found]) if found else np.zeros(0, U), [f[row] for f in flags]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, values in merged(batches, 2, 2 * k, np.add):
            yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)) for v in (token, *values)], names=["token", "ci", "cj"])

    return dealt(sent(rows.select("in_i", "in_j", F.col(seq).alias("__seq")), make, 2 * k, np.add)).mapInArrow(run, "token long, ci long, cj long")


def marks(rows: DataFrame, k: int, finders: list[Callable[[bytes], np.ndarray]], seq: str = "seq") -> DataFrame:
    """(token, mask) of rows with flags ``in_i`` and ``in_j``: each k-mer of up to 31 bases once. Bits 0 and 1 of the mask tell in which sides it is, and the next two, for each
    finder of positions of k-mers in a sequence, in which sides it is at one of them."""

    def make(b: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
        flags = sum(b.column(c).fill_null(False).to_numpy(zero_copy_only=False).astype(np.uint8) << i for i, c in enumerate(("in_i", "in_j")))
        raws = b.column("__seq").cast(pa.binary()).fill_null(b"").to_pylist()
        at = np.cumsum([0, *(len(r) + 1 for r in raws)])
        chosen = np.zeros((len(finders), int(at[-1])), bool)
        for i, find in enumerate(finders):  # lines are broken as by any other letter than a base
            chosen[i, find(b"\n".join(raws))] = True
        tokens, masks = [], []
        for row, pos, token in windows_of(raws, k):
            place, own = at[row] + pos, flags[row]
            tokens.append(token)
            masks.append(sum(((own * c[place]) << U8(2 * i + 2) for i, c in enumerate(chosen)), own))
        return (np.concatenate(tokens), [np.concatenate(masks)]) if tokens else (np.zeros(0, U), [np.zeros(0, np.uint8)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, (mask,) in merged(batches, 1, 2 * k, np.bitwise_or):
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(mask.astype(np.int32))], names=["token", "mask"])

    return dealt(sent(rows.select("in_i", "in_j", F.col(seq).alias("__seq")), make, 2 * k, np.bitwise_or)).mapInArrow(run, "token long, mask int")


def covered(rows: DataFrame, k: int, g: int, find: Callable[[bytes], np.ndarray], seq: str = "seq") -> DataFrame:
    """(token, mask) of rows with flags ``in_i`` and ``in_j``: each k-mer once. Bits 0 and 1 of the mask tell in which sides it is, bits 2 and 3 in which sides' own extended
    tokens: those of k + g letters, up to 27, at the positions that ``find`` gives and at both ends of a sequence, which are in one side only."""
    size, fine = k + g, cell_bits(rows)
    bits = (5**size - 1).bit_length()

    def flags_of(b: pa.RecordBatch) -> np.ndarray:
        return sum(b.column(c).fill_null(False).to_numpy(zero_copy_only=False).astype(np.uint8) << i for i, c in enumerate(("in_i", "in_j")))

    def extended(b: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
        raws = b.column("__seq").cast(pa.binary()).fill_null(b"").to_pylist()
        whole = b"\n".join(raws)
        length = np.array([len(r) for r in raws], np.int64)
        start = np.concatenate(([0], np.cumsum(length + 1)))
        at = find(whole)
        row = np.searchsorted(start, at, side="right") - 1
        inside = at - start[row] + size < length[row]
        long = np.flatnonzero(length >= size)
        at = np.concatenate((at[inside], start[long], start[long] + length[long] - size))
        row = np.concatenate((row[inside], long, long))
        code, token = codes(whole), np.zeros(len(at), U)
        for i in range(size):
            token = token * U(5) + code[at + i].astype(U)
        return token, [flags_of(b)[row]]

    def exact(b: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
        found = list(windows_of(b.column("__seq").cast(pa.binary()).fill_null(b"").to_pylist(), k))
        return (np.concatenate([t for _, _, t in found]), [flags_of(b)[np.concatenate([r for r, _, _ in found])]]) if found else (np.zeros(0, U), [np.zeros(0, np.uint8)])

    def inner(token: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The k-mers in extended tokens, and of which token each is."""
        letters = np.zeros((size, len(token)), np.uint8)
        for i in range(size - 1, -1, -1):
            letters[i] = (token % U(5)).astype(np.uint8)
            token = token // U(5)
        out, of = [], []
        for a in range(g + 1):
            good = np.flatnonzero((letters[a : a + k] < 4).all(axis=0))
            x = np.zeros(len(good), U)
            for i in range(a, a + k):
                x = (x << U(2)) | letters[i][good].astype(U)
            out.append(x)
            of.append(good)
        return out, of

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, masks, n = [], [], 0

        def together() -> pa.RecordBatch:
            return rows_of(cut(*folded(mixed(np.concatenate(held), 2 * k), [np.concatenate(masks)], np.bitwise_or), 2 * k, fine), 0)

        for token, (mask,) in merged(batches, 1, bits, np.bitwise_or):
            one = (mask == 1) | (mask == 2)
            found, of = inner(token[one])
            held += found
            masks += [mask[one][o].astype(np.uint8) << U8(2) for o in of]
            n += sum(map(len, found))
            if n > BATCH:
                yield together()
                held, masks, n = [], [], 0
        if n:
            yield together()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, (mask,) in merged(batches, 1, 2 * k, np.bitwise_or):
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(mask.astype(np.int32))], names=["token", "mask"])

    own = rows.select("in_i", "in_j", F.col(seq).alias("__seq"))
    held = dealt(sent(own, extended, bits, np.bitwise_or)).mapInArrow(unpacked, ROW)
    return dealt(sent(own, exact, 2 * k, np.bitwise_or).unionByName(held)).mapInArrow(run, "token long, mask int")


def own_counters(reads: DataFrame, k: int, key: str, seq: str = "seq") -> DataFrame:
    """(key, counters): for each window of a read, in order, how often it is in all reads; 0 for one with other than bases. A row for each read with a window.

    Reads are written in batches. The different k-mers of a batch go out once, and their counts come back to the batch, which has them in the same order.
    """
    bits, fine = 2 * k, cell_bits(reads)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = TaskContext.get().partitionId() << 31
        for b in slices(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(b)
            yield rows_of(iter([(-1, sink.getvalue().to_pybytes())]), source)
            source += 1

    def unpack(body: bytes) -> pa.RecordBatch:
        with pa.ipc.open_stream(body) as r:
            return r.read_next_batch()

    def all_windows(b: pa.RecordBatch) -> tuple[list[bytes], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        raws = b.column("__seq").cast(pa.binary()).fill_null(b"").to_pylist()
        return raws, list(windows_of(raws, k))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source, body in zip(b.column("source").to_pylist(), b.column("data").to_pylist(), strict=True):
                _, found = all_windows(unpack(body))
                x, n = np.unique(mixed(np.concatenate([t for _, _, t in found]), bits), return_counts=True) if found else (np.zeros(0, U), np.zeros(0, np.int64))
                yield rows_of(cut(x, [n], bits, fine), source)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def told() -> Iterator[pa.RecordBatch]:
            # Only what a cell was sent is held, compressed; it is read once to be added up, and once to be answered.
            x, n = np.zeros(0, U), [np.zeros(0, U)]
            some, size = [], 0
            for i, (_, data) in enumerate(held):
                d, c = read(data, 2)
                some.append((np.cumsum(d, dtype=U), c))
                size += len(d)
                if size > GATHERED or i + 1 == len(held):
                    x, n = folded(np.concatenate([x, *(s[0] for s in some)]), [np.concatenate([n[0], *(s[1] for s in some)])], np.add)
                    some, size = [], 0
            for source, data in held:
                own = np.cumsum(read(data, 1)[0], dtype=U)
                yield rows_of(iter([(now, written([n[0][np.searchsorted(x, own)]]))]), source)

        for b in batches:
            for cell, source, data in zip(*(b.column(c).to_pylist() for c in ("cell", "source", "data")), strict=True):
                if cell != now and held:
                    yield from told()
                    held = []
                now = cell
                held.append((source, data))
        if held:
            yield from told()

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        body, own, replies = None, None, []

        def counted() -> Iterator[pa.RecordBatch]:
            batch = unpack(body)
            raws, found = all_windows(batch)
            size = np.maximum(np.array([len(r) for r in raws], np.int64) - k + 1, 0)
            start = np.concatenate(([0], np.cumsum(size)))
            out = np.zeros(int(start[-1]), np.int64)
            if replies:
                n = np.concatenate([read(r, 1)[0] for r in replies]).astype(np.int64)
                _, place = np.unique(mixed(np.concatenate([t for _, _, t in found]), bits), return_inverse=True)
                out[np.concatenate([start[r] + p for r, p, _ in found])] = n[place]
            some = np.flatnonzero(size)
            yield pa.RecordBatch.from_arrays([batch.column("__key").take(pa.array(some)), pa.ListArray.from_arrays(pa.array(np.append(start[some], start[-1]), pa.int32()), pa.array(out))], names=["__key", "counters"])

        for b in batches:
            for cell, source, data in zip(*(b.column(c).to_pylist() for c in ("cell", "source", "data")), strict=True):
                if cell < 0:
                    if body is not None:
                        yield from counted()
                    body, own, replies = data, source, []
                else:
                    assert source == own
                    replies.append(data)
        if body is not None:
            yield from counted()

    packs = checkpointed(reads.select(F.col(key).alias("__key"), F.col(seq).alias("__seq")).mapInArrow(pack, ROW))
    answers = dealt(packs.mapInArrow(ask, ROW)).mapInArrow(answer, ROW)
    back = answers.unionByName(packs).repartition(partitions(reads), "source").sortWithinPartitions("source", "cell")
    kind = reads.schema[key].dataType.simpleString()
    return back.mapInArrow(give, f"__key {kind}, counters array<bigint>").withColumnRenamed("__key", key)
