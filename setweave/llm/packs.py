"""Tables of packs: record batches of documents, each a compressed row, and the parts of an exchange that belong to them.

Where documents have to meet what other tasks found out about them, moving them one by one costs more than the work itself. A pack is about
``PACK`` bytes of text in one row; a row of it is named by the pack's number and its place in there, so rows that repeat an id, a text or both are
still told apart. Packs are written once, before anything refers to them.

Parts are rows (kind, target, source, payload), a payload being arrays of numbers, one row for each sender and receiver: an exchange costs bytes and not rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.llm.common import pieces, save

PACK = 4 << 20
#: Bytes of text whose share of an exchange one task holds.
SHARE = 64 << 20
#: The kind of a pack among its parts, which come before it.
BODY = 9
ROW = "kind int, target long, source long, payload binary"


def written(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read(body: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(body) as r:
        return r.read_next_batch()


def packed(docs: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, text: str = "text", name: str = "packs") -> DataFrame:
    """(pack, size, body): the rows of ``docs``, or what ``make`` makes of each batch of them, and the bytes of text in them; written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 31
        for b in pieces(batches, text, PACK):
            size = pc.sum(pc.binary_length(b.column(text))).as_py() or 0
            body = written(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in b.columns], names=b.schema.names) if make is None else make(b))
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([size], pa.int64()), pa.array([body], pa.binary())], names=["pack", "size", "body"])
            number += 1

    return save(docs.mapInArrow(run, "pack long, size long, body binary"), name)


def n_parts(spark: SparkSession, packs: DataFrame) -> int:
    """Into how many parts to deal what an exchange over these packs holds: as many as keep a part's share bounded, whatever their size."""
    size = packs.agg(F.sum("size")).first()[0] or 0
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / SHARE))


def together(packs: DataFrame, parts: DataFrame, n: int) -> DataFrame:
    """The packs among their parts, a pack's parts in one task before it."""
    bodies = packs.select(F.lit(BODY).alias("kind"), F.col("pack").alias("target"), F.col("pack").alias("source"), F.col("body").alias("payload"))
    mixed = F.shiftright("target", 31) * 1_000_003 + F.col("target").bitwiseAND(F.lit((1 << 31) - 1))
    return parts.select("kind", "target", "source", "payload").union(bodies).repartitionById(n, F.pmod(mixed, F.lit(n)).cast("int")).sortWithinPartitions("target", "kind")


def with_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, list[tuple[int, int, bytes]]]]:
    """Of rows in the order of ``together``: each pack's number, body and parts (kind, source, payload)."""
    held: list[tuple[int, int, bytes]] = []
    for b in batches:
        kinds, targets, sources, payloads = (b.column(c) for c in ("kind", "target", "source", "payload"))
        for i in range(b.num_rows):
            kind, payload = kinds[i].as_py(), payloads[i].as_py()
            if kind == BODY:
                yield targets[i].as_py(), payload, held
                held = []
            else:
                held.append((kind, sources[i].as_py(), payload))


def dealt_to(parts: DataFrame, n: int) -> DataFrame:
    """Parts whose target is a number below n, each target's in one task."""
    return parts.repartitionById(n, F.col("target").cast("int"))


def _written(values: np.ndarray, kind: str) -> bytes:
    size = int(kind[-1])
    if size in (1, 2, 4, 8):
        return np.asarray(values).astype(kind).tobytes()
    return np.asarray(values).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _read(raw: bytes, kind: str, n: int, at: int) -> np.ndarray:
    size = int(kind[-1])
    if size in (1, 2, 4, 8):
        return np.frombuffer(raw, kind, n, at)
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8, n * size, at).reshape(n, size)
    return out.view("<u8").ravel()


def held_as(kind: str) -> str:
    """The type in which numpy holds a column; one with an odd number of bytes is written shorter than it is held."""
    return kind if int(kind[-1]) in (1, 2, 4, 8) else "<u8"


def pack(columns: dict[str, np.ndarray], kinds: tuple, blobs: list[bytes] | None = None) -> bytes:
    """Columns of numbers as (name, type) in ``kinds``, and the texts that come with their rows, compressed."""
    n = len(columns[kinds[0][0]])
    tail = [] if blobs is None else [zstandard.ZstdCompressor(level=1).compress(b"".join(blobs))]
    return b"".join([n.to_bytes(8, "little"), *(_written(columns[c], t) for c, t in kinds), *tail])


def unpack(raw: bytes, kinds: tuple, blobs: bool = False) -> tuple[dict[str, np.ndarray], bytes]:
    n, at, out = int.from_bytes(raw[:8], "little"), 8, {}
    for c, t in kinds:
        out[c] = _read(raw, t, n, at)
        at += n * int(t[-1])
    return out, zstandard.ZstdDecompressor().decompress(raw[at:]) if blobs else b""


def joined(parts: list[dict[str, np.ndarray]], kinds: tuple) -> dict[str, np.ndarray]:
    return {c: np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, held_as(t)) for c, t in kinds}


def dealt(kind: int, source: int, target: np.ndarray, columns: dict[str, np.ndarray], kinds: tuple, blobs: list[bytes] | None = None) -> list[tuple[int, int, int, bytes]]:
    """Rows (kind, target, source, payload), one for each target that gets anything; each keeps the order of its rows."""
    if not len(target):
        return []
    order = np.argsort(target, kind="stable")
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(target[order])) + 1, [len(order)]))
    return [
        (kind, int(target[order[a]]), source, pack({c: columns[c][order[a:b]] for c, _ in kinds}, kinds, None if blobs is None else [blobs[i] for i in order[a:b].tolist()]))
        for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)
    ]


def rows_of(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["kind", "target", "source", "payload"])
