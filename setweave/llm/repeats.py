"""Windows of a document that also start earlier in the corpus: the skeleton of both passage removers.

Units are bytes or words; a window is ``width`` consecutive units of one document. Earlier means a smaller id, or the
same document and an earlier start; rows of one id, null ids among them, which come first, follow each other in the order of a hash of their texts. Which
windows repeat is judged on the input.

1. Documents are written in packs (see ``packs``). Each window has an anchor: the run of ``gram`` units in it with the smallest hash, the leftmost of
   equals. Equal windows have equal anchors at the same offset, and neighbouring windows mostly share theirs, so there are far
   fewer anchors than units. Anchors meet by hash; one whose hash occurs twice is flagged.
2. The flags go back to their packs, which send each flagged anchor's context: the units that
   its windows cover. Equal contexts of one pack are sent once, the others being repeats of it.
3. Contexts of equal anchors meet, and a kernel finds the windows that repeat an earlier one, from the units themselves.
4. The repeats go back to their packs, whose covered units are removed.

An anchor that occurs more often than ``HOT`` times, and than an eighth of a part's share, is not brought together. Its contexts fall apart into
single windows, which are spread over all parts by their own hashes; and of one window that is itself in very many packs, the kernel first looks at
``SALTS`` groups of packs apart, whose earliest occurrences alone go on. So a part gets a bounded number of texts of any one window, and none
counts as equal before its units were compared. Long documents are read in overlapping stretches.

Rows that repeat both id and text are documents of their own, of which the first stays whole.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setweave.llm.common import remove, save, texts
from setweave.llm.packs import ROW, dealt, dealt_to, held_as, joined, n_parts, pack, packed, read, rows_of, together, unpack, with_parts

HOT = 2000
SALTS = 64
STRETCH = 1 << 20
_NULL = -(1 << 63)

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64, for i < n at least."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        inverse = U(pow(int(BASE), -1, 1 << 64))
        for name, b in (("up", BASE), ("down", inverse)):
            steps = np.full(size, b, U)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=U)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_hashes(units: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes, modulo 2^64."""
    up, _ = powers(len(units) + 1)
    return np.concatenate((np.zeros(1, U), np.cumsum(units * up[: len(units)], dtype=U)))


def run_hashes(prefix: np.ndarray, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Hashes of runs of units, which don't depend on where a run stands."""
    _, down = powers(len(prefix))
    return (prefix[start + length] - prefix[start]) * down[start]


def anchors(units: np.ndarray, ends: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of units in stretches with these ends (for each unit): hash, place, first window and number of windows of each anchor."""
    n = len(units)
    if n < width:
        return (np.zeros(0, U), *(np.zeros(0, np.int64),) * 3)
    at = np.arange(n - gram + 1)
    h = mix(run_hashes(prefix_hashes(units), at, gram))
    low = U((1 << 24) - 1)
    packed = (h & ~low) | at.astype(U)
    w = width - gram + 1
    size = -(-len(packed) // w) * w
    blocks = np.concatenate((packed, np.full(size - len(packed), ~U(0)))).reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - width + 1
    least = np.minimum(right[:starts], left[w - 1 : w - 1 + starts])
    p = np.flatnonzero(np.arange(starts) + width <= ends[:starts])
    if not len(p):
        return (np.zeros(0, U), *(np.zeros(0, np.int64),) * 3)
    a = (least[p] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1))))
    return h[a[new]] >> U(24), a[new], p[new], np.diff(np.concatenate((new, [len(p)])))


#: What parts hold of rows of a pack. A hash of 40 bits is enough to meet by: the units themselves decide. ``times`` is how often the pack has an anchor; on
#: the way back, 1 marks one that is hot.
ANCHOR = (("h", "<u5"), ("row", "<u4"), ("a", "<u4"), ("left", "<u1"), ("n", "<u1"), ("times", "<u2"))
#: ``th``, of a text's hash, only orders texts of one id.
CONTEXT = (("h", "<u5"), ("id", "<i8"), ("th", "<u4"), ("row", "<u4"), ("p", "<u4"), ("left", "<u1"), ("n", "<u1"), ("size", "<u4"))
SPAN = (("row", "<u4"), ("start", "<u4"), ("end", "<u4"))
LOW = U((1 << 40) - 1)


@dataclass
class Units:
    """What a window is made of."""

    width: int
    gram: int
    #: Texts -> hashes of units, where each text's units begin, and a function giving raw texts of (text, unit, n units).
    split: Callable[[pa.Array], tuple[np.ndarray, np.ndarray, Callable[[int, int, int], bytes]]]
    #: Contexts in groups of equal anchors, earliest first, as (sizes of groups, units before the anchor, windows, raw contexts) ->
    #: runs of windows that repeat an earlier one, as (context, first window, last window).
    kernel: Callable[[list[int], np.ndarray, np.ndarray, list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]
    #: (raw text, spans) -> what is kept, and the number of units.
    keep: Callable[[bytes, np.ndarray], tuple[bytes, int]]


def _stretches(at: np.ndarray, width: int) -> Iterator[tuple[list[tuple[int, int, int]], int]]:
    """Parts (text, from, to) of about STRETCH units together; stretches of one text overlap by width - 1 units."""
    held, size = [], 0
    for k in range(len(at) - 1):
        n, begin = int(at[k + 1] - at[k]), 0
        while n - begin >= width:
            end = min(n, begin + STRETCH)
            held.append((k, begin, end))
            size += end - begin
            if size >= STRETCH:
                yield held, size
                held, size = [], 0
            if end == n:
                break
            begin = end - width + 1
    if held:
        yield held, size


def _find_anchors(units: Units, n: int):
    """Of each pack, its anchors: each hash once to its part (kind 0), with how often it is here, and those whose hash is here twice to the pack itself (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, body in zip(b.column("pack").to_pylist(), b.column("body"), strict=True):
                out = _anchors_of(number, read(body.as_py()), units, n)
                if out:
                    yield rows_of(out)

    return run


def _anchors_of(number: int, b: pa.RecordBatch, units: Units, n: int) -> list:
    found: list[dict[str, np.ndarray]] = []
    hashes, at, _ = units.split(texts(b.column("text")))
    for parts, _n in _stretches(at, units.width):
        whole = np.concatenate([hashes[at[k] + i : at[k] + j] for k, i, j in parts])
        sizes = np.array([j - i for _, i, j in parts])
        upto = np.cumsum(sizes)
        h, a, p, many = anchors(whole, np.repeat(upto, sizes), units.width, units.gram)
        if not len(h):
            continue
        part = np.searchsorted(upto, p, side="right")
        row = np.array([k for k, _, _ in parts])[part]
        shift = np.array([i for _, i, _ in parts])[part] - (upto - sizes)[part]
        found.append({"h": h, "row": row, "a": a + shift, "left": a - p, "n": many, "times": np.zeros(len(h), np.int64)})
    x = joined(found, ANCHOR)
    if not len(x["h"]):
        return []
    order = np.argsort(x["h"], kind="stable")
    h = x["h"][order]
    first = np.concatenate(([True], h[1:] != h[:-1]))
    times = np.diff(np.concatenate((np.flatnonzero(first), [len(h)])))
    x["times"][order] = np.repeat(np.minimum(times, (1 << 16) - 1), times)
    one = {c: v[order[first]] for c, v in x.items()}
    some = x["times"] > 1
    again = {c: v[some] for c, v in x.items()} | {"times": np.zeros(int(some.sum()), np.int64)}
    return dealt(0, number, (one["h"] % U(n)).astype(np.int64), one, ANCHOR) + dealt(1, number, np.full(len(again["h"]), number), again, ANCHOR)


def _flag(hot: int):
    """Of anchors of one part of the hashes, those whose hash more than one pack has, or which is hot, for their packs (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, sources = [], []
        for b in batches:
            for source, raw in zip(b.column("source").to_pylist(), b.column("payload").to_pylist(), strict=True):
                parts.append(unpack(raw, ANCHOR)[0])
                sources.append(np.full(len(parts[-1]["h"]), source))
        x = joined(parts, ANCHOR)
        if not len(x["h"]):
            return
        order = np.argsort(x["h"], kind="stable")
        h = x["h"][order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        sizes = np.diff(np.concatenate((first, [len(h)])))
        often = np.add.reduceat(x["times"][order].astype(np.int64), first) > hot
        some = order[np.repeat((sizes > 1) | often, sizes)]
        x["times"] = np.zeros(len(h), np.int64)
        x["times"][order] = np.repeat(often, sizes)
        out = dealt(1, -1, np.concatenate(sources)[some], {c: v[some] for c, v in x.items()}, ANCHOR)
        if out:
            yield rows_of(out)

    return run


def _send_contexts(units: Units, n: int):
    """Of packs with their flags: contexts (kind 0), single windows of hot anchors (3), and spans known here (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, body, parts in with_parts(batches):
            if parts:
                out = _contexts_of(number, read(body), units, n, joined([unpack(raw, ANCHOR)[0] for _, _, raw in parts], ANCHOR))
                if out:
                    yield rows_of(out)

    return run


def _contexts_of(number: int, b: pa.RecordBatch, units: Units, n: int, x: dict[str, np.ndarray]) -> list:
    hot = np.unique(x["h"][x["times"] > 0])
    # An anchor near the border of two stretches has windows in both: repeats have the same first window, too.
    order = np.lexsort((-x["left"].astype(np.int64), x["a"], x["row"]))
    x = {c: v[order] for c, v in x.items()}
    new = np.ones(len(order), bool)
    new[1:] = (x["row"][1:] != x["row"][:-1]) | (x["a"][1:] != x["a"][:-1]) | (x["left"][1:] != x["left"][:-1])
    x = {c: v[new] for c, v in x.items()}
    x["times"] = np.isin(x["h"], hot)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(x["row"])) + 1, [len(x["row"])])).tolist()
    flagged = {int(x["row"][i]): (i, j) for i, j in zip(cuts, cuts[1:], strict=False)}
    ids, ths = b.column("ord").to_pylist(), b.column("th").to_pylist()
    rows = sorted(flagged, key=lambda k: (ids[k], ths[k], k))
    _, _, text_of = units.split(texts(b.column("text").take(pa.array(rows))))
    seen: set[tuple[int, int, bytes]] = set()
    out: dict[int, tuple[dict[str, list], list[bytes]]] = {kind: ({c: [] for c, _ in CONTEXT}, []) for kind in (0, 3)}
    spans = {c: [] for c, _ in SPAN}
    for place, k in enumerate(rows):
        i, j = flagged[k]
        for h, a, left, many, single in zip(*(x[c][i:j].tolist() for c in ("h", "a", "left", "n", "times")), strict=True):
            p = a - left
            todo = [(p, left, many, text_of(place, p, many - 1 + units.width))]
            while todo:
                at, before, wide, context = todo.pop()
                if (before, wide, context) in seen:
                    spans["row"].append(k), spans["start"].append(at), spans["end"].append(at + wide - 1 + units.width)
                    continue
                seen.add((before, wide, context))
                if single and wide > 1:
                    todo = [(p + d, left - d, 1, text_of(place, p + d, units.width)) for d in range(many)]
                    continue
                columns, blobs = out[3 if single else 0]
                name = xxhash.xxh64_intdigest(context, before) & int(LOW) if single else h
                for c, v in zip(columns, (name, ids[k], ths[k], k, at, before, wide, len(context)), strict=True):
                    columns[c].append(v)
                blobs.append(context)
    sent = []
    for kind, (columns, blobs) in out.items():
        columns = {c: np.array(columns[c], held_as(t)) for c, t in CONTEXT}
        salt = 0 if kind == 0 else xxhash.xxh64_intdigest(number.to_bytes(8, "little")) % SALTS
        sent += dealt(kind, number, ((mix(columns["h"]) + mix(np.array([salt], U))) % U(n)).astype(np.int64), columns, CONTEXT, blobs)
    spans = {c: np.array(spans[c], held_as(t)) for c, t in SPAN}
    return sent + dealt(2, -1, np.full(len(spans["row"]), number), spans, SPAN)


def _compare(units: Units, n: int, salted: bool):
    """Of contexts of one part of the hashes: spans of windows that repeat an earlier one, for their packs (kind 2); if ``salted``, also the contexts that are not wholly repeats (kind 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, blobs, sources = [], [], []
        for b in batches:
            for source, raw in zip(b.column("source").to_pylist(), b.column("payload").to_pylist(), strict=True):
                columns, blob = unpack(raw, CONTEXT, blobs=True)
                # Survivors of the salted round come from many packs, which are named behind their texts.
                if source < 0:
                    sources.append(np.frombuffer(blob, "<i8", len(columns["h"]), len(blob) - 8 * len(columns["h"])))
                else:
                    sources.append(np.full(len(columns["h"]), source))
                parts.append(columns)
                at = np.concatenate(([0], np.cumsum(columns["size"], dtype=np.int64))).tolist()
                blobs += [blob[i:j] for i, j in zip(at, at[1:], strict=False)]
        x = joined(parts, CONTEXT)
        if not len(x["h"]):
            return
        source = np.concatenate(sources)
        order = np.lexsort((x["p"] + x["left"], x["row"], source, x["th"], x["id"], x["h"]))
        h = x["h"][order]
        cuts = np.concatenate(([0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]))
        spans: list[dict[str, np.ndarray]] = []
        owners: list[np.ndarray] = []
        repeated = np.zeros(len(h), bool)
        groups, held = [], 0

        def solve() -> None:
            rows = np.concatenate(groups)
            member, first, last = units.kernel([len(g) for g in groups], x["left"][rows].astype(np.int64), x["n"][rows].astype(np.int64), [blobs[i] for i in rows.tolist()])
            if len(member):
                i = rows[member]
                spans.append({"row": x["row"][i], "start": x["p"][i] + first, "end": x["p"][i] + last + units.width})
                owners.append(source[i])
                repeated[i[(first == 0) & (last + 1 == x["n"][i])]] = True

        for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            if b - a < 2:
                continue
            groups.append(order[a:b])
            held += b - a
            if held >= 10_000:
                solve()
                groups, held = [], 0
        if groups:
            solve()
        s = joined(spans, SPAN)
        out = dealt(2, -1, np.concatenate(owners) if owners else np.zeros(0, np.int64), s, SPAN)
        if salted:
            on = np.flatnonzero(~repeated)
            target = mix(x["h"][on]) % U(n)
            by = np.argsort(target, kind="stable")
            on, target = on[by], target[by]
            for t in np.unique(target).tolist():
                some = on[target == U(t)]
                tail = [*(blobs[i] for i in some.tolist()), source[some].astype("<i8").tobytes()]
                out.append((0, int(t), -1, pack({c: v[some] for c, v in x.items()}, CONTEXT, tail)))
        if out:
            yield rows_of(out)

    return run


def merged(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Spans that overlap or touch as one; rows (start, end)."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], start[1:] > end[:-1]))
    at = np.flatnonzero(new)
    return np.stack((start[at], end[np.concatenate((at[1:], [len(end)])) - 1]), axis=1)


def _cut(units: Units, names: list[str]):
    none = np.zeros((0, 2), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, body, parts in with_parts(batches):
            s = joined([unpack(raw, SPAN)[0] for _, _, raw in parts], SPAN)
            s = {c: v.astype(np.int64) for c, v in s.items()}
            order = np.argsort(s["row"], kind="stable")
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(s["row"][order])) + 1, [len(order)])).tolist()
            known = {int(s["row"][order[i]]): merged(s["start"][order[i:j]], s["end"][order[i:j]]) for i, j in zip(cuts, cuts[1:], strict=False) if j > i}
            whole = read(body)
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                raws = texts(b.column("text")).cast(pa.binary()).to_pylist()
                spans = [known.get(at + k, none) for k in range(len(raws))]
                kept = [units.keep(raw, s) for raw, s in zip(raws, spans, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), pa.array([k for _, k in kept], pa.int64()), pa.array([s.tolist() for s in spans], pa.list_(pa.list_(pa.int64()))), pa.array([k for k, _ in kept], pa.binary())],
                    names=names,
                )

    return run


def _free(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def without_repeats(docs: DataFrame, units: Units, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, spans, kept): units of each document, removed spans of units [start, end), and what is left, as UTF-8."""
    if not 1 <= units.gram <= units.width <= 255:
        raise ValueError("a window has 1 to 255 units")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL)).alias("ord"), F.xxhash64(text).bitwiseAND(F.lit((1 << 32) - 1)).alias("th"), text.alias("text"))
    packs = packed(rows)
    n = n_parts(spark, packs)

    found = save(packs.select("pack", "body").mapInArrow(_find_anchors(units, n), ROW), "anchors")
    bytes_met = found.filter("kind = 0").agg(F.sum(F.octet_length("payload"))).first()[0] or 0
    hot = max(HOT, bytes_met // sum(int(t[-1]) for _, t in ANCHOR) // (8 * n))
    flags = save(found.filter("kind = 1").union(dealt_to(found.filter("kind = 0"), n).mapInArrow(_flag(hot), ROW)), "flags")
    remove(spark, found)
    del found
    _free(spark)

    sent = save(together(packs, flags, n).mapInArrow(_send_contexts(units, n), ROW), "contexts")
    remove(spark, flags)
    del flags
    _free(spark)

    first = save(dealt_to(sent.filter("kind = 3"), n).mapInArrow(_compare(units, n, True), ROW), "hot-windows")
    rest = dealt_to(sent.filter("kind = 0").union(first.filter("kind = 0")), n).mapInArrow(_compare(units, n, False), ROW)
    spans = save(sent.filter("kind = 2").union(first.filter("kind = 2")).union(rest), "spans")
    remove(spark, sent, first)
    del sent, first, rest
    _free(spark)

    shape = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept", T.BinaryType())])
    return together(packs, spans, n).mapInArrow(_cut(units, shape.names), shape)
