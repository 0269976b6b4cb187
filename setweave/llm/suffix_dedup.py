"""Suffix-array dedup: remove bytes covered by a string of ``width`` bytes that also starts earlier in the corpus.

Contexts of equal anchors (see ``repeats``) are sorted twice, by what follows the anchor and by what precedes it, read
backwards. The sort is a merge sort of all groups side by side. Two suffixes are compared by a binary search for the length of
their common extension, each step one comparison of prefix polynomial hashes, so a comparison takes the logarithm of the
length. The common extensions of neighbours in the finished order are then verified byte by byte; on a collision of hashes the
group is sorted by its bytes. In sorted order the strings that agree in n bytes are a run, so a window is named by a pair
of runs, one to the right of its anchor and one to the left, and repeats if an earlier window has the same pair.

Defined results: a null text counts as empty; a text shorter than ``width`` bytes loses nothing; of equal texts the one with the
smallest id stays whole; rows that repeat id and text count as one; an empty table gives an empty result.
"""

from __future__ import annotations

from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from setweave.llm.repeats import U, Units, mix, prefix_hashes, run_hashes, without_repeats

SYMBOL = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


def suffix_sort(data: np.ndarray, start: np.ndarray, length: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings data[start : start + length] within consecutive groups, and each one's common extension with the one before (-1 for the first)."""
    n = len(start)
    prefix = prefix_hashes(SYMBOL[data])
    padded = np.concatenate((data, np.zeros(1, np.uint8)))

    def common(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(i), np.int64), np.minimum(length[i], length[j])
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_] + 1) >> 1
            same = run_hashes(prefix, start[i[open_]], mid) == run_hashes(prefix, start[j[open_]], mid)
            low[open_] = np.where(same, mid, low[open_])
            high[open_] = np.where(same, high[open_], mid - 1)
        return low

    def compare(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        at = common(i, j)
        over = (at == length[i]) | (at == length[j])
        return np.where(over, length[i] - length[j], padded[np.where(over, 0, start[i] + at)].astype(np.int64) - padded[np.where(over, 0, start[j] + at)])

    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    size, place = np.repeat(sizes, sizes), np.arange(n) - begin
    order, run = np.arange(n), 1
    while run < sizes.max(initial=0):
        pair, side = place // (2 * run) * (2 * run), (place // run) & 1
        other = begin + pair + np.where(side == 0, run, 0)
        other_size = np.where(side == 0, np.clip(size - pair - run, 0, run), run)
        active = np.flatnonzero(other_size > 0)
        low, high = np.zeros(len(active), np.int64), other_size[active]
        while (open_ := np.flatnonzero(low < high)).size:
            rows = active[open_]
            mid = (low[open_] + high[open_]) >> 1
            c = compare(order[other[rows] + mid], order[rows])
            before = (c < 0) | ((c == 0) & (side[rows] == 1))
            low[open_] = np.where(before, mid + 1, low[open_])
            high[open_] = np.where(before, high[open_], mid)
        rank = np.zeros(n, np.int64)
        rank[active] = low
        merged = np.empty(n, np.int64)
        merged[begin + pair + (place - pair - side * run) + rank] = order
        order, run = merged, 2 * run

    lcp = np.full(n, -1, np.int64)
    later = np.flatnonzero(place > 0)
    lcp[later] = common(order[later - 1], order[later])
    k = lcp[later]
    step = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    a, b = (np.repeat(start[order[x]], k) + step for x in (later - 1, later))
    wrong = np.unique(np.repeat(begin[later], k)[data[a] != data[b]])
    raw = data.tobytes() if len(wrong) else b""
    for g in wrong.tolist():  # hashes collided
        texts = {i: raw[start[i] : start[i] + length[i]] for i in range(g, g + int(size[g]))}
        own = sorted(texts, key=texts.__getitem__)
        order[g : g + len(own)] = own
        lcp[g + 1 : g + len(own)] = [len(commonprefix([texts[x], texts[y]])) for x, y in zip(own, own[1:], strict=False)]
    return order, lcp


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of set flags."""
    edge = np.zeros((len(flags), 1), np.int8)
    change = np.diff(np.concatenate((edge, flags.astype(np.int8), edge), axis=1), axis=1)
    row, first = np.nonzero(change == 1)
    return row, first, np.nonzero(change == -1)[1] - 1


def window_kernel(width: int):
    def kernel(sizes: list[int], left: np.ndarray, n: np.ndarray, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        group, m = np.array(sizes), len(left)
        data = np.frombuffer(b"".join(raw), np.uint8)
        size = np.fromiter(map(len, raw), np.int64, m)
        at = np.cumsum(size) - size
        order, after = suffix_sort(data, at + left, size - left, group)
        rank = np.empty(m, np.int64)
        rank[order] = np.arange(m)
        order, before = suffix_sort(data[::-1], len(data) - at - left, left, group)
        rank_before = np.empty(m, np.int64)
        rank_before[order] = np.arange(m)
        flags, here = np.zeros((m, int(n.max())), bool), np.arange(m)
        for r in range(int(left.max()) + 1):  # windows that begin r bytes before their anchor
            some = np.flatnonzero((left >= r) & (left - n < r))
            if len(some) < 2:
                continue
            run = np.maximum.accumulate(np.where(after < width - r, here, 0))[rank[some]]
            run_before = np.maximum.accumulate(np.where(before < r, here, 0))[rank_before[some]]
            key = run * m + run_before
            by = np.argsort(key, kind="stable")  # members are in order of age
            later = some[by[1:][key[by[1:]] == key[by[:-1]]]]
            flags[later, left[later] - r] = True
        return runs_of(flags)

    return kernel


def split_bytes(text: pa.Array):
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, np.int32, len(text) + 1).astype(np.int64) if len(text) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8, at[-1]) if at[-1] else np.zeros(0, np.uint8)
    return SYMBOL[raw], at, lambda row, i, n: raw[at[row] + i : at[row] + i + n].tobytes()


def keep_bytes(raw: bytes, spans: np.ndarray) -> tuple[bytes, int]:
    if not len(spans):
        return raw, len(raw)
    cuts = [0, *spans.ravel().tolist(), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)), len(raw)


def without_repeated_strings(docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, spans, kept): bytes of each text, removed spans [start, end) and the bytes that stay."""
    return without_repeats(docs, Units(width, max(1, width // 3), split_bytes, window_kernel(width), keep_bytes), id_col, text_col)
