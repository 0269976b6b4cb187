"""Substring dedup: remove words covered by a window of ``width`` words that also starts earlier in the corpus.

A suffix automaton is built over the passages of a reference shard, earliest first, and every document's passages are streamed
through it: after each word the automaton's state gives the longest match that ends there and where it first ended. A window whose
match is at least ``width`` words long and first ended earlier is a repeat.

The whole corpus is its own reference here, and automata of all its shards have no bounded size that could be broadcast. So a
shard is a set of passages around one anchor (see ``repeats``), each automaton is built in the task to which the
passages that may match it are sent, and no document meets an automaton in which it can't match. With ``reference_matches``, a
reference of checked size is broadcast instead.

Defined results: a null or empty text has no word; fewer words than a window lose nothing; of equal texts the one with the
smallest id stays whole; rows that repeat id and text count as one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setweave.llm.common import is_small, pieces, texts
from setweave.llm.repeats import U, Units, merged, without_repeats


class SuffixAutomaton:
    """Of several sequences, added one by one; each state knows where its strings first ended."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [(-1, -1)]

    def _state(self, length: int, first: tuple[int, int], follow: dict, link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.first.append(first)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, word, q: int) -> int:
        """A copy of q for strings as long as p's and the word."""
        clone = self._state(self.length[p] + 1, self.first[q], dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, number: int, words: Sequence) -> None:
        last = 0
        for end, word in enumerate(words):
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
                continue
            new = self._state(self.length[last] + 1, (number, end), {}, 0)
            p, last = last, new
            while p != -1 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p != -1:
                q = self.next[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)

    def statistics(self, words: Sequence, width: int) -> Iterator[tuple[int, tuple[int, int]]]:
        """After each word: the length of the longest match that ends there, and where its last ``width`` words (or all, if fewer) first ended."""
        state = matched = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                matched += 1
            place = state
            while self.link[place] != -1 and self.length[self.link[place]] >= width:
                place = self.link[place]
            yield matched, self.first[place]


def automaton_kernel(width: int):
    def kernel(sizes: list[int], left: np.ndarray, n: np.ndarray, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        members, firsts, lasts = [], [], []
        begin = 0
        for size in sizes:
            passages = [raw[begin + k].split(b" ") for k in range(size)]
            automaton = SuffixAutomaton()
            for k, words in enumerate(passages):
                automaton.add(k, words)
            for k in range(1, size):
                run = None
                for end, (matched, first) in enumerate(automaton.statistics(passages[k], width)):
                    if matched >= width and first < (k, end):
                        window = end - width + 1
                        if run is not None and lasts[run] == window - 1:
                            lasts[run] = window
                        else:
                            run = len(members)
                            members.append(begin + k), firsts.append(window), lasts.append(window)
            begin += size
        return np.array(members, np.int64), np.array(firsts, np.int64), np.array(lasts, np.int64)

    return kernel


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def split_words(text: pa.Array):
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, np.int32, len(text) + 1).astype(np.int64) if len(text) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8, at[-1]) if at[-1] else np.zeros(0, np.uint8)
    solid = ~_SPACE[raw]
    border = np.zeros(len(raw) + 1, bool)
    border[at] = True
    start = np.flatnonzero(solid & (border[:-1] | ~np.concatenate(([False], solid[:-1])))) if len(raw) else np.zeros(0, np.int64)
    upto = np.concatenate(([0], np.cumsum(solid)))
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(np.concatenate((upto[start], upto[-1:])).astype(np.int32)), pa.py_buffer(raw[solid])).dictionary_encode()
    hashed = np.array([xxhash.xxh64_intdigest(w, 7) for w in words.dictionary.cast(pa.binary()).to_pylist()], U)
    units = hashed[words.indices.to_numpy(zero_copy_only=False)] if len(start) else np.zeros(0, U)
    first = np.searchsorted(start, at)
    current: dict[int, list[bytes]] = {}

    def text_of(row: int, i: int, n: int) -> bytes:
        if row not in current:
            current.clear()
            current[row] = raw[at[row] : at[row + 1]].tobytes().split()
        return b" ".join(current[row][i : i + n])

    return units, first, text_of


def keep_words(raw: bytes, spans: np.ndarray) -> tuple[bytes, int]:
    words = raw.split()
    cuts = [0, *spans.ravel().tolist(), len(words)]
    return b" ".join([w for a, b in zip(cuts[::2], cuts[1::2], strict=True) for w in words[a:b]]), len(words)


def without_repeated_passages(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, spans, kept): words of each text, removed spans [start, end) of words and the words that stay, joined by spaces."""
    return without_repeats(docs, Units(width, max(1, 2 * width // 5), split_words, automaton_kernel(width), keep_words), id_col, text_col)


def reference_matches(docs: DataFrame, reference: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = 200, max_rows: int = 20_000) -> DataFrame:
    """(id, spans): the maximal spans of words of each document that match a reference of at most ``max_rows`` texts in ``width`` words or more.

    The reference is cut into shards of ``shard_rows`` texts, whose automata are built on the executors from the broadcast texts.
    """
    if not is_small(reference, max_rows):
        raise ValueError("the reference is too large to broadcast: put it among the documents and use without_repeated_passages")
    known = docs.sparkSession.sparkContext.broadcast([(r[0] or "").encode().split() for r in reference.select(F.col(text_col).cast("string")).collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = []
        for at in range(0, len(known.value), shard_rows):
            shards.append(SuffixAutomaton())
            for k, words in enumerate(known.value[at : at + shard_rows]):
                shards[-1].add(k, words)
        for b in pieces(batches, "text"):
            found = []
            for raw in texts(b.column("text")).cast(pa.binary()).to_pylist():
                words = raw.split()
                hits = [(end - matched + 1, end + 1) for s in shards for end, (matched, _) in enumerate(s.statistics(words, width)) if matched >= width]
                found.append(merged(*np.array(hits).T).tolist() if hits else [])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, pa.list_(pa.list_(pa.int64())))], names=["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` AS id", f"cast(`{text_col}` AS string) AS text").mapInArrow(run, f"id {kind}, spans array<array<bigint>>")
