"""Quality rules as a short-circuit cascade.

A document is kept if no rule rejects it. Rules are run one after another on what the ones before have
left, so the order matters for cost only, never for the verdict. Each rule is first timed, and its rejections
are counted, on a random sample (about ``SAMPLE`` documents); rules run in descending order of the share rejected per
second. All rules work on whole record batches, by array arithmetic over the bytes of the texts.

Defined results: a null or empty text has no word, so all counts are 0 and the base rule rejects it; a
very long text makes a batch of its own; repeated rows are judged alike; an empty table gives an empty
result. Lines are what newlines part; words are what ASCII white space parts.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setweave.llm.common import pieces, texts

SAMPLE = 1000
SYMBOLS = b"#*$%&|<>"
BULLETS = ("-", "*", "•", "●", "▪")

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
#: Letters: ASCII ones and all characters beyond ASCII.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Batch:
    """Texts with what the rules need of them, each found when first asked for."""

    def __init__(self, column: pa.Array):
        self.text = texts(column)
        self.n = len(self.text)
        _, offsets, data = self.text.buffers()
        self.at = np.frombuffer(offsets, np.int32, self.n + 1).astype(np.int64) if self.n else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8, self.at[-1]) if data is not None and self.at[-1] else np.zeros(0, np.uint8)
        self._known: dict[str, object] = {}

    def get(self, name: str):
        if name not in self._known:
            self._known[name] = getattr(self, f"_{name}")()
        return self._known[name]

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        upto = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return upto[self.at[1:]] - upto[self.at[:-1]]

    def _space(self):
        return _SPACE[self.data]

    def _starts(self):
        """Flags of bytes at which a word begins."""
        space = self.get("space")
        first = np.zeros(len(space) + 1, bool)
        first[self.at] = True
        return ~space & (np.concatenate(([True], space[:-1])) | first[:-1]) if len(space) else space

    def _n_words(self):
        return self.per_text(self.get("starts"))

    def _word_chars(self):
        return self.per_text(((self.data & 0xC0) != 0x80) & ~self.get("space"))

    def _n_symbols(self):
        return self.per_text(_SYMBOL[self.data])

    def _words(self):
        """The words of all texts as one array, and the text each is in."""
        starts = np.flatnonzero(self.get("starts"))
        solid = ~self.get("space")
        at = np.concatenate((np.concatenate(([0], np.cumsum(solid)))[starts], [solid.sum()])).astype(np.int32)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(self.data[solid]))
        return words, np.searchsorted(self.at, starts, side="right") - 1

    def _codes(self):
        words, doc = self.get("words")
        coded = words.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary), doc

    def _lines(self):
        """Lines as codes, the text of each, and which codes have a word."""
        lists = pc.split_pattern(self.text, "\n")
        coded = lists.flatten().dictionary_encode()
        doc = np.repeat(np.arange(self.n), np.diff(lists.offsets.to_numpy()))
        worded = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(coded.dictionary)), 0).to_numpy(zero_copy_only=False)
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), doc, worded.astype(bool), coded.dictionary

    def _n_lines(self):
        codes, doc, worded, _ = self.get("lines")
        return np.bincount(doc[worded[codes]], minlength=self.n)

    def _n_dup_lines(self):
        codes, doc, worded, _ = self.get("lines")
        keep = worded[codes]
        different = np.unique(doc[keep] * len(worded) + codes[keep])
        return self.get("n_lines") - np.bincount(different // max(1, len(worded)), minlength=self.n)

    def _n_bullets(self):
        codes, doc, worded, values = self.get("lines")
        trimmed = pc.ascii_ltrim_whitespace(values)
        marked = np.logical_or.reduce([pc.starts_with(trimmed, b).to_numpy(zero_copy_only=False) for b in BULLETS]).astype(bool) & worded
        return np.bincount(doc[marked[codes]], minlength=self.n)

    def _n_letter_words(self):
        starts = np.flatnonzero(self.get("starts"))
        letters = np.concatenate(([0], np.cumsum(_LETTER[self.data], dtype=np.int64)))
        ends = np.concatenate((starts[1:], [len(self.data)]))
        doc = np.searchsorted(self.at, starts, side="right") - 1
        return np.bincount(doc[letters[np.minimum(ends, self.at[doc + 1])] > letters[starts]], minlength=self.n)

    def _repeats(self):
        """Flags of windows of three words, by their first word, that occur twice or more in their text."""
        codes, n, doc = self.get("codes")
        flags = np.zeros(len(codes), bool)
        if len(codes) < 3:
            return flags
        first = np.flatnonzero(doc[:-2] == doc[2:])
        a, b, c, d = codes[first], codes[first + 1], codes[first + 2], doc[first]
        mix = np.uint64
        with np.errstate(over="ignore"):
            h = a.astype(mix) * mix(0x9E3779B97F4A7C15)
            for x in (b, c, d):
                h = (h ^ (h >> mix(29)) ^ x.astype(mix)) * mix(0xBF58476D1CE4E5B9)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        maybe = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        if len(maybe):  # equal hashes are only a hint: the windows themselves decide
            _, pair = np.unique(a[maybe] * n + b[maybe], return_inverse=True)
            _, three = np.unique(pair * n + c[maybe], return_inverse=True)
            _, at, counts = np.unique(three * self.n + d[maybe], return_inverse=True, return_counts=True)
            flags[first[maybe[counts[at] > 1]]] = True
        return flags

    def _n_repeat_words(self):
        flags = self.get("repeats")
        doc = self.get("words")[1]
        if not len(flags):
            return np.zeros(self.n, np.int64)
        covered = flags.copy()
        covered[1:] |= flags[:-1]
        covered[2:] |= flags[:-2]
        return np.bincount(doc[covered], minlength=self.n)

    def _base_failed(self):
        n = self.get("n_words")
        return (n < 50) | (100 * self.get("n_repeat_words") > 50 * n)


def _ratio(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    return top / np.maximum(bottom, 1)


#: Each says which texts it rejects.
RULES: dict[str, Callable[[Batch], np.ndarray]] = {
    "base": lambda b: b.get("base_failed"),
    "word_length": lambda b: (m := _ratio(b.get("word_chars"), b.get("n_words"))) * 0 + ((m < 2) | (m > 15)) > 0,
    "symbols": lambda b: b.get("n_symbols") > 0.1 * b.get("n_words"),
    "duplicate_lines": lambda b: b.get("n_dup_lines") > 0.3 * b.get("n_lines"),
    "letter_words": lambda b: b.get("n_letter_words") < 0.7 * b.get("n_words"),
    "bullets": lambda b: b.get("n_bullets") > 0.9 * b.get("n_lines"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def order_rules(sample: pa.Array, rules: dict[str, Callable] = RULES) -> list[str]:
    """Rules by descending share rejected per second on the sample."""
    worth = {}
    for name, rule in rules.items():
        batch = Batch(sample)
        began = time.perf_counter()
        rejected = int(rule(batch).sum())
        worth[name] = rejected / max(1, batch.n) / max(time.perf_counter() - began, 1e-6)
    return sorted(rules, key=lambda name: -worth[name])


def cascade(column: pa.Array, order: list[str], rules: dict[str, Callable] = RULES) -> np.ndarray:
    """Which texts are kept; a rule sees only what the rules before it have left."""
    alive = np.arange(len(column))
    for name in order:
        if not len(alive):
            break
        alive = alive[~rules[name](Batch(column.take(pa.array(alive)) if len(alive) < len(column) else column))]
    kept = np.zeros(len(column), bool)
    kept[alive] = True
    return kept


def _order(docs: DataFrame, text_col: str) -> list[str]:
    """The rules in the order that a random sample of about ``SAMPLE`` documents, from all parts of the table, suggests."""
    share = min(1.0, SAMPLE / max(1, docs.count()))
    return order_rules(docs.select(F.col(text_col).cast("string").alias("text")).sample(share, seed=42).toArrow().column(0).combine_chunks())


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, the five counts, ``base_failed`` and ``kept``."""
    order = _order(docs, text_col)
    rest = [name for name in order if name != "base"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            whole = Batch(b.column("text"))
            failed = whole.get("base_failed")
            kept = ~failed
            open_rows = np.flatnonzero(kept)  # the base rule's counts are wanted for every row, so it comes first here
            if len(open_rows):
                kept[open_rows] = cascade(whole.text.take(pa.array(open_rows)), rest)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), *(pa.array(whole.get(m).astype(np.int64)) for m in MEASURES), pa.array(failed), pa.array(kept)], names=names
            )

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(m, T.LongType()) for m in MEASURES), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])
    names = schema.names
    return docs.selectExpr(f"`{id_col}` AS id", f"cast(`{text_col}` AS string) AS text").mapInArrow(run, schema)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that no rule rejects, with all their columns."""
    order = _order(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text_col):
            yield b.filter(pa.array(cascade(texts(b.column(text_col)), order)))

    return docs.mapInArrow(run, docs.schema)
